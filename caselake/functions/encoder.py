"""The port for text encoders: texts in Arrow batches to vectors, with one encoder for each worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions of the hashing encoder, and components that a token has.
DIM, COMPONENTS = 64, 4
TOKEN = re.compile(r"[0-9a-zA-Zа-яёА-ЯЁ]+(?:[-_./][0-9a-zA-Zа-яёА-ЯЁ]+)*")


class HashingEncoder:
    """Signed feature hashing: deterministic and not semantic, for tests and as a model of the port. Entries are small whole
    numbers, so they are exact as floats; searches bring vectors to unit length."""

    def __init__(self, dim: int = DIM, limit: int = 200_000) -> None:
        self.dim, self.limit = dim, limit
        self.place: dict[str, int] = {}
        self.at, self.sign = np.zeros((limit, COMPONENTS), dtype=np.int64), np.zeros((limit, COMPONENTS))

    def token(self, token: str) -> int:
        """Where a token's components stand; a table that is full begins anew."""
        place = self.place[token] = len(self.place)
        d = hashlib.md5(token.lower().encode()).digest()
        self.at[place] = [d[2 * j] % self.dim for j in range(COMPONENTS)]
        self.sign[place] = [1 - 2 * (d[2 * j + 1] % 2) for j in range(COMPONENTS)]
        return place

    def vector(self, tokens: list[str]) -> np.ndarray:
        """The sum of the tokens' components, exact in doubles."""
        out = np.zeros(self.dim)
        for first in range(0, len(tokens), self.limit):
            some = tokens[first : first + self.limit]
            if len(self.place) + len(some) > self.limit:
                self.place.clear()
            known = self.place.get
            places = [p if (p := known(t)) is not None else self.token(t) for t in some]
            out += np.bincount(self.at[places].ravel(), weights=self.sign[places].ravel(), minlength=self.dim)
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            if tokens := TOKEN.findall(text):
                row[:] = self.vector(tokens)
        return out


def encode(text: Column | str, factory: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEncoder, batch: int = 256) -> Column:
    """The text's vector. ``factory`` makes the encoder once for all batches of a task, where a model would be loaded; it gets
    ``batch`` texts at a time, nulls as empty."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in columns:
            known = texts.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(known), batch) for v in encoder(known[at : at + batch])], dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>").asNondeterministic()(text)  # so that a filter of vectors doesn't encode all texts once more
