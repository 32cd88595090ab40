"""Russian token normalisation over vocabularies, and cleaning of extracted page text.

Stemming has no built-in expression: distinct tokens are stemmed once in Arrow batches and joined back, so the work
follows the vocabulary, not the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings by word class, in the order of the source list, each once. The Latin "ah" and "ete" stand there and never match.
VOWELS = "аеиоуыэюя"
GERUND_1 = ("вшись", "вши", "вшийся", "в")
GERUND_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = ("ыми", "ими", "его", "ому", "ему", "ого", "ых", "их", "ый", "ой", "ий", "ая", "яя", "ое", "ее", "ые", "ие", "ым", "им", "ом", "ем", "ую", "юю", "ей", "ah")
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ешь", "ete", "йте", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н")
VERB_2 = ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ит", "ыт", "им", "ым", "ен", "ил", "ыл", "ыв", "ив")
NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ах", "ях", "ам", "ям", "ов", "ей", "ий", "ие", "ия", "ию", "ью", "ом", "ем", "ых", "ой", "ые", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
DERIVATIONAL = ("ост", "ость")
SUPERLATIVE = ("ейше", "ейш")


def _ending(words: tuple[str, ...], after: bool = False) -> re.Pattern:
    return re.compile(("(?<=[ая])" if after else "") + "(?:" + "|".join(words) + ")$")


G1, G2, ADJ, P1, P2 = _ending(GERUND_1, True), _ending(GERUND_2), _ending(ADJECTIVE), _ending(PARTICIPLE_1, True), _ending(PARTICIPLE_2)
REFL, V1, V2, N, DER, SUP = _ending(REFLEXIVE), _ending(VERB_1, True), _ending(VERB_2), _ending(NOUN), _ending(DERIVATIONAL), _ending(SUPERLATIVE)
FIRST_VOWEL = re.compile(f"[{VOWELS}]")
VOWEL_THEN_OTHER = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _cut(word: str, start: int, *endings: re.Pattern) -> str | None:
    """The word without the longest ending of the first class that has one from ``start`` on; a search finds the longest."""
    for e in endings:
        if m := e.search(word, start):
            return word[: m.start()]
    return None


def _second_region(word: str) -> int:
    first = VOWEL_THEN_OTHER.search(word)
    second = VOWEL_THEN_OTHER.search(word, first.end()) if first else None
    return second.end() if second else len(word)


def stem(word: str) -> str:
    """Stem of a lower-case Russian word; words without vowels stay."""
    vowel = FIRST_VOWEL.search(word)
    if not vowel:
        return word
    rv = vowel.end()
    cut = _cut(word, rv, G2, G1)
    if cut is None:
        word = _cut(word, rv, REFL) or word
        adjective = _cut(word, rv, ADJ)
        if adjective is not None:
            cut = _cut(adjective, rv, P2, P1) or adjective
        else:
            cut = _cut(word, rv, V2, V1, N)
    word = word if cut is None else cut
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    word = _cut(word, _second_region(word), DER) or word
    if word.endswith(("нн", "ь")):
        return word[:-1]
    shorter = _cut(word, rv, SUP)
    return word if shorter is None else shorter[:-1] if shorter.endswith("нн") else shorter


def normalise(token: str) -> str:
    """Abbreviations are lowered, Russian words stemmed, compounds by part, all else lowered."""
    low = token.lower().replace("ё", "е")
    if re.fullmatch("[А-ЯЁ]{1,6}", token):
        return low
    return "".join(stem(p) if re.fullmatch("[а-я]+", p) else p for p in re.split(r"([-_./])", low))


def _mapped(fn: Callable[[str], str], c: Column | str) -> Column:
    """fn over a column in Arrow batches; nulls stay."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def nfkc(c: Column | str) -> Column:
    """NFKC form (F1)."""
    return _mapped(lambda x: unicodedata.normalize("NFKC", x), c)


def vocabulary(rows: DataFrame, token: str) -> DataFrame:
    """Distinct tokens with their normal form."""
    return rows.select(token).where(F.col(token).isNotNull()).distinct().withColumn("normal", _mapped(normalise, F.col(token)))


def joins_on(above: str, line: str) -> bool:
    """Whether a line goes on where the one above broke off."""
    ended = re.search(r"[.:;!?»)]$", above)
    opens = re.match(r"[-–—•*]|\d+[.)]\s|[А-ЯЁ]{4,}", line)
    return bool(above) and not ended and not opens and len(above) < 200


def clean(text: str) -> str:
    """NFKC, soft hyphens out, wrapped lines joined, blank runs collapsed."""
    flat = unicodedata.normalize("NFKC", text).replace("­", "").replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    for line in map(str.strip, flat.split("\n")):
        if line and out and joins_on(out[-1], line):
            out[-1] = f"{out[-1]} {line}"
        elif line or (out and out[-1]):
            out.append(line)
    return re.sub(r"[ \t]{2,}", " ", "\n".join(out)).strip()


def clean_text(c: Column | str) -> Column:
    """clean() of a column; null as empty."""
    return _mapped(clean, F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def normal_tokens(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, position, token, normal: by way of the vocabulary."""
    each = rows.select(key, F.posexplode(tokens).alias("position", "token"))
    return each.join(vocabulary(each, "token"), "token").select(key, "position", "token", "normal")
