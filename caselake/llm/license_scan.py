"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

1. Whole texts are scored by TF-IDF cosine in three kinds of units: single lines, header blocks (up to WINDOW
   neighbouring runs of lines without a blank line) and whole files. Every unit meets every template: the short
   statements, the headers and SPDX tags, and the full texts beside this module. Weights come from the templates
   alone, those of the short ones apart from those of the long ones; words that no template has weigh as the rarest
   and count in the norm. The best template of a file's best unit is its own licence if the cosine reaches THRESHOLD.
   A unit is left out only if the weight of its known words already bounds its cosine below THRESHOLD.
2. A file that opens with such a unit is a licence file of its directory. Directories (not files) are expanded into
   their ancestors and joined to licensed ones; the deepest wins. Files without an own licence take it.

Only the templates, a fixed table, go to all tasks; texts aren't shuffled. The full texts of CC-BY-4.0 and CC-BY-NC-4.0
are derived from that of CC-BY-SA-4.0. Defined cases: null and empty texts have no own licence; null
source or lang stand as ``_`` in a path; ties go to the template, then the path, that is first in order; rows that
repeat an id are files of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files as resource_files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import table

THRESHOLD = 0.6
#: Neighbouring blocks that a header may have.
WINDOW = 4
TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
# Short statements of common licences by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use permitted under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
}


def template_weights(templates: dict[str, str] = TEMPLATES) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(template, token, unit weight) rows, idf by token, idf of a token that no template has."""
    counts = {name: Counter(re.findall(TOKEN, text.lower())) for name, text in templates.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf, math.log(1 + len(templates)) + 1


GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {no} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see https://www.gnu.org/licenses/."
CC = "This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/{tag}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
#: Headers of source files by SPDX name.
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": CC.format(name="Attribution", tag="by"),
    "CC-BY-NC-4.0": CC.format(name="Attribution-NonCommercial", tag="by-nc"),
    "CC-BY-SA-4.0": CC.format(name="Attribution-ShareAlike", tag="by-sa"),
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "GPL-2.0": GNU.format(what="program", name="General Public License", no=2),
    "GPL-3.0": GNU.format(what="program", name="General Public License", no=3),
    "LGPL-2.1": GNU.format(what="library", name="Lesser General Public License", no=2.1),
    "LGPL-3.0": GNU.format(what="library", name="Lesser General Public License", no=3),
    "MIT": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
}


def long_templates() -> dict[str, str]:
    """License|kind -> text: headers, SPDX tags and full texts."""
    full = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in resource_files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")}
    paragraphs = re.split(r"\n\s*\n", full["CC-BY-SA-4.0"])
    by = "\n\n".join(re.sub("(?i)-?ShareAlike", "", x) for x in paragraphs if not re.search("BY-SA|ShareAlike\\.|Adapter's License", x))
    full["CC-BY-4.0"] = by
    said = "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. for NonCommercial purposes only; and produce, reproduce, and Share Adapted Material for NonCommercial purposes only. including when the Licensed Material is used other than for NonCommercial purposes."
    full["CC-BY-NC-4.0"] = re.sub("(?i)(Attribution)(?= 4.0)", r"\1-NonCommercial", by) + "\n" + said
    tags = {f"{n}|spdx": f"SPDX-License-Identifier: {n}" for n in sorted(set(full) | set(HEADERS) - {"Proprietary"})}
    return {f"{n}|header": x for n, x in HEADERS.items()} | tags | {f"{n}|full": full[n] for n in sorted(full)}


class Scorer:
    """Cosines of token lists with all templates of one set."""

    def __init__(self, templates: dict[str, str]) -> None:
        rows, self.idf, self.unknown = template_weights(templates)
        self.names = [name.partition("|")[0] for name in templates]
        place = {name: i for i, name in enumerate(templates)}
        self.at = {t: i for i, t in enumerate(self.idf)}
        self.weights = np.zeros((len(self.at), len(self.names)))
        for name, t, w in rows:
            self.weights[self.at[t], place[name]] = w

    def best(self, counts: Counter, threshold: float) -> tuple[float, str] | None:
        """(-score, license) of the best template, if its score reaches the threshold."""
        known = [t for t in counts if t in self.idf]
        if not known:
            return None
        w = np.array([counts[t] * self.idf[t] for t in known])
        in_all = float(w @ w)
        total = in_all + self.unknown**2 * (sum([n * n for n in counts.values()]) - sum([counts[t] ** 2 for t in known]))
        if in_all < (threshold - 1e-6) ** 2 * total:  # the dot product with a unit vector is at most the known weights' length
            return None
        scores = np.round(w @ self.weights[[self.at[t] for t in known]] / math.sqrt(total), 6)
        top = scores.max()
        return (-float(top), min(n for n, s in zip(self.names, scores, strict=True) if s == top)) if top >= threshold else None


def units(text: str) -> Iterator[tuple[bool, list[str]]]:
    """(opens the file, tokens) of each line, each window of neighbouring blocks, and the whole file; each extent once."""
    token, blocks, lines = re.compile(TOKEN), [], 0
    inside = False
    for line in text.lower().split("\n"):
        if not line.strip():
            inside = False
            continue
        said = token.findall(line)
        yield lines == 0, said
        if not inside:
            blocks.append([])
        blocks[-1].append(said)
        inside, lines = True, lines + 1
    joined = [[t for said in b for t in said] for b in blocks]
    for i in range(len(blocks)):
        window = list(joined[i])
        if len(blocks[i]) > 1:
            yield i == 0, window
        for other in joined[i + 1 : i + WINDOW]:
            window = window + other
            yield i == 0, window
    if len(blocks) > WINDOW:
        yield True, [t for b in joined for t in b]


def own_license(text: str | None, scorers: list[Scorer], threshold: float) -> tuple[str | None, float | None, bool]:
    """License and score of the best unit, and whether the file opens with a unit that reaches the threshold."""
    best, opens = None, False
    for first, said in units(text or ""):
        counts = None
        for s in scorers:
            if not any(map(s.idf.__contains__, said)):
                continue
            counts = Counter(said) if counts is None else counts
            hit = s.best(counts, threshold)
            if hit:
                best, opens = min(best or hit, hit), opens or first
    return (best[1], -best[0], opens) if best else (None, None, False)


def scan_units(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (..., text) -> the other columns, license, score, opens for every row."""
    more = long_templates() if templates is TEMPLATES else {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(t) for t in (templates, more) if t]
        for batch in batches:
            found = [own_license(x.as_py(), scorers, threshold) for x in batch.column("text")]
            names, scores, opens = zip(*found, strict=True) if found else ((), (), ())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(opens, pa.bool_())], names=[*kept, "license", "score", "opens"])

    schema = StructType([f for f in files.schema.fields if f.name != "text"]).add("license", StringType()).add("score", DoubleType()).add("opens", "boolean")
    return files.mapInArrow(score, schema)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text, and others) -> path, own_license, own_score, inherited_from, license, and the others."""
    others = [c for c in files.columns if c not in ("path", "text")]
    packed = files.select("path", F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("other"))
    own = table(scan_units(packed, templates, threshold), "license-own")
    licensed = own.where("opens").groupBy(directory(F.col("path")).alias("licensed_dir")).agg(F.min(F.struct("path", "license")).alias("by"))
    dirs = own.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("licensed_dir"))
    nearest = up.join(licensed, "licensed_dir").groupBy("dir").agg(F.max(F.struct("depth", "licensed_dir", F.col("by.license").alias("license"))).alias("near"))
    found = own.select("path", "other", "license", "score", directory(F.col("path")).alias("dir")).join(nearest, "dir", "left")
    heir = F.col("license").isNull()
    return found.select(
        *[F.col("other").getField(c).alias(c) for c in others],
        "path",
        F.col("license").alias("own_license"),
        F.col("score").alias("own_score"),
        F.when(heir, F.col("near.licensed_dir")).alias("inherited_from"),
        F.coalesce("license", F.col("near.license")).alias("license"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: /source/lang, then a level for each digit of doc_id but the last two, as digit-sharded stores
    have it, and doc_id as the file's name: so the files of small ids stand above those of larger ones."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))
    levels = F.regexp_replace(F.regexp_replace(name, ".{1,2}$", ""), "(.)", "/$1")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), levels, F.lit("/"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
