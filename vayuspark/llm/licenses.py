"""License scans: TF-IDF cosine of lines and licence files with templates, then inheritance from the nearest directory.

Terms are lower-cased words, their inverse document frequency is counted over all files. Marks are no words, so comment signs
do not matter. Units are lines, paragraphs (runs of lines with words, so a wrapped header is one) and the sentences of these; a
licence file is one unit more as a whole. Templates are short statements, the paragraphs of standard headers and the opening
ones of licence texts, and tags that name a licence. Only units that can reach the similarity are looked at: a template's weightiest terms, without which
its remaining terms stay below the threshold, must have one in common with the unit (a prefix filter), and its cosine with the other terms at their least weight must reach
the similarity; neither loses anything. Units are compared once each, however many files hold them; vectors are rows (unit, term, weight) and meet the
templates' in a join by term.

A file's licence is that of its best unit. A file without one takes that of the licence file in its own directory or the nearest
one above; directories, not files, are joined with the licences of their ancestors.

Defined results: a null or empty text has no units and can only inherit; a null path has no directory and inherits nothing; of
equal similarities the template that stands first in the list counts, of several licence files in a directory the best; repeated rows with
one path are one file, whose best unit counts, and each row gets its result; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import table, written

SIMILAR = 0.7
#: Names of licence files, lower-cased, without ending.
LICENSE_FILES = r"^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

#: Short statements of common licences, paragraphs of their standard headers, openings of their texts.
STATEMENTS = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]


def tag(name: str) -> tuple[str, str]:
    """The template of a tag that names a licence; the name counts three times, so that tags of other licences stay apart."""
    return name, "SPDX-License-Identifier: " + " ".join([name] * 3)


TEMPLATES = STATEMENTS + [tag(name) for name in sorted({name for name, _ in STATEMENTS} - {"Proprietary"})]

#: Between paragraphs: a line without words. Between sentences: an end mark and white space. Between lines: line ends.
_NO_WORD = r"\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F"
PARAGRAPHS, SENTENCES, LINES = rf"\n[{_NO_WORD}]*\n", r"[.!?][\x09-\x0D\x20]+", r"[\n\r]+"
_CUTS = [re.compile(x.encode()) for x in (PARAGRAPHS, SENTENCES, LINES)]


def _terms(column: pa.Array) -> words_.Words:
    return words_.words_of(column, words_.MARKS, lower=True)


def _file_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, files) of a piece: each file counts once for a term."""
    for piece in words_.pieces(batches, "text"):
        found = _terms(piece.column("text"))
        salt = words_.mix(np.arange(1, piece.num_rows + 1, dtype=np.uint64))
        once = np.unique(found.hash ^ salt[found.row], return_index=True)[1]
        term, files = np.unique(found.hash[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words_.signed(term)), pa.array(files, pa.int64())], names=["term", "files"])


def _unit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, term, n): how often each unit has a term."""
    for piece in words_.pieces(batches, "text"):
        found = _terms(piece.column("text"))
        order = np.lexsort((found.hash, found.row))
        row, term = found.row[order], found.hash[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(row)))
        yield pa.RecordBatch.from_arrays([piece.column("unit").take(pa.array(row[at])), pa.array(words_.signed(term[at])), pa.array(counts, pa.int64())], names=["unit", "term", "n"])


def _weighed(terms: DataFrame, files: DataFrame, total: int) -> DataFrame:
    """(unit, term, weight) by term frequency and inverse document frequency."""
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.coalesce("files", F.lit(0)))) + 1.0
    return terms.join(files, "term", "left").select("unit", "term", (F.col("n") * idf).alias("weight"), idf.alias("idf"))


def _needed(weights: dict[str, dict[int, float]], similar: float) -> set[int]:
    """Terms of which any unit similar to some template has one."""
    needed = set()
    for terms in weights.values():
        norm, rest = sum(w * w for w in terms.values()), 0.0
        for term, w in sorted(terms.items(), key=lambda x: (x[1], x[0])):
            rest += w * w / norm
            if rest >= (similar * 0.999) ** 2:  # the terms so far could reach the similarity by themselves
                needed.add(term)
    return needed


def _spans(text: bytes) -> set[tuple[int, int]]:
    """First and last+1 byte of the lines, paragraphs and sentences of paragraphs."""

    def parts(cut: re.Pattern, low: int, high: int) -> list[tuple[int, int]]:
        found = [(m.start() + low, m.end() + low) for m in cut.finditer(text[low:high])]
        return list(zip([low, *(e for _, e in found)], [*(s for s, _ in found), high], strict=True))

    paragraphs = parts(_CUTS[0], 0, len(text))
    return {*paragraphs, *parts(_CUTS[2], 0, len(text)), *(s for low, high in paragraphs for s in parts(_CUTS[1], low, high))}


class _Reach:
    """The terms of all templates, and whether a unit can reach the similarity of any of them.

    The weights of a unit's template terms are known exactly; every other term has an inverse document frequency of 1 at least,
    so the cosine is never above what is worked out here.
    """

    def __init__(self, weights: dict[str, dict[int, float]], idf: dict[int, float], similar: float):
        self.needed = np.sort(np.array(sorted(_needed(weights, similar)), np.int64).view(np.uint64))
        terms = np.array(sorted(idf), np.int64)
        order = np.argsort(terms.view(np.uint64))
        self.terms, self.idf = terms.view(np.uint64)[order], np.array([idf[t] for t in terms.tolist()])[order]
        place = {t: i for i, t in enumerate(terms[order].tolist())}
        self.share = np.zeros((len(terms), len(weights)))
        for k, own in enumerate(weights.values()):
            norm = sum(w * w for w in own.values()) ** 0.5
            for t, w in own.items():
                self.share[place[t], k] = w / norm
        self.least = similar * 0.999

    def possible(self, hashes: np.ndarray) -> bool:
        term, n = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        weight = n[known] * self.idf[at[known]]
        whole = (weight * weight).sum() + (n[~known].astype(float) ** 2).sum()
        return bool(len(weight)) and (weight @ self.share[at[known]]).max() >= self.least * whole**0.5


def _units(reach: _Reach):
    """(path, text) of the units that have a needed term and can be similar, and of such licence files as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            column = piece.column("text")
            raw, at = words_.buffer_of(column)
            found = _terms(column)
            hit = np.flatnonzero(np.isin(found.hash, reach.needed))
            is_license = piece.column("is_license").to_pylist()
            rows, texts = [], []
            for r in np.unique(found.row[hit]).tolist():
                text = raw[at[r] : at[r + 1]].tobytes()
                places = found.start[hit[found.row[hit] == r]] - at[r]
                spans = sorted(_spans(text) | ({(0, len(text))} if is_license[r] else set()))
                spans = [(low, high) for low, high in spans if np.searchsorted(places, low) < np.searchsorted(places, high)]
                edges = np.searchsorted(found.start, np.array(spans, np.int64).reshape(-1, 2) + at[r])
                for (low, high), (first, last) in zip(spans, edges.tolist(), strict=True):
                    if reach.possible(found.hash[first:last]):
                        rows.append(r)
                        texts.append(text[low:high])
            yield pa.RecordBatch.from_arrays([piece.column("path").take(pa.array(rows, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], names=["path", "text"])

    return run


def directory(path: Column) -> Column:
    """Path of the directory, empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, similar: float = SIMILAR) -> DataFrame:
    """(path, license, how, similarity) for each row of files (path, text); how: file, header, inherited or none."""
    spark = files.sparkSession
    templates = templates or TEMPLATES
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    files = files.select("path", F.col("text").cast("string").alias("text"), F.coalesce(name.rlike(LICENSE_FILES), F.lit(False)).alias("is_license"))
    texts = files.where("text is not null")
    counts = written(texts.select("text").mapInArrow(_file_counts, "term long, files long").groupBy("term").agg(F.sum("files").alias("files")), "terms")
    total = texts.count()

    # The place in the list goes before the name: equal similarities go to the first.
    models = spark.createDataFrame([(f"{i:04d} {name}", text) for i, (name, text) in enumerate(templates)], "unit string, text string")
    model = _weighed(models.mapInArrow(_unit_terms, "unit string, term long, n long"), counts, total)
    weights: dict[str, dict[int, float]] = {}
    idf: dict[int, float] = {}
    for r in model.collect():  # as many rows as the templates have words
        weights.setdefault(r.unit, {})[r.term] = r.weight
        idf[r.term] = r.idf
    reach = _Reach(weights, idf, similar)
    rows = [(unit, term, w / sum(x * x for x in terms.values()) ** 0.5) for unit, terms in weights.items() for term, w in terms.items()]
    model = F.broadcast(spark.createDataFrame(rows, "template string, term long, share double"))

    units = written(texts.where("path is not null").mapInArrow(_units(reach), "path string, text string").withColumn("unit", F.md5("text")), "units")
    distinct = units.groupBy("unit").agg(F.min("text").alias("text"))
    vectors = written(_weighed(distinct.mapInArrow(_unit_terms, "unit string, term long, n long"), counts, total).drop("idf"), "vectors")
    norms = vectors.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = vectors.join(model, "term").groupBy("unit", "template").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    close = dots.join(norms, "unit").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= similar)
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "template")).alias("best")
    judged = written(close.groupBy("unit").agg(best), "judged")
    own = written(units.select("path", "unit").join(judged, "unit").groupBy("path").agg(F.min("best").alias("best")), "own")

    # Licences of directories, and of the nearest one above each directory.
    held = texts.where("is_license and path is not null").select("path").distinct().join(own, "path")
    held = written(held.groupBy(directory(F.col("path")).alias("above")).agg(F.min("best").alias("best")), "held")
    own_directory = files.where("path is not null").select(directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = own_directory.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("directory", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above")).where("depth > 0 or directory <> ''")
    nearest = above.join(held, "above").groupBy("directory").agg(F.max(F.struct("depth", "best")).alias("x"))
    nearest = written(nearest.select("directory", F.col("x.best").alias("inherited")), "nearest")

    out = files.select("path", "is_license").join(own, "path", "left").withColumn("directory", directory(F.col("path"))).join(nearest, "directory", "left")
    chosen = F.coalesce("best", "inherited")
    how = F.when(F.col("best").isNotNull(), F.when(F.col("is_license"), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.substring(chosen["template"], 6, 1000).alias("license"), how.alias("how"), (-chosen["less"]).alias("similarity"))


def paths_of(docs: DataFrame) -> DataFrame:
    """Documents as files: their source and language are folders, runs of 256 and of 16 numbers folders in these; the first document of each run of 16 is the licence file of the folder above."""
    deep = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 256).cast("string"))
    group = F.floor(F.col("doc_id") / 16).cast("string")
    first = F.col("doc_id") % 16 == 0
    return docs.select("doc_id", "text", F.when(first, F.concat_ws("/", deep, F.concat(F.lit("LICENSE."), group))).otherwise(F.concat_ws("/", deep, group, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(paths_of(table(spark, sf_dir, "documents")))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
with d as (select doc_id, text, case when doc_id % 16 = 0 then concat(coalesce(source, 'unknown'), '/', coalesce(lang, 'unknown'), '/', doc_id // 256, '/LICENSE.', doc_id // 16)
        else concat(coalesce(source, 'unknown'), '/', coalesce(lang, 'unknown'), '/', doc_id // 256, '/', doc_id // 16, '/', doc_id, '.txt') end path, doc_id % 16 = 0 is_license from documents),
t(template, body) as (values {", ".join(f"('{i:04d} {n}', '{b}')" for i, (n, b) in enumerate(TEMPLATES))}),
df as (select term, count(distinct doc_id) files from (select doc_id, unnest({_WORDS.format(_LOW.format("text"))}) term from d where text is not null) group by term),
n as (select count(*) n from d where text is not null),
tw as (select template, term, count(*) * (ln((1.0 + any_value(n.n)) / (1.0 + coalesce(any_value(df.files), 0))) + 1.0) w
       from (select template, unnest({_WORDS.format(_LOW.format("body"))}) term from t) left join df using (term), n group by template, term),
ts as (select template, term, w / sqrt(sum(w * w) over (partition by template)) share from tw),
pg as (select path, unnest(regexp_split_to_array(text, '{PARAGRAPHS}')) unit from d where text is not null),
u as (select distinct path, unit from (select path, unnest(regexp_split_to_array(text, '{LINES}')) unit from d where text is not null union all select path, unit from pg
      union all select path, unnest(regexp_split_to_array(unit, '{SENTENCES}')) from pg union all select path, text from d where is_license and text is not null) where unit <> ''),
uw as (select unit, term, count(*) * (ln((1.0 + any_value(n.n)) / (1.0 + any_value(df.files))) + 1.0) w
       from (select unit, unnest({_WORDS.format(_LOW.format("unit"))}) term from (select distinct unit from u)) join df using (term), n group by unit, term),
c as (select uw.unit, template, round(sum(uw.w * ts.share) / any_value(m.norm), 6) similarity
      from uw join ts using (term) join (select unit, sqrt(sum(w * w)) norm from uw group by unit) m on m.unit = uw.unit group by uw.unit, template),
own as (select path, template, similarity from (select path, template, similarity, row_number() over (partition by path order by similarity desc, template) k
        from u join c using (unit) where similarity >= {SIMILAR}) where k = 1),
held as (select dir, template, similarity from (select regexp_replace(path, '/?[^/]*$', '') dir, template, similarity, row_number() over (partition by regexp_replace(path, '/?[^/]*$', '') order by similarity desc, template) k
        from own join (select distinct path from d where is_license) using (path)) where k = 1),
f as (select path, is_license, regexp_replace(path, '/?[^/]*$', '') dir from d),
a as (select dir, k, array_to_string(string_split(dir, '/')[1 : k], '/') above from (select dir, unnest(range(1, cast(len(string_split(dir, '/')) + 1 as bigint))) k from (select distinct dir from f))),
i as (select dir, template, similarity from (select a.dir, template, similarity, row_number() over (partition by a.dir order by k desc) r from a join held on held.dir = a.above) where r = 1)
select f.path, substr(coalesce(own.template, i.template), 6) license,
       case when own.path is not null then case when is_license then 'file' else 'header' end when i.dir is not null then 'inherited' else 'none' end how,
       coalesce(own.similarity, i.similarity) similarity
from f left join own on own.path = f.path left join i on i.dir = f.dir
"""
