"""Operator 7: license texts by MinHash bands over overlapping windows, DataFrame functions only.

Templates and documents are cut into overlapping windows of word shingles. The smallest value of each of BANDS
hashes over a window is a band of one row; a window of a template and one of a document that share a band
bring the template up, which is confirmed by the exact share of its shingles that the whole document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 8
CONTAINED = 0.8
#: Window sizes in shingles and the step between a document's windows; a template uses the largest size it fills.
#: A template's own windows lie at every place, so an unchanged stretch of a document meets an equal window. Where a fifth
#: of a window's shingles differ, the Jaccard similarity is 2/3 and one of 8 bands agrees with probability 0.9998.
WINDOWS = ((1, 1), (3, 1), (8, 2))
#: Words that stand for no shingle if it has another one.
COMMON = ("that", "this", "with", "from", "will", "under", "have", "which", "there", "must", "form", "basis", "except", "person", "anyone")
SEPARATORS = r"[\x09-\x0D\x20!-/:-@\[-`{-~]+"

# Public license notices, as they are commonly written.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-2", "MIT", "This project is licensed under the terms of the MIT license."),
    ("mit-text", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-text", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-text", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-text", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-text", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc-text", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense-text", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reference would be computed again for each element of a transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles in order; an empty array for fewer words."""
    return _bound(words(text), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>")))


def band_keys(h: Column, windows, bands: int = BANDS) -> Column:
    """The bands of the windows (size, step) of shingle hashes, in one array. A window of one shingle has itself for its bands."""
    def hashed(band: int) -> Column:
        return F.transform(h, lambda x: F.xxhash64(x, F.lit(band)))

    def least(size: int, step: int):
        return lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - size + 1, F.lit(1)), F.lit(step)), lambda i: F.array_min(F.slice(g, i, size)))

    parts = [h if size == 1 else _bound(hashed(band), least(size, step)) for size, step in windows for band in range(1 if size == 1 else bands)]
    return F.concat(*parts)


def _longs(values) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "bigint(-9223372036854775808)" for v in sorted(values)) + ")")


def scan(docs: DataFrame, templates=TEMPLATES, *, contained: float = CONTAINED, bands: int = BANDS) -> DataFrame:
    """One row per document and template found: doc_id, template, license, n_shingles, n_found, containment.

    A template is found if the document holds the part `contained` of its distinct shingles of five words or more.
    Templates (driver-side, a few kilobytes) are the only thing broadcast; nothing is shuffled. A null, empty or
    short text gives no row; repeated rows give their rows again; rows without doc_id are left out; other columns
    are not looked at. Templates of fewer than five words are never found.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates), "template string, license string, body string")
    known = known.select("template", "license", words(F.col("body")).alias("w"), F.array_distinct(shingles(F.col("body"))).alias("t"), shingles(F.col("body")).alias("h")).where("size(t) > 0")
    size = F.size("h")
    by_size = [(w, F.when((size >= w) & (size < (WINDOWS[k + 1][0] if k + 1 < len(WINDOWS) else 1 << 30)), band_keys(F.col("h"), [(w, 1)], bands))) for k, (w, _) in enumerate(WINDOWS)]
    known = known.select("template", "license", "w", "t", F.array_distinct(F.coalesce(*(c for _, c in by_size))).alias("keys")).toLocalIterator()
    rows = [r.asDict() for r in known]
    if not rows:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("template", "string"), ("license", "string"), ("n_shingles", "int"), ("n_found", "int"), ("containment", "double")))).limit(0)
    keys = sorted({k for r in rows for k in r["keys"]})
    # one word of every shingle of every template: a document without any of them holds no shingle at all, so no window of it can match
    anchors = sorted({max(r["w"][i : i + SHINGLE], key=lambda w: (w not in COMMON, len(w), w)) for r in rows for i in range(len(r["w"]) - SHINGLE + 1)})
    by_key = spark.createDataFrame([(k, r["template"], r["license"], r["t"]) for r in rows for k in r["keys"]], "key long, template string, license string, t array<long>")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    d = d.where(F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, anchors))))
    d = d.select("doc_id", shingles(F.col("text")).alias("h")).where(F.arrays_overlap("h", _longs({x for r in rows for x in r["t"]})))
    hits = _bound(F.col("h"), lambda h: F.array_intersect(band_keys(h, WINDOWS, bands), _longs(keys)))
    names = d.select("doc_id", "h", F.explode(hits).alias("key")).join(F.broadcast(by_key), "key")
    n = F.size("t")
    found = F.size(F.array_intersect("t", "h"))
    out = names.select("doc_id", "template", "license", n.alias("n_shingles"), found.alias("n_found"), (found / n).alias("containment"))
    return out.where(F.col("n_found") >= contained * F.col("n_shingles")).distinct()


def oracle_sql(templates=TEMPLATES, contained: float = CONTAINED) -> str:
    """DuckDB SQL for scan() over the view documents, without any index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in templates)
    pattern = SEPARATORS.replace("'", "''")
    cut = lambda text: f"list_filter(regexp_split_to_array(lower({text}), '{pattern}'), lambda x: x <> '')"
    shingle = f"unnest(list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' '))))"
    return f"""
WITH templates(template, license, body) AS (VALUES {values}),
t AS (SELECT template, license, {shingle} AS s FROM (SELECT template, license, {cut('body')} AS w FROM templates)),
d AS (SELECT doc_id, {shingle} AS s FROM (SELECT doc_id, {cut('text')} AS w FROM documents WHERE text IS NOT NULL)),
n AS (SELECT template, license, count(*) AS n FROM t GROUP BY ALL)
SELECT d.doc_id, n.template, n.license, CAST(n.n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / CAST(n.n AS DOUBLE) AS containment
FROM d JOIN t USING (s) JOIN n ON n.template = t.template GROUP BY d.doc_id, n.template, n.license, n.n HAVING count(*) >= {contained} * n.n"""
