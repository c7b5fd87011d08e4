"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits, A-Z lower-cased; shingles are five words. For each length of a template, texts
are cut into windows that are a little longer than it and start at every fourth part of it, so a template of that
length that stands in a text lies whole in some window. A window is retrieved for a template if all ROWS least hashes of
one of its bands are the template's. A window that has CONTAINED of a template's distinct shingles has a known least
Jaccard similarity with it; each length takes as many bands as bring the chance that none of them meets under MISS.
Windows without a shingle of any template are like none of them and make no bands. A license that some window retrieved
is found if the text has at least CONTAINED of its distinct shingles, counted exactly. Everything is DataFrame
expressions; texts without any template's shingle are dropped inside the scan, before any shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import ascii_lower, stored, table

SHINGLE = 5
CONTAINED = 0.8
#: Least hashes that make one band; chance that all bands of a window miss a template that it holds.
ROWS = 2
MISS = 1e-4
#: Up to so many shingles of all templates go into the plan; more are joined by a shuffle.
MAX_KEYS = 50_000

#: Wording of license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Words in order; a leading or trailing separator makes an empty string, which goes."""
    return F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """64-bit hash of each run of five words, in order; empty if there are fewer."""
    n = F.size(words) - (SHINGLE - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))


@dataclass(frozen=True)
class Tier:
    """Windows and bands for templates of `size` shingles, `distinct` of them different."""

    size: int
    distinct: int

    @property
    def stride(self) -> int:
        return math.ceil(self.size / 4)

    @property
    def window(self) -> int:
        """Shingles of a window: any `size` neighbouring shingles lie in one."""
        return self.size + self.stride - 1

    @property
    def similarity(self) -> float:
        """Least Jaccard similarity of a template and a window that has CONTAINED of its shingles."""
        common = math.ceil(CONTAINED * self.distinct)
        return common / (self.window + self.distinct - common)

    @property
    def bands(self) -> int:
        return 1 if self.similarity == 1 else math.ceil(math.log(MISS) / math.log(1 - self.similarity**ROWS))


def band_values(hashes: Column, bands: Column) -> Column:
    """The band values of a set of shingle hashes: each one hashes ROWS least hashes under orders of its own."""
    least = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]))


def index_templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, total, hashes, bands) of each template of at least one shingle; total counts distinct shingles."""
    words = words_of(F.col("text"))
    made = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", shingles(words).alias("hashes")).where(F.size("hashes") > 0)
    return made.select("license", F.size("hashes").alias("size"), F.size(F.array_distinct("hashes")).alias("total"), "hashes")


def _windows(places: Column, tier: Column) -> Column:
    """Numbers of the tier's windows that hold any of the places; window j starts at j times the stride."""
    low = lambda p: F.greatest(F.lit(0), F.ceil((p - tier["window"] + 1) / tier["stride"])).cast("int")
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(low(p), F.floor(p / tier["stride"]).cast("int")))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word), a row for each license found in a row of docs.

    containment is the share of the template's distinct shingles that the text has; first_word is the number of the word
    at which the first of them starts. Texts without a find, null texts and texts of fewer than five words have no row,
    templates of fewer than five words are never found; rows that repeat an id with the same text are one.
    """
    spark = docs.sparkSession
    index = index_templates(spark, templates)
    own = index.collect()  # the templates are the caller's own list
    tiers = {(r["size"], r["total"]): Tier(r["size"], r["total"]) for r in own}
    grams = sorted({h for r in own for h in r["hashes"]})
    few = len(grams) <= MAX_KEYS
    small = F.broadcast if few else lambda df: df  # at most MAX_KEYS rows
    owned = index.select("license", "total", F.explode("hashes").alias("hash")).distinct()

    # one value of a list of one, so that each step's result is worked out once for all that use it
    words = F.transform(F.array(words_of(F.col(text_col))), shingles)
    if few:
        def with_places(hashes: Column) -> Column:
            own = F.filter(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))), lambda x: x["hash"].isin(grams))
            return F.struct(hashes.alias("hashes"), F.transform(own, lambda x: x["place"]).alias("places"))

        held_by = F.filter(F.transform(words, with_places), lambda x: F.size(x["places"]) > 0)
        found = stored(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.inline(held_by)))
    else:
        rows = stored(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.explode(words).alias("hashes"), F.monotonically_increasing_id().alias("_row")))
        hits = rows.select("_row", F.posexplode("hashes").alias("place", "hash")).join(owned.select("hash").distinct(), "hash", "left_semi")
        found = stored(rows.join(hits.groupBy("_row").agg(F.array_sort(F.collect_list("place")).alias("places")), "_row").drop("_row"))

    shape = [F.struct(F.lit(t.size).alias("size"), F.lit(t.distinct).alias("total"), F.lit(t.window).alias("window"), F.lit(t.stride).alias("stride"), F.lit(t.bands).alias("bands")) for t in tiers.values()]
    windows = found.select("_id", "_text", "hashes", "places", F.explode(F.array(*shape) if shape else F.array().cast(NO_TIERS)).alias("tier"))
    windows = windows.select("_id", "_text", "hashes", "tier", F.explode(_windows(F.col("places"), F.col("tier"))).alias("j"))
    banded = lambda df, hashes, bands, *keep: df.select(*keep, F.posexplode(band_values(hashes, bands)).alias("band", "value"))
    text_bands = banded(windows, F.slice("hashes", F.col("j") * F.col("tier.stride") + 1, F.col("tier.window")), F.col("tier.bands"), "_id", "_text", F.col("tier.size").alias("size"), F.col("tier.total").alias("total"))
    per_size = F.create_map(*[c for (n, d), t in tiers.items() for c in (F.lit(f"{n},{d}"), F.lit(t.bands))]) if tiers else F.create_map().cast("map<string,int>")
    template_bands = banded(index, F.col("hashes"), per_size[F.concat_ws(",", "size", "total")], "license", "size", "total")
    retrieved = text_bands.join(small(template_bands), ["size", "total", "band", "value"]).select("_id", "_text", "license").distinct()

    held = found.select("_id", "_text", F.explode(F.transform("places", lambda p: F.struct(p.alias("place"), F.get("hashes", p).alias("hash")))).alias("g")).select("_id", "_text", "g.*")
    sums = held.join(small(owned), "hash").groupBy("_id", "_text", "license", "total").agg(F.countDistinct("hash").alias("n"), F.min("place").alias("place"))
    kept = sums.where(F.col("n") >= CONTAINED * F.col("total"))
    a, b = kept.alias("a"), retrieved.alias("b")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & F.col("a._text").eqNullSafe(F.col("b._text")) & (F.col("a.license") == F.col("b.license"))
    return a.join(b, same, "left_semi").select(F.col("_id").alias(id_col), "license", (F.col("n") / F.col("total")).alias("containment"), F.col("place").cast("long").alias("first_word"))


NO_TIERS = "array<struct<size:int,total:int,window:int,stride:int,bands:int>>"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    """Plain containment in DuckDB: every shingle of every text against every shingle of the templates."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(TEMPLATES.items()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[\p{{L}}\p{{N}}]+')"
    shingled = f"array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS sh"
    return f"""
WITH lists AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS place, {shingled} FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM lists)),
tl AS (SELECT license, {words} AS w FROM (VALUES {values}) t(license, text)),
ts AS (SELECT DISTINCT license, {shingled} FROM (SELECT license, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM tl)),
total AS (SELECT license, count(*) AS total FROM ts GROUP BY license)
SELECT doc_id, license, count(DISTINCT sh) / any_value(total)::DOUBLE AS containment, min(place) AS first_word
FROM s JOIN ts USING (sh) JOIN total USING (license) GROUP BY doc_id, license HAVING count(DISTINCT sh) >= {CONTAINED} * any_value(total)"""


SQL = _sql()
