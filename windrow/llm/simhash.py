"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits, by deletion-variant signatures.

A fingerprint is cut into two halves. Two fingerprints within two bits of each other have a half in which they differ
by one bit at most, so they agree on one of that half's 32 one-wildcard variants. Distinct fingerprints are indexed by
all variants, equal keys are joined and the pairs verified. Where a key holds many fingerprints, pairs within it would
grow with its square: its fingerprints are joined by two-wildcard variants of the whole instead (2,016 each, and at
most four fingerprints share one), which finds the same links in work that grows with their number.

Links are closed to components by large-star and small-star steps over DataFrames, written down each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import named, packed, stored, table, unpacked

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Keys with more distinct fingerprints than this go the two-wildcard way.
CROWDED = 64
#: The blanks between words, lower-casing A-Z on the way: what bytes.split() takes as blank is exactly \x20, \x09-\x0D.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; zero where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes. Works through long inputs in slices."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed 64-bit form of each text's fingerprint."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(x) for x in batch], np.uint64).view(np.int64))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FULL = (1 << 64) - 1
LOW = (1 << 32) - 1


def _half_keys(fp: Column) -> Column:
    """Keys of the one-wildcard variants: a half without one of its bits below, the number of half and bit above.

    The number takes 6 bits and the half 32, so a key is a positive long, and equal only for equal variants.
    """
    halves = (fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 32))
    return F.array(*[half.bitwiseAND(F.lit(LOW & ~(1 << k))).bitwiseOR(F.lit((32 * i + k) << 32)) for i, half in enumerate(halves) for k in range(32)])


def _whole_keys(fp: Column) -> Column:
    """Keys of the two-wildcard variants: the number of the two bits, and the fingerprint without them."""
    masks = F.array(*[F.lit(_signed(FULL & ~(1 << a | 1 << b))).cast("long") for a, b in combinations(range(64), MAX_BITS)])
    return F.transform(masks, lambda m, i: F.struct(i.alias("slot"), m.bitwiseAND(fp).alias("part")))


def _variants(fps: DataFrame, keys: Column) -> DataFrame:
    """A row (fp, key) for each key. Fingerprints are dealt out first, as each becomes as many rows as it has keys."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.repartition(n, "fp").select("fp", F.explode(keys).alias("key"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Verified pairs a < b of fingerprints that share a key."""
    a, b = rows.select("key", F.col("fp").alias("a")), rows.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values of column fp that differ in one or two bits."""
    rows = _variants(fps, _half_keys(F.col("fp")))
    sizes = rows.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")  # partial sums: a crowded key is no task's alone
    shared = stored(rows.join(sizes.hint("merge"), F.col("key") == F.col("_key")).select("fp", "key", "n"), 64 * fps.count())
    found = _pairs(shared.where(F.col("n") <= CROWDED))
    crowded = shared.where(F.col("n") > CROWDED).select("fp").distinct()
    return found.unionByName(_pairs(_variants(crowded, _whole_keys(F.col("fp"))))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the links: root is the smallest node of its component.

    Each round hangs a node's larger neighbours on its smallest one (large star), then all of its smaller neighbours
    (small star), until nothing changes; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(pairs.select(F.col("a").alias("lo"), F.col("b").alias("hi")))
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        large = both.where("hi > lo").join(least.hint("merge"), "lo").select(F.col("m").alias("lo"), "hi").distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least.hint("merge"), "hi").select("m", F.explode(F.array("hi", "lo")).alias("n"))
        edges = stored(small.where("m <> n").select(F.col("m").alias("lo"), F.col("n").alias("hi")).distinct(), 2 * before[0])
        now = state(edges)
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
        before = now


def _rooted(classes: DataFrame) -> DataFrame:
    """Rows of classes, which has distinct values of column fp, with root: the same for all that the links connect."""
    joined = components(links(classes.select("fp"))).hint("merge")  # grows with the corpus, so it is never broadcast
    return classes.join(joined, classes["fp"] == joined["node"], "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    component_id is the smallest id among the rows whose fingerprints the links connect to the row's own; null only if
    all of them have a null id. Null, empty and blank texts have fingerprint zero, which links like any other.
    Repeated rows stay; an empty table gives an empty one.
    """
    rows = stored(docs.select(F.col(id_col).alias("_id"), fingerprints(F.col(text_col)).alias("fp")))
    rooted = _rooted(stored(rows.groupBy("fp").agg(F.min("_id").alias("least")), rows.count()))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = rooted.join(best.hint("merge"), "root").select("fp", "component_id")
    return rows.join(final.hint("merge"), "fp").select(F.col("_id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with exactly one row for each component: that of the smallest doc_id, null ids last, ties by a hash of the row."""
    whole = F.xxhash64(*map(named, docs.columns), *[named(c).isNull() for c in docs.columns])  # hashes skip nulls
    rows = stored(docs.select("doc_id", whole.alias("_hash"), fingerprints(F.col("text")).alias("fp")))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_d"), F.col("_hash").alias("_h"))
    rooted = _rooted(stored(rows.groupBy("fp").agg(F.min(rank).alias("first")), rows.count()))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._d", "first._h")
    all_rows = docs.select(packed(docs), whole.alias("_hash"), F.col("doc_id"))
    found = all_rows.join(keep.hint("merge"), (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return found.dropDuplicates(["_hash", "doc_id"]).select(*unpacked(docs.columns))  # rows alike in both are alike in all columns


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
