"""LM scoring by prediction by partial matching (PPM), beside a unigram base score.

The model is a byte-context trie of fixed depth, pretrained on the corpus: how often each byte followed each context
of up to ORDER bytes. A byte's probability comes from the longest context in which it was seen; each longer context
that is known gives an escape, estimated from its number of distinct followers: each of them gives up DISCOUNT of a count
to it (method D, with its half made a parameter). Bytes that a longer context
would have predicted are excluded from the shorter ones. Because a context's followers also follow its suffix, what an
exclusion takes from the suffix's counts is one number for each context, so scoring needs table lookups only.

Texts are lower-cased (A-Z), taken as UTF-8 and closed by one end symbol, a byte that UTF-8 never has.

The trie is a set of tables, one of entries and one of contexts for each order, made by grouped sums over the whole
corpus; no task and no driver ever holds it. Every gram is scored from the whole trie: the probabilities of the grams of
the highest order that make up a share of SHARED or more of all go to all tasks (up to HEAD_GRAMS of them), and each
text's other grams are joined with the tables by shuffles. The share is of the corpus, so what is shared hardly grows with it. Unigram counts work alike: up to HEAD most frequent tokens go to all tasks, and each text's other
tokens are joined with the counts. The two limits bound what is shared; they change no score.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import fold, packed, stored, table, unpacked

ORDER = 5
DISCOUNT = 0.35
END = 255
SYMBOLS = 256
#: Most frequent grams and tokens that all tasks get; the others are joined. They move work, not results.
SHARED = 2.0**-23
HEAD_GRAMS = 1 << 20
HEAD = 100_000
#: Longer tokens are not shared, however frequent.
SHARED_BYTES = 64
#: Bytes that a task turns into contexts at once; distinct tokens and contexts it counts before handing them on.
CHUNK_BYTES = 1_000_000
HELD = 200_000
HELD_BYTES = 16_000_000
HELD_GRAMS = 400_000
#: Tables of the lowest orders have 256 ^ (order + 1) rows at most; up to this order they are broadcast.
SMALL_ORDER = 1
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Added to each token's count in the base score. The end of a text is a token, written as the empty word.
ADDED = 0.1
FOLDS, HELD_OUT = 10, 0


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERED)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text number) of every byte and end: the byte in the low 8 bits, its context of `order` bytes above.

    Before a text's first byte stand end symbols.
    """
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + order * (owner + 1)
    keys = data[at].astype(np.int64)
    for k in range(1, order + 1):
        keys |= data[at - k].astype(np.int64) << (8 * k)
    return keys, owner


def _chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    n = 0
    for t in map(lowered, texts):
        part.append(t)
        n += len(t)
        if n >= CHUNK_BYTES:
            yield part
            part, n = [], 0
    if part:
        yield part


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): how often each byte followed each context of `order` bytes, over all rows of (text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        n = np.concatenate([m for _, m in parts])
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, n, len(found)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for chunk in _chunks(batch["text"]):
                parts.append(np.unique(grams(chunk, order)[0], return_counts=True))
                if len(parts) > 1 and sum(len(k) for k, _ in parts) > 4 * HELD_GRAMS:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 2 * HELD_GRAMS:
                        yield pd.DataFrame({"key": parts[0][0], "n": parts[0][1]})
                        parts = []
        if parts:
            keys, n = merged(parts)
            yield pd.DataFrame({"key": keys, "n": n})

    return texts.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all rows of (text): words of the lowered text, and the empty word for each text's end."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        size = 0
        frame = lambda: pd.DataFrame({"token": pd.Series([w.decode("utf-8", "surrogatepass") for w in held], dtype=object), "n": list(held.values())})
        for batch in batches:
            for text in batch["text"]:
                fresh = Counter(lowered(text).split())
                size += sum(len(w) for w in fresh if w not in held)
                held.update(fresh)
                held[b""] += 1
                if len(held) > HELD or size > HELD_BYTES:
                    yield frame()
                    held.clear()
                    size = 0
        if held:
            yield frame()

    return texts.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Head:
    """Grams with their log10 probabilities, and a table that finds most of them at once."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self._slots = np.zeros(1 << self.BITS, np.int32)
        self._slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hit) of each gram."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self._slots[self._slot(keys)]
        hit = self.keys[at] == keys
        rest = np.flatnonzero(~hit)
        at[rest] = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
        hit[rest] = self.keys[at[rest]] == keys[rest]
        return at, hit


@dataclass
class Order:
    """One order of the trie. entries: (key, count), what followed which context; nodes: (context, total, followers, taken).

    total and followers sum up a context's entries; taken is the sum of the counts that its followers have at its suffix.
    """

    entries: DataFrame
    nodes: DataFrame


def trie(texts: DataFrame, order: int = ORDER) -> list[Order]:
    """The orders from 0 on, counted over all rows of (text)."""
    entries = [stored(gram_counts(texts, order).withColumnRenamed("n", "count"))]
    for k in range(order - 1, -1, -1):
        cut = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        entries.insert(0, stored(entries[0].groupBy(cut.alias("key")).agg(F.sum("count").alias("count")), min(256 ** (k + 1), entries[0].count())))
    out = []
    for k, own in enumerate(entries):
        rows = own.withColumn("_at_suffix", F.lit(0).cast("long"))
        if k:
            suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
            below = entries[k - 1].select(F.col("key").alias("_below"), F.col("count").alias("_at_suffix"))
            rows = own.join(_shared(below, k - 1), suffix == F.col("_below"))
        context = F.shiftrightunsigned("key", 8).alias("context")
        nodes = rows.groupBy(context).agg(F.sum("count").alias("total"), F.count("*").alias("followers"), F.sum("_at_suffix").alias("taken"))
        out.append(Order(own, stored(nodes, min(256**k, own.count()))))
    return out


def _shared(df: DataFrame, k: int) -> DataFrame:
    """A table of order k, broadcast where its order bounds it to 65,536 rows."""
    return F.broadcast(df) if k <= SMALL_ORDER else df


def gram_scores(grams: DataFrame, orders: list[Order]) -> DataFrame:
    """(key, p): the log10 probability of each row of (key), a gram of the highest order."""
    rows = grams.select("key", F.lit(0.0).alias("p"), F.lit(False).alias("_done"), F.lit(0).cast("long").alias("_excluded"), F.lit(0).cast("long").alias("_gone"))
    for k in range(len(orders) - 1, -1, -1):
        cut = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        nodes = orders[k].nodes.withColumnRenamed("context", "_context")
        entries = orders[k].entries.select(F.col("key").alias("_key"), "count")
        rows = rows.join(_shared(nodes, k), F.shiftrightunsigned(cut, 8) == F.col("_context"), "left").join(_shared(entries, k), cut == F.col("_key"), "left")
        known = F.col("total").isNotNull() & ~F.col("_done")
        space = F.col("total") - F.col("_excluded")
        found = known & F.col("count").isNotNull()
        step = F.when(found, F.log10((F.col("count") - DISCOUNT) / space)).when(known & (space > 0), F.log10(DISCOUNT * (F.col("followers") - F.col("_gone")) / space))
        rows = rows.select(
            "key", (F.col("p") + F.coalesce(step, F.lit(0.0))).alias("p"), (F.col("_done") | found).alias("_done"),
            F.when(known, F.col("taken")).otherwise(F.col("_excluded")).alias("_excluded"), F.when(known, F.col("followers")).otherwise(F.col("_gone")).alias("_gone"),
        )
    unseen = F.log10(F.greatest(F.lit(1), SYMBOLS - F.col("_gone")))
    return rows.select("key", (F.col("p") - F.when(F.col("_done"), 0.0).otherwise(unseen)).alias("p"))


def least_count(top: Order, share: float, most: int) -> float:
    """A bound of count that at most `most` entries of the order reach, and all make up a share of `share` or more."""
    sizes = top.entries.groupBy(F.floor(8 * F.log2("count")).alias("e")).agg(F.count("*").alias("n"), F.sum("count").alias("c")).collect()  # 504 rows at most
    least, total = share * sum(r["c"] for r in sizes), 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        total += r["n"]
        if total > most:
            # a count on the very edge may fall on either side of it, so the edge is set a little above
            return max(least, 2.0 ** ((r["e"] + 1) / 8) * (1 + 1e-12))
    return least


def head_grams(top: Order, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log10 probabilities) of the grams of the highest order whose count is at least `least`."""
    frequent = top.entries.where(F.col("count") >= least).withColumn("context", F.shiftrightunsigned("key", 8))
    got = frequent.join(top.nodes, "context").select("key", F.log10((F.col("count") - DISCOUNT) / F.col("total")).alias("p")).toArrow()
    return got["key"].to_numpy(), got["p"].to_numpy()


SCORED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("token_times", T.ArrayType(T.IntegerType())),
    T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("gram_times", T.ArrayType(T.IntegerType())),
])


def _head_scores(texts: list[bytes], order: int, head: Head) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each text: the sum over its grams in head, and the others as (keys, times)."""
    keys, owner = grams(texts, order)
    at, hit = head.find(keys)
    missed, of = keys[~hit], owner[~hit]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    rest = [np.unique(missed[a:b], return_counts=True) if a < b else none for a, b in itertools.pairwise(edges.tolist())]
    return np.bincount(owner[hit], head.values[at[hit]], len(texts)), rest


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, share: float = SHARED, most: int = HEAD_GRAMS, head: int = HEAD) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score; train is (text).

    Null texts count as empty ones: they have the end token alone. Every row is scored by itself, so repeated rows and
    null ids stay. With nothing to learn from, base_score is 0 and every byte has the probability 1/256.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    spark = docs.sparkSession
    orders = trie(train, order)
    counts = stored(token_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    first = counts.where(F.octet_length("token") <= SHARED_BYTES).orderBy(F.desc("n"), "token").limit(head).toArrow()  # HEAD rows of SHARED_BYTES at most
    space = total + ADDED * (distinct + 1)
    logs = np.log10((first["n"].to_numpy() + ADDED) / space).tolist()
    known = {t.encode("utf-8", "surrogatepass"): p for t, p in zip(first["token"].to_pylist(), logs, strict=True)}
    shared = spark.sparkContext.broadcast((head_grams(orders[-1], least_count(orders[-1], share, most)), known))  # HEAD_GRAMS and HEAD entries at most

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        top, known = shared.value
        most = Head(*top)
        for batch in texts:
            rows = []
            for part in _chunks(batch):
                sums, missed = _head_scores(part, order, most)
                for text, ppm, more in zip(part, sums.tolist(), missed, strict=True):
                    words = text.split()
                    words.append(b"")
                    base, n, tail, times_of = 0.0, 0, [], []
                    for w, times in Counter(words).items():
                        p = known.get(w)
                        if p is None:
                            tail.append(w.decode("utf-8", "surrogatepass"))
                            times_of.append(times)
                        else:
                            base += p * times
                            n += times
                    rows.append((len(words), n, base, ppm, tail, times_of, *more))
            yield pd.DataFrame(rows, columns=SCORED.names)

    kept = [c for c in docs.columns if c != "text"]
    rows = stored(docs.select(packed(docs, kept), scored(F.col("text")).alias("_s"), F.monotonically_increasing_id().alias("_row")))
    pairs = lambda a, b, name: rows.select("_row", F.inline(F.arrays_zip(F.col(f"_s.{a}").alias(name), F.col(f"_s.{b}").alias("times"))))
    tokens = pairs("tokens", "token_times", "token").join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nothing = F.lit(None).cast("double")
    base = tokens.select("_row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10((F.col("n") + ADDED) / space)).alias("base"), nothing.alias("ppm"))
    missed = pairs("grams", "gram_times", "key")
    found = missed.join(gram_scores(missed.select("key").distinct(), orders), "key")
    ppm = found.select("_row", F.lit(0).alias("known"), nothing.alias("base"), (F.col("times") * F.col("p")).alias("ppm"))
    rest = base.unionByName(ppm).groupBy("_row").agg(F.sum("known").alias("_known"), F.sum("base").alias("_base"), F.sum("ppm").alias("_ppm"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.join(rest, "_row", "left").select(
        *unpacked(kept), F.col("_s.n_tokens").alias("n_tokens"), plus("_s.n_known", "_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("_s.base", "_base").alias("base_score"), plus("_s.score", "_ppm").alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(docs.withColumn("held_out", out), docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
