"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased. Fixed masks choose some of neighbouring token positions and ignore
the rest. Test items and training texts are cut into seeds, the hashes of the chosen tokens at each position, and the
two sides are joined on equal seeds. A hit bears the tokens around it on both sides, so each overlap is verified by
itself, token by token, without the whole texts.

An item of SPAN tokens or more is found in a text if at least NEEDED of some SPAN neighbouring tokens of it are at the
same places in the text; the masks have a place in any such overlap that avoids its substitutions, so no overlap is
missed. A shorter item of at least LOOSE tokens is found if all its tokens but one at most are there, by seeds of four
neighbouring tokens, of which one is whole in a half without the substitution. The shortest items must be there whole.

A bit map of the items' seeds goes to all tasks, and seeds of texts that are not in it are dropped where they are made.
It has at most 2 ^ MAX_BITS bits; a benchmark with more seeds lets more through to the join, which decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import packed, stored, table, unpacked

TOKEN = re.compile(r"[^\W_]+")
SPAN = 13
NEEDED = 11
LOOSE = 8
#: Chosen positions for items of SPAN tokens or more: for any two of 13 neighbouring tokens, one mask has a place that chooses neither.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10))
LOOSE_MASK = (0, 1, 2, 3)
#: Odd multipliers of the chosen tokens' hashes, from fractional digits of the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIERS = np.array([pow(GOLDEN, 2 * k + 1, 1 << 64) | 1 for k in range(LOOSE)], np.uint64)
#: Tokens before and after a seed's first one that a hit bears: any span with the seed lies within.
AROUND = SPAN - 1
WIDTH = 2 * AROUND + 1
#: Bounds of the bit map, as powers of two.
MIN_BITS, MAX_BITS = 16, 27
#: Tokens of training texts hashed at once; distinct tokens whose hashes a task keeps.
CHUNK_TOKENS = 200_000
HELD_TOKENS = 300_000
#: Seeds of items that a task hands on at once.
HELD_SEEDS = 10_000
HIT = "mask int, seed long, place int, around array<long>"


class Hasher:
    """64-bit hashes of tokens, with a bounded store."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > HELD_TOKENS:
            self.known = {}
        known = self.known
        for t in set(tokens):
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= SPAN else (LOOSE_MASK,) if n >= LOOSE else (tuple(range(n)),)


#: All masks there are, by number.
EVERY_MASK = (*MASKS, LOOSE_MASK, *(tuple(range(n)) for n in range(1, LOOSE) if n != len(LOOSE_MASK)))


def seeds_of(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the chosen tokens at each position where the mask fits."""
    n = max(0, len(hashes) - mask[-1])
    out = np.zeros(n, np.uint64)
    for m, k in zip(MULTIPLIERS, mask, strict=False):
        out += hashes[k : k + n] * m
    return out ^ (out >> np.uint64(29))


def _bits(seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each seed in a map of 2 ^ size."""
    return seeds >> np.uint64(64 - size), seeds & np.uint64((1 << size) - 1)


def _around(hashes: np.ndarray, outside: int) -> np.ndarray:
    """For each position, the WIDTH hashes around it; `outside` stands before the first and after the last."""
    edge = np.full(AROUND, outside, np.int64)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, hashes.view(np.int64), edge]), WIDTH)


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item, item_id, n), (mask, seed, place, around, item, n)): the items of at least one token, and a row for each seed."""
    numbered = stored(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))

    names = ["mask", "seed", "place", "around", "item", "n"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                hashes = hasher(tokens_of(text))
                if not len(hashes):
                    continue
                around = _around(hashes, -2)
                for mask in masks_of(len(hashes)):
                    number = EVERY_MASK.index(mask)
                    for i, s in enumerate(seeds_of(hashes, mask).view(np.int64).tolist()):
                        out.append((number, s, i, around[i], item, len(hashes)))
                        if len(out) >= HELD_SEEDS:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    seeds = stored(numbered.select("item", "text").mapInPandas(cut, f"{HIT}, item long, n int"))
    return numbered.join(seeds.select("item", "n").distinct(), "item").select("item", "item_id", "n"), seeds


def bit_map(seeds: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """(power of two, words of 64 bits by number of mask): the bits of the seeds, for the masks that the items use."""
    used = [r["mask"] for r in seeds.select("mask").distinct().collect()]  # of EVERY_MASK
    size = min(MAX_BITS, max(MIN_BITS, 8 + math.ceil(math.log2(1 + seeds.count()))))
    both = F.array(F.shiftrightunsigned("seed", 64 - size), F.col("seed").bitwiseAND(F.lit((1 << size) - 1)))
    bits = seeds.select("mask", F.explode(both).alias("bit")).select("mask", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, int(bit & 63))").alias("one"))
    words = bits.groupBy("mask", "word").agg(F.bit_or("one").alias("ones")).toArrow()  # 2 ^ (MAX_BITS - 6) rows a mask at most
    mask, word, ones = (words[c].to_numpy() for c in ("mask", "word", "ones"))
    out = {m: np.zeros(1 << (size - 6), np.uint64) for m in used}
    for m, table_of in out.items():
        table_of[word[mask == m]] = ones[mask == m].view(np.uint64)
    return size, out


def _in_map(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) > 0


def text_hits(hashes: np.ndarray, ends: np.ndarray, size: int, words: dict[int, np.ndarray]) -> list[list[tuple]]:
    """For each text, whose hashes stand in a row up to its end: its seeds that are in the map."""
    out: list[list[tuple]] = [[] for _ in ends]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for number, own in words.items():
        mask = EVERY_MASK[number]
        seeds = seeds_of(hashes, mask)
        first, second = _bits(seeds, size)
        at = np.flatnonzero(_in_map(own, first))
        at = at[_in_map(own, second[at])]
        text = np.searchsorted(ends, at, "right")
        whole = at + mask[-1] < ends[text]  # not one that starts in one text and ends in the next
        for i, t in zip(at[whole].tolist(), text[whole].tolist(), strict=True):
            a, b = max(int(starts[t]), i - AROUND), min(int(ends[t]), i + AROUND + 1)
            around = np.full(WIDTH, -1, np.int64)
            around[a - i + AROUND : b - i + AROUND] = hashes[a:b].view(np.int64)
            out[t].append((number, int(seeds[i : i + 1].view(np.int64)[0]), i - int(starts[t]), around))
    return out


def with_hits(docs: DataFrame, size: int, words: dict[int, np.ndarray], text_col: str, kept: list[str]) -> DataFrame:
    """(callers_columns, _hits, _row) for each row of docs: its kept columns, the seeds of its text that may be an item's, a number."""
    shared = docs.sparkSession.sparkContext.broadcast((size, words))  # 2 ^ MAX_BITS bits for each mask at most

    @F.pandas_udf(f"array<struct<{', '.join(f'{c}: {t}' for c, t in (x.split() for x in HIT.split(', ')))}>>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size, words = shared.value
        hasher = Hasher()
        for batch in texts:
            out: list[list[dict]] = []
            tokens: list[str] = []
            ends: list[int] = []

            def flush() -> None:
                if ends:
                    found = text_hits(hasher(tokens), np.array(ends), size, words)
                    out.extend([dict(zip(("mask", "seed", "place", "around"), h, strict=True)) for h in own] for own in found)
                tokens.clear()
                ends.clear()

            for x in batch:
                tokens.extend(tokens_of(x))
                ends.append(len(tokens))
                if len(tokens) > CHUNK_TOKENS:
                    flush()
            flush()
            yield pd.Series(out, dtype=object)

    return docs.select(packed(docs, kept), hits.asNondeterministic()(F.col(text_col)).alias("_hits"), F.monotonically_increasing_id().alias("_row"))  # or else a filter would work it out again


def verified(pairs: DataFrame) -> DataFrame:
    """(row, item, first, places): for each pair of seeds, where the item starts and which of its places match in found spans."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = np.stack(batch["around"].to_list()) == np.stack(batch["item_around"].to_list()) if len(batch) else np.zeros((0, WIDTH), bool)
            n, place = batch["n"].to_numpy(), batch["item_place"].to_numpy()
            held = np.zeros_like(same)
            for size in np.unique(n):
                own = np.flatnonzero(n == size)
                span = min(int(size), SPAN)
                need = NEEDED if size >= SPAN else span - (size >= LOOSE)
                sums = np.cumsum(np.pad(same[own], ((0, 0), (1, 0))), axis=1)
                for i in range(WIDTH - span + 1):
                    start = place[own] - AROUND + i
                    ok = (sums[:, i + span] - sums[:, i] >= need) & (start >= 0) & (start + span <= size)
                    held[own[ok], i : i + span] |= same[own[ok], i : i + span]
            found = np.flatnonzero(held.any(axis=1))
            places = [(np.flatnonzero(held[r]) + int(place[r]) - AROUND).tolist() for r in found]
            yield pd.DataFrame({"row": batch["row"].to_numpy()[found], "item": batch["item"].to_numpy()[found], "first": (batch["place"] - batch["item_place"]).to_numpy()[found], "places": places})

    return pairs.select("row", "item", "n", "place", "item_place", "around", "item_around").mapInPandas(check, "row long, item long, first int, places array<int>")


def found_items(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, item, matched) for each item found in a row of (_row, _hits): its matching places in the spans of its best position."""
    hits = rows.select(F.col("_row").alias("row"), F.inline("_hits"))
    own = seeds.select("mask", "seed", "item", "n", F.col("place").alias("item_place"), F.col("around").alias("item_around"))
    spans = verified(hits.join(own, ["mask", "seed"]))
    laid = spans.groupBy("row", "item", "first").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"))  # an item's own places
    return laid.groupBy("row", "item").agg(F.max("matched").alias("matched"))


NAMES = ("contaminated", "n_items", "item_id", "matched", "coverage")


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with contaminated, n_items, item_id, matched and coverage.

    n_items counts the items found in the whole text; matched is how many tokens of an item are in spans that are found,
    at the item's best position. item_id is the item with the most (ties: the smallest id, null last; then any of those
    with the same id), coverage its share of the item. Texts without a find, null and empty ones and those compared with
    an empty benchmark get false, 0, null, 0 and 0. An item_id that repeats is several items, a null one is an item;
    items without a token are never found. Columns of docs that bear one of the names are replaced.
    """
    docs = docs.drop(*NAMES)
    items, seeds = item_seeds(benchmark)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    rows = stored(with_hits(docs, *bit_map(seeds), text_col, kept))
    rank = F.struct((-F.col("matched")).alias("less"), F.col("item_id").isNull().alias("last"), F.col("item_id").alias("item_id"), F.col("matched").alias("matched"), (F.col("matched") / F.col("n")).alias("coverage"))
    best = found_items(rows, seeds).join(items, "item").groupBy("row").agg(F.count("*").cast("int").alias("n_items"), F.min(rank).alias("top"))
    joined = rows.join(best, rows["_row"] == best["row"], "left")
    return joined.select(
        *unpacked(kept), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("top.item_id").alias("item_id"),
        F.coalesce("top.matched", F.lit(0)).alias("matched"), F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with their own columns."""
    _, seeds = item_seeds(benchmark)
    rows = stored(with_hits(docs, *bit_map(seeds), "text", docs.columns))
    found = stored(found_items(rows, seeds).select(F.col("row").alias("_row")).distinct(), rows.count())
    return rows.join(found, "_row", "left_anti").select(*unpacked(docs.columns))
