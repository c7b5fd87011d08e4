"""Prefix trie of conversations as a z-fast trie: compacted nodes in a hash table, found by fat binary search.

A conversation is a string whose letters are turns (role, text). A prefix is known by a 120-bit hash, the exclusive or of
what each (place, turn) hashes to; turns are hashed by SHA-256, so different prefixes don't meet in practice.

A compacted node stands for an edge: the depths (a, e] through which the same conversations pass. Its handle is the
prefix at the two-fattest depth of (a, e], the number in it with most trailing zero bits. Where a string leaves the trie
is found by fat binary search: its prefix at the two-fattest depth of what is still open is looked up among the handles.
A hit jumps to the end of the node's edge, a miss drops all depths from there on; after log2(length) lookups the string's
last node is known, the next edge is looked up by its first letter, and the string is compared with that edge.

Strings are inserted in batches: of all waiting strings that leave the trie at one place by the same next letter, the
one with the least hash goes in, edges are cut where strings leave them, and the others are searched again below that
place. The least hash picks at random, so the number of batches grows with the logarithm of the number of strings.

Strings are cut into segments of SEGMENT turns, each of which starts in the node where the one before it ends, so that
no row holds more than one segment. Lookups are equality joins, and each batch is written down. Sums over subtrees are
made by doubling, from all descendants less than 2^k levels below to those less than 2^(k+1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import WORD, stored, table

SEGMENT = 512
#: Lookups that one job makes, before strings that are done leave the search.
PROBES = 4
#: Ids that a row takes at most where the ids of a node's conversations are put in order.
IDS_OF_ROW = 4096
#: The rebuilt conversations of a family of FAMILY ids share up to SHARED - 1 turns.
FAMILY, SHARED = 20, 4
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
KEY = "struct<hi:bigint,lo:bigint>"


def two_fattest(a: Column, e: Column) -> Column:
    """The number in (a, e] that the highest power of two divides, for 0 <= a < e."""
    return e.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(a.bitwiseXOR(e))) - 1) - 1))


def turns_of(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words): turns by their hashes. Null role or text counts as empty; rows without conv_id are no conversation's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("_sha", at, 15), 16, 10).cast("long")
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", sha.alias("_sha"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.select("conv_id", "turn", half(1).alias("t1"), half(16).alias("t2"), "words")


def numbered(turns: DataFrame) -> DataFrame:
    """turns with k, their place in the conversation from 1: by turn, null first, equal turns by their hashes.

    Rows are dealt out by ranges of (conversation, turn), so a conversation with most rows is many tasks.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2"]
    rows = stored(stored(turns).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    offsets = counts.select("conv_id", "part", before.alias("before")).where("before > 0")  # at most one for each part
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:]))
    return rows.withColumn("k", here).join(offsets, ["conv_id", "part"], "left").select("conv_id", "t1", "t2", "words", (F.col("k") + F.coalesce("before", F.lit(0))).cast("long").alias("k"))


def families(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, length) of each, and their turns (conv_id, depth, length, t1, t2, words).

    Conversation c starts with the first h turns of conversation c - c % FAMILY (all if there are fewer, none if that
    one is absent) and goes on with its own turns after the first h; h is crc32 of c as text, modulo SHARED.
    """
    rows = stored(numbered(turns))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    convs = rows.groupBy("conv_id").agg(F.max("k").alias("n")).select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    firsts = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("k") < SHARED)).select(F.col("conv_id").alias("base"), "k", "t1", "t2", "words")
    heads = firsts.groupBy("base").agg(F.max("k").alias("has"))
    lent = F.least("h", F.coalesce("has", F.lit(0)))
    convs = stored(convs.join(heads, "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    borrowed = convs.join(firsts, "base").where("k <= lent").select("conv_id", F.col("k").alias("depth"), "length", "t1", "t2", "words")
    own = rows.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("lent")).alias("depth"), "length", "t1", "t2", "words")
    return convs.select("conv_id", "length"), borrowed.unionByName(own)


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, length, d0, root, w0, keys, cums) for each segment of each conversation.

    keys: the hashes of the prefixes of depth d0 + 1, d0 + 2 and so on; root: that of depth d0. cums and w0 are the words
    of all turns up to the same depths.
    """
    mixed = [F.xxhash64(F.lit(i), "depth", "t1", "t2") for i in (0, 1)]
    rows = turns.select("conv_id", "depth", "length", "words", mixed[0].alias("hi"), mixed[1].alias("lo"), F.floor((F.col("depth") - 1) / size).alias("seg"))
    run = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "seg", "depth", "length", F.bit_xor("hi").over(run).alias("hi"), F.bit_xor("lo").over(run).alias("lo"), F.sum("words").over(run).alias("cum"))
    rows = rows.groupBy("conv_id", "seg").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("depth", "hi", "lo", "cum"))).alias("items"))  # at most `size` each
    rows = stored(rows)
    last = F.element_at("items", -1)
    long = rows.where(F.col("length") > size)
    until = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.select("conv_id", "seg", last["hi"].alias("hi"), last["lo"].alias("lo"), last["cum"].alias("cum"))
    zero = F.lit(0).cast("long")
    starts = starts.select("conv_id", "seg", *[F.coalesce(f.over(until), zero).alias(n) for n, f in (("r1", F.bit_xor("hi")), ("r2", F.bit_xor("lo")), ("w0", F.sum("cum")))])
    short = rows.where(F.col("length") <= size).select("*", zero.alias("r1"), zero.alias("r2"), zero.alias("w0"))
    key = lambda x: F.struct(x["hi"].bitwiseXOR(F.col("r1")).alias("hi"), x["lo"].bitwiseXOR(F.col("r2")).alias("lo"))
    return short.unionByName(long.join(starts, ["conv_id", "seg"])).select(
        "conv_id", "length", (F.col("seg") * size).alias("d0"), F.struct(F.col("r1").alias("hi"), F.col("r2").alias("lo")).alias("root"), "w0",
        F.transform("items", key).alias("keys"), F.transform("items", lambda x: x["cum"] + F.col("w0")).alias("cums"),
    )


def ends_of(convs: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, end, cum): the prefix at which each conversation ends, and its words."""
    whole = parts.where(F.col("d0") + F.size("keys") == F.col("length")).select("conv_id", F.element_at("keys", -1).alias("end"), F.element_at("cums", -1).alias("cum"))
    nothing = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    return whole.unionByName(convs.where("length = 0").select("conv_id", nothing.alias("end"), F.lit(0).cast("long").alias("cum")))


def strings(parts: DataFrame) -> DataFrame:
    """Distinct segments (end, d0, root, w0, keys, cums), the same for all conversations that have them."""
    end = F.element_at("keys", -1).alias("end")
    return parts.groupBy(end).agg(F.first(F.struct("d0", "root", "w0", "keys", "cums")).alias("s")).select("end", "s.*")


def _at(depth: Column) -> Column:
    """A string's prefix hash at a depth."""
    return F.when(depth <= F.col("d0"), F.col("root")).otherwise(F.get("keys", (depth - F.col("d0") - 1).cast("int")))


#: Columns of a node: parent's prefix, depths (a, e], words up to a, and prefixes and words at each depth of the edge.
NODE = ["parent", "a", "e", "w0", "keys", "cums"]
NODES = f"parent {KEY}, a bigint, e bigint, w0 bigint, keys array<{KEY}>, cums array<bigint>"


def locate(nodes: DataFrame, waiting: DataFrame) -> DataFrame:
    """waiting with `low` moved to the end of the last edge that each string passes whole.

    waiting: strings with low, the depth of a node that the string is known to pass.
    """
    fat = two_fattest(F.col("a"), F.col("e"))
    handles = nodes.select(fat.alias("_d"), F.get("keys", (fat - F.col("a") - 1).cast("int")).alias("_h"), F.struct("a", "e", F.element_at("keys", -1).alias("end")).alias("_node"))
    handles = handles.select("_d", "_h.*", "_node").toDF("_d", "_h1", "_h2", "_node")
    todo, done = waiting.withColumn("high", F.col("d0") + F.size("keys")), None
    while True:
        for _ in range(PROBES):
            going = F.col("high") > F.col("low")
            probe = F.when(going, two_fattest(F.col("low"), F.col("high"))).otherwise(-1)  # no handle has a negative depth
            key = F.when(going, _at(F.col("_f"))).otherwise(F.col("end"))  # ended strings stay spread
            asked = todo.withColumn("_f", probe).withColumn("_k", key).withColumns({"_k1": F.col("_k.hi"), "_k2": F.col("_k.lo")}).drop("_k")
            met = asked.join(handles.hint("merge"), (F.col("_f") == F.col("_d")) & (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
            passed = (F.col("_node.e") <= F.col("d0") + F.size("keys")) & (_at(F.col("_node.e")) == F.col("_node.end"))
            hit = F.col("_node").isNotNull()
            low = F.when(hit & passed, F.col("_node.e")).when(hit, F.col("_node.a")).otherwise(F.col("low"))
            high = F.when(hit & passed, F.col("high")).when(hit, F.col("_node.a")).when(F.col("_f") > 0, F.col("_f") - 1).otherwise(F.col("high"))
            todo = met.select(*waiting.columns[:-1], low.alias("low"), high.alias("high"))
        todo = stored(todo)
        ended = todo.where("high <= low").drop("high")
        done = ended if done is None else done.unionByName(ended)
        todo = todo.where("high > low")
        if todo.isEmpty():
            return done


def leave(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Located strings with edge (the end of the edge that each leaves, null if none), edge_e, and low: the depth where it leaves."""
    key = _at(F.col("low") + 1)
    asked = found.withColumn("_n", key).withColumns({"_n1": F.coalesce("_n.hi", "end.hi"), "_n2": F.coalesce("_n.lo", "end.lo"), "_d": F.when(F.col("_n").isNotNull(), F.col("low")).otherwise(-1)}).drop("_n")
    edges = nodes.select(F.col("a").alias("_a"), F.col("keys")[0]["hi"].alias("_e1"), F.col("keys")[0]["lo"].alias("_e2"), F.col("e").alias("edge_e"), F.col("keys").alias("_edge"))
    met = asked.join(edges.hint("merge"), (F.col("_d") == F.col("_a")) & (F.col("_n1") == F.col("_e1")) & (F.col("_n2") == F.col("_e2")), "left")
    own = F.slice("keys", (F.col("low") - F.col("d0") + 1).cast("int"), F.size("_edge"))
    same = F.size(F.filter(F.zip_with(own, "_edge", lambda p, q: p.eqNullSafe(q)), lambda x: x))  # prefixes: once they differ they stay different
    low = F.col("low") + F.when(F.col("_edge").isNull(), 0).otherwise(same)
    return met.select(*found.columns[:-1], low.alias("low"), F.element_at("_edge", -1).alias("edge"), "edge_e")


def cut(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """nodes with edges cut at places (edge, low), inside the edge whose end is `edge`."""
    at = places.groupBy("edge").agg(F.sort_array(F.collect_set("low")).alias("_cuts"))  # fewer than the edge has depths
    rows = nodes.withColumn("_end", F.element_at("keys", -1)).join(at.hint("merge"), F.col("_end") == F.col("edge"), "left")
    bounds = F.concat(F.array("a"), F.coalesce("_cuts", F.array().cast("array<bigint>")), F.array("e"))
    rows = rows.withColumn("_b", bounds).select(*NODE, "_b", F.explode(F.sequence(F.lit(0), F.size("_b") - 2)).alias("_i"))
    a, e = F.get("_b", F.col("_i")), F.get("_b", F.col("_i") + 1)
    start, n = (a - F.col("a") + 1).cast("int"), (e - a).cast("int")
    before = lambda c, own: F.when(F.col("_i") == 0, F.col(own)).otherwise(F.get(c, start - 2))
    return rows.select(before("keys", "parent").alias("parent"), a.alias("a"), e.alias("e"), before("cums", "w0").alias("w0"), F.slice("keys", start, n).alias("keys"), F.slice("cums", start, n).alias("cums"))


def insert(nodes: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """The nodes of the trie with all strings of new in it. nodes: those of the trie so far; None for an empty one."""
    waiting = new.withColumn("low", F.col("d0"))
    nothing = new.sparkSession.createDataFrame([], NODES)
    while not waiting.isEmpty():
        if nodes is None:
            left = waiting.withColumns({"edge": F.lit(None).cast(KEY), "edge_e": F.lit(None).cast("long")})
        else:
            left = stored(leave(nodes, locate(nodes, waiting)))
        longer = left.where(F.col("d0") + F.size("keys") > F.col("low")).withColumn("next", _at(F.col("low") + 1)).withColumn("luck", F.struct(F.xxhash64("end"), "end"))
        firsts = longer.groupBy("next").agg(F.min("luck").alias("first"))
        ranked = stored(longer.join(firsts.hint("merge"), "next").withColumn("goes", F.col("luck") == F.col("first")).drop("luck", "first", "next"))
        start, n = (F.col("low") - F.col("d0")).cast("int"), F.size("keys")
        tail = lambda c: F.slice(c, start + 1, n).alias(c)
        w0 = F.when(start == 0, F.col("w0")).otherwise(F.get("cums", start - 1))
        leaves = ranked.where("goes").select(_at(F.col("low")).alias("parent"), F.col("low").alias("a"), (F.col("d0") + n).alias("e"), w0.alias("w0"), tail("keys"), tail("cums"))
        kept = nothing if nodes is None else cut(nodes, left.where("low < edge_e").select("edge", "low"))
        nodes = stored(kept.unionByName(leaves))
        waiting = ranked.where("not goes").select(*new.columns, "low")  # all edges were cut where strings left them, so there is a node at `low`
    return nodes


@dataclass
class Trie:
    """nodes: the compacted nodes; ends: where each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def build(convs: DataFrame, turns: DataFrame, size: int = SEGMENT) -> Trie:
    """The trie of conversations (conv_id, length) with turns (conv_id, depth, length, t1, t2, words)."""
    parts = stored(segments(turns, size))
    nodes = insert(None, stored(strings(parts)))
    return Trie(nodes if nodes is not None else convs.sparkSession.createDataFrame([], NODES), stored(ends_of(convs, parts)))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256): SHA-256 of the ids of the conversations that end there, ascending, comma-joined.

    Ids are put in order within ranges of IDS_OF_ROW ids first; a task then only passes such rows on to the digest.
    """
    rows = ends.groupBy("end", F.floor(F.col("conv_id") / IDS_OF_ROW).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("end.hi").alias("hi"), F.col("end.lo").alias("lo"), "range", "ids").repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo", "range")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(batch["hi"].tolist(), batch["lo"].tolist(), batch["ids"], strict=True):
                if at == (hi, lo):
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (hi, lo), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["hi", "lo", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["hi", "lo", "ends_sha256"])

    got = rows.select("hi", "lo", "ids").mapInPandas(digest, "hi bigint, lo bigint, ends_sha256 string")
    return got.select(F.struct("hi", "lo").alias("end"), "ends_sha256")


SUMS = ["n_convs", "n_leaves", "words_of_convs", "words_of_edges"]


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(end, conv_id, *SUMS) for nodes (end, parent, least, *SUMS): the least conv_id and the sums over each one's subtree.

    Each round adds what the descendants 2^k levels below have summed up so far, and doubles the step.
    """
    state = stored(nodes.select("end", F.col("parent").alias("up"), "least", *SUMS))
    while True:
        risen = state.where("up is not null").groupBy(F.col("up").alias("_end")).agg(F.min("least").alias("_least"), *[F.sum(c).alias(f"_{c}") for c in SUMS])
        steps = state.select(F.col("end").alias("_at"), F.col("up").alias("_up")).where("_up is not null")
        more = state.join(risen.hint("merge"), F.col("end") == F.col("_end"), "left")
        state = stored(
            more.join(steps.hint("merge"), F.col("up") == F.col("_at"), "left")
            .select("end", F.col("_up").alias("up"), F.least("least", "_least").alias("least"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS])
        )
        if state.where("up is not null").isEmpty():
            return state.drop("up").withColumnRenamed("least", "conv_id")


def expand(trie: Trie) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the plain trie.

    All depths of an edge have the same conversations. saved_tokens follows from sums over the subtree: the words of its
    conversations below depth d - 1, less the words of its nodes, which are paid once.
    """
    zero, nobody = F.lit(0).cast("long"), F.lit(None).cast("long")
    n_ends = trie.ends.groupBy("end").agg(F.count("*").alias("own"), F.min("conv_id").alias("least"), F.first("cum").alias("cum"))
    root = F.struct(zero.alias("hi"), zero.alias("lo"))
    top = trie.ends.limit(1).select(F.lit(None).cast(KEY).alias("parent"), zero.alias("a"), zero.alias("e"), zero.alias("w0"), F.array().cast(f"array<{KEY}>").alias("keys"), F.array().cast("array<bigint>").alias("cums"), root.alias("end"))
    every = stored(trie.nodes.select(*NODE, F.element_at("keys", -1).alias("end")).unionByName(top))
    children = every.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("n_children"))
    rows = every.select("end", "parent", F.when(F.size("cums") > 0, F.element_at("cums", -1) - F.col("w0")).otherwise(zero).alias("words_of_edges"))
    rows = rows.join(children.hint("merge"), F.col("end") == F.col("_of"), "left").join(n_ends.withColumnRenamed("end", "_e").hint("merge"), F.col("end") == F.col("_e"), "left")
    own = F.coalesce("own", zero)
    rows = stored(rows.select("end", "parent", "least", own.alias("n_convs"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), (own * F.coalesce("cum", zero)).alias("words_of_convs"), "words_of_edges", F.coalesce("n_children", zero).alias("n_children"), F.col("words_of_edges").alias("edge")))
    sums = stored(subtree_sums(rows).join(rows.select(F.col("end").alias("_e"), "n_children", "edge").hint("merge"), F.col("end") == F.col("_e")).drop("_e"))
    full = every.join(sums.withColumnRenamed("end", "_e").hint("merge"), F.col("end") == F.col("_e")).drop("_e")
    full = full.join(sums.select(F.col("end").alias("_p"), F.col("conv_id").alias("parent_conv")).hint("merge"), F.col("parent") == F.col("_p"), "left")
    full = full.join(ends_digest(trie.ends).withColumnRenamed("end", "_d").hint("merge"), F.col("end") == F.col("_d"), "left")
    # of each depth, what the turn before it had summed up in words; the root has one entry, of depth 0
    depths = F.when(F.col("parent").isNull(), F.array(F.struct(zero.alias("d"), zero.alias("w")))).otherwise(
        F.transform(F.concat(F.array("w0"), F.slice("cums", 1, F.greatest(F.lit(0), F.size("cums") - 1))), lambda w, i: F.struct((F.col("a") + 1 + i).alias("d"), w.alias("w")))
    )
    flat = full.select("*", F.explode(depths).alias("at")).select("*", "at.d", "at.w")
    below = F.col("words_of_edges") - F.col("edge")
    here = F.coalesce(F.element_at(F.when(F.size("cums") > 0, F.col("cums")), -1), zero) - F.col("w")
    last = F.col("d") == F.col("e")
    return flat.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("parent").isNull(), nobody).when(F.col("d") == F.col("a") + 1, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("words_of_convs") - F.col("n_convs") * F.col("w") - below - here).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )


def family_trie(convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations of convs (conv_id, turn, role, text); other columns don't matter.

    Null role and text count as empty, null turns come first, equal turns are put in order by their contents, rows
    without conv_id are left out. Repeated rows are turns of their own. Without conversations there is no node, not even
    the root.
    """
    every, turns = families(turns_of(convs.select("conv_id", "turn", "role", "text")))
    return expand(build(every, turns, size))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_trie(table(spark, sf_dir, "conversations"))
