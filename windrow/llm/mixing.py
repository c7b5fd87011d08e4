"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source gets the same expected number of copies, target / source size. Its whole part is taken for
sure; the fractional parts are rounded together: two documents trade words at random until one of them is at 0 or 1,
so that their words and their expectations stay, and the other one goes on as the residual. Blocks of documents are
folded side by side, then blocks of their residuals, up a tree, until each source has one residual, which is rounded
by itself. So the words a source gives miss its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import WORD, checkpointed, stored, table

#: Weights of the sources in order, repeating; share of all words that the mix takes; most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 42
#: Documents, or residuals, of one fold; documents of one sorted bin.
BLOCK = 128
BIN = 8192
NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark): size counts the words of text; null texts have none. mark tells texts apart whose ids are alike."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target), a row for each source.

    Sources in order of code points, null last, bear the weights in turn. Targets are proportional to weights, but
    those above `most` times the source's size stop there, and the excess goes to the others by weight: the level per
    weight is found from running sums over the sources in order of the level at which they stop. The windows here run
    over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(most)).withColumn("stop", F.col("cap") / F.col("weight"))
    order = Window.orderBy("stop", "place")
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) * share - F.sum("cap").over(order) + F.col("cap")
    open_weight = F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")
    per = per.withColumns({"left": left, "open": open_weight})
    held = F.when(F.col("left") / F.col("open") <= F.col("stop"), F.struct("stop", "place", "left", "open"))
    per = per.withColumn("level", F.min(held).over(everything))
    target = F.least("cap", F.col("level.left") * F.col("weight") / F.col("level.open"))
    return per.select("source", "source_size", "n_docs", F.coalesce(target, F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


ITEM = "struct<size:bigint,p:double,doc_id:{0},rn:bigint,bin:bigint>"
STATE = "struct<rest:{1},done:array<struct<doc_id:{0},size:bigint,take:int>>>"


def _done(x: Column, take: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), take.cast("int").alias("take"))


def _with_p(x: Column, p: Column) -> Column:
    snapped = F.when(p < NEAR, F.lit(0.0)).when(p > 1 - NEAR, F.lit(1.0)).otherwise(p)
    return F.struct(x["size"].alias("size"), snapped.alias("p"), x["doc_id"].alias("doc_id"), x["rn"].alias("rn"), x["bin"].alias("bin"))


def _trade(acc: Column, x: Column) -> Column:
    """One pivotal step between the residual and the next document: struct(rest, done)."""
    a = acc["rest"]
    ratio = a["size"] / x["size"]
    up = F.least(1 - a["p"], x["p"] / ratio)
    down = F.least(a["p"], (1 - x["p"]) / ratio)
    chance = F.struct(up.alias("up"), down.alias("down"), ratio.alias("ratio"), _uniform(a["rn"], a["bin"], x["rn"], x["bin"]).alias("u"))

    def outcome(v: Column) -> Column:
        rises = v["u"] * (v["up"] + v["down"]) < v["down"]
        full = rises & (v["up"] >= 1 - a["p"])
        empty = ~rises & (v["down"] >= a["p"])
        p_x = F.when(rises, x["p"] - v["up"] * v["ratio"]).otherwise(x["p"] + v["down"] * v["ratio"])
        p_a = F.when(rises, a["p"] + v["up"]).otherwise(a["p"] - v["down"])
        settled = full | empty
        return F.struct(
            F.when(settled, _with_p(x, p_x)).otherwise(_with_p(a, p_a)).alias("rest"),
            F.when(settled, _done(a, full)).otherwise(_done(x, ~rises)).alias("done"),
        )

    return _let(chance, outcome)


def _fold(items: Column, id_type: str) -> Column:
    """Folds the items of a block, largest first, into struct(rest, done); rest may be integral already."""
    item = ITEM.format(id_type)
    ordered = F.sort_array(items, asc=False)
    start = F.struct(F.element_at(ordered, 1).cast(item).alias("rest"), F.array().alias("done")).cast(STATE.format(id_type, item))

    def step(acc: Column, x: Column) -> Column:
        integral = (acc["rest"]["p"] <= 0) | (acc["rest"]["p"] >= 1)
        moved = F.when(integral, F.struct(_with_p(x, x["p"]).alias("rest"), _done(acc["rest"], acc["rest"]["p"] >= 1).alias("done"))).otherwise(_trade(acc, x))
        return _let(moved, lambda m: F.struct(m["rest"].alias("rest"), F.concat(acc["done"], F.array(m["done"])).alias("done"))).cast(STATE.format(id_type, item))

    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), start, step)


def round_copies(parts: DataFrame) -> DataFrame:
    """(source, doc_id, size, take) for each row of (source, doc_id, size > 0, mark, 0 < p < 1, n_docs): take is 0 or 1.

    Documents go to bins of about BIN by a hash, and are numbered within a bin; every BLOCK numbers are one fold.
    """
    id_type = dict(parts.dtypes)["doc_id"]
    mixed = F.xxhash64(F.lit(SEED), "doc_id", "size", "mark")
    bins = F.ceil(F.col("n_docs") / BIN)
    rows = parts.withColumns({"h": mixed, "bin": F.pmod(mixed, bins)})
    number = F.row_number().over(Window.partitionBy("source", "bin").orderBy("h", "doc_id", "size")).cast("long") - 1
    rows = rows.withColumn("rn", number).withColumn("block", F.floor(F.col("rn") / BLOCK))
    item = F.struct("size", "p", "doc_id", "rn", "bin").cast(ITEM.format(id_type)).alias("item")
    level = rows.select("source", F.col("bin").alias("top"), "block", item)
    out = []
    while True:
        folded = level.groupBy("source", "top", "block").agg(F.collect_list("item").alias("items"))
        folded = stored(folded.select("source", "top", "block", _fold(F.col("items"), id_type).alias("f")))
        out.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*"))
        block, top = folded.agg(F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.max("top"), F.lit(0))).first()
        if not block and not top:
            break
        up = ("top", F.col("top")), ("block", F.floor(F.col("block") / BLOCK))
        if not block:
            up = ("top", F.floor(F.col("top") / BLOCK)), ("block", F.col("block"))
        level = folded.select("source", *[c.alias(n) for n, c in up], F.col("f.rest").alias("item"))
    last = F.col("f.rest")
    take = (_uniform(last["rn"], last["bin"], F.lit(-1)) < last["p"]).cast("int")
    out.append(folded.select("source", last["doc_id"].alias("doc_id"), last["size"].alias("size"), take.alias("take")))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of (doc_id, source, text).

    Null and empty texts have size 0 and are taken 0 times. A null source is a source, the last one. Rows that repeat
    are rounded one by one. The same rows give the same result, however they are dealt. An empty table gives no row.
    """
    sized = checkpointed(sizes(docs))
    goals = checkpointed(targets(sized, weights, share, most), sized.count())
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = goals.select(F.col("source").alias("_s"), "n_docs", "source_size", "target", share_of.alias("rate"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    rows = sized.join(rates.select("_s", "n_docs", "rate"), same).withColumn("p", F.col("rate") - F.floor("rate"))
    rounds = (F.col("size") > 0) & (F.col("p") >= NEAR) & (F.col("p") <= 1 - NEAR)
    taken = round_copies(rows.where(rounds).select("source", "doc_id", "size", "mark", "p", "n_docs"))
    whole = rows.where(~rounds).select("source", "doc_id", "size", F.when(F.col("size") > 0, F.round("p")).otherwise(0).cast("int").alias("take"))
    every = taken.unionByName(whole).join(rates, same)
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.col("take")).otherwise(F.lit(0)).cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
