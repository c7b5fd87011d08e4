"""Readers and normalisers of input tables, and writers of results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from windrow.config import LabelParams
from windrow.functions.columns import flag, safe_int
from windrow.operators.packets import clean_packets
from windrow.schemas import ENRICHED_RECORD, PACKET, PAYLOAD, RECORD, RICH_TEXT
from windrow.storage import stored


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return clean_packets(spark.read.schema(PACKET).parquet(path))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """A dissector's field table in CSV, all columns as text."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _field(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in df.columns else F.lit("")


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def normalise_packets(df: DataFrame) -> DataFrame:
    """Packet rows of a field table; rows without a readable frame, time, address or protocol number go."""
    f = lambda name: _field(df, name)
    got = df.select(
        *[c for c in ("capture_id",) if c in df.columns], f("frame.number").try_cast("double").try_cast("long").alias("frame_number"), f("frame.time_epoch").try_cast("double").alias("ts"),
        F.when(f("ip.proto").rlike(r"^[+-]?\d+$"), f("ip.proto").try_cast("int")).alias("proto"), F.nullif(f("ip.src"), F.lit("")).alias("src_ip"), F.nullif(f("ip.dst"), F.lit("")).alias("dst_ip"),
        safe_int(_first(f("tcp.srcport"), f("udp.srcport"))).cast("int").alias("src_port"), safe_int(_first(f("tcp.dstport"), f("udp.dstport"))).cast("int").alias("dst_port"),
        safe_int(f("frame.len")).cast("int").alias("pkt_len"),
        *[flag(f(f"tcp.flags.{n}")).cast("int").alias(f"tcp_{a}") for n, a in (("syn", "syn"), ("ack", "ack"), ("fin", "fin"), ("reset", "rst"), ("push", "psh"))],
        safe_int(f("tcp.window_size_value")).cast("int").alias("tcp_window"), F.lower(F.trim(F.replace(f("data.data"), F.lit(":"), F.lit("")))).alias("payload_hex"),
    )
    return got.na.drop(subset=["frame_number", "ts", "proto", "src_ip", "dst_ip"])


def normalise_payload(df: DataFrame) -> DataFrame:
    """Payload and context rows of a field table: the first payload that there is, its length, stacks with `>`, answers with `;`."""
    f = lambda name: _field(df, name)
    raw = F.lower(F.replace(_first(f("data.data"), f("tcp.payload"), f("udp.payload")), F.lit(":"), F.lit("")))
    answers = F.concat_ws(";", *[F.nullif(F.replace(f(n), F.lit(","), F.lit(";")), F.lit("")) for n in ("dns.a", "dns.aaaa")])
    plain = {
        "rich_http_method": "http.request.method", "rich_http_uri": "http.request.uri", "rich_http_host": "http.host", "rich_http_user_agent": "http.user_agent",
        "rich_http_status_code": "http.response.code", "rich_http_status_phrase": "http.response.phrase", "rich_dns_query": "dns.qry.name", "rich_dns_qtype": "dns.qry.type",
        "rich_tls_server_name": "tls.handshake.extensions_server_name", "rich_tls_handshake_type": "tls.handshake.type", "rich_tls_content_type": "tls.record.content_type", "rich_tls_version": "ssl.record.version",
    }
    named = {k: f(v) for k, v in plain.items()} | {"rich_frame_protocols": F.replace(f("frame.protocols"), F.lit(":"), F.lit(">")), "rich_dns_answers": answers}
    got = df.select(
        *[c for c in ("capture_id",) if c in df.columns], f("frame.number").try_cast("double").try_cast("long").alias("frame_number"), raw.alias("rich_payload_hex"),
        F.expr("0").alias("rich_payload_len"), *[named[c].alias(c) for c in RICH_TEXT],
    )
    return got.withColumn("rich_payload_len", F.expr("length(rich_payload_hex) div 2").cast("int")).where(F.col("frame_number").isNotNull())


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """A payload table in Parquet, or in CSV by its ending; frame_number must be there."""
    if path.endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        df = spark.read.parquet(path)
    if "frame_number" not in df.columns:
        raise ValueError("the payload table has no frame_number")
    types = dict(x.rsplit(" ", 1) for x in PAYLOAD.split(", "))
    df = df.select([F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    return df.na.fill("", [c for c in df.columns if types.get(c) == "string"]).na.fill(0, [c for c in ("rich_payload_len",) if c in df.columns])


def read_labels(spark: SparkSession, path: str, params: LabelParams) -> DataFrame:
    """Ground truth in CSV: addresses as text, ports and protocol as numbers, columns by the data set's names."""
    df = spark.read.option("header", True).csv(path)
    name = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.select(
        name(params.label).alias("label"), name(params.start).alias(params.start), name(params.end).alias(params.end), name(params.src_ip).alias("src_ip"), name(params.dst_ip).alias("dst_ip"),
        safe_int(name(params.src_port)).cast("int").alias("src_port"), safe_int(name(params.dst_port)).cast("int").alias("dst_port"), safe_int(name(params.protocol)).cast("int").alias("proto"),
        F.coalesce(name(params.capture_id), F.lit("")).alias("label_capture_id"), F.coalesce(name(params.flow_id), F.lit("")).alias("label_flow_id"),
    )


def read_records(spark: SparkSession, path: str, enriched: bool = False, tolerant: bool = True) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped; tolerant also skips malformed lines and missing labels."""
    schema = (ENRICHED_RECORD if enriched else RECORD) + ", _corrupt_record string"
    df = spark.read.schema(schema).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.where(F.col("_corrupt_record").isNull() & F.col("label").isNotNull()).drop("_corrupt_record") if tolerant else df.drop("_corrupt_record")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, numbered by file from 1.

    Files are read in blocks, many tasks to a file. A block's lines are in order, so a line's number is its place in the
    block and the number of lines in the blocks before it.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = stored(read)
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = rows.join(blocks.withColumn("before", before).drop("n"), ["file", "block"])
    return numbered.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "val", "test"), enriched: bool = False) -> DataFrame:
    """features_{split} or features_enriched_{split} tables of a folder in one, with split; missing ones are skipped."""
    out = None
    for name in names:
        try:
            one = spark.read.parquet(f"{folder}/features_{'enriched_' if enriched else ''}{name}.parquet").withColumn("split", F.lit(name))
        except AnalysisException:
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no split table in {folder}")
    return out


def read_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, text) of log files; the run is the name of a file's folder."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select(F.element_at(F.split("path", "/"), -2).alias("run"), "text")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as {name}.parquet in the folder, over an old one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_splits(df: DataFrame, folder: str, names: tuple[str, ...] = ("train", "val", "test"), enriched: bool = False) -> None:
    """Each split as features_{split} or features_enriched_{split}, over old ones; rows of other splits are left out.

    df is evaluated once: its rows are written by split into a folder beside, whose parts are then renamed. A split
    without rows becomes an empty table.
    """
    spark = df.sparkSession
    beside = f"{folder}/_splits-{uuid.uuid4().hex}"
    df.where(F.col("split").isin(*names)).withColumn("_split", F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("split"))).drop("split").write.partitionBy("_split").parquet(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(names):
        part, target = path(f"{beside}/_split={i}"), f"{folder}/features_{'enriched_' if enriched else ''}{name}.parquet"
        files.delete(path(target), True)
        if files.exists(part):
            files.rename(part, path(target))
        else:
            spark.createDataFrame([], df.drop("split").schema).write.parquet(target)
    files.delete(path(beside), True)


def write_bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, path: str | None = None) -> DataFrame:
    """df as a table of the catalog in `buckets` buckets by the keys, sorted by them, over an old one; returns the table.

    Tables of as many buckets by the same keys are joined on them, or grouped by them, without a shuffle. With a path
    the files go there, else into the warehouse. Rows are dealt out by bucket first, so each bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_lines(df: DataFrame, json_text: Column, path: str) -> None:
    """One text line for each row, in the table's order."""
    df.select(json_text.alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.orderBy("index").drop("index").write.mode("overwrite").json(path)


def write_stats(one_row: DataFrame, path: str) -> None:
    one_row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
