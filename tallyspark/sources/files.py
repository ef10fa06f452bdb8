"""File sources and sinks: NDJSON, envelopes, API pages, CSV ledgers, manifests, write-once publishing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one, on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows written to the shared folder and read back: lineage ends there, and what is read many times is computed once."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, n: int, *keys: str, per_task: int = 1 << 19) -> DataFrame:
    """rows (n of them) dealt by keys over so many tasks that one holds about per_task rows, however large the table is."""
    tasks = max(-(-n // per_task), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (1 << 16))))
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_envelopes(spark: SparkSession, path: str, record: str) -> DataFrame:
    """{source, sync_run_id, fetched_at_ms, record} lines with the record's fields beside the envelope's."""
    rows = read_ndjson(spark, path, f"source string, sync_run_id string, fetched_at_ms bigint, record struct<{record}>")
    return rows.select("source", "sync_run_id", "fetched_at_ms", "record.*", F.col("_metadata.file_path").alias("file"))


def explode_pages(pages: DataFrame, body: str, status: str, element: str) -> DataFrame:
    """Records of the pages with status 200, with their place in the page; other pages give none."""
    items = F.from_json(F.col(body), f"array<{element}>")
    return pages.where(F.col(status) == 200).select(*[c for c in pages.columns if c not in (body, status)], F.posexplode(items).alias("place", "item")).select("*", "item.*").drop("item")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in fixed order with a header."""
    rows.select(*columns).write.option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """zstd Parquet; an empty table is refused."""
    if rows.isEmpty():
        raise ValueError("an empty table is not written")
    writer = rows.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def manifest(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """Per file of NDJSON: records, parse errors, first and last time, length and sha256."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", f"$.{ts}").try_cast("long").alias("t"), F.expr("try_parse_json(value)").isNull().alias("bad"))
    counts = lines.groupBy("file").agg(F.count("*").alias("records"), F.count_if("bad").alias("parse_errors"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"))
    content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return content.withColumn("file", plain("file")).join(counts.withColumn("file", plain("file")), "file", "left")


def schema_profile(lines: DataFrame, text: str, expected: list[str]) -> DataFrame:
    """Per field of JSON lines: how many have it, and whether it is expected; expected fields that none has count 0."""
    seen = lines.select(F.explode(F.map_keys(F.from_json(text, "map<string,string>"))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    names = lines.sparkSession.createDataFrame([(f,) for f in expected], "field string").withColumn("expected", F.lit(True))
    out = seen.join(names, "field", "full_outer").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("expected", F.coalesce("expected", F.lit(False)))
    return out.withColumn("status", F.when(~F.col("expected"), "UNKNOWN").when(F.col("n") == 0, "MISSING").otherwise("OBSERVED"))


def publish_once(rows: DataFrame, path: str, key: list[str]) -> str:
    """Write rows to path: PUBLISHED the first time, SAME if the content is equal; changed content is an error."""
    spark = rows.sparkSession
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(1 << 40))).alias("h")).first()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        if digest(spark.read.parquet(path)) != digest(rows):
            raise ValueError(f"{path} holds other content")
        return "SAME"
    rows.sort(*key).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return "PUBLISHED"
