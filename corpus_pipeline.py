"""From raw documents to packed training sequences: language ID, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, materialize
from tallyspark.llm.jaccard_join import jaccard_join
from tallyspark.llm.language_id import predict, train
from tallyspark.llm.mixing import mix
from tallyspark.llm.packing import pack
from tallyspark.llm.queries import END_ID, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no text, no letter); lang becomes the predicted language."""
    model = train(docs.select("text", "lang"))
    found = predict(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """COLUMNS of docs with a number for each row, row_key, written down so that it stays; ids may be null or repeated."""
    return materialize(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), label)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies: the one with the smallest id (nulls last; of equal ids the smallest text hash).

    Rows are told apart by their place in the table: rows with a null id, or with the id of another
    row, stay unless their texts are near copies.
    """
    docs = numbered(docs, "numbered")
    members, _ = jaccard_join(docs.select(F.col("row_key").alias("doc_id"), "text"))
    members = members.where("component is not null").select(F.col("doc_id").alias("row_key"), "component")
    order = docs.select("row_key", "doc_id", F.xxhash64("text").alias("h"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row_key")
    first = members.join(order, "row_key").groupBy("component").agg(F.min(rank).alias("first")).select("first.row_key")
    dropped = members.join(first, "row_key", "left_anti").select("row_key")
    return docs.join(dropped, "row_key", "left_anti").select(*COLUMNS)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources with weights 1, 2, 3 in turn: for each pass over a document the words that the mix takes.

    A document taken whole keeps its text as it is; of one taken in part the taken words stay, joined by spaces.
    Ids may be null or repeated.
    """
    docs = numbered(docs, "blended")
    rows, _, spans = mix(docs.select("doc_id", "source", "text", "row_key"), lambda i, _: 1.0 + i % 3)
    runs = spans.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("runs"), F.sum("words").alias("taken"))
    runs = runs.join(rows.select("row", "row_key", "size"), "row")
    whole = runs.select("row_key", "runs", (F.col("taken") == F.col("size")).alias("whole"))
    texts = docs.join(whole, "row_key")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["start"].cast("int") + 1, r["words"].cast("int")))), " ")
    texts = texts.withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(part))
    return texts.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row per piece."""
    return pack(docs, tokenizer_path(), END_ID)


STAGES = [("language ID", language), ("n-gram Jaccard join", deduplicate), ("mixing", blend), ("packing", pack_sequences)]
#: Language ID, mixing and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
