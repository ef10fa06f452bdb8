"""Closed-syncmer fingerprints of texts, with DataFrame functions only.

Units are lower-cased words. Of every k-mer of words the inner s-mers are hashed; the k-mer is an
anchor if the smallest of them is its first or its last. Whether a k-mer is an anchor depends on its
own words alone, so texts that share a passage share the anchors inside it, in the same order.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, ascii_lower, bucket_count, materialize

#: Words of a k-mer and of an inner s-mer; a k-mer has K - S + 1 = 4 inner s-mers.
K, S = 5, 2
#: Common anchors at one shift from which a shift counts as a match.
MATCHES = 3
#: Zones of the document order in which neighbours are found, at most.
MOST_ZONES = 10_000


def _neighbours(values: Column, distance: int, f) -> Column:
    """f(values[i], values[i + distance]) for every i that has both."""
    n = F.greatest(F.size(values) - distance, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, distance + 1, n), f)


def with_anchors(df: DataFrame, text: str, anchors: str) -> DataFrame:
    """df with the column anchors: array<int> of the anchors of a text column, in the text's order.

    Fewer than K words, but one at least, make a single anchor of them all; null and empty texts and
    texts without words have none. A passage that a text repeats gives its anchors each time.
    """
    df = df.withColumn("_words", F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    df = df.withColumn("_s", _neighbours(F.col("_h"), 1, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_m", _neighbours(F.col("_s"), 1, lambda a, b: F.least(a, b)))
    df = df.withColumn("_m", _neighbours(F.col("_m"), 2, lambda a, b: F.least(a, b)))
    s = lambda i: F.get("_s", i)
    pick = F.transform("_m", lambda m, i: F.when((m == s(i)) | (m == s(i + 3)), F.hash(s(i), s(i + 2), F.get("_h", i + 4))))
    n = F.size("_h")
    found = F.when(n >= K, F.array_compact(pick)).when(n > 0, F.array(F.hash("_h"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(anchors, found).drop("_h", "_s", "_m")


def fingerprint(anchors: Column) -> Column:
    """Anchors as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(F.pmod(a.cast("long"), F.lit(1 << 32)))), 8, "0")), "")


def _once(value: Column, f) -> Column:
    """f(value) where f uses the value in lambdas: it is computed once, not for each element."""
    return F.transform(F.array(value), f)[0]


def likeness(a: Column, b: Column) -> Column:
    """Positional likeness of two anchor lists, 0 to 1: matched / (size a + size b - matched), sizes without repeats; two empty lists are alike.

    Common anchors (each at its first place in either list) match where they keep their places: at a shift between
    the lists that MATCHES of them share (all of them, if one list has fewer). Common words out of order don't match.
    """
    tagged = lambda c, side: F.transform(c, lambda h, i: F.struct(h.alias("h"), F.lit(side).alias("s"), i.alias("i")))
    placed = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    other = lambda x, y: (x["h"] != y["h"]) | (x["s"] != y["s"])
    firsts = _once(placed, lambda t: F.filter(t, lambda x, i: F.when(i > 0, other(F.get(t, i - 1), x)).otherwise(F.lit(True))))

    def share(t: Column) -> Column:
        follows = lambda i: F.get(t, i + 1)
        shifts = F.sort_array(F.array_compact(F.transform(t, lambda x, i: F.when((x["s"] == 0) & (follows(i)["h"] == x["h"]), follows(i)["i"] - x["i"]))))
        n_a = F.size(F.filter(t, lambda x: x["s"] == 0))
        n_b = F.size(t) - n_a
        least = F.least(F.lit(MATCHES), n_a, n_b)
        closed = lambda s: s["n"] + F.when(s["run"] >= least, s["run"]).otherwise(F.lit(0))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(0).alias("at"))
        step = lambda s, d: F.when((s["run"] > 0) & (s["at"] == d), F.struct(s["n"].alias("n"), (s["run"] + 1).alias("run"), d.alias("at"))).otherwise(F.struct(closed(s).alias("n"), F.lit(1).alias("run"), d.alias("at")))
        matched = F.aggregate(shifts, start, step, closed)
        return F.when(n_a + n_b == 0, 1.0).otherwise(_once(matched, lambda m: m / (n_a + n_b - m))).cast("double")

    return _once(firsts, share)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the next row by (doc_id, hash of text); after the last comes the first.

    Rows are dealt into zones of the id order; every zone also gets a copy of the next zone's first
    row, so neighbours are found inside zones. Null ids come first.
    """
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    n = docs.count()
    if not n:
        return docs.drop("_tie").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    zones = min(2 * bucket_count(n), MOST_ZONES)
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / zones for i in range(1, zones)], 10 * zones).alias("b")).first()["b"] or []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))
    zoned = Bucketizer(splits=splits, inputCol="_at", outputCol="_zone").transform(docs.withColumn("_at", at)).drop("_at")
    low = F.coalesce("doc_id", F.lit(-(2**63)))
    firsts = zoned.groupBy("_zone").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), low.alias("id"), F.col("_tie").alias("tie"))).alias("f")).orderBy("_zone").collect()
    before = [firsts[i - 1]["_zone"] for i in range(len(firsts))]
    table = docs.sparkSession.createDataFrame([(r["f"]["has"], r["f"]["id"], r["f"]["tie"], z) for r, z in zip(firsts, before, strict=True)], "_has boolean, _id long, _ft long, _also double")
    zoned = zoned.join(F.broadcast(table), (F.col("doc_id").isNotNull() == F.col("_has")) & (low == F.col("_id")) & (F.col("_tie") == F.col("_ft")), "left").drop("_has", "_id", "_ft")
    copies = F.array_compact(F.array(F.struct(F.lit(False).alias("copy"), F.col("_zone").alias("zone")), F.when(F.col("_also").isNotNull(), F.struct(F.lit(True).alias("copy"), F.col("_also").alias("zone")))))
    dealt = zoned.withColumn("_in", F.explode(copies)).select("*", F.col("_in.copy").alias("_copy"), F.col("_in.zone").alias("_of")).drop("_in", "_zone", "_also")
    over = Window.partitionBy("_of").orderBy("_copy", F.asc_nulls_first("doc_id"), "_tie")
    out = dealt.select("*", *[F.lead(c).over(over).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_copy")).drop("_copy", "_of", "_tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and anchors (array<int>) of every row of docs (doc_id, text); null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_anchors(rows, "text", "anchors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprints() with edited_text, edited_anchors and next_anchors.

    The edited text has the last half of its code points replaced by as many of the next document's
    first ones. A table of one row is its own next document; an empty table gives no rows. Repeated
    rows and equal ids follow one another in the order of their texts' hashes.
    """
    rows = with_next(fingerprints(docs), ["text", "anchors"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited_text", edited).drop("next_text")
    return with_anchors(rows, "edited_text", "edited_anchors")
