"""Exact self-join of documents on the Jaccard similarity of word n-gram sets.

Method: inverted lists over the rarest tokens of each set (prefix filter). Entries carry the most that
they can still share from their position on; blocks of a list whose bounds cannot reach each other are
skipped, and so are entries that no entry of another component can reach. In a family of near copies
one set, the pivot, is compared with every other; the rest of the answers is derived from the
differences to the pivot: with p the pivot, d(x) the tokens in one of x and p only,

    |a & b| = |p| - |p - a| - |p - b| + |d(a) & d(b)|,

so lists over the small d(x) find the linked pairs of a family, and members linked with the pivot need
no pair at all.

Nodes are classes of documents with equal sets, so exact copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize, semi_join_sized
from tallyspark.llm.components import connected_components, extended_components
from tallyspark.llm.hashing import set_key, shingle_sets, sub_batches

#: Tokens known as frequent before the lists are built; they steer the token order, never the result.
FREQUENT_TOKENS = 1 << 18
#: Tokens whose hashes lie below this share of all hashes come first in the token order, rarest first.
RANKED_SHARE = 0.3
#: Tokens counted together inside a task, and entries of one slice of the inverted lists.
COUNTED_TOGETHER = 1 << 22
SLICE_ENTRIES = 150_000
#: Pairs of one pivot that are verified in one group, and about the tokens of sets that one group verifies.
PAIRS_TOGETHER = 64
BUCKET_TOKENS = 250_000
#: Each next block of a list holds entries with weights larger by this factor.
BLOCK_STEP = 1.1

_SET_SCHEMA = "doc_id long, text_key long, n_shingles long, n_ranked long, set_id long, token long, seen long"


def _sets(width: int):
    """Per row its set's size and identity; per stretch of rows the tokens that three or more rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("n_ranked", pa.int64()), ("set_id", pa.int64()), ("token", pa.int64()), ("seen", pa.int64())])

        def frequent() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            tokens, seen = tokens[seen >= 3].view(np.int64), seen[seen >= 3]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(tokens), pa.array(seen)], schema=schema)

        for whole in batches:
            for batch in sub_batches(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_ranked(s, RANKED_SHARE) for s in sets], pa.int64()), keys, none, none], schema=schema)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED_TOGETHER:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return run


_ENTRY = np.dtype([("token", "<u8"), ("set_id", "<i8"), ("key", "<i4")])
#: Entries whose key is 0, without it; tokens are told apart by 48 bits in the lists.
_SHORT = np.dtype([("low", "<u4"), ("high", "<u2"), ("set_id", "<i8")])
_TOKEN_BITS = np.uint64(16)


def _entries(width: int, percent: int, slices: int, frequent, share: float):
    """Packed entries per slice of the token space; tokens known as frequent go apart, salted.

    The token order: tokens with small hashes (share of all) by (number of sets, hash), then the
    others by hash. A set of n tokens needs the first n - ceil(n * percent / 100) + 1 of that order, so
    its ranked tokens, and more by hash if these are fewer, are sent. key is the number of sets of a
    token known as frequent, 0 for what the lists will count, and -1 - position of an unranked token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        parts, size, done = [], 0, set()

        def packed(salt: int) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts)
            for some, group in ((rows[rows["key"] == 0], -1), (rows[rows["key"] < 0], -2), (rows[rows["key"] > 0], salt % 64)):
                where = (some["token"] % np.uint64(slices)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                where, some = where[order], some[order]
                if group == -1:
                    short = np.empty(len(some), _SHORT)
                    short["low"], short["high"], short["set_id"] = some["token"] & np.uint64(0xFFFFFFFF), some["token"] >> np.uint64(32), some["set_id"]
                    some = short
                cut = np.flatnonzero(np.diff(where)) + 1
                ids = where[np.concatenate([[0], cut])] if len(where) else where
                data = [x.tobytes() for x in np.split(some, cut)] if len(where) else []
                yield pa.RecordBatch.from_pydict({"slice": ids, "salt": np.full(len(ids), group, np.int64), "entries": pa.array(data, pa.binary())})

        for whole in batches:
            for batch in sub_batches(whole, "text"):
                for s in shingle_sets(batch.column("text"), width):
                    if not len(s) or (key := set_key(s)) in done:
                        continue
                    done.add(key)  # the lists of one task hold a set once
                    ranked = _ranked(s, share)
                    p = max(ranked, _prefix(len(s), percent))
                    rows = np.empty(p, _ENTRY)
                    rows["token"], rows["set_id"], rows["key"] = s[:p] >> _TOKEN_BITS, key, 0
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s[:ranked]), len(tokens) - 1)
                        rows["key"][:ranked] = np.where(tokens[at] == s[:ranked], counts[at], 0)
                    rows["key"][ranked:] = -1 - np.arange(ranked, p)
                    parts.append(rows)
                    size += p
                if size >= 500_000:
                    yield from packed(key & 0xFFFF)
                    parts, size = [], 0
        if parts:
            yield from packed(key & 0xFFFF)

    return run


def _ranked(s: np.ndarray, share: float) -> int:
    """How many of a set's sorted tokens lie below that share of all hashes."""
    return len(s) if share >= 1 else int(np.searchsorted(s, np.uint64(int(share * 2**64))))


def _prefix(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _shared(slice_rows: pd.DataFrame) -> pd.DataFrame:
    """Entries of one slice whose token at least two sets hold, with that number as key.

    Groups of unranked entries (salt -2) keep their key; salted groups of frequent tokens are kept as they are.
    """
    salt, data = slice_rows["salt"].iloc[0], b"".join(slice_rows["entries"])
    if salt == -1:
        short = np.frombuffer(data, _SHORT)
        rows = np.zeros(len(short), _ENTRY)
        rows["token"], rows["set_id"] = (short["high"].astype(np.uint64) << np.uint64(32)) | short["low"], short["set_id"]
    else:
        rows = np.frombuffer(data, _ENTRY)
    rows = np.unique(rows)
    if salt < 0 and len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
        n = np.diff(np.concatenate([first, [len(rows)]]))
        many = np.repeat(n, n)
        if salt == -1:
            rows["key"] = many
        rows = rows[many > 1]
    return pd.DataFrame({"token": rows["token"].astype("<i8"), "set_id": rows["set_id"], "key": rows["key"].astype("int64")})


def _can_link(percent: int) -> Column:
    """The position filter: entries (n, pos) and (n2, pos2) of one token can belong to linked sets."""
    most = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return 100 * most >= percent * (F.col("n") + F.col("n2") - most)


def _overlaps(width: int, differences: bool):
    """For the pivots (left) and their partners (right) of one bucket the numbers of common tokens, and the differences if asked for.

    A partner that differs from its pivot by more tokens than it has gets no differences.
    """

    def run(pivots: pd.DataFrame, partners: pd.DataFrame) -> pd.DataFrame:
        own, out = {}, []
        for i in range(0, len(pivots), 64):
            some = pivots.iloc[i : i + 64]
            own |= dict(zip(some["pivot"].tolist(), shingle_sets(pa.array(some["pivot_text"], pa.string()), width), strict=True))
        for i in range(0, len(partners), 64):
            some = partners.iloc[i : i + 64]
            for a, b, s in zip(some["a"].tolist(), some["b"].tolist(), shingle_sets(pa.array(some["text"], pa.string()), width), strict=True):
                p = own[a]
                at = np.minimum(np.searchsorted(p, s), len(p) - 1)
                c = int((p[at] == s).sum())
                near = differences and len(p) <= 2 * c
                out.append((a, b, c, len(p), len(s), np.setxor1d(p, s, assume_unique=True).view(np.int64) if near else None))
        out = pd.DataFrame(out, columns=["a", "b", "common", "n_a", "n_b", "apart"])
        return out if differences else out.drop(columns="apart")

    return run


def _meet(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, label: str, differences: bool = False) -> DataFrame:
    """a, b, common, n_a, n_b (and apart) of pairs (a, b) of classes: their texts are fetched once, then met in buckets of pivots.

    A pivot with many partners is in several buckets.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = materialize(ids.join(classes.select("set_id", "text_key", "n_shingles"), "set_id"), f"{label}-wanted")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("tokens")).first()
    some = semi_join_sized(texts, wanted.select("text_key").distinct(), "text_key", size["n"])
    held = some.groupBy("text_key").agg(F.first("text").alias("text"))
    held = materialize(wanted.select("set_id", "text_key").join(held, "text_key").select("set_id", "text"), f"{label}-texts")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).alias("salts"))
    buckets = int(max(64, size["tokens"] // BUCKET_TOKENS))
    salt = F.pmod(F.xxhash64("b"), F.col("salts"))
    pairs = materialize(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("a", salt), F.lit(buckets)).alias("bucket")), f"{label}-pairs")
    right = pairs.join(held.select(F.col("set_id").alias("b"), "text"), "b")
    left = pairs.select(F.col("bucket").alias("place"), F.col("a").alias("pivot")).distinct().join(held.select(F.col("set_id").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    tasks = max(32, buckets // 4)
    met = left.repartition(tasks, "place").groupBy("place").cogroup(right.repartition(tasks, "bucket").groupBy("bucket"))
    met = met.applyInPandas(_overlaps(width, differences), "a long, b long, common long, n_a long, n_b long" + (", apart array<long>" if differences else ""))
    return materialize(met, f"{label}-met")


def _lists(docs: DataFrame, classes: DataFrame, width: int, percent: int, frequent, share: float, total: int) -> DataFrame:
    """(token, set_id, n, pos): the inverted lists over the prefixes of docs' sets (text), of tokens that several hold.

    pos is an entry's place in its set's order. Ranked tokens that one set holds alone come first and are
    not listed. total: tokens of all sets. share: see RANKED_SHARE.
    """
    slices = max(16, int(total * max(share, 1 - percent / 100) / SLICE_ENTRIES))
    packed = docs.select("text").mapInArrow(_entries(width, percent, slices, frequent, share), "slice long, salt long, entries binary")
    entries = packed.groupBy("slice", "salt").applyInPandas(_shared, "token long, set_id long, key long").distinct()
    ranked = F.col("n_shingles") if share >= 1 else F.col("n_ranked")
    entries = entries.join(classes.select("set_id", F.col("n_shingles").alias("n"), ranked.alias("n_ranked")), "set_id")
    over = Window.partitionBy("set_id", F.col("key") > 0)
    place = F.row_number().over(over.orderBy("key", "token")) - 1 + F.col("n_ranked") - F.count("*").over(over)
    entries = entries.withColumn("pos", F.when(F.col("key") > 0, place).otherwise(-1 - F.col("key")).cast("long"))
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return materialize(entries.where(F.col("pos") < prefix).select("token", "set_id", "n", "pos"), "lists")


def _open_sets(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets of lists that hold several components."""
    named = _named(lists, labels)
    several = named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return named.join(several.select("token"), "token", "left_semi").select("set_id").distinct()


def _named(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """sets with each one's component so far."""
    named = sets.join(labels.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    return named.withColumn("component", F.coalesce("component", "set_id"))


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for sets b, the pivot a that heads most of b's lists.

    Lists are taken by bands of sizes; the head of a list is its set that shares most tokens with others.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    banded = lists.withColumn("band", band)
    held = banded.groupBy("token", "band").agg(F.count("*").alias("held")).where("held > 1")
    banded = banded.join(held, ["token", "band"])
    degree = banded.groupBy("set_id").agg(F.sum("held").alias("degree"))
    banded = materialize(banded.join(degree, "set_id"), "banded")
    heads = banded.groupBy("token", "band").agg(F.max(F.struct("degree", "set_id", "n", "pos")).alias("head"))
    heads = heads.select("token", "band", F.col("head.set_id").alias("a"), F.col("head.n").alias("n2"), F.col("head.pos").alias("pos2"))
    near = banded.join(heads, ["token", "band"]).where((F.col("set_id") != F.col("a")) & _can_link(percent))
    near = near.groupBy("set_id", "a").agg(F.count("*").alias("votes"))
    return near.groupBy("set_id").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", F.col("set_id").alias("b"))


def _families(met: DataFrame, open_sets: DataFrame) -> DataFrame:
    """(a, b): open sets b with the pivot a of their family, a itself among them; families of two or more.

    Sets that share less than half of their pivot are in no family. A pivot that is near to a pivot of its own
    hands its family on to that one.
    """
    up = met.where("3 * common >= n_a + n_b").select(F.col("b").alias("low"), F.col("a").alias("high"))
    family = met.where("n_a <= 2 * common").select("b", "a")
    for _ in range(2):
        family = family.join(up, F.col("a") == F.col("low"), "left").select("b", F.coalesce("high", "a").alias("a"))
    family = materialize(family, "families")
    pivots = family.select(F.col("a").alias("b")).distinct().join(up.select(F.col("low").alias("b")), "b", "left_anti")
    family = family.join(pivots, "b", "left_anti").select("a", "b").unionByName(pivots.select(F.col("b").alias("a"), "b"))
    family = family.join(open_sets.select(F.col("set_id").alias("b")), "b", "left_semi")
    several = family.groupBy("a").count().where("count > 1").select("a")
    return materialize(family.join(several, "a", "left_semi"), "families")


def _pairs(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of sets whose entries in some list can reach each other.

    entries: space and token name a list; set_id; side, whose equals are not paired; weight, such that
    two sets are linked if their shared tokens, each worth a fixed amount, reach the sum of both weights;
    slack, the worth of the tokens from the entry's position on, less the weight. So two entries can
    belong to linked sets only if each one's slack reaches the other's weight.
    """
    name = ["space", "token"]
    sides = entries.groupBy(*name, "side").agg(F.max("slack").alias("slack"), F.min("weight").alias("weight"))
    first = sides.groupBy(*name).agg(F.max(F.struct("slack", "side")).alias("s1"), F.min(F.struct("weight", "side")).alias("w1"))
    other = lambda best, value: F.when(F.col("side") != F.col(f"{best}.side"), F.col(value))
    both = sides.join(first, name).groupBy(*name).agg(F.first("s1").alias("s1"), F.first("w1").alias("w1"), F.max(other("s1", "slack")).alias("s2"), F.min(other("w1", "weight")).alias("w2"))
    most, least = F.coalesce(other("s1", "s1.slack"), "s2"), F.coalesce(other("w1", "w1.weight"), "w2")
    kept = entries.join(both.where("s2 is not null"), name).where((most >= F.col("weight")) & (F.col("slack") >= least)).select(*name, "set_id", "side", "weight", "slack", "scale")
    block = F.floor(F.log(F.col("scale") + F.lit(1.0)) / F.log(F.lit(BLOCK_STEP)))
    kept = materialize(kept.withColumn("block", block), "kept")

    blocks = kept.groupBy(*name, "block").agg(F.max("slack").alias("slack"), F.min("weight").alias("weight"), F.min("side").alias("low"), F.max("side").alias("high"))
    again = blocks.withColumnsRenamed({"block": "block2", "slack": "slack2", "weight": "weight2", "low": "low2", "high": "high2"})
    reach = (F.col("slack") >= F.col("weight2")) & (F.col("slack2") >= F.col("weight"))
    several = (F.least("low", "low2") < F.greatest("high", "high2")) & (F.col("block") <= F.col("block2"))
    met = blocks.join(again, name).where(reach & several).select(*name, "block", "block2")
    left = kept.join(met, [*name, "block"]).drop("block")
    right = kept.select(*name, F.col("block").alias("block2"), F.col("set_id").alias("set_id2"), F.col("side").alias("side2"), F.col("weight").alias("weight2"), F.col("slack").alias("slack2"))
    found = left.join(right, [*name, "block2"]).where(reach & (F.col("side") != F.col("side2")))
    return found.select(F.least("set_id", "set_id2").alias("a"), F.greatest("set_id", "set_id2").alias("b")).distinct()


def _family_links(families: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b, common, n_a, n_b of linked pairs of families' members (_meet with differences) that span their components.

    A member's weight is 200 |p - x| + 2 percent |x - p| - (100 - percent) |p|, a shared token is worth 2 (100 + percent).
    """
    own = _named(families.where("apart is not null").withColumnRenamed("b", "set_id"), labels)
    missing = F.col("n_a") - F.col("common")
    scale = 200 * missing + 2 * percent * (F.col("n_b") - F.col("common"))
    own = own.select(F.col("a").alias("space"), "set_id", F.col("component").alias("side"), "apart", scale.alias("scale"), (scale - (100 - percent) * F.col("n_a")).alias("weight"), missing.alias("missing"), F.col("n_a").alias("n_p"), F.col("n_b").alias("n"))
    own = materialize(own, "differences")
    tokens = own.select("space", "set_id", "side", "scale", "weight", F.size("apart").alias("size"), F.explode("apart").alias("token"))
    held = tokens.groupBy("space", "token").agg(F.count("*").alias("held")).where("held > 1")
    tokens = tokens.join(held, ["space", "token"])
    over = Window.partitionBy("space", "set_id")
    pos = F.col("size") - F.count("*").over(over) + F.row_number().over(over.orderBy("held", "token")) - 1
    entries = tokens.withColumn("slack", 2 * (100 + percent) * (F.col("size") - pos) - F.col("weight"))
    pairs = _pairs(materialize(entries.select("space", "token", "set_id", "side", "weight", "scale", "slack"), "entries"))
    a = own.select("space", F.col("set_id").alias("a"), F.col("apart").alias("apart_a"), F.col("missing").alias("m_a"), F.col("n").alias("n_a"), "n_p")
    b = own.select(F.col("space").alias("space_b"), F.col("set_id").alias("b"), F.col("apart").alias("apart_b"), F.col("missing").alias("m_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "a").join(b, "b").where("space = space_b")
    common = (F.col("n_p") - F.col("m_a") - F.col("m_b") + F.size(F.array_intersect("apart_a", "apart_b"))).cast("long")
    return both.select("a", "b", common.alias("common"), "n_a", "n_b")


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT_TOKENS tokens with the largest counts, sorted, with these: those above a count that a histogram gives."""
    seen = materialize(rows.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "seen")
    step = F.floor(F.log2(F.col("seen").cast("double")) * 8)
    held, least = 0, None
    for r in sorted(seen.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > FREQUENT_TOKENS:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    often = seen.where(step >= least).toPandas()
    tokens = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], often["seen"].to_numpy(np.int64)[order]


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Documents with their classes, and verified links between classes.

    docs: doc_id long, text string; other columns are ignored. Returns (members, links):
    members has doc_id, n_shingles, set_id (null for an empty set) and component (a set_id of the
    class's component; null for an empty set), one row per input row; links has a, b, common, n_a,
    n_b for pairs of sets that were verified as linked and that span every component.

    Null and empty texts and texts without words have empty sets and link with nothing. Fewer words
    than width make one shingle of them all. Rows with a null doc_id, repeated rows and rows with equal
    doc_id stay rows of their own; equal sets are one class. An empty table gives no rows. Sets are
    compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_sets(width), _SET_SCHEMA), "sets")
    members = rows.where("n_shingles is not null").select("doc_id", "text_key", "n_shingles", "n_ranked", "set_id")
    classes = members.where("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("n_ranked").alias("n_ranked"), F.min("text_key").alias("text_key"))
    classes = materialize(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    frequent = spark.sparkContext.broadcast(_frequent(rows))

    # Every listed set meets its pivot.
    lists = _lists(docs, classes, width, percent, frequent, RANKED_SHARE, total)
    linked = (100 * F.col("common")) >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    met = _meet(materialize(_pivot_pairs(lists, percent), "pairs"), classes, texts, width, "met")
    links = met.where(linked)
    labels = connected_components(links.select("a", "b"))

    # Sets in lists that still hold several components: families first, by differences to their pivots.
    rest = materialize(_open_sets(lists, labels).join(classes, "set_id"), "rest")
    families = _meet(_families(met, rest), classes, texts, width, "families", differences=True)
    found = materialize(_family_links(families, labels, percent).where(linked), "family-links")
    derived = families.where(linked & (F.col("a") != F.col("b"))).select(*found.columns)
    more = found.unionByName(derived)
    links = links.unionByName(more).distinct()
    labels = extended_components(labels, more)

    # What is left lies in different families: these sets are listed again, all their tokens in exact order of rarity.
    rest = materialize(_open_sets(lists, labels).join(classes, "set_id"), "rest")
    size = rest.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("total")).first()
    again = semi_join_sized(texts, rest.select("text_key"), "text_key", size["n"]).select("text")
    lists = _lists(again, classes, width, percent, frequent, 1.0, size["total"])
    family = families.where("apart is not null").select(F.col("b").alias("set_id"), F.xxhash64(F.lit("family"), "a").alias("family"))
    entries = _named(lists, labels).join(family, "set_id", "left")
    weight = 2 * percent * F.col("n")
    entries = entries.select(
        F.lit(0).alias("space"), "token", "set_id", F.coalesce("family", "component").alias("side"), weight.alias("weight"), weight.alias("scale"),
        (2 * (100 + percent) * (F.col("n") - F.col("pos")) - weight).alias("slack"),
    )
    cross = materialize(_pairs(materialize(entries, "entries")), "cross")
    component = labels.select(F.col("id").alias("a"), F.col("component").alias("c"))
    cross = cross.join(component, "a", "left").join(component.withColumnsRenamed({"a": "b", "c": "c2"}), "b", "left").where(~F.coalesce(F.col("c") == F.col("c2"), F.lit(False))).select("a", "b")
    tested = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _meet(materialize(cross.join(tested, ["a", "b"], "left_anti"), "pairs"), classes, texts, width, "cross")
    links = links.unionByName(found.where(linked))
    labels = extended_components(labels, found.where(linked))
    members = members.join(labels.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return members.select("doc_id", "n_shingles", "set_id", "component"), links
