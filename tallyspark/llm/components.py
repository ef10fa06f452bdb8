"""Connected components of a link table by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """id, component for every id of links (a long, b long); component is one of the component's ids.

    Each round every node joins its neighbour (or itself) that comes first in a pseudorandom order of
    that round, and links between joined nodes vanish. The order keeps the number of rounds near the
    logarithm of the longest path. Self links and nulls are ignored; no links give no rows.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    edges = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    names = None
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        to = edges.groupBy("a").agg(F.min(rank("b")).alias("nb")).select("a", F.least("nb", rank("a"))["id"].alias("to"))
        to = materialize(to, "joined")
        if names is None:
            names = to.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            names = names.join(to, names["component"] == to["a"], "left").select("id", F.coalesce("to", "component").alias("component"))
        left = edges.join(to, "a").select(F.col("to").alias("a"), "b")
        right = left.join(to.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b").select("a", F.col("to_b").alias("b"))
        edges = materialize(right.where("a != b").distinct(), "edges")
        turn += 1
        if turn % 4 == 0:
            names = materialize(names, "names")
    if names is None:
        return links.sparkSession.createDataFrame([], "id long, component long")
    return materialize(names, "names")


def extended_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component; from connected_components) with further links (a, b): only components that these join are worked on."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    ids = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    ids = materialize(ids, "ids")
    of = lambda c: ids.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    joined = connected_components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return materialize(ids.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "names")
