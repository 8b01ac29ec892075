"""Connected components, and pairs of blocks for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges``.

    Each round maps every node to the smallest of itself and its neighbours and keeps the
    mapped edges, without loops and repeats; a star is gone after one round. When no edge is
    left, the maps are composed. Every round is written to the shared folder. Rows with a null
    end are no edges.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNull() | F.col(b).isNull())
    edges = cut_lineage(edges.toDF("a", "b", "_null").where("NOT _null AND a <> b").select("a", "b").distinct())
    spark = edges.sparkSession
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        # The smaller end of an edge is a candidate for the larger one; both ends keep themselves.
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            edges.select(F.col("a").alias("node"), F.col("a").alias("to"))
        )
        maps.append(cut_lineage(ends.groupBy("node").agg(F.min("to").alias("to"))))
        left = maps[-1].select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    found = maps[-1].select("node", F.col("to").alias("component"))
    for earlier in reversed(maps[:-1]):
        onward = found.select(F.col("node").alias("to"), F.col("component").alias("_c"))
        found = earlier.join(onward, "to", "left").select("node", F.coalesce("_c", "to").alias("component"))
    return found


def block_pairs(rows: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: adds ``_own``, ``_b1``, ``_b2``.

    A group of up to ``block`` rows is one pair (0, 0). A larger one has as many blocks as it
    needs, and a row goes to every pair that its block is in, so any two rows meet in exactly
    one pair and no task gets more than about two blocks. The copies of a row are as many as
    the blocks of its group; no pair of rows is ever written out.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(
        *rows.columns, "_own", F.least("_own", "_with").alias("_b1"), F.greatest("_own", "_with").alias("_b2")
    )
