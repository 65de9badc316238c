"""Connected components of an edge table, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.session import cut_lineage

_TASK_EDGES = 1 << 18  # edges of a task, about, where a round's tables are written


def _with_least(edges: DataFrame, parts: int) -> DataFrame:
    """Each edge (u, v) with the least node next to u, u itself included.

    The least nodes are summed on the map side and written, so that the join has plain shuffles on both sides and
    adaptive execution may split a hub's edges over many tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(cut_lineage(least.coalesce(parts)), "u")


def _star(edges: DataFrame, parts: int) -> DataFrame:
    """One round of alternating stars: every node's larger neighbours, then its smaller ones, are linked
    to the least node it can see. Keeps components, and ends with every node linked to its least. Its tables are
    written by at most ``parts`` tasks."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, parts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = _with_least(cut_lineage(large.coalesce(parts)), parts)
    return (
        down.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(down.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
        .coalesce(parts)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v bigint), root being the least node of its component.

    The table is written to the checkpoint folder every round, in as many files as its edges need; the rounds end when no link changes and
    grow with the logarithm of the longest chain. Loops, repeated and reversed edges are allowed; null
    ends are dropped; no edges give no rows.
    """
    links = edges.filter("u is not null and v is not null and u <> v")
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame):
        mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
        return df.agg(F.count(F.lit(1)), F.sum(mixed)).first()

    before = state(links)
    while True:
        links = cut_lineage(_star(links, max(1, -(-2 * before[0] // _TASK_EDGES))))
        after = state(links)
        if after == before:
            break
        before = after
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
