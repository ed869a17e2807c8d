"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.staging import stage_table


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node in the links ``(a, b)``; a component has one label.

    In each round a node moves to the smallest node among itself and its neighbours, and the
    links are rewritten to the new places; stars whose centre is their smallest node vanish at
    once.  Rounds go on until no link is left, and then the moves are followed back.  Minima
    and distinct links are aggregated before the shuffle, so a node with very many links is no
    hot group.  Node values should be hashes, as the number of rounds then grows with the
    logarithm of a chain's length.  Nothing is collected, and every round is a stage table.
    """
    edges = stage_table(_clean(links), "links")
    moves = []
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = stage_table(
            ends.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("to")),
            "moves",
        )
        moves.append(move)
        at_a = move.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        at_b = move.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(at_a, "a").join(at_b, "b")
        edges = stage_table(_clean(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves.pop().select("node", F.col("to").alias("label"))
    while moves:
        later = labels.select(F.col("node").alias("to"), "label")
        labels = moves.pop().join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return labels


def _clean(links: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return links.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct()
