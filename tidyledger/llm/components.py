"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import forget, stored


def _forest(links: DataFrame) -> bool:
    """Whether no node has two links to lesser nodes, or links both ways: then every component is a star around its least node."""
    ends = links.selectExpr("b node", "1 up", "0 down").unionAll(links.selectExpr("a node", "0 up", "1 down"))
    wrong = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).filter("ups > 1 or ups = 1 and down = 1")
    return wrong.agg(F.count("*")).first()[0] == 0


def _least(both: DataFrame, label: str) -> DataFrame:
    """(u, m): every node with the least of its neighbours and itself.

    It comes from a map-side aggregate and is stored, so that the join with the links of
    a hub has an exchange on both sides and a hub's links can be split over tasks.
    """
    return stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long node ids -> (node, root), root the least id reachable; linked nodes only.

    Each round is stored in the shared folder and takes the place of the one before. Ends when all links form stars;
    links of a node to itself and repeated links add nothing, no links give no rows.
    """
    links = stored(links.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "links")
    while not _forest(links):
        both = links.selectExpr("a u", "b v").unionAll(links.selectExpr("b u", "a v"))
        high = _least(both, "large")
        large = stored(both.join(high, "u").filter("v > u").selectExpr("m a", "v b"), "large")
        down = large.selectExpr("b u", "a v")
        low = _least(down, "small")
        small = stored(down.join(low, "u").selectExpr("m a", "v b").unionAll(low.selectExpr("m a", "u b"))
                       .filter("a <> b").distinct(), "small")
        for spent in (links, high, large, low):
            forget(spent)
        links = small
    return links.selectExpr("b node", "a root").unionAll(links.selectExpr("a node", "a root").distinct())
