"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.session import stored

_ROUNDS = 60  # far more than any graph needs: each round at least halves the live nodes


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, component`` (the component's smallest node), for nodes with edges.

    Each round hooks every node to its smallest neighbour, shortens the pointers once
    and contracts the edges, so that groups shrink whatever their diameter. Minima
    combine before the shuffle; nothing is collected. Rows with a null are left out.
    """
    links = stored(
        edges.select("a", "b")
        .filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    names = stored(
        links.select(F.col("a").alias("node"))
        .union(links.select("b"))
        .distinct()
        .withColumn("component", F.col("node")),
        "components",
    )
    for _ in range(_ROUNDS):
        if links.isEmpty():
            return names
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("p"))
        hooks = hooks.select("a", F.least("a", "p").alias("p"))
        further = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
        hooks = stored(
            hooks.join(further, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "hooks"
        )
        over = hooks.select(F.col("a").alias("component"), "p")
        names = stored(
            names.join(over, "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "components",
        )
        left = hooks.select("a", F.col("p").alias("x"))
        right = hooks.select(F.col("a").alias("b"), F.col("p").alias("y"))
        links = stored(
            links.join(left, "a")
            .join(right, "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    raise RuntimeError("components did not settle")
