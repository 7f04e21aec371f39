"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.session import Scratch, written


def _kept(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, with their number and the sums of two hashes, which are observed while they are written."""
    total = lambda *salt: F.sum(F.xxhash64("u", "v", *salt).cast("decimal(38,0)"))
    seen = Observation()
    kept = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), total().alias("a"), total(F.lit(1)).alias("b")), "links")
    return kept, tuple(seen.get[c] for c in ("n", "a", "b"))


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of an undirected graph; the component is its smallest node.

    Alternates large-star and small-star steps: each node sends its larger neighbours, then its smaller
    ones, to the smallest neighbour. The links shrink towards stars in about log(n) rounds, each of
    two shuffles; no step gathers a component in one place, and lineage is cut through the shared
    folder; the tables of earlier rounds are deleted, and the result is a table there. Links with a null end and from a node to itself only name the node.
    """
    with Scratch(links.sparkSession) as scratch:
        named = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        nodes = scratch.keep(named.select(F.col("u").alias("node")).unionByName(named.select(F.col("v").alias("node"))).where("node is not null").distinct(), "nodes")
        rounds = Scratch(links.sparkSession)
        with rounds:
            edges, seen = _kept(rounds, named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
            for _ in range(max_rounds):
                both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
                large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
                low = large.groupBy("u").agg(F.min("v").alias("m"))
                joined = large.join(low, "u")
                small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
                edges, now = _kept(rounds, small)
                rounds.drop_before(1)
                # Settled when the links are the same stars as before: as many, with the same sums of two hashes.
                if now == seen:
                    break
                seen = now
            else:
                raise RuntimeError(f"components not settled after {max_rounds} rounds")
            roots = edges.groupBy("u").agg(F.min("v").alias("component"))
            return written(nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("component", "node").alias("component")), "components")
