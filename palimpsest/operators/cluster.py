"""Density clusters of vectors and what they consist of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.components import connected_components
from palimpsest.operators.dense import near_pairs
from palimpsest.session import written


def standardized(vectors: DataFrame) -> DataFrame:
    """``uid, v`` with every dimension shifted to mean 0 and scaled to deviation 1 (population); constant dimensions become 0."""
    long = vectors.select("uid", F.posexplode(F.col("v").cast("array<double>")).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("st"))  # one row of as many entries as dimensions
    scaled = F.zip_with("v", "st", lambda x, s: F.when(s.s > 0, (x.cast("double") - s.m) / s.s).otherwise(0.0))
    return vectors.crossJoin(F.broadcast(row)).select("uid", scaled.alias("v"))


def dbscan(vectors: DataFrame, dim: int, eps: float = 0.3, min_samples: int = 3, scale: bool = True) -> DataFrame:
    """``uid, cluster, core``: density clusters by cosine distance, -1 for noise; a point counts among its own neighbours.

    ``scale`` standardises dimensions first. Clusters are the connected components of core points within ``eps``; their
    numbers follow their smallest core point. A border point near several takes the smallest.
    Zero vectors are noise.
    """
    v = standardized(vectors) if scale else vectors.select("uid", "v")
    near = near_pairs(v, dim, 1 - eps)  # both directions, without the point itself
    degree = near.groupBy("uid").agg((F.count("*") + 1).alias("n"))
    core = degree.where(F.col("n") >= min_samples).select("uid") if min_samples > 1 else v.select("uid")
    core_pairs = near.join(core, "uid", "left_semi").join(core.withColumnRenamed("uid", "other"), "other", "left_semi")
    alone = core.select("uid", F.col("uid").alias("other"))
    parts = connected_components(core_pairs.select("uid", "other").unionByName(alone), "uid", "other")
    number = parts.select("component").distinct().withColumn("cluster", F.dense_rank().over(Window.orderBy("component")) - 1)  # one row a cluster
    cores = parts.join(number, "component").select(F.col("node").alias("uid"), "cluster")
    border = near.join(core, "uid", "left_anti").join(cores.withColumnRenamed("uid", "other"), "other").groupBy("uid").agg(F.min("cluster").alias("cluster"))
    found = cores.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return vectors.select("uid").join(found, "uid", "left").select("uid", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def cluster_profile(units: DataFrame, clusters: DataFrame, words: int = 10) -> DataFrame:
    """By cluster: size, span of times, and the commonest words of more than two letters. ``units``: uid, text, created."""
    x = clusters.select("uid", "cluster").join(units, "uid")
    sizes = x.groupBy("cluster").agg(F.count("*").alias("size"), F.date_diff(F.max("created"), F.min("created")).alias("span_days"))
    count = x.select("cluster", F.explode(tokens(F.col("text"))).alias("w")).where("length(w) > 2").groupBy("cluster", "w").count()
    ranked = count.withColumn("i", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "w"))).where(F.col("i") <= words)
    top = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("t")).select("cluster", F.array_join(F.transform("t", lambda r: r.w), " ").alias("words"))
    return sizes.join(top, "cluster", "left")


def silhouettes(vectors: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """``cluster, n, silhouette``: the mean simplified silhouette (cosine distances to the own centre and the nearest other one) of each cluster; 0 for a point whose centres coincide."""
    unit = vectors.where(F.size("v") == dim).join(labels.select("uid", "cluster").where("cluster >= 0"), "uid").select("uid", "cluster", _unit("v").alias("v"))
    long = unit.select("cluster", F.posexplode("v").alias("i", "x"))
    centre = long.groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col("cluster").alias("other"), _unit(F.transform("c", lambda e: e.x)).alias("c"))
    # As many rows a point as there are clusters.
    d = unit.crossJoin(centre).withColumn("d", 1 - F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    each = d.groupBy("uid", "cluster").agg(F.min(F.when(F.col("other") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("d"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return each.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def _unit(v) -> F.Column:
    c = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def tuned(vectors: DataFrame, dim: int, eps: tuple[float, ...] = (0.1, 0.275, 0.45, 0.625, 0.8), min_samples: tuple[int, ...] = tuple(range(2, 11)), least: int = 10) -> DataFrame:
    """``eps, min_samples, clusters, noise_share, score``: density clusters for each pair of settings, scored by 0.5 silhouette (the simplified one, of ``silhouettes``), 0.3 min(CH / 1000, 1)
    (Calinski-Harabasz over the standardised dimensions) and 0.2 of what isn't noise; 0 for fewer than two clusters and at least 0. Fewer than ``least`` vectors aren't tuned.
    Near pairs are found once, at the largest eps, and all settings are clustered together."""
    spark = vectors.sparkSession
    if vectors.limit(least).count() < least:
        return spark.createDataFrame([(0.3, 3, None, None, None)], "eps double, min_samples int, clusters bigint, noise_share double, score double")
    v = written(standardized(vectors), "standardized")
    near = written(near_pairs(v, dim, 1 - max(eps)), "near")
    grid = F.broadcast(spark.createDataFrame([(i * len(min_samples) + j, e, m) for i, e in enumerate(eps) for j, m in enumerate(min_samples)], "setting int, eps double, min_samples int"))
    levels = F.broadcast(spark.createDataFrame([(e,) for e in eps], "eps double"))
    within = F.col("cosine") >= 1 - F.col("eps") - 1e-9
    degree = v.select("uid").crossJoin(levels).join(near.crossJoin(levels).where(within).groupBy("uid", "eps").agg(F.count("*").alias("n")), ["uid", "eps"], "left")
    core = written(degree.join(grid, "eps").where(F.coalesce("n", F.lit(0)) + 1 >= F.col("min_samples")).select("setting", "uid"), "core")
    other = core.withColumnRenamed("uid", "other")
    pairs = near.crossJoin(grid).where(within).select("setting", "uid", "other")
    links = pairs.where("uid < other").join(core, ["setting", "uid"], "left_semi").join(other, ["setting", "other"], "left_semi").unionByName(core.withColumn("other", F.col("uid")))
    parts = connected_components(links.select(F.struct("setting", "uid").alias("a"), F.struct("setting", F.col("other").alias("uid")).alias("b")), "a", "b")
    cores = parts.select("node.setting", "node.uid", F.col("component.uid").alias("cluster"))  # a cluster goes by its smallest core point
    border = pairs.join(core, ["setting", "uid"], "left_anti").join(cores.withColumnRenamed("uid", "other"), ["setting", "other"]).groupBy("setting", "uid").agg(F.min("cluster").alias("cluster"))
    labels = written(cores.unionByName(border), "labels")
    total = v.agg(F.count("*").alias("all"))  # one row
    shares = labels.groupBy("setting").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"))
    scores = _separation(v, labels).join(_silhouette(vectors.where(F.size("v") == dim), labels), "setting", "full")
    out = grid.join(shares, "setting", "left").join(scores, "setting", "left").crossJoin(F.broadcast(total))
    clusters, noise = F.coalesce("k", F.lit(0)), 1 - F.coalesce("n", F.lit(0)) / F.col("all")
    score = 0.5 * F.coalesce("s", F.lit(0.0)) + 0.3 * F.least(F.coalesce("ch", F.lit(0.0)) / 1000, F.lit(1.0)) + 0.2 * (1 - noise)
    return out.select("eps", "min_samples", clusters.alias("clusters"), noise.alias("noise_share"), F.when(clusters > 1, F.greatest(score, F.lit(0.0))).otherwise(0.0).alias("score"))


def _separation(v: DataFrame, labels: DataFrame) -> DataFrame:
    """``setting, ch``: the Calinski-Harabasz score of each setting's clusters, from their sums and squares; 1 if nothing is spread within them."""
    long = labels.join(v, "uid").select("setting", "cluster", F.posexplode("v").alias("i", "x"))
    sums = long.groupBy("setting", "cluster", "i").agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    one = sums.groupBy("setting", "i").agg(F.sum(F.col("t") * F.col("t") / F.col("n")).alias("between"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"))
    all_ = one.groupBy("setting").agg(F.sum(F.col("between") - F.col("t") * F.col("t") / F.col("n")).alias("b"), F.sum(F.col("q") - F.col("between")).alias("w"), F.max("n").alias("n"), F.max("k").alias("k"))
    ch = F.when(F.col("w") <= 1e-9, 1.0).otherwise(F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1)))
    return all_.where("k > 1").select("setting", ch.alias("ch"))


def _silhouette(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``setting, s``: the mean of ``silhouettes`` over all points of each setting's clusters."""
    unit = labels.join(vectors.select("uid", _unit("v").alias("v")), "uid")
    centre = unit.select("setting", "cluster", F.posexplode("v").alias("i", "x")).groupBy("setting", "cluster", "i").agg(F.avg("x").alias("x")).groupBy("setting", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    centre = centre.select("setting", F.col("cluster").alias("other"), _unit(F.transform("c", lambda e: e.x)).alias("c"))
    d = unit.join(centre, "setting").withColumn("d", 1 - F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    each = d.groupBy("setting", "uid", "cluster").agg(F.min(F.when(F.col("other") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("d"))).alias("b"))
    return each.groupBy("setting").agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("s"))


def cluster_nodes(vectors: DataFrame, edges: DataFrame, method: str, dim: int, **settings) -> DataFrame:
    """Clusters by name of the method: ``density`` (dbscan) or ``community`` (label propagation)."""
    from palimpsest.operators.graph import label_propagation

    if method in ("density", "dbscan"):
        return dbscan(vectors, dim, **settings)
    if method in ("community", "leiden"):
        return label_propagation(edges, **settings)
    raise ValueError(f"unknown method {method}")
