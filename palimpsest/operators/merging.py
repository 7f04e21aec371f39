"""Merging of entities and facts that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.dense import near_pairs
from palimpsest.session import Scratch, written


def first_per_name(entities: DataFrame, order: str) -> DataFrame:
    """The first entity of each name, upper and lower case and outer blanks aside; empty names are dropped."""
    named = entities.withColumn("_name", F.lower(F.trim("name"))).where("_name <> ''")
    return named.withColumn("_i", F.row_number().over(Window.partitionBy("_name").orderBy(order))).where("_i = 1").drop("_i", "_name")


def merged_entities(entities: DataFrame, group: list[str], order: str) -> DataFrame:
    """One row for each group: the longest name (the first of equal ones), mean confidence, members, distinct aliases.

    Only distinct values and bounded aggregates leave a group; members are counted, and listed by their smallest and largest.
    """
    longest = F.min_by("name", F.struct((-F.length("name")).alias("n"), F.col(order)))
    return entities.groupBy(*group).agg(
        longest.alias("name"), F.avg("confidence").alias("confidence"), F.count("*").alias("members"), F.min(order).alias("first_member"), F.max(order).alias("last_member"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )


def merged_facts(facts: DataFrame, group: list[str], order: str) -> DataFrame:
    """One row for each group of facts: the longest content, and the distinct participants, keys and sources of all."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    return facts.groupBy(*group).agg(F.min_by("content", F.struct((-F.length(F.coalesce("content", F.lit("")))).alias("n"), F.col(order))).alias("content"), F.count("*").alias("members"), every("participants"), every("retrieval_keys"), every("source_unit_uids"))


def leaders(vectors: DataFrame, dim: int, threshold: float, strict: bool = False, group: str = "kind", max_rounds: int = 200) -> DataFrame:
    """``uid, leader``: in order of uid within a group, an item joins the first leader at a cosine of at least (strict: above) ``threshold``, else leads itself. Vectors that can't be compared (see
    ``near_pairs``) lead themselves.

    The order makes it a sequential rule, but an item is settled as soon as all earlier ones near it are: in each round those without an earlier near leader or unsettled item lead, and
    those with an earlier near leader follow. Near pairs are found in blocks, so no group is held by one task.
    """
    items = vectors.where("uid is not null").select("uid", group).dropDuplicates(["uid"])
    near = near_pairs(vectors.select("uid", "v", group), dim, threshold, group=group)
    near = written(near.where(F.col("cosine") > threshold if strict else F.lit(True)).where("other < uid").select("uid", "other"), "near")
    led = near.sparkSession.createDataFrame([], items.select("uid").schema)
    with Scratch(near.sparkSession) as scratch:
        open_ = scratch.keep(items.select("uid"), "open")
        for _ in range(max_rounds):
            before = near.join(open_, "uid", "left_semi")
            waiting = before.join(open_.withColumnRenamed("uid", "other"), "other", "left_semi").select("uid").distinct()
            new = open_.join(waiting, "uid", "left_anti").join(before.join(led.withColumnRenamed("uid", "other"), "other", "left_semi").select("uid").distinct(), "uid", "left_anti")
            led = scratch.keep(led.unionByName(new), "leading")
            follow = before.join(led.withColumnRenamed("uid", "other"), "other", "left_semi").select("uid").distinct()
            open_ = scratch.keep(open_.join(led, "uid", "left_anti").join(follow, "uid", "left_anti"), "open")
            if open_.isEmpty():
                break
        else:
            raise RuntimeError(f"leaders not settled after {max_rounds} rounds")
        first = near.join(led.withColumnRenamed("uid", "other"), "other", "left_semi").groupBy("uid").agg(F.min("other").alias("leader"))
        out = items.join(led.withColumn("leads", F.lit(True)), "uid", "left").join(first, "uid", "left")
        return written(out.select("uid", group, F.when(F.col("leads"), F.col("uid")).otherwise(F.col("leader")).alias("leader")), "leaders")


def aggregated_facts(facts: DataFrame, cluster: str, dated: list[str], undated: list[str]) -> DataFrame:
    """Facts of a cluster by category. Categories ``dated`` are split by date too; ``undated`` ones drop the date; others take the commonest date.
    The content is the commonest if it occurs twice, else the longest; a fact is stable if it comes from several sessions; confidence is the mean (0.95 if unknown)."""
    kind = F.when(F.col("category").isin(*dated), F.col("date"))
    x = facts.withColumn("_date", kind).withColumn("content", F.coalesce("content", F.lit("")))
    keys = [cluster, "category", "_date"]
    by_content = x.groupBy(*keys, "content").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    content = by_content.groupBy(*keys).agg(
        F.max("n").alias("top"), F.min_by("content", F.struct((-F.col("n")).alias("a"), F.col("first"))).alias("modal"), F.min_by("content", F.struct((-F.length("content")).alias("a"), F.col("first"))).alias("longest")
    )
    by_date = x.where("date is not null").groupBy(*keys, "date").agg(F.count("*").alias("n"), F.min("pos").alias("first")).groupBy(*keys).agg(F.min_by("date", F.struct((-F.col("n")).alias("a"), F.col("first"))).alias("modal_date"))
    base = x.groupBy(*keys).agg(F.count("*").alias("facts"), F.count_distinct("session").alias("sessions"), F.avg(F.coalesce("confidence", F.lit(0.95))).alias("confidence"))
    c = content.select(*[F.col(k).alias(f"c{k}") for k in keys], "top", "modal", "longest")
    d = by_date.select(*[F.col(k).alias(f"d{k}") for k in keys], "modal_date")
    on_c = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys]
    on_d = [F.col(k).eqNullSafe(F.col(f"d{k}")) for k in keys]
    out = base.join(c, on_c).join(d, on_d, "left")
    date = F.when(F.col("category").isin(*dated), F.col("_date")).when(F.col("category").isin(*undated), None).otherwise(F.col("modal_date"))
    return out.select(cluster, "category", date.alias("date"), F.when(F.col("top") > 1, F.col("modal")).otherwise(F.col("longest")).alias("content"), "facts", "sessions", (F.col("sessions") > 1).alias("stable"), "confidence")


def cross_session_groups(mentions: DataFrame) -> DataFrame:
    """Names (upper and lower case and outer blanks aside) borne by several entities in several sessions: ``name, entities, sessions``."""
    x = mentions.select(F.lower(F.trim("name")).alias("name"), "entity_id", "session_id").where("name <> ''")
    return x.groupBy("name").agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("session_id").alias("sessions")).where("entities > 1 and sessions > 1")


def built_relations(relations: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Relations whose ends are both nodes; of several between the same ends in one direction, the last."""
    ids = nodes.select(F.col("id").alias("_id"))
    ok = relations.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
    return ok.withColumn("_i", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc(order)))).where("_i = 1").drop("_i")


def resolve_names(references: DataFrame, entities: DataFrame) -> DataFrame:
    """``reference, entity_id``: ids (``entity_...`` or ``E...``) are themselves; an exact name, upper and lower case aside, comes before the first entity (by id) whose name contains the reference or is contained in it."""
    r = references.select("reference", F.lower(F.trim("reference")).alias("low")).where("low <> ''").distinct()
    own = r.where(F.col("reference").rlike("^(entity_|E[0-9])")).select("reference", F.col("reference").alias("entity_id"))
    e = entities.select("entity_id", F.lower(F.trim("name")).alias("name")).where("name <> ''")
    exact = r.join(e, r.low == e.name).groupBy("reference").agg(F.min("entity_id").alias("entity_id"))
    rest = r.join(own, "reference", "left_anti").join(exact, "reference", "left_anti")
    part = rest.join(e, F.contains(e.name, rest.low) | F.contains(rest.low, e.name)).groupBy("reference").agg(F.min("entity_id").alias("entity_id"))
    return own.unionByName(exact.join(own, "reference", "left_anti")).unionByName(part)
