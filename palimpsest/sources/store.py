"""Snapshots of the engine's tables: one folder of parquet for each, and a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None, state: dict | None = None) -> None:
    """Write all tables, then the manifest; a folder without one isn't a snapshot."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by[name]) if partition_by and name in partition_by else w).parquet(f"{folder}/{name}")
    manifest = {"tables": {n: df.schema.jsonValue() for n, df in tables.items()}, "state": state or {}}
    fs, p = _fs(spark, f"{folder}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()


def manifest(spark: SparkSession, folder: str) -> dict:
    fs, p = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(p):
        raise FileNotFoundError(f"no snapshot in {folder}")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in manifest(spark, folder)["tables"]}


def write_version(df: DataFrame, folder: str, version: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{version}")


def read_version(spark: SparkSession, folder: str, before: str | None = None) -> DataFrame | None:
    """The last complete version (before ``before``, if given); None if there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if before is None or n < before]
    return spark.read.parquet(f"{folder}/{names[-1]}") if names else None


def read_cases(spark: SparkSession, path: str, max_questions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions and messages of a nested JSON list of samples: ``sample_id, question, answer, category, evidence`` and ``sample_id, session_no, pos, speaker, text, dia_id``.
    A missing answer with an adversarial one makes the question category 5. ``max_questions`` is a limit for each sample."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    raw = spark.read.option("multiLine", True).json(path)
    ident = F.coalesce(*[F.col(c) for c in ("sample_id", "conversation_id") if c in raw.columns])
    qa = raw.select(ident.alias("sample_id"), F.posexplode("qa").alias("pos", "q"))
    fields = raw.schema["qa"].dataType.elementType.fieldNames()
    get = lambda f: F.col(f"q.{f}").cast("string") if f in fields else F.lit(None).cast("string")
    adversarial = get("answer").isNull() & get("adversarial_answer").isNotNull()
    questions = qa.select("sample_id", "pos", get("question").alias("question"), F.coalesce(get("answer"), get("adversarial_answer")).alias("answer"), F.when(adversarial, 5).otherwise(get("category").try_cast("int")).alias("category"), (F.col("q.evidence") if "evidence" in fields else F.array().cast("array<string>")).alias("evidence"))
    if max_questions is not None:
        w = Window.partitionBy("sample_id").orderBy("pos")
        questions = questions.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max_questions).drop("i")
    inner = raw.schema["conversation"].dataType
    names = sorted((n for n in inner.fieldNames() if n.startswith("session_") and n[8:].isdigit()), key=lambda n: int(n[8:]))
    out = None
    for n in names:
        x = raw.select(ident.alias("sample_id"), F.lit(int(n[8:])).alias("session_no"), F.posexplode(f"conversation.{n}").alias("pos", "m"))
        have = inner[n].dataType.elementType.fieldNames()
        some = lambda *fs, have=have: F.coalesce(*[F.col(f"m.{f}") for f in fs if f in have], F.lit(None).cast("string"))
        parts = [F.col(f"m.{f}") for f in ("blip_caption", "query") if f in have]
        m = x.select("sample_id", "session_no", "pos", some("speaker").alias("speaker"), F.concat_ws(" | ", some("text", "message"), *parts).alias("text"), some("dia_id").alias("dia_id"))
        out = m if out is None else out.unionByName(m)
    return questions, out


def evicted(units: DataFrame, capacity: int, high: float = 0.85, low: float = 0.70) -> DataFrame:
    """``uid``: which units leave the resident tier when it is filled above ``high``: the coldest (accesses, then last access), down to ``low`` of the capacity.

    ``units``: uid, accesses, last_access. The number to leave is counted by distinct (accesses, last access) values, so no task sorts all units.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = units.count()
    if n <= high * capacity:
        return units.select("uid").limit(0)
    leave = n - int(low * capacity)
    by_age = units.groupBy("accesses", F.date_trunc("day", "last_access").alias("day")).count()
    upto = F.sum("count").over(Window.orderBy("accesses", "day").rowsBetween(Window.unboundedPreceding, 0))
    edges = by_age.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("count")).where(F.col("before") < leave)
    x = units.withColumn("day", F.date_trunc("day", "last_access")).join(edges, ["accesses", "day"])
    within = Window.partitionBy("accesses", "day").orderBy("last_access", "uid")
    return x.withColumn("i", F.row_number().over(within)).where(F.col("before") + F.col("i") <= leave).select("uid")
