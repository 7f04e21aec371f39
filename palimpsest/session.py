"""Session settings, the shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, as in tests on
    one machine, a new local folder takes its place and is written back to the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and what was written
    outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    with brief_shuffles(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one computation in the shared folder, deleted together when its block ends. What the block
    returns must therefore be ``written`` itself, or be computed before the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            drop_shared(self.spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back."""
        path = shared_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, last: int) -> None:
        """Delete all but the ``last`` tables written."""
        for path in self.paths[: len(self.paths) - last]:
            drop_shared(self.spark, path)
        self.paths = self.paths[len(self.paths) - last :]


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows and about ``max_bytes``, looked at by reading at most one
    row more; else leave the strategy to the optimizer."""
    size = F.lit(16 * len(df.columns)) + sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


@contextlib.contextmanager
def setting(spark: SparkSession, **values: str):
    """Set session options (dots written as double underscores) for a block."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brief_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files are deleted when the action ends, not when the driver happens to collect its garbage."""
    return setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")
