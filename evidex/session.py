"""Spark sessions and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName("evidex")
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the given tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="evidex-"))
    return path.rstrip("/")


def staging(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark)}/evidex-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_staged(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables, once no result that reads them is needed any more."""
    _delete(spark, staging(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{staging(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _made:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


_made: list[list[str]] = []


def discard(df: DataFrame) -> None:
    """Deletes one staged table that nothing reads any more."""
    _delete(df.sparkSession, df.staged_path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are deleted at the end; what must outlive them is passed to the function that this yields."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path)
        return df

    _made.append(made)
    try:
        yield keep
    finally:
        _made[:] = [other for other in _made if other is not made]  # by identity: scopes may hold equal lists
    for path in made:
        if path not in kept:
            _delete(spark, path)


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A SQL text over the given tables, bound by name for this statement alone."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
