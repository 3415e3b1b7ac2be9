"""Session helpers shared by all layers: worker imports and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started elsewhere."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="emberlog-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/emberlog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the JVM may be gone already; the folder is scratch space
        return


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exploded(df: DataFrame, column: str, name: str, *kept: str, place: str | None = None) -> DataFrame:
    """The kept columns and one row for each element of an array column that is not null (its place too, if named).

    An inner explode makes the optimizer test the array's size below all projections, which
    computes a costly array again and again; the outer one with a test of its rows doesn't.
    """
    made = F.posexplode_outer(column).alias(place, name) if place else F.explode_outer(column).alias(name)
    return df.select(*[F.col(f"`{c}`") for c in kept], made).where(F.col(f"`{name}`").isNotNull())


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly over four partitions a core, or as many as the input has splits if those are more.

    For tables of narrow rows that cost much each: how many splits an input has doesn't tell how its rows lie, since a
    file of few row groups leaves most of its splits empty.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df with the rows of each key together, over four partitions a core; more would cost, as every task compiles its patterns."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


#: Rows for each distinct value from which computing once for each value and joining pays.
REPEATS = 4


def once_each(df: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df), where make keeps the rows' columns and what it adds depends on the key columns alone.

    Where rows repeat, make runs once for each distinct key and all rows are joined with what it made; where they
    don't, it runs on the rows as they are. One pass over the keys tells which. df is read more than once.
    """
    told = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*[F.col(f"`{k}`") for k in keys]))).first()
    if told[0] < REPEATS * told[1]:
        return make(df)
    made = make(df.select(*[F.col(f"`{k}`") for k in keys]).distinct())
    added = [c for c in made.columns if c not in keys]
    table = materialize(made.select(*[F.col(f"`{k}`").alias(f"__of_{k}") for k in keys], *[F.col(f"`{c}`") for c in added]), "distinct")
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`")) for k in keys])
    return df.join(table, same).select(*[F.col(f"`{c}`") for c in (*df.columns, *added)])


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; as it is where the input has that many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
