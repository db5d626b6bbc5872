"""Where intermediate and final tables go."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:  # iterative fits cut their lineage there
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="stormglass-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never used twice."""
    return f"{shared_dir(spark).rstrip('/')}/stormglass/{name}-{uuid.uuid4().hex}"


_owner: ContextVar[str | None] = ContextVar("owner", default=None)
_written: dict[tuple[str, str], set[str]] = {}  # tables by application and owner


@contextmanager
def tables_of(owner: str) -> Iterator[None]:
    """Intermediate tables written meanwhile belong to `owner`, who may release them."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, owner: str, *needed: DataFrame) -> int:
    """Delete the owner's intermediate tables, but those that the needed frames read.

    For the moment when every other frame built on them has been written elsewhere. Frames that nothing refers to any
    more let go of their shuffle files too. Returns how many tables went.
    """
    let_go(spark)
    tables = _written.get((spark.sparkContext.applicationId, owner), set())
    read = {f.split(":", 1)[-1].lstrip("/") for df in needed for f in df.inputFiles()}
    gone = {t for t in tables if not any(f.startswith(t.split(":", 1)[-1].strip("/") + "/") for f in read)}
    for path in gone:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    tables -= gone
    return len(gone)


def materialise(df: DataFrame, name: str = "table",
                partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table once and read it back: short lineage, columnar, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    if owner := _owner.get():
        _written.setdefault((df.sparkSession.sparkContext.applicationId, owner), set()).add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A configuration list as a table whose size the optimizer knows.

    Spark can then decide by itself to broadcast it; a table made from Python objects
    has no size estimate.
    """
    names, kinds = zip(*[f.strip().split(" ", 1) for f in schema.split(",")])
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)])
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
