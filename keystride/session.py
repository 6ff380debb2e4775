"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="keystride-"))
    elif named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/keystride/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Later readers all see the same rows and survive lost executors without going back to the
    sources; being columnar, the table also gives them column pruning and a known size. Its folder
    may be removed once the job is over.
    """
    path = work_dir(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows of the given schema, without a Python worker."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
