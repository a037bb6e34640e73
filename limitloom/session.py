"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The operators lean on adaptive execution: hot join keys are split at run time
# and joins turn into broadcasts only when the measured side is small enough.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# A long rule chain compiles to one Java method. Beyond 8,000 bytes of bytecode the JVM
# leaves a method uncompiled, so such stages run faster as split expression code.
RUNTIME_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_SPARK_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "65535"}


def build_session(master: str | None = None, app: str = "limitloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_for(input_bytes: int, cores: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for a run over ``input_bytes``, to pass on to :func:`build_session`.

    Shuffles start with pieces of about ``partition_bytes`` and at least three per core;
    adaptive execution merges the ones that turn out small. It never cuts a partition that
    is merely large, so the starting number must fit the data.
    """
    partitions = max(-(-input_bytes // partition_bytes), 3 * cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings a session leaves at their defaults."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key) == _SPARK_DEFAULTS[key]:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a cluster
    without it is an error, because a machine-local path would not be shared.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="limitloom-")
    sc.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, unique to one run."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def durable(df: DataFrame, label: str = "frame") -> DataFrame:
    """``df`` as a written table in the shared folder, read back.

    For a frame that several later steps read: it is computed once, its lineage ends here,
    and all readers see the same rows after an executor is lost. Being a stored table it
    keeps column pruning and a known size, which decide joins downstream.
    """
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
