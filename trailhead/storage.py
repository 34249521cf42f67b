"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _shared(sc) -> str:
    """The checkpoint folder, set from spark.checkpoint.dir; a temporary one only in local mode."""
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="trailhead-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a reliable checkpoint, which survives lost executors."""
    _shared(df.sparkSession.sparkContext)
    return df.checkpoint()


def shared_path(spark, name: str) -> str:
    """A folder of that name below the shared one."""
    return f"{_shared(spark.sparkContext)}/{name}"


#: Most bytes of a batch that Spark hands to a Python worker, which rows with whole methods would else fill by the thousand.
BATCH_BYTES = 4 << 20


def in_frames(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas with batches bounded by bytes as well as rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInPandas(function, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a table in the shared folder and read back: like a checkpoint, but the planner knows its size."""
    path = f"{_shared(df.sparkSession.sparkContext)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
