"""What the operators of this subpackage share: tables, Arrow passes, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a batch that Spark hands to a Python worker; long texts make short batches.
BATCH_BYTES = 4 << 20
#: Rows of one key that a task may get before the key is dealt over several.
SHARE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="trailhead-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back, so lost executors cost one stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trailhead/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() wrote, once nothing reads them any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, total: int, least: int = SHARE, how: str = "inner", held: str | None = None) -> DataFrame:
    """big joined with small, which has one row a key with n, the number of rows of big that have it.

    A key of very many rows is dealt over tasks by the column by. Of total rows in big no more
    than 65,536 keys can have more than a share of total / 65,536, so the list of these is
    small at any size and is broadcast; the other keys are joined as usual. Where big has n itself
    in its column held, nothing is broadcast.
    """
    share = max(least, total >> 16)
    if total <= share:
        return big.join(small.drop("n"), key, how)
    salt, parts = fresh(big, "salt"), fresh(big, "parts")
    many = F.greatest(F.ceil(F.col("n") / share), F.lit(1)).cast("int")
    if held:
        tagged = big.withColumn(parts, F.greatest(F.ceil(F.col(held) / share), F.lit(1)).cast("int"))
    else:
        tagged = big.join(F.broadcast(small.where(F.col("n") > share).select(key, many.alias(parts))), key, "left")
    tagged = tagged.withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop("n")
    return tagged.join(dealt, [key, salt], how).drop(salt)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def lists_of(values: np.ndarray, sizes: np.ndarray | int, n: int) -> pa.ListArray:
    """A column of n lists whose values lie in a row; sizes is the length of each, or of all."""
    ends = np.cumsum(np.broadcast_to(np.asarray(sizes), n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
