"""Tables that several jobs of one operator read, and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session on the driver's own threads (``local[...]``, as in tests)
    may leave it unset; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="edgeframe-")
    return _local[app]


#: Rows and bytes of an Arrow batch, at most: a task's Python worker holds a batch and its copies.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session be small, unless it sets their size itself."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in _default:
            _default[key] = spark.conf.get(key, None)
        if spark.conf.get(key, None) == _default[key] and not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


_default: dict[str, str | None] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    Survives the loss of any executor, as the files are not theirs.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.stored_at
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` besides ``taken``; like Spark, upper and lower case are the same."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def batched(df: DataFrame, text_col: str, *taken: str) -> tuple[DataFrame, list[T.StructField]]:
    """``df`` as (its columns besides ``text_col`` and ``taken``, then the text), and the fields of the former.

    For functions over Arrow batches: columns are named by place, so no name can clash or need quoting.
    """
    small_batches(df.sparkSession)
    keep = others(df, text_col, *taken)
    fields = [T.StructField(c, df.select(quoted(c)).schema[0].dataType) for c in keep]
    return df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)), F.col(quoted(text_col)).alias("text")), fields


def named(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The columns ``c0``, ``c1``, ... of :func:`batched` under their own names again."""
    first = [F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)]
    return df.select(*first, *(quoted(c) for c in df.columns[len(fields) :]))
