"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows in an Arrow batch, if the session leaves Spark's default (10,000): whole texts make large rows.
BATCH_ROWS, BATCH_KEY = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver was started; keep their batches small."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, to: str) -> bool:
    """Have what was written to ``to`` deleted when the application ends; false if there is nothing."""
    file_system, path = _located(spark, to)
    return file_system.deleteOnExit(path)


def _located(spark: SparkSession, to: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise_table`` wrote for these, which nothing reads any more."""
    for df in tables:
        if to := _written.pop(df, None):
            file_system, path = _located(df.sparkSession, to)
            file_system.delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's shared checkpoint folder and read from there.

    Cuts the lineage, so that what follows never runs the work above again, and survives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def materialise_table(df: DataFrame) -> DataFrame:
    """As ``materialise``, as a compressed Parquet table in the same folder: for rows that carry whole texts."""
    to = scratch_path(df.sparkSession, "table")
    df.write.parquet(to)
    delete_at_end(df.sparkSession, to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    _written[out] = to
    return out


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Bytes of a table of row names, as written, up to which it is told to all tasks: about a million rows.
NAMES_BYTES = 4 << 20


def _scanned(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of one file: a scan, perhaps filtered, with other columns."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` as ``rec`` (a struct of its columns) and ``row``: file and position, which name a row alike in every scan.

    Later scans can then find rows by name, so that what decides about them moves without their texts. Where a row has no
    place in a file of its own, the rows are written first.
    """
    rec = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("rec")
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row")
    if "_metadata" not in df.columns and _scanned(df):
        try:
            return df.select(rec, row)
        except AnalysisException:  # files of a format without positions
            pass
    return materialise_table(df.select(rec)).select("rec", row)


def without(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The records of ``numbered`` rows that are not among ``names`` (a column ``row``). Texts stay where they are read as long as the names are few."""
    names = materialise_table(names.select("row"))
    return rows.join(broadcast_if_small(names, NAMES_BYTES), "row", "left_anti").select("rec.*")
