"""What the operators of this subpackage share: shared-folder tables, row keys and bounded text batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as one sub-batch.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 512
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = "4m"
#: Rows up to which a table of keys may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Rows that are numbered in one task, and tasks up to which more rows are spread over more tasks.
NUMBERED_ROWS, NUMBERED_PARTS = 1000, 50_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one of our own in local mode, as in tests; elsewhere
    that is an error, as executors would write to disks of their own."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="cytosift-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of this application's folder of intermediate tables, which goes when the driver ends."""
    top = f"{shared_dir(spark)}/cytosift/{spark.sparkContext.applicationId}"
    if top not in _own:
        _own[top] = top
        atexit.register(_remove, spark, top)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so that a lost executor recomputes nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a table that `materialize` wrote and nothing will read again. (The rest goes when the driver ends.)"""
    _remove(table.sparkSession, table._written_at)


def by_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded to BATCH_BYTES. The bound on rows alone would let long texts fill an executor, in the
    JVM and in each of its Python workers. Spark reads this setting when a plan runs, so it holds for the session; it is only ever lowered."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    given = conf.get(name, None)
    if given is None or given.startswith("-") or as_bytes(given) > as_bytes(BATCH_BYTES):
        conf.set(name, BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text") -> Iterator[pa.RecordBatch]:
    """Sub-batches of at most SLICE_ROWS rows and about SLICE_BYTES bytes of text; one longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist() if text else [0] * batch.num_rows
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(table: DataFrame, group: str, sizes: dict[int, int], row: str, name: str = "rank") -> DataFrame:
    """table with a number from 0 in each group (a whole number, with its rows in sizes), gapless. row is unique, and table is written, as it is
    read twice. Groups of over NUMBERED_ROWS rows are numbered in several tasks, by a hash of row, each task's numbers from where the one
    before ends; what is broadcast has NUMBERED_PARTS rows more than there are groups at most."""
    spark = table.sparkSession
    each = max(NUMBERED_ROWS, -(-sum(sizes.values()) // NUMBERED_PARTS))
    parts = {g: max(1, -(-n // each)) for g, n in sizes.items()}
    if max(parts.values(), default=1) == 1:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(row)).cast("long") - 1)
    table = table.join(F.broadcast(spark.createDataFrame(sorted(parts.items()), f"{group} long, _parts int")), group)
    table = table.withColumn("_part", F.pmod(F.xxhash64(row), F.col("_parts")).cast("int")).drop("_parts")
    bases, before = [], {}
    for g, part, n in sorted(tuple(r) for r in table.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        bases.append((g, part, before.get(g, 0)))
        before[g] = before.get(g, 0) + n
    base = F.broadcast(spark.createDataFrame(bases, f"{group} long, _part int, _base long"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(row)) - 1
    return table.withColumn(name, place).join(base, [group, "_part"]).withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def keyed(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str, bool]:
    """(docs, name of a column that is unique and not null, whether it was added). The given key if it is so already;
    else row numbers, in a table written once so that every later reader sees the same ones."""
    n, filled, distinct = docs.agg(F.count(F.lit(1)), F.count(key), F.countDistinct(key)).first()
    if n == filled == distinct:
        return docs, key, False
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name, True
