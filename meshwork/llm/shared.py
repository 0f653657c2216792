"""What the operators of this package share: scratch tables, row keys, joins that
survive hot keys, and zero-copy access to texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least this share of all rows counts as hot; so there are at most as many hot keys.
HOT_KEYS = 1000

_own_folder: dict[str, str] = {}
_tables: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary folder of our own on a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; master {master!r} has none")
    if "" not in _own_folder:
        _own_folder[""] = tempfile.mkdtemp(prefix="meshwork-")
    return _own_folder[""]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends here, the files
    outlive executors, and what a task decided (row keys, random choices) is never decided twice.

    discard() deletes it; what a result still reads goes when the driver's JVM ends, or by clear_scratch()."""
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/meshwork/{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    system, target = _place(spark, folder)
    system.deleteOnExit(target)
    _tables.add(folder)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(df.sparkSession, path.rpartition("/")[0])


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver, when no result is read any more."""
    for folder in list(_tables):
        _delete(spark, folder)


def _place(spark: SparkSession, folder: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, folder: str) -> None:
    system, target = _place(spark, folder)
    system.delete(target, True)
    system.cancelDeleteOnExit(target)
    _tables.discard(folder)


def settle(spark: SparkSession) -> None:
    """Let go of plans that are done with. An operator of many jobs calls it between its rounds: the
    driver's memory stays what one round needs, and Spark deletes the shuffle files of the rounds
    before, which it does only once the driver has collected their plans.

    What the JVM's compiler and Python have freed outside the heap stays with the C library, hundreds
    of MB after some hundred plans, so it is handed back as well."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Hand memory that the C library holds free, the JVM's and Python's, back to the system. Says
    whether the JVM could; one without such a command (older ones, or not on glibc) keeps its own."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's own class isn't open to reflection, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0], arguments[1] = command, "systemTrimNativeHeap"
        invoke.invoke(server, arguments)
    except Py4JError:
        return False
    return True


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """`row_key` and the given columns; row_key is unique to a row, whatever the row holds.

    On a plain scan of Parquet files the key is the place of the row in its file, the same in every
    plan over the same files, so that one plan may aggregate narrow columns and another come back
    for the text. Anything else (a shuffle below, a join) is written to scratch first.
    """
    files = numbered_files(df)
    if files is None:
        df = materialize(df.select(*columns), "keyed")
        files, columns = numbered_files(df), tuple(F.col(f"`{c}`") for c in df.columns)
    return _numbered(df, files, "row_key", columns)


def with_key(df: DataFrame, name: str) -> DataFrame:
    """df, a plain scan, and the row_key of keyed() under a name that no column has."""
    return _numbered(df, numbered_files(df), name, tuple(F.col(f"`{c}`") for c in df.columns))


#: Rows of a file that a key can count; the number of the file is in the bits above.
ROW_BITS = 40


def numbered_files(df: DataFrame) -> DataFrame | None:
    """_path, _file: the numbers of the files of df in the order of their paths; None if the rows of
    df have no fixed place, as it isn't a plain scan of Parquet files, each listed once."""
    if not is_scan(df):
        return None
    place = df.metadataColumn("_metadata")
    try:
        seen = df.select(place["file_path"].alias("_path"), place["row_index"].alias("_row"))
        found = seen.groupBy("_path").agg(F.count(F.lit(1)).alias("rows"), F.max("_row").alias("last")).collect()
    except AnalysisException:
        return None
    if any(r.rows != r.last + 1 for r in found):
        return None
    numbers = [(r, i) for i, r in enumerate(sorted(r["_path"] for r in found))]
    return F.broadcast(df.sparkSession.createDataFrame(numbers, "_path string, _file long"))


def _numbered(df: DataFrame, files: DataFrame, name: str, columns: tuple[Column, ...]) -> DataFrame:
    """The columns of a scan with a key that doesn't depend on how the files are split into tasks."""
    place = df.metadataColumn("_metadata")
    rows = df.select(place["file_path"].alias("_path"), place["row_index"].alias("_row"), *columns)
    kept = rows.columns[2:]
    rows = rows.join(files, "_path")
    key = F.shiftleft("_file", ROW_BITS).bitwiseOR(F.col("_row"))
    return rows.select(key.alias(name), *(F.col(f"`{c}`") for c in kept))


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads files, so that its rows have the same places in every plan over it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return all(n in ("Project", "LogicalRelation") for n in _node_names(plan))


def _node_names(plan) -> Iterator[str]:
    yield plan.nodeName().split(" ")[0]
    children = plan.children()
    for i in range(children.size()):
        yield from _node_names(children.apply(i))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows ⟕ groups on keys, where one group may match a third of all rows.

    `size` is the column of groups that counts a group's rows among `total`. Groups with at least
    total / HOT_KEYS rows are broadcast: as sizes add up to total there are at most HOT_KEYS of
    them. The others are joined by a shuffle, in which no key has more than that share.
    """
    extra = [c for c in groups.columns if c not in keys]
    hot_groups = groups.where(F.col(size) * HOT_KEYS >= F.lit(total))
    cold_groups = groups.where(F.col(size) * HOT_KEYS < F.lit(total))
    hot = F.broadcast(hot_groups.withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    found = marked.where(F.col("_hot"))
    rest = marked.where(F.col("_hot").isNull()).drop("_hot", *extra).join(cold_groups, keys, "left")
    columns = [*rows.columns, *extra]
    return found.select(*columns).unionByName(rest.select(*columns))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    large = pa.types.is_large_string(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(
        buffers[1], np.int64 if large else np.int32, count=n + 1, offset=column.offset * (8 if large else 4)
    ).astype(np.int64)
    data = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (fixed public constants of the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
