"""Helpers that several operators share: tables, shared storage, Arrow loops, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time; keeps a worker's memory flat whatever the batch size.
SLICE_ROWS = 128


#: Rows of an Arrow batch. Rows here are whole documents, and both ends of the pipe to a Python worker hold a batch or two.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS where they are more, so that memory doesn't follow the length of texts.

    Registered queries and stages of the pipeline call this, and the session keeps it, as Spark reads it when a query runs. Operators don't: who calls them sets what suits the texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What this worker process keeps for tasks to come: one object, under the name of its operator and a key of its parameters.
_KEPT: dict[tuple, object] = {}


def kept(name: str, key, make: Callable):
    """The object that make() gives, made once in this worker; another one takes its place, so that a worker never holds two."""
    found = _KEPT.get((name, key))
    if found is None:
        _KEPT.clear()
        found = _KEPT[name, key] = make()
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sqlbranch-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in shared storage: the lineage above it is never run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, row_group: int = 128 << 20) -> DataFrame:
    """df as a compressed table in shared storage, removed when the application ends. The shuffle files that writing it took go at once, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() gave and that nothing reads any more."""
    for df in tables:
        for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Values of one Bloom filter, which has FILTER_BITS for each; Spark makes none of more than 64 million bits.
FILTER_VALUES, FILTER_BITS = 8_000_000, 8


def perhaps_in(values: DataFrame, column: str) -> Column:
    """Whether a long column of a table may have one of the values that a column of that name of `values` (stored) has: true for all that do and for about 2 in 100 others.

    By Bloom filters, of a byte for each value, in parts of FILTER_VALUES. They are subqueries, so that plans stay small.
    """
    spark = values.sparkSession
    expressions, wrapped = spark._jvm.org.apache.spark.sql.catalyst.expressions, spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    parts = -(-values.count() // FILTER_VALUES) or 1
    which, found = F.pmod(F.col(column), F.lit(parts)), F.lit(False)
    for part in range(parts):
        own = values.filter(which == part)
        size = own.count()
        if not size:
            continue
        out = spark._jvm.java.io.ByteArrayOutputStream()
        own._jdf.stat().bloomFilter(column, size, size * FILTER_BITS + 64).writeTo(out)
        bits = spark.createDataFrame([(bytearray(out.toByteArray()),)], "bits binary").scalar()
        inside = type(found)(wrapped.column(expressions.BloomFilterMightContain(wrapped.expression(bits._jc), wrapped.expression(F.col(column)._jc))))
        found = F.when(which == part, inside).otherwise(found)
    return found


def unused(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as it takes to be no column of df, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = "_" + name
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: str):
    """A text column as UTF-8 bytes, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of Python values, SLICE_ROWS rows at a time."""
    _KEPT.clear()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield [column.to_pylist() for column in part.columns]


def per_row(function: Callable, schema: pa.Schema) -> Callable:
    """A mapInArrow function that calls function(*values) for each row and collects the tuples it returns."""

    def run(batches):
        for columns in slices(batches):
            out = [function(*values) for values in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


class Interner(dict):
    """Numbers words in the order of their first use; cleared by its user when it has grown large."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Hasher(dict):
    """Remembers the 64-bit hash of each word; forgets all when it has grown past its limit."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` word hashes; fewer words than that make one shingle, none make none."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, width):
            out = out * np.uint64(0x100000001B3) + mix(words[k : k + n] + np.uint64(k))
    return mix(out)
