"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper-case letters folded to lower case, as a ``bytes.translate`` table.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    large_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_mod(column, modulus: int):
    """``crc32(value as text) mod modulus`` as a Column (null ids hash like the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def crc32_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fernsql-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def large_rows(spark: SparkSession, most: int = 1000) -> None:
    """Limits the rows of the session's record batches: whole texts make large rows, and workers hold a few batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor costs a re-read only.

    ``free`` drops tables that no later step reads; what the returned DataFrame still needs goes at interpreter exit.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

    def save(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """The table read back; parts are columns with a folder for each value, which ``free`` can drop alone."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def free(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")
        self.collect_garbage()

    def collect_garbage(self) -> None:
        """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
        for _ in range(2):  # the JVM lets go only after Python has, and drops files a little later
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.4)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batches(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 20_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples in schema order."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batch_iter: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, a slice of each batch at a time."""
    for batch in batch_iter:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def groups(rows: Iterator[tuple], most_chars: int = 200_000, most_rows: int = 200) -> Iterator[list[tuple]]:
    """Lists of rows whose last columns, the texts, come to about most_chars characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= most_chars or len(held) >= most_rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def numbered(ordered: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A written table of the rows with a column ``name``: 0, 1, 2 and so on in the order of partitions and rows.

    Numbers are those of the written rows: a partition's own, plus the rows of the partitions before it.
    """
    own = fresh(ordered, "own")
    kept = scratch.save(ordered.withColumn(own, F.monotonically_increasing_id()), f"{name}-ordered")
    part = F.shiftright(own, 33)
    # One row for each partition of the sort.
    sizes = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, at = [], 0
    for k, n in sizes:
        firsts.append((k, at - (k << 33)))
        at += n
    shift = fresh(ordered, "shift")
    table = kept.sparkSession.createDataFrame(firsts, f"{own}_part long, {shift} long")
    joined = kept.join(F.broadcast(table), part == F.col(f"{own}_part"))
    return joined.select(*ordered.columns, (F.col(own) + F.col(shift)).alias(name))


def with_uid(docs: DataFrame, scratch: Scratch, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a unique column ``name`` in the order of the key, nulls first, then of a hash of the text, then of the text.

    A key that is unique and not null is its own number. Otherwise rows are numbered in a written table, so that
    repeated and null keys stay separate rows.
    """
    own = F.col(key).cast("long")
    odd = docs.select(own.alias("k")).groupBy("k").count().filter("k is null or count > 1").limit(1).count()
    if not odd:
        return docs.withColumn(name, own)
    # The hash parts the rows of a hot key.
    order = [own.asc_nulls_first(), F.xxhash64(text), F.col(text).asc_nulls_first()]
    return numbered(docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order), scratch, name)


def keyed(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid long, key, text), see ``with_uid``."""
    return with_uid(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), scratch, "uid", key, text).select("uid", key, text)


#: Rows of one key that a task may take in a join, at least; hot keys are the few beyond.
HOT_ROWS = 1_000_000


def join_hot(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with a table of unique keys; its column weight, the rows of the key, goes. total: the weights' sum at most.

    A key of a thousandth of all rows or more (and HOT_ROWS) doesn't gather in one task: at most 1000 such keys
    exist, so their rows of ``unique`` are broadcast and the rows that they meet stay where they are.
    """
    if total is None:
        total = unique.agg(F.sum(weight)).first()[0] or 0
    if total <= HOT_ROWS:
        return rows.join(unique.drop(weight), keys, how)
    hot = unique.filter(F.col(weight) >= max(HOT_ROWS, total / 1000)).drop(weight)
    cold = unique.filter(F.col(weight) < max(HOT_ROWS, total / 1000)).drop(weight)
    first = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return first.unionByName(rest)
