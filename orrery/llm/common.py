"""What the training-data operators share: safe column picking, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever the contracts speak of words: a run of anything but ASCII white space.
#: On bytes, ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session. Where it is unset, a folder of this
    machine, if the session runs on it alone; on a cluster that raises."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="orrery-")
    return _own_dir


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`materialize` wrote and nobody reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody refers to any more. Its cleaner needs two rounds."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def pick(df: DataFrame, *names: str, types: dict[str, str] | None = None) -> DataFrame:
    """Exactly these columns by exact name; other columns may have any names, even clashing ones. Missing: null."""
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, tmp[i])
    types = types or {}
    return df.toDF(*tmp).select(
        *[
            (F.col(at[n]) if n in at else F.lit(None)).cast(types[n]).alias(n) if n in types or n not in at else F.col(at[n]).alias(n)
            for n in names
        ]
    )


def docs_of(df: DataFrame, *names: str) -> DataFrame:
    """Columns of ``documents``, with their types."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    return pick(df, *names, types={n: kinds[n] for n in names if n in kinds})


def masked(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """All columns under unique names, ``_c0`` on, and where each (first of its name) went; undo by selecting those
    and ``toDF(*df.columns)``. Of ``names``, missing ones are there as nulls behind the others."""
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    at: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, tmp[i])
    d = df.toDF(*tmp)
    for n in names:
        if n not in at:
            at[n] = f"_n{n}"
            d = d.withColumn(at[n], F.lit(None).cast("bigint" if n == "doc_id" else "string"))
    return d, at


#: What a Python worker holds between tasks, of the operator that used it last.
_held: dict[str, dict] = {}


def worker_state(kind: str) -> dict:
    """A dictionary that a Python worker keeps between tasks of one operator. The first task of another operator frees
    it, so a worker that Spark reuses for many stages never holds the caches of two."""
    if kind not in _held:
        _held.clear()
        release()
        _held[kind] = {}
    return _held[kind]


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes: what repeats between small batches is met once."""
    held, size = [], 0

    def whole():
        t = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], names=t.column_names)

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


class Recent(dict):
    """What was made for keys, of two generations: when the younger one has ``most`` keys, it becomes the older one, and
    what is asked for again is taken over from there. So what is common stays, in bounded memory."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def age(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def lacking(self, keys: Iterable) -> list:
        """Keys of which neither generation knows anything; the others are in the younger one from now on."""
        out, old = [], self.old
        for k in keys:
            if k not in self:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


def lean(kind: str, run: Callable) -> Callable:
    """A mapInArrow function that frees what other operators left in its worker, and at its end what it doesn't keep."""

    def task(batches):
        worker_state(kind)
        yield from run(batches)
        release()

    return task


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: texts differ in length by orders of magnitude. Where the session asks for smaller ones yet,
    those stay; results don't depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    # By way of NumPy: to_pylist makes a scalar object of each value first.
    return pc.fill_null(column.cast(kind), b"").to_numpy(zero_copy_only=False).tolist()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a text column, which of them each word of each text is, and how many words each text has.

    Words are those of WORD; with ``lower``, A-Z are lower-cased first. Only distinct words become Python objects.
    """
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lens = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    every = split.flatten()
    # White space at an end of a text leaves an empty part there.
    full = pc.binary_length(every).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        text_of = np.repeat(np.arange(len(lens)), lens)
        lens = np.bincount(text_of[full], minlength=len(lens))
        every = every.filter(pa.array(full))
    coded = every.dictionary_encode()
    return raw(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), lens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_sizes(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``; a single larger item gets a range of its own."""
    lo = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    n = i + 1 if total or i or lo else 0
    if n > lo:
        yield lo, n
