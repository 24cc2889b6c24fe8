"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import share


#: Rows of an Arrow batch: Spark's 10,000 whole texts at once are too many for small executors.
BATCH_ROWS = 400


def tune(spark: SparkSession) -> None:
    """Sets BATCH_ROWS where the session has Spark's own default; lets workers find this package."""
    share(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read through Spark so that any store works."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    A machine-local folder is set up only where the session names none and runs on one machine (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    tune(df.sparkSession)
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    trim(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give freed native memory back to the system; whether it could.

    Every plan is compiled, and what compilers free stays in the C library's arenas: hundreds of MB
    after some hundred plans, whatever the tables' size, beside a heap that is bounded.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # The server's own class is hidden from Py4J: its interface's method is called.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:  # another JVM or C library: it keeps that memory
        return False
    return True


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more, and lets Spark drop the shuffles that led to them."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
    trim(spark)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if its rows, whose bytes are summed up, take no more than `most`."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 24 if f.dataType.simpleString() in ("string", "binary") else F.lit(_width(f.dataType)) if not f.dataType.simpleString().startswith("array") else F.lit(24) + F.coalesce(F.size(f"`{f.name}`"), F.lit(0)) * _width(f.dataType.elementType) for f in df.schema.fields]
    size = df.agg(F.sum(sum(widths, F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def _width(kind) -> int:
    """Bytes of a value of fixed size in a row."""
    return 24 + sum(_width(f.dataType) for f in kind.fields) if hasattr(kind, "fields") else 8


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch, rows: int = 256):
    """Arrow batch in slices of a bounded row count, so Python objects stay few at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Memo(dict):
    """Results of make by key, in two generations of at most `limit` entries, so the frequent ones stay."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        self[key] = v
        return v

    def trim(self) -> None:
        """To be called between texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


_KEPT: dict[Hashable, object] = {}


def per_process(key: Hashable, make: Callable[[], object]):
    """make()'s result, kept in this Python worker for later tasks; what other operators kept goes."""
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release(collect: bool = True) -> None:
    """Gives freed memory back to the system, where the C library can; from now on large arrays at once."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows
        lib.malloc_trim(0)


def released(run):
    """The Arrow function run, giving memory back: what other operators kept in the worker before, its own after each task."""

    def wrapped(batches):
        kept = bool(_KEPT)
        _KEPT.clear()
        release(collect=kept)
        yield from run(batches)
        release(collect=False)

    return wrapped
