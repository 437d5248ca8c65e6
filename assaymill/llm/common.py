"""What the corpus operators share: patterns, lineage cuts, a sieve of fixed
size that keeps texts out of joins, and column bookkeeping."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words, as all contracts of these operators define them
#: (ASCII blanks only).  ``bytes.split()`` cuts at exactly this set.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a sieve: at most 2^20 words of 64 bits are broadcast (16 MB),
#: however many keys it holds.
SIEVE_BITS = 26

#: Seconds between looks at the driver's heap while a result is computed.
WATCH_S = 2.0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.
    Where that is unset a local master gets a folder of its own; on a cluster
    it is an error, since executors wouldn't see each other's disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="assaymill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a checkpoint in the shared folder.
    For narrow results; the files go when Spark's cleaner drops the frame."""
    shared_dir(df.sparkSession)
    with watched(df.sparkSession):
        return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage once its heap takes more than half of
    its limit: operators of many jobs leave plans and broadcasts behind, for
    which the heap would grow to that limit and stay there."""
    runtime = spark._jvm.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.System.gc()


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM return native memory that it has freed (compilers and
    plans leave much of it in malloc's arenas) to the system; false where the
    JVM has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    try:
        # the server's own class isn't open to calls, its interface is
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


@contextmanager
def watched(spark: SparkSession) -> Iterator[None]:
    """Sweeps and trims the driver while the block computes and after it: one
    job of many stages and tasks leaves enough behind to fill the heap."""
    done, heap = threading.Event(), spark._jvm.Runtime.getRuntime()

    def watch() -> None:
        swept = 0
        try:
            while not done.wait(WATCH_S):
                # a heap that is full of what is needed isn't swept again and again
                if 10 * heap.totalMemory() > 11 * swept:
                    sweep(spark)
                    swept = heap.totalMemory()
                trim(spark)
        except Exception:  # the session may go meanwhile; its job tells
            return

    watcher = InheritableThread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
    sweep(spark)
    trim(spark)


#: Tables stored by this process, for :func:`release`.
_STORED: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables :func:`stored` made in this process, once no frame
    that reads them is needed any more; returns how many there were."""
    n = len(_STORED)
    for path in _STORED:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.clear()
    return n


def stored(df: DataFrame) -> DataFrame:
    """Compute once into a Parquet table in the shared folder: columnar and
    compressed, for results too wide or too long for :func:`cut`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/assaymill/{uuid.uuid4().hex}"
    with watched(spark):
        df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that this process has freed, but its allocators keep, to
    the system, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, with :func:`give_back` at its end: Python
    workers outlive their tasks, and what idle ones hold is missing elsewhere in
    their executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def sieve(keys: DataFrame, *columns: Column) -> DataFrame:
    """A set of keys as bits of a fixed-size table, ``_am_word, _am_bits``:
    what it doesn't hold isn't among the keys; of other values a share passes
    that grows with the number of keys (1.5 % for a million)."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(1 << SIEVE_BITS))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("_am_word"))
    return stored(words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("_am_bits")))


def sifted(rows: DataFrame, by: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with ``_am_maybe``: false for those whose ``columns`` the sieve
    ``by`` doesn't hold.  So wide rows that have nothing to be joined with skip
    the join; the others still go through an exact one."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(1 << SIEVE_BITS))
    both = rows.withColumn("_am_bit", bit).join(F.broadcast(by), F.shiftright("_am_bit", 6) == F.col("_am_word"), "left")
    hit = F.coalesce(F.getbit("_am_bits", F.pmod("_am_bit", F.lit(64)).cast("int")) == 1, F.lit(False))
    return both.withColumn("_am_maybe", hit).drop("_am_bit", "_am_word", "_am_bits")


def row_tie(text_col: str) -> Column:
    """With the id it names a row, up to rows that repeat both id and text."""
    return F.xxhash64(text_of(text_col))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: the smallest id
    (null last), then the smallest hash of the text; of rows equal in both one.

    ``members`` (``_am_id, _am_tie``, and the group ``_am_part``, never null)
    lists every row of ``docs``, or those of all groups of more than one.
    Decisions are joined as narrow rows; a sieve lets all other texts pass
    without a shuffle, and only rows it holds are joined."""
    alike = members.groupBy("_am_part", "_am_id", "_am_tie").agg(F.count(F.lit(1)).alias("_am_rows"))
    order = F.struct(F.col("_am_id").isNull().alias("no"), F.col("_am_id").alias("id"), F.col("_am_tie").alias("tie"))
    alike = stored(alike)
    firsts = alike.groupBy("_am_part").agg(F.min(order).alias("_am_first"), F.sum("_am_rows").alias("_am_n")).where("_am_n > 1").drop("_am_n")
    placed = alike.join(stored(firsts), "_am_part").where((F.col("_am_first") != order) | (F.col("_am_rows") > 1))
    marked = stored(placed.select(F.col("_am_id").alias("_am_of"), F.col("_am_tie").alias("_am_with"), (F.col("_am_first") == order).alias("_am_again")))
    names = carried(docs, ["_am_of", "_am_with", "_am_again", "_am_tie", "_am_bit", "_am_word", "_am_bits", "_am_maybe"])
    rows = docs.select(*map(q, names)).withColumn("_am_tie", row_tie(text_col))
    rows = sifted(rows, sieve(marked, F.col("_am_of"), F.col("_am_with")), q(id_col), F.col("_am_tie"))
    same = q(id_col).eqNullSafe(F.col("_am_of")) & (F.col("_am_tie") == F.col("_am_with"))
    clear = rows.where(~F.col("_am_maybe")).select(*map(q, names))
    rest = rows.where("_am_maybe").join(marked, same, "left_anti").select(*map(q, names))
    out = clear.unionByName(rest)
    again = marked.where("_am_again")
    if not again.isEmpty():
        once = rows.where("_am_maybe").join(again, same, "left_semi").dropDuplicates([id_col, "_am_tie"])
        out = out.unionByName(once.select(*map(q, names)))
    return out


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def carried(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` to carry along: all whose names, in any case, don't
    clash with a column the operator makes itself."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(q(column).cast("string"), F.lit(""))


def unit_hash(*columns: Column, seed: int) -> Column:
    """Deterministic uniform double in (0, 1) of the columns' values."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
