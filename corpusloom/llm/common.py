"""Shared helpers: the shared folder, written intermediate tables, text normalisation."""
from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the contracts: runs of anything but space and \\t..\\r (what bytes.split() splits on).
WORD = r"[^\x20\x09-\x0D]+"

_heard = threading.local()


def _listeners() -> list[list[str]]:
    """Of this thread: queries in other threads have tables of their own."""
    if not hasattr(_heard, "lists"):
        _heard.lists = []
    return _heard.lists


@contextmanager
def made(into: list[str]):
    """Note in ``into`` the paths of the tables that this thread writes meanwhile."""
    _listeners().append(into)
    try:
        yield into
    finally:
        _listeners().pop()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. Where that is unset
    and Spark runs within this one process (tests, bench), a temporary folder takes its place; on a
    cluster there is no stand-in, since a folder of one machine would lose what the others write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    for x in _listeners():
        x.append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor
    costs a reread instead of a recomputation."""
    path = new_path(df.sparkSession, name)
    # Row groups are held in memory until they are whole, one for each task of an executor.
    df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables. Call only once their readers are done."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, name: str, build) -> DataFrame:
    """The rows of build(), written; the tables that were written on the way are deleted."""
    with made([]) as paths:
        out = materialize(build(), name)
    remove(spark, paths[:-1])
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it holds over one HOT-th of the rows, so there are HOT of them at most; its rows
#: are dealt to SPLITS shares or fewer, so that a share holds about one HOT-th again.
HOT, SPLITS = 1000, 64


def skew_join(rows: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, total: int, by: Column, how: str = "inner") -> DataFrame:
    """rows joined with ``one``, which has a row per key at most. ``sizes``, a written table, has
    (keys, k): how many of the ``total`` rows hold a key. The hashes of hot keys, HOT at most, come to
    the driver; their rows are dealt out by a hash of ``by``, and their row of ``one`` goes to every
    share. Keys of equal hash are dealt out alike, which changes no result. Without hot keys there is one
    share and the join is of the same kind, so that runs over different inputs can be compared by join:
    each gives a row for a row of ``rows`` at most."""
    hot = sizes.where(F.col("k") * HOT > total).select(F.xxhash64(*keys).alias("h"), "k").collect()
    shares = min(SPLITS, max((-(-r["k"] * HOT // total) for r in hot), default=1))
    dealt, every = F.pmod(F.xxhash64(by), F.lit(shares)), F.sequence(F.lit(0), F.lit(shares - 1))
    if hot:
        is_hot = F.xxhash64(*keys).isin([r["h"] for r in hot])
        dealt, every = F.when(is_hot, dealt).otherwise(0), F.when(is_hot, every).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__share", dealt.cast("int")).join(one.withColumn("__share", F.explode(every)), [*keys, "__share"], how).drop("__share")


_state: dict = {}


def worker_state(key, make):
    """What an operator keeps from task to task in a Python worker. It goes when another operator's
    begins: a worker that serves several operators in turn holds the largest of them, not their sum."""
    if key not in _state:
        _state.clear()
        trim()
        _state[key] = make()
    return _state[key]


def trim() -> None:
    """Give freed memory of this worker back to the system, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def splitmix(x):
    """64-bit finaliser over a numpy uint64 array (wraps)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
