"""Token-ID output: Parquet list columns in ascending doc_id order.

Texts are range-partitioned by doc_id before they are encoded, so that ids are made once, where
they are written. Each task writes one ascending run of documents: ids as a list column (dictionary
encoding: the vocabulary bounds the dictionary, and 16-bit indices take the place of 32-bit
values), doc_id and positions with delta encoding (format version 2), row groups and pages of a set
size with page indexes, so that a reader of a doc_id range or of the metadata alone skips the rest.
A document's start is its file's base, summed from the metadata columns, plus its place there.

Defined cases: null and empty texts hold the end id alone; documents with the same doc_id follow
each other in text order, identical ones in any order; null doc_ids come first; a very long text is
encoded whole, in one task, and is one list; an empty table gives files without rows; extra columns,
whatever their names, are ignored.
"""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, new_path, tokenizer_path
from .encoder import LibraryCache, slices, worker_cache

#: Rows of a batch of texts that goes to Python.
BATCH_ROWS = 2500
SCHEMA = "doc_id long, part int, place long, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 0,
                 row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Encode every whole text, append ``end_id`` and write the files of ``out``."""
    path = path or tokenizer_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache, part, at, place = worker_cache(LibraryCache, path), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            for s in slices(texts):
                ids, ends = cache.encode(texts[s])
                ids, n = np.insert(ids.astype(np.int32), ends, end_id), np.diff(ends, prepend=0) + 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                k = len(n)
                yield pa.RecordBatch.from_arrays([doc_ids[s], pa.array(np.full(k, part, np.int32)), pa.array(np.arange(place, place + k)), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "part", "place", "local_start", "n_tokens", "ids"])
                at, place = at + int(ends[-1]), place + k

    d = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    # Texts wait outside the heap in batches of this many rows.
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        _write(d.mapInArrow(run, SCHEMA), out, row_group_mb, page_kb)
    finally:
        conf.set(key, before)


def _write(d: DataFrame, out: str, row_group_mb: int, page_kb: int) -> None:
    (d.write
        .option("compression", "zstd").option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
        .option("parquet.dictionary.page.size", 1 << 20).option("parquet.page.write-checksum.enabled", "true")
        .parquet(out))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): columns not selected are not read, and a filter on doc_id
    reaches the row groups and pages."""
    t = spark.read.schema(SCHEMA).parquet(out)
    # One row per file that has rows, so the window below sorts as many rows as there are files.
    sums = t.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # Written first, so that its size is known and the ids are not shuffled to meet it.
    return t.join(materialize(base, "bases"), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("ids")
            raw = np.asarray(lists.values).astype("<u4").tobytes()
            o = (np.asarray(lists.offsets).astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_verify(docs: DataFrame, **options) -> DataFrame:
    """Write the files into the shared folder and digest what is read back from them."""
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, **options)
    return checksums(read_tokens(docs.sparkSession, out))
