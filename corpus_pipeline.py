"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next one's docs. All but the last return the columns of documents. No stage looks rows up by
doc_id, so rows with null or repeated doc_ids are neither lost nor multiplied.

Defined cases, for every stage: null and empty texts fail the quality rules (too few words), and pass
the later stages as they are; null lang or source is a group of its own; a null doc_id is linked with
nothing and comes after all others; of repeated rows with enough words one stays (near-dedup); very
long texts are judged whole; ties of doc_id go to the first row; an empty table gives an empty result;
extra columns are passed on, whatever their names, but for packing, which returns pieces.
"""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import neardup, packing, quality, secrets, suffixdedup
from corpusloom.llm.common import made, new_path, read, remove, settled


#: Tables written within the latest stage of a run; a run has a thread and a folder of its own.
_tables: dict[tuple[int, str], list[str]] = {}


def _step(stage, first: bool = False):
    """The stage, which first deletes the tables written within the stage before: its rows have been
    written and reread by then."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (threading.get_ident(), sf_dir)
        before = _tables.pop(run_of, [])
        if not first:
            remove(spark, before)
        with made([]) as written:
            out = stage(spark, docs, sf_dir)
        _tables[run_of] = written
        return out

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The verdict needs no join back by doc_id: counts travel
    with the row."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return neardup.deduplicate(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document are cut out; n_chars follows."""
    return suffixdedup.remove_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    done = secrets.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, written once; nothing else of this stage is left behind."""
    return settled(spark, "pieces", lambda: packing.pack(docs))


STAGES = [("quality rules", _step(quality_rules, first=True)), ("near-dedup", _step(near_dedup)), ("suffix-array dedup", _step(suffix_dedup)), ("secret scan", _step(secret_scan)), ("packing", _step(pack))]

#: The trained forest and the tokenizer have no SQL form: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            written.append(new_path(spark, f"stage{k}"))
            out.write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
    remove(spark, written)
    return out
