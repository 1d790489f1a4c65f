"""Sentence segmentation and chunking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SPACE

BOUNDARY = rf"(?<=[.!?])[{SPACE}]+"


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """G-S1: (key, pos, sentence), one row per sentence."""
    return docs.select(key, F.posexplode(F.split(text, BOUNDARY)).alias("pos", "sentence"))


def chunks(text: Column, size: int = 500_000) -> Column:
    """G-S3: greedy chunks. A sentence and a space are added while the chunk stays below ``size``;
    a longer sentence is a chunk of its own. Only the places of the cuts are folded, so the work grows
    with the text."""
    parts = F.split(text, BOUNDARY)
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))

    def step(s, x):
        fits = (s["at"] == 0) | (s["cur"] + F.length(x) < size)
        return F.struct(F.when(fits, s["cur"]).otherwise(0).alias("cur"), s["at"].alias("at"), F.when(fits, s["cuts"]).otherwise(F.concat(s["cuts"], F.array(s["at"]))).alias("cuts"))

    def grown(s, x):
        t = step(s, x)
        return F.struct((t["cur"] + F.length(x) + 1).alias("cur"), (t["at"] + 1).alias("at"), t["cuts"].alias("cuts"))

    cuts = F.aggregate(parts, start, grown, lambda s: F.concat(s["cuts"], F.array(s["at"])))
    held = F.transform(F.array(F.struct(parts.alias("p"), cuts.alias("c"))), lambda x: F.zip_with(F.slice(x["c"], F.lit(1), F.size(x["c"]) - 1), F.slice(x["c"], F.lit(2), F.size(x["c"])), lambda a, b: F.btrim(F.array_join(F.slice(x["p"], a + 1, b - a), " "))))
    return F.get(held, F.lit(0))
