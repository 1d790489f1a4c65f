"""G-S2: sentence segmentation that learns from the corpus itself which words end in a full stop without
ending a sentence, after Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection"
(2006). No labels, no pretrained weights.

One aggregation counts words by (type, has a full stop, next type where the word ends in ``.``, ``!`` or
``?``). A type is an abbreviation if its full stop is far likelier than chance by a log-likelihood ratio,
weighed down by its length and by its uses without a full stop. A type is a sentence starter if it follows
sentence ends more often than chance explains. A boundary behind an abbreviation counts only if a
starter that isn't in lower case follows; all others are those of the plain rule (segment.sentences).

Defined cases: null texts give no row, an empty one gives one empty sentence; rows that share a key stay
apart; a corpus without full stops has no abbreviations; types without letters or with digits are none.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SPACE, words
from ..sources.shared import new_folder
from .ranking import null_safe_join
from .segment import BOUNDARY

#: Marks around a word that are not part of it; least scores of abbreviations and of starters.
MARKS, LEAST_ABBREVIATION, LEAST_STARTER = "\"'()[]{},;:", 0.3, 30.0


@dataclass
class BoundaryModel:
    """``abbreviations`` and ``starters``: (type, score), a row for each type."""
    abbreviations: DataFrame
    starters: DataFrame


def word_type(w: Column) -> Column:
    return F.lower(F.rtrim(F.btrim(w, F.lit(MARKS)), F.lit(".?!")))


def has_stop(w: Column) -> Column:
    return F.endswith(F.btrim(w, F.lit(MARKS)), F.lit("."))


def boundary_words(text: Column) -> tuple[Column, Column]:
    """For each boundary of the plain rule, in order, the word before and the word after it (empty at a
    text's end). Words are run over once and never tried again from within."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![^{SPACE}])([^{SPACE}]++)(?<=[.!?])[{SPACE}]+"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"[.!?](?=[{SPACE}]+([^{SPACE}]*+))"), F.lit(1))


def boundary_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, stop, next, n) over all words: one scan, added up before the shuffle."""
    w = docs.select(words(F.col(text)).alias("w"))
    follows = lambda x, k: F.when(F.right(x, F.lit(1)).isin(".", "!", "?"), F.get("w", k + 1))
    t = w.select(F.explode(F.transform("w", lambda x, k: F.struct(x.alias("word"), follows(x, k).alias("after")))).alias("x"))
    t = t.select(word_type(F.col("x.word")).alias("type"), has_stop(F.col("x.word")).alias("stop"), word_type(F.col("x.after")).alias("next"))
    return t.groupBy("type", "stop", "next").agg(F.count("*").alias("n"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of the types whose full stop belongs to them."""
    t = counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("k"))
    t = t.where(F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike("[0-9]"))
    all_ = t.agg((F.sum("k") / F.sum("n")).alias("share"))
    p = F.least(F.greatest(F.col("share"), F.lit(1e-9)), F.lit(1 - 1e-9))
    without = F.col("n") - F.col("k")
    ratio = -2 * (F.col("k") * F.log(p) + without * F.log(1 - p) - F.col("k") * F.log(F.lit(0.99)) - without * F.log(F.lit(0.01)))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    stops = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * stops * F.pow(letters.cast("double"), -without)
    # ``all_`` is one row.
    return t.where("k > 0").join(F.broadcast(all_)).select("type", score.alias("score")).where(F.col("score") >= LEAST_ABBREVIATION)


def starters(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(type, score) of the types that follow sentence ends more often than chance explains; ends behind
    the ``known`` abbreviations don't count."""
    n = counts.groupBy("type").agg(F.sum("n").alias("n"))
    ends = counts.where("next is not null").join(known.select("type", F.lit(True).alias("stop")), ["type", "stop"], "left_anti")
    a = ends.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("a"))
    total, breaks = n.agg(F.sum("n").alias("words")), a.agg(F.sum("a").alias("breaks"))
    t = a.join(n, "type").where(F.col("type").rlike(r"\p{L}")).join(F.broadcast(total)).join(F.broadcast(breaks))
    a, n, words_, b = map(F.col, ("a", "n", "words", "breaks"))
    term = lambda x, q: F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(q))
    p, own, rest = b / words_, a / n, (b - a) / F.greatest(words_ - n, F.lit(1))
    fit = lambda q, r: term(a, q) + term(n - a, 1 - q) + term(b - a, r) + term(words_ - n - b + a, 1 - r)
    return t.select("type", (own > p).alias("more"), (2 * (fit(own, rest) - fit(p, p))).alias("score")).where(F.col("more") & (F.col("score") >= LEAST_STARTER)).drop("more")


def train_boundaries(docs: DataFrame, text: str = "text") -> BoundaryModel:
    """Learn from all words of ``docs``. The counts are written into the shared folder once, since three
    passes read them."""
    at = new_folder(docs.sparkSession, "boundaries")
    boundary_counts(docs, text).write.parquet(at)
    counts = docs.sparkSession.read.parquet(at)
    known = abbreviations(counts)
    return BoundaryModel(known, starters(counts, known))


def joined_places(docs: DataFrame, model: BoundaryModel, key: str, text: str) -> DataFrame:
    """(key, __print, places): the boundaries of the plain rule, counted from 0, that the model does not
    see. ``__print`` is a hash of the text. The model's two lists are sent to all tasks: they hold types,
    not places, and a join that deals places out by type would have one task for each frequent word."""
    left, right = boundary_words(F.col(text))
    at = docs.select(key, F.xxhash64(text).alias("__print"), F.posexplode(F.arrays_zip(left.alias("left"), right.alias("after"))).alias("k", "x")).select(key, "__print", "k", "x.*")
    d = at.where(has_stop(F.col("left")) & (F.col("after") != "")).select(key, "__print", "k", "after", word_type(F.col("left")).alias("__left"), word_type(F.col("after")).alias("__right"))
    d = d.join(F.broadcast(model.abbreviations.select(F.col("type").alias("__left"))), "__left", "left_semi")
    d = d.join(F.broadcast(model.starters.select(F.col("type").alias("__right"), F.lit(True).alias("starts"))), "__right", "left")
    d = d.where(F.col("starts").isNull() | F.col("after").rlike(r"^\p{Ll}"))
    return d.groupBy(key, "__print").agg(F.collect_set("k").alias("places"))


def model_sentences(docs: DataFrame, model: BoundaryModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """G-S2: (key, pos, sentence). Parts of the plain rule are joined again where the model sees no
    boundary, with the white space that stood between them; none is added or lost within a sentence. Only
    words around boundaries meet the model; a text then meets its places by key and hash, once, and is put
    together within its row."""
    d = null_safe_join(docs.select(key, text, F.xxhash64(text).alias("__print")), joined_places(docs, model, key, text), [key, "__print"], "left")
    # Through an array of one, so that a text is split once.
    held = F.struct(F.split(text, BOUNDARY).alias("p"), F.regexp_extract_all(F.col(text), F.lit(BOUNDARY), F.lit(0)).alias("s"), F.col("places").alias("c"))

    def whole(x: Column) -> Column:
        last = F.size(x["p"]) - 1
        pieces = F.flatten(F.zip_with(x["p"], x["s"], lambda a, b: F.array(a, b)))
        ends = F.concat(F.array_except(F.sequence(F.lit(0), last - 1), x["c"]), F.array(last))
        y = F.transform(F.array(F.struct(pieces.alias("q"), ends.alias("e"))), lambda v: F.zip_with(
            v["e"], F.concat(F.array(F.lit(-1)), F.slice(v["e"], F.lit(1), F.size(v["e"]) - 1)),
            lambda b, a: F.array_join(F.slice(v["q"], 2 * a + 3, 2 * (b - a) - 1), "")))
        return F.get(y, F.lit(0))

    made = F.get(F.transform(F.array(held), whole), F.lit(0))
    return d.select(key, F.posexplode(F.when(F.col("places").isNull(), F.split(text, BOUNDARY)).otherwise(made)).alias("pos", "sentence"))
