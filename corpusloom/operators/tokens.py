"""Character tokens, vocabulary, encoding and next-token examples."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from .ranking import null_safe_join, running_offsets, sampled_ranges

PAD, UNK, WIDTH = 0, 1, 128


def characters(s: Column) -> Column:
    """V1: code points of a stripped line; none for a blank one."""
    t = strip(s)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def frequencies(lines: DataFrame, text: str = "text") -> DataFrame:
    """V2."""
    return lines.select(F.explode(characters(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def vocabulary(lines: DataFrame, order: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """V4: (token, id) with padding 0, unknown 1 and the rest in order of first occurrence. The least key
    of each character comes from (key, character) rows without text: with the lines beside them, or as a
    least pair, they would be sorted and spilled whole. Only the lines that hold a first occurrence, one
    for each distinct character at most, are then searched for its place. Null keys come last. The last
    window sorts one row per distinct token."""
    c = characters(F.col(text))
    least_key = lines.select(order, F.explode(F.array_distinct(c)).alias("token")).groupBy("token").agg(F.min(order).alias(order))
    wanted = least_key.groupBy(order).agg(F.collect_list("token").alias("tokens"))
    # ``wanted`` has a row per distinct character at most.
    held = null_safe_join(lines.select(order, text), F.broadcast(wanted), [order]).select(order, strip(F.col(text)).alias("line"), "tokens")
    places = held.select(order, F.explode(F.transform("tokens", lambda t: F.struct(t.alias("token"), F.call_function("locate", t, F.col("line")).alias("pos")))).alias("x")).select(order, "x.*")
    first = places.where("pos > 0").groupBy("token").agg(F.min(order).alias("first"), F.min("pos").alias("pos"))
    seen = frequencies(lines, text).where(F.col("freq") >= least).join(first, "token")
    own = seen.select("token", (F.row_number().over(Window.orderBy(F.asc_nulls_last("first"), "pos")) + 1).cast("int").alias("id"))
    special = lines.sparkSession.createDataFrame([("<PAD>", PAD), ("<UNK>", UNK)], "token string, id int")
    return special.unionByName(own)


def id_table(vocab: DataFrame) -> Column:
    """The ids of a character vocabulary as one array by code point: a scalar subquery, four bytes for
    each code point up to the highest (4.5 MB at most)."""
    own = vocab.where(F.col("id") > UNK).agg(F.array_sort(F.collect_list(F.struct(F.ascii("token").alias("code"), "id"))).alias("x"))
    before = F.concat(F.array(F.lit(-1)), F.transform("x", lambda e: e["code"]))
    runs = F.zip_with("x", F.slice(before, F.lit(1), F.size("x")), lambda e, last: F.concat(F.array_repeat(F.lit(UNK), e["code"] - last - 1), F.array(e["id"])))
    return own.select(F.flatten(runs).alias("ids")).scalar()


def encoded(lines: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids). Each line looks its characters up in the table by itself: nothing is
    exploded or shuffled."""
    own = lines.select(key, text, id_table(vocab).alias("__ids"))
    return own.select(key, F.coalesce(looked_up(characters(F.col(text))), F.array().cast("array<int>")).alias("ids"))


def looked_up(chars: Column) -> Column:
    """The ids of characters by the table ``__ids``."""
    return F.transform(chars, lambda c: F.coalesce(F.get("__ids", F.ascii(c)), F.lit(UNK)))


def framed(ids: Column, n: Column, width: int = WIDTH) -> Column:
    """V8: the first n ids, padded on the right, or the last ``width`` of them."""
    return F.when(n < width, F.concat(F.slice(ids, F.lit(1), n), F.array_repeat(F.lit(PAD), F.lit(width) - n))).otherwise(F.slice(ids, F.greatest(n - (width - 1), F.lit(1)), F.lit(width)))


def prefix_examples(lines: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """V7, V8: every prefix of two or more ids with the id that follows. (key, i, input, target)."""
    at = lines.where(F.size("ids") > 1).select(key, "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("i"))
    return example(at, width).select(key, "i", "input", "target")


def example(at: DataFrame, width: int = WIDTH) -> DataFrame:
    """``ids`` and a prefix length ``i`` become the prefix's input and target."""
    return at.withColumns({"input": framed(F.col("ids"), F.col("i"), width), "target": F.element_at("ids", F.col("i") + 1)}).drop("ids")


def example_count(s: Column) -> Column:
    """How many prefix examples a line gives; it needs no ids."""
    return F.greatest(F.coalesce(F.length(strip(s)), F.lit(0)) - 1, F.lit(0))


def encoded_examples(at: DataFrame, vocab: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``text`` and a prefix length ``i`` become the prefix's input and target. Only the characters that
    the example holds are looked up."""
    piece = F.substring(strip(F.col(text)), F.greatest(F.col("i") - (width - 1), F.lit(1)), F.least(F.col("i"), F.lit(width)) + 1)
    own = at.withColumn("__piece", piece).drop(text).withColumn("__ids", id_table(vocab))
    own = own.withColumn("ids", looked_up(F.split("__piece", ""))).drop("__piece", "__ids")
    return own.withColumns({"input": framed(F.col("ids"), F.size("ids") - 1, width), "target": F.element_at("ids", -1)}).drop("ids")


def prefix_sums(ids: Column) -> tuple[Column, Column, Column]:
    """Of all prefix examples of one line: how many, the sum of their targets, and the sum of each
    one's last input times its length; without making them."""
    heads = F.slice(ids, F.lit(1), F.size(ids) - 1)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return (F.size(ids) - 1).cast("long"), total(F.slice(ids, F.lit(2), F.size(ids))), total(F.transform(heads, lambda v, k: v.cast("long") * (k + 1)))


def cut_example(ids: Column, cut: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """One example per line; a blank line is all padding, a single id has an unknown target."""
    blank = F.array_repeat(F.lit(PAD), width)
    return (F.when(F.size(ids) == 0, blank).when(F.size(ids) == 1, framed(ids, F.lit(1), width)).otherwise(framed(ids, cut + 1, width)),
            F.when(F.size(ids) == 0, F.lit(PAD)).when(F.size(ids) == 1, F.lit(UNK)).otherwise(F.try_element_at(ids, cut + 2)))


def document_blocks(docs: DataFrame, key: str, words: Column, size: int = WIDTH) -> DataFrame:
    """S9 within a row: (key, block, tokens) of ``size`` words each; a ragged end goes. Blocks are
    slices, so nothing is shuffled."""
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / size).cast("int") - 1), lambda k: F.struct(k.cast("long").alias("block"), F.slice(w, k * size + 1, F.lit(size)).alias("tokens")))
    # Through an array of one, so that the words of a text are split once.
    held = F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, cut(w)))
    return docs.select(key, F.explode(F.get(held, F.lit(0))).alias("x")).select(key, "x.*")


def file_blocks(lines: DataFrame, file: str, key: str, text: str, words: Callable[[Column], Column], size: int = WIDTH) -> DataFrame:
    """(file, block, tokens): the words of a file's lines, in order of (key, words), cut every ``size``
    words; a file's ragged end goes. A line's place comes from the counts before it, and only counts are put
    in order: with the text beside them, a file's lines would meet in one task. Text is dealt by (file, key),
    and only lines that tie in both are ordered by their words. Blocks inside one line are slices of it; only
    what is left at a line's two ends, less than a block each, meets others by (file, block). Null files are
    a file, null keys come first; lines without words add nothing."""
    line = F.struct(file, key).alias("__line")  # never null, and equals itself where file or key is null
    counts = sampled_ranges(lines.select(file, key, F.size(words(F.col(text))).alias("__n")), [key], "__range")
    counts = counts.groupBy(file, key, "__range").agg(F.sum("__n").alias("__n"))
    first = running_offsets(counts, [file], F.col("__range"), [key], F.col("__n"), "__first").select(line, "__first")
    d = lines.select(line, words(F.col(text)).alias("__w")).withColumn("__n", F.size("__w"))
    before = F.sum("__n").over(Window.partitionBy("__line").orderBy("__w").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__at", F.coalesce(before, F.lit(0))).join(first, "__line").where("__n > 0")
    d = d.select(F.col("__line")[file].alias(file), "__w", "__n", (F.col("__at") + F.col("__first")).alias("__at"))
    lead = F.least((-F.col("__at") % size + size) % size, F.col("__n")).cast("int")
    d = d.withColumns({"__lead": lead, "__block": F.ceil(F.col("__at") / size), "__whole": F.floor((F.col("__n") - lead) / size).cast("int")})
    part = lambda block, tokens: F.struct(block.cast("long").alias("block"), tokens.alias("tokens"))
    whole = d.where("__whole > 0").select(file, "__lead", "__block", "__w", F.explode(F.expr("sequence(0, __whole - 1)")).alias("__k"))
    whole = whole.select(file, (F.col("__block") + F.col("__k")).cast("long").alias("block"), F.slice("__w", F.col("__lead") + F.col("__k") * size + 1, F.lit(size)).alias("tokens"))
    ends = d.where((F.col("__lead") > 0) | (F.col("__lead") + F.col("__whole") * size < F.col("__n")))
    rest = F.col("__lead") + F.col("__whole") * size
    ends = ends.select(file, "__at", F.explode(F.array(part(F.floor(F.col("__at") / size), F.slice("__w", F.lit(1), F.col("__lead"))),
                                                       part(F.col("__block") + F.col("__whole"), F.slice("__w", rest + 1, F.col("__n"))))).alias("x"))
    ends = ends.select(file, "__at", "x.*").where(F.size("tokens") > 0).groupBy(file, "block").agg(F.array_sort(F.collect_list(F.struct("__at", "tokens"))).alias("x"))
    ends = ends.select(file, "block", F.flatten(F.transform("x", lambda x: x["tokens"])).alias("tokens")).where(F.size("tokens") == size)
    return whole.unionByName(ends)


def non_pad(ids: Column) -> Column:
    """V13."""
    return F.size(F.array_remove(ids, PAD))
