"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by containment.

The rules (`license_rules`) are written by hand: addresses, names with and without version, passages
of license texts; their order is their priority. A text is lower-cased and gated: only the rules
whose keywords it contains are tried. Identifiers in SPDX tags, expressions included, are read apart.
All places are kept as intervals. A place inside another one falls away (``gpl`` inside ``lgpl``); of
equal intervals the earlier rule stays. Every row is judged by itself, so nothing is shuffled.

Defined cases: a null text counts as empty: no words, null first_word and last_word, empty labels,
score 0; ties are equal intervals; a very long text is scanned whole, in one task, in time linear in
its matches; repeated rows each give a row; an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import SPDX_IDS, rules
from .spans import let, match_spans, running

# Characters that are no part of a word, before A-Z are lower-cased.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{_GAP}]"
_SEP = f"[{_GAP}]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: An SPDX tag with its license expression (of up to 1,001 identifiers: the regex engine takes a frame
#: of the stack for each), and an identifier in it.
_ID = r"[a-z0-9][a-z0-9.+-]*+"
SPDX_TAG = rf"\bspdx-license-identifier:[\s(]*+{_ID}(?:[\s)]*\s(?:or|and|with)\s[\s(]*+{_ID}){{0,1000}}"


def base_regex(phrase: str | None = None) -> str:
    some = [phrase] if phrase else [p for p, _ in BASE]
    return f"(?i)(?<!{WORD})(?:" + "|".join(p.replace(" ", _SEP) for p in some) + f")(?!{WORD})"


def spdx_places(text: Column) -> Column:
    """Places of the known identifiers in SPDX tags."""
    def places(tag: Column) -> Column:
        named = F.transform(match_spans(tag["match"], F.lit(_ID)), lambda m: F.struct((tag["start"] + m["start"]).alias("start"), (tag["start"] + m["end"]).alias("end"), F.regexp_replace(m["match"], r"(?:-only|-or-later|\+|\.)$", "").alias("id")))
        known = F.filter(named, lambda m: m["id"].rlike(f"^(?:{SPDX_IDS})$"))
        # Whole versions of the GNU licenses go without their .0.
        return F.transform(known, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus_end"), F.lit(-1).alias("priority"), F.regexp_replace(m["id"], r"^((?:a|l)?gpl-[123])\.0$", "$1").alias("label"), F.lit(1.0).alias("weight")))

    return F.when(F.contains(text, F.lit("spdx")), F.flatten(F.transform(match_spans(text, F.lit(SPDX_TAG)), places)))


def detections(text: Column) -> Column:
    """array<struct<start, end, label, weight>> of the places of the method's rules in a lower-cased
    text that stay after suppression."""
    by_keyword: dict[str, list] = {}
    for i, (k, r, n, w) in enumerate(rules()):
        by_keyword.setdefault(k, []).append(F.struct(F.lit(i).alias("priority"), F.lit(r).alias("regex"), F.lit(n).alias("label"), F.lit(w).alias("weight")))
    table = F.array(*(F.struct(F.array(*map(F.lit, k.split())).alias("keywords"), F.array(*rs).alias("rules")) for k, rs in by_keyword.items()))
    tried = F.flatten(F.transform(F.filter(table, lambda t: F.forall(t["keywords"], lambda k: F.contains(text, k))), lambda t: t["rules"]))
    found = F.flatten(F.transform(tried, lambda r: F.when(F.regexp_like(text, r["regex"]), F.transform(match_spans(text, r["regex"]), lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("minus_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))).otherwise(F.expr("cast(array() as array<struct<start:int,minus_end:int,priority:int,label:string,weight:double>>)"))))
    none = F.expr("cast(array() as array<struct<start:int,minus_end:int,priority:int,label:string,weight:double>>)")

    def kept(places: Column) -> Column:
        # In this order a place lies inside another one just if an earlier one reaches as far.
        reach = running(F.transform(places, lambda p: -p["minus_end"]), F.lit(-1), lambda s, e: F.greatest(s, e))
        marked = F.zip_with(places, reach, lambda p, far: F.struct(p["start"].alias("start"), (-p["minus_end"]).alias("end"), p["label"].alias("label"), p["weight"].alias("weight"), far.alias("reach")))
        return F.transform(F.filter(marked, lambda p: p["reach"] < p["end"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), p["weight"].alias("weight")))

    return let(F.array_sort(F.concat(found, F.coalesce(spdx_places(text), none))), kept)


def gates() -> list[tuple[str, ...]]:
    """Sets of literals; every text that some rule but those on ``cc`` fits holds all of one set.
    ``licen`` serves the rules that hold it outside optional and alternative parts."""
    def fixed(regex: str) -> str:
        regex = regex.removeprefix(r"\b(?:").removeprefix(r"\b")
        while (less := re.sub(r"\([^()]*\)\??", "", regex)) != regex:
            regex = less
        return regex

    return list(dict.fromkeys([("spdx",), *(("licen",) if "licen" in fixed(r) else tuple(k.split()) for k, r, *_ in rules() if k != "cc")]))


def gated(text: Column) -> Column:
    """Whether some rule may fit the lower-cased text."""
    gate = F.contains(text, F.lit("cc")) & text.rlike(r"\bcc[^a-z0-9]+by")
    for words in reversed(gates()):
        some = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            some = some & F.contains(text, F.lit(w))
        gate = some | gate
    return gate


def count_words(text: Column) -> Column:
    """How many words there are: the parts between gaps but for empty ones at either end. Splitting at
    gaps is several times as fast as matching words."""
    def inner(p: Column) -> Column:
        return F.greatest(F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - (F.element_at(p, -1) == "").cast("int"), F.lit(0))

    return let(F.split(text, f"[{_GAP}]++", -1), inner)


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, found (the method's places), n_words, n_base, first_word, last_word and
    base (array of base labels)."""
    words = count_words
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*(F.col(k) for k in dict.fromkeys(keep)), text.alias("__text"))
    d = d.withColumn("__base", F.col("__text").rlike(base_regex()))
    d = d.withColumn("__lower", F.lower("__text"))
    gate = F.col("__base") | gated(F.col("__lower"))
    parts = F.split("__text", base_regex(), -1)
    last_words = words(F.element_at(F.regexp_extract_all("__text", F.lit(base_regex()), F.lit(0)), -1))
    d = d.withColumns({
        "n_words": words(F.col("__text")).cast("long"),
        "n_base": F.when(F.col("__base"), F.size(parts) - 1).otherwise(0).cast("long"),
        "first_word": F.when(F.col("__base"), words(F.get(parts, F.lit(0)))).cast("long"),
        "__after": F.when(F.col("__base"), words(F.element_at(parts, -1)) + last_words),
        "base": F.when(F.col("__base"), F.array_compact(F.array(*(F.when(F.col("__text").rlike(base_regex(p)), F.lit(n)) for p, n in BASE)))).otherwise(F.array().cast("array<string>")),
        "found": F.when(gate, detections(F.col("__lower"))),
    })
    return d.withColumn("last_word", F.col("n_words") - F.col("__after")).drop("__text", "__lower", "__base", "__after")


def license_report(docs: DataFrame) -> DataFrame:
    s = scan(docs, "doc_id")
    mine = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(0.0))
    return s.select("doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(F.concat("base", mine)).alias("labels"), score.alias("score"))
