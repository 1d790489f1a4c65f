"""String expressions of the rewrite rules. Each is a Column -> Column function, so plans stay in
whole-stage code generation."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space as Python's str.strip and str.split have it, as a character class and as characters.
SPACE = "\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(_BLANKS))


def without_end(s: Column) -> Column:
    """All trailing ``.``, ``?``, ``!`` removed."""
    return F.rtrim(s, F.lit(".?!"))


def words(s: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.array_remove(F.split(s, f"[{SPACE}]+"), "")


def reverse_words(s: Column) -> Column:
    """P3."""
    return F.concat(F.array_join(F.reverse(words(without_end(s))), " "), F.lit("."))


def parity_negation(s: Column) -> Column:
    """An even number of words gets a leading ``Not``, an odd one a trailing ``Not``."""
    w = words(without_end(s))
    text = F.array_join(w, " ")
    return F.when(F.size(w) % 2 == 0, F.concat(F.lit("Not "), text, F.lit("."))).otherwise(F.concat(text, F.lit(" Not.")))


#: Rule registry: name -> Column function.
RULES: dict[str, Callable[[Column], Column]] = {"reversed": reverse_words, "parity_negation": parity_negation}


def guarded(rule: Callable[[Column], Column], s: Column) -> Column:
    """Blank input gives an empty result."""
    return F.when(strip(s) == "", F.lit("")).otherwise(rule(s))


def shorten(s: Column, limit: int = 1000) -> Column:
    """Longer texts keep their first and last ``limit // 2`` characters."""
    half = limit // 2
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(half)), F.right(s, F.lit(half)))).otherwise(s)


def head_words(s: Column, n: int = 10) -> Column:
    """The first n words without the sentence's end, and a full stop. The rules apply to this."""
    return F.concat(F.array_join(F.slice(words(without_end(s)), 1, n), " "), F.lit("."))


def output_name(path: Column, rule: Column) -> Column:
    """P10: file stem, underscore, rule."""
    return F.concat(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("_"), rule, F.lit(".train"))


def megabytes(size: Column) -> Column:
    """Bytes as the reference's file report shows them."""
    return F.format_string("%.2f MB", size / F.lit(1024.0 * 1024.0))


def minutes(seconds: Column) -> Column:
    return F.format_string("%.2f min", seconds / F.lit(60.0))


def file_safe(name: Column) -> Column:
    out = F.lower(name)
    for c in " -/":
        out = F.replace(out, F.lit(c), F.lit("_"))
    return out


def tail_start(s: Column) -> Column:
    """G-S4: characters up to and with the last sentence end (``. ``, ``? ``, ``! `` or a line
    feed); 0 where there is none."""
    def last(mark: str) -> Column:
        at = F.locate(mark[::-1], F.reverse(s))
        return F.when(at > 0, F.length(s) - at + 1).otherwise(0)

    return F.greatest(last(". "), last("? "), last("! "), last("\n"))


def carry_over(s: Column, least: int = 10_000, tail: int = 5000) -> Column:
    """G-S4: the part of a batch that is carried to the next one."""
    at = tail_start(s)
    return F.when(F.length(s) <= least, F.lit("")).when(at > 0, F.substring(s, at + 1, F.length(s))).otherwise(F.right(s, F.lit(tail)))
