"""Cleaning and formatting as Column expressions: no Python runs on the data.

White space is Unicode white space throughout; numbers are parsed by a fixed grammar, so that Java's suffixes,
infinities and NaN become null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import contracts as C

SPACE_ENDS = r"(?U)^\s+|\s+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_ENDS, "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_missing(c: Column) -> Column:
    return c.isNull() | strip(c.cast("string")).isin(*C.MISSING_WORDS)


def nullify(c: Column) -> Column:
    return F.when(~is_missing(c), strip(c.cast("string")))


def text(c: Column, weak: bool = False) -> Column:
    """Stripped, missing as ''. weak: only null is missing, the words for it are text."""
    return F.coalesce(strip(c.cast("string")) if weak else nullify(c), F.lit(""))


def number(c: Column) -> Column:
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def clean_numeric(c: Column, units: tuple[str, ...] = C.NUMBER_UNITS) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), "|".join(units), ""), r"(?U)\s+", "")
    return number(bare)


def to_bool(c: Column, also_true: tuple[str, ...] = ()) -> Column:
    low, n = F.lower(strip(c.cast("string"))), number(c)
    return F.when(is_missing(c), None).when(low.isin(*C.TRUE_WORDS, *also_true) | (n == 1), True).when(low.isin(*C.FALSE_WORDS) | (n == 0), False)


def bool_label(c: Column, yes: str, no: str) -> Column:
    b = to_bool(c)
    return F.when(b, yes).when(~b, no)


def flag(c: Column) -> Column:
    up = F.upper(strip(c.cast("string")))
    return F.when(up.isin("Y", "N"), up).otherwise("")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def normalize(c: Column) -> Column:
    """Lower case; all but 0-9, a-z, Hangul syllables and white space to a space; collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^0-9a-z가-힣\s]", " "))


def lowered(c: Column) -> Column:
    """Lower case and collapsed, punctuation kept."""
    return collapse(F.lower(c))


def tokens(c: Column) -> Column:
    """The distinct words of the normalised text in order: runs of what ``normalize`` keeps, cut out in one pass."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^0-9a-z가-힣]+"), lambda t: t != ""))


def line_list(c: Column) -> Column:
    """Items of a list literal or comma list, unquoted, without blanks and 'nan', each once, in order."""
    s = strip(c)
    literal = F.from_json(F.when(s.startswith("["), s), "array<string>")
    items = F.transform(F.coalesce(literal, F.split(s, ",")), lambda t: F.regexp_replace(strip(t), "^['\"]+|['\"]+$", ""))
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(items, lambda t: (t != "") & (F.lower(t) != "nan"))))


def pipe_values(c: Column, most: int) -> Column:
    return F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|]"), strip), lambda t: t != ""), 1, most)


def address(c: Column) -> Column:
    """struct(sido, sigungu, dong, detail, complete): city-and-district pairs join as the second level."""
    t = F.split(collapse(nullify(c)), " ")
    n = F.size(t)
    pair = (n >= 4) & F.get(t, 1).endswith("시") & F.get(t, 2).rlike("(구|군)$")
    used = F.when(pair, 4).when(n >= 3, 3).when(n >= 2, 2).otherwise(1)
    sigungu = F.when(pair, F.concat_ws(" ", F.get(t, 1), F.get(t, 2))).when(n >= 2, F.get(t, 1))
    dong = F.when(pair, F.get(t, 3)).when(n >= 3, F.get(t, 2))
    detail = F.when(n > used, F.array_join(F.slice(t, used + 1, F.greatest(n - used, F.lit(0))), " "))
    there = F.coalesce(~is_missing(F.get(t, 0)) & ~is_missing(sigungu) & ~is_missing(dong), F.lit(False))
    return F.struct(F.get(t, 0).alias("sido"), sigungu.alias("sigungu"), dong.alias("dong"), detail.alias("detail"), there.alias("complete"))


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)\s+$", ""), F.lit("…")))


def py_round(c: Column, digits: int = 0) -> Column:
    """Half to even on the binary value."""
    if digits == 0:
        return F.bround(c, 0)
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).try_cast("double")


def format_number(c: Column, digits: int = 0) -> Column:
    return F.format_number(F.bround(c, 0), 0) if digits == 0 else F.format_number(c, digits)


def metric(c: Column, unit: str, digits: int = 2) -> Column:
    return F.concat(format_number(c, digits), F.lit(unit))


def any_hint(c: Column, hints: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (c.contains(h) for h in hints))


def disclosed(c: Column, profile: str) -> Column:
    """Whether a text states its limits, by the hints and the normalisation of a profile."""
    how, hints = C.DISCLOSURE[profile]
    c = F.coalesce(c, F.lit(""))
    if how == "nospace":
        return any_hint(F.replace(c, F.lit(" "), F.lit("")), tuple(h.replace(" ", "") for h in hints))
    return any_hint(normalize(c) if how == "words" else lowered(c), hints)


def sha_rank(salt: str, c: Column) -> Column:
    return F.sha2(F.concat_ws("||", F.lit(salt), c), 256)
