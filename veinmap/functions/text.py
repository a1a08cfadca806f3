"""Scalar functions as Columns, with the whitespace, case and letter classes of Unicode text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as str.strip() and \s take it.
SPACE = r"[\s\x1c-\x1f]"
#: A word character.
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lowered_contains(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def exact_key(c: Column) -> Column:
    return F.lower(strip(c))


def normalized_key(c: Column) -> Column:
    return F.regexp_replace(exact_key(c), r"(?U)[\s\x1c-\x1f\-_]", "")


def safe_id(c: Column) -> Column:
    return F.translate(c, " /", "__")


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def char_count(c: Column) -> Column:
    return F.length(c)


def line_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n")) + 1


def property_key(name: str) -> str:
    return name if name.startswith("prop_") else f"prop_{name}"


def bare_property(c: Column) -> Column:
    return F.replace(c, F.lit("prop_"), F.lit(""))


def formula(name: Column) -> Column:
    """The first part between underscores with an upper-case letter and a digit, without dashes; else empty."""
    parts = F.filter(F.split(name, "_"), lambda p: p.rlike(r"\p{Lu}") & p.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]"))
    return F.coalesce(F.replace(F.get(parts, F.lit(0)), F.lit("-"), F.lit("")), F.lit(""))


def grade(score: Column) -> Column:
    out = F.when(score >= 90, "A+")
    for least, name in ((80, "A"), (70, "B"), (60, "C"), (50, "D")):
        out = out.when(score >= least, name)
    return out.otherwise("F")


def bar(score: Column, cells: int = 20) -> Column:
    full = F.floor(score * cells / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), cells - full))


def first_class(classes: Column) -> Column:
    return F.coalesce(F.get(classes, F.lit(0)), F.lit("Unknown"))


def _mapped(f, kind: T.DataType, *columns: Column) -> Column:
    """``f`` of the columns' values, Arrow batch by Arrow batch; null where one of them is null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*series)], dtype="object")

    return F.pandas_udf(run, kind)(*columns)


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two strings (the standard library's; not symmetric)."""
    return _mapped(_ratio, T.DoubleType(), a, b)


def rounded(x: Column) -> Column:
    """Rounded to one digit, half to even on the binary value."""
    return _mapped(lambda v: round(float(v), 1), T.DoubleType(), x)


def printed(x: Column) -> Column:
    """A number as Python's str() prints it."""
    return _mapped(str, T.StringType(), x)
