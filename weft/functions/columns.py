"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """A column name for use in F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def nest(df: DataFrame, name: str) -> DataFrame:
    """All columns of df as one struct column."""
    return df.select(F.struct(*[F.col(quote(c)) for c in df.columns]).alias(name))


def expression(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def draw(*parts) -> Column:
    """A reproducible pseudo-random whole number below 2 ** 48 of the given columns and constants: the first 12 hex digits of
    the MD5 of their texts, joined by ":", which other engines can compute too."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def unit_hash(*parts) -> Column:
    """The same as a double in [0, 1)."""
    return draw(*parts) / F.lit(float(1 << 48))
