"""String operators on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path; the part itself if it has none."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^.*\.", "")


def file_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def file_dir(path: Column) -> Column:
    """The path up to its last part; ./ if it has no other."""
    found = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(found == "", "./").otherwise(found)


def leading_zeros(number: Column, width: int = 3) -> Column:
    """The number as text of at least ``width`` digits."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def get_uuid(text: Column) -> Column:
    """The first UUID in a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, "([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1), F.lit(""))


def separate_col(df: DataFrame, col: str, into: list[str], sep: str = "[^a-zA-Z0-9]+") -> DataFrame:
    """Splits a text column at a pattern (by default any run of other characters than letters and digits) into leading
    columns; missing parts are null."""
    parts = F.split(F.col(col), sep)
    return df.select(*[F.try_element_at(parts, F.lit(k + 1)).alias(n) for k, n in enumerate(into)], *[c for c in df.columns if c != col])


def round_cols(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every floating column rounded, halves to the even digit."""
    return df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def trunc_path(path: Column, max_chars: int = 100, sep: str = "...") -> Column:
    """A text of more than ``max_chars`` characters as its start and its end, of equal length, around ``sep``."""
    half = (max_chars - len(sep)) // 2
    return F.when(F.length(path) <= max_chars, path).otherwise(F.concat(F.substring(path, 1, half), F.lit(sep), F.right(path, F.lit(half))))


def uuid(uppercase: bool = False, usetime: bool = False) -> Column:
    """A new UUID for each row: random (version 4), or led by the milliseconds of now (version 7)."""
    random = F.uuid()
    if usetime:
        ms = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
        random = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(random, 16, 21))
    return F.upper(random) if uppercase else random


def check_inf(df: DataFrame) -> DataFrame:
    """df without the columns that hold a null, NaN or infinity. One pass counts them all; one row comes back."""
    bad = lambda c, t: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf")) if t in ("double", "float") else F.lit(False))
    found = df.agg(*[F.count_if(bad(c, t)).alias(str(k)) for k, (c, t) in enumerate(df.dtypes)]).first()
    return df.select(*[f"`{c}`" for k, c in enumerate(df.columns) if not found[k]])


def add_missing_columns(df: DataFrame, width: int = 4) -> DataFrame:
    """df led by unique_id, block, plot_id, row and column, made up where it has none: numbers in the rows' order, one
    block B01, plots P and the number in ``width`` digits, row and column 1. Numbers of rows come from their partitions'
    offsets, so no task holds all rows."""
    if "unique_id" not in df.columns:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df = df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1)), f"{schema}, unique_id long")
    made = {"block": F.lit("B01"), "plot_id": F.concat(F.lit("P"), leading_zeros(F.col("unique_id"), width)), "row": F.lit(1), "column": F.lit(1)}
    df = df.withColumns({c: e for c, e in made.items() if c not in df.columns})
    first = ["unique_id", *made]
    return df.select(*first, *[f"`{c}`" for c in df.columns if c not in first])


def check_cols_shp(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The same for plots, whose names have three digits and whose geometry comes last."""
    out = add_missing_columns(df, 3)
    return out.select(*[f"`{c}`" for c in out.columns if c != geometry], *[geometry] * (geometry in out.columns))
