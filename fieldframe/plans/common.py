"""Helpers for queries that are compared with SQL: doubles are rounded alike on both sides.

Operators give exact values; only the registered queries round, to the 24 bits of a single-precision number (and to nine
decimals, for sums that cancel), since the order of a sum may change its last bits. A relative error of one in ten
millions shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame) -> DataFrame:
    """Every double rounded, without negative zero. A column is named once, so its expression is computed once."""
    one = lambda n: ((F.rint(F.col(f"`{n}`") * 1e9) / F.lit(1e9)).cast("float").cast("double") + F.lit(0.0)).alias(n)
    return df.select(*[one(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def sql(columns: str, body: str) -> str:
    """SQL with the columns ``plain ... | doubles ...`` of a subquery, the doubles rounded."""
    plain, _, doubles = columns.partition("|")

    def one(c: str) -> str:
        return f'(round_even("{c}"::DOUBLE * 1e9, 0) / 1e9::DOUBLE)::FLOAT::DOUBLE + 0.0::DOUBLE AS "{c}"'

    return f"SELECT {', '.join([f'\"{c}\"' for c in plain.split()] + [one(c) for c in doubles.split()])} FROM ({body}) AS body"
