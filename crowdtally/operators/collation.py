"""Equality of names as a collation gives it, for every uniqueness rule.

The rules of ``validate`` compare names byte by byte.  Databases often compare them without
case and accents instead.  ``with_collation`` runs any rule that way: all names of the batch
and the tables are grouped by the collation once, each name is replaced by its group's least
member, and the rule then compares as before, so its joins and aggregates stay hash or
sort-merge ones on plain strings.  The names that come out are the ones that went in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT = "UNICODE_CI_AI"
ORDER = "batchOrder"


def representatives(names: DataFrame, collation: str = DEFAULT) -> DataFrame:
    """(text, same): each of the distinct ``names`` (text) with the least equal one."""
    names = names.where(F.col("text").isNotNull()).distinct()
    least = names.groupBy(F.collate("text", collation).alias("key")).agg(F.min("text").alias("same"))
    keyed = names.withColumn("key", F.collate("text", collation))
    return keyed.join(least, "key").select("text", "same")


def with_collation(rule: Callable[..., DataFrame], cands: DataFrame, columns: list[str],
                   tables: list[tuple[DataFrame, list[str]]], collation: str = DEFAULT) -> DataFrame:
    """``rule(cands, *tables)`` with the text ``columns`` of the candidates and the given
    ones of each table compared by ``collation``."""
    cands = cut_lineage(cands)
    frames = [(cands, columns), *tables]
    all_names = reduce(DataFrame.unionAll, [df.select(F.col(c).alias("text")) for df, cs in frames for c in cs])
    same = cut_lineage(representatives(all_names, collation))

    def replaced(df: DataFrame, cols: list[str]) -> DataFrame:
        out = df
        for c in cols:
            by = same.select(F.col("text").alias(c), F.col("same").alias("_same"))
            out = out.join(by, c, "left").withColumn(c, F.col("_same")).drop("_same")
        return out.select(*df.columns)

    decided = rule(*[replaced(df, cols) for df, cols in frames])
    given = cands.select(ORDER, *[F.col(c).alias(f"_given_{c}") for c in columns])
    return (decided.join(given, ORDER)
            .select(*[F.col(f"_given_{c}").alias(c) if c in columns else F.col(c) for c in decided.columns]))
