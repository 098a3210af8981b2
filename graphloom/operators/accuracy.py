"""How well found relations agree with expected ones, as multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import settled
from graphloom.operators.trace import numbered_dealt


def matched(expected: DataFrame, actual: DataFrame, exact: Sequence[str], loose: Sequence[str], place: str, order: Sequence[str]) -> DataFrame:
    """exact keys (those of loose at least), match (exact, loose, missed or extra), expected_at, actual_at: one row a
    pair or single row.

    Rows are paired one to one: first those of equal exact keys, the k-th of either side by place and order, then
    what is left of both by the loose keys alike. Numbers are made part of the keys, so a key of many rows is
    joined in many tasks.
    """
    first = lambda rows, name: numbered_dealt(rows.select(*exact, place, *order), exact, [place, *order], "n_").select(*exact, "n_", *[F.col(c).alias(f"{name}_{c}") for c in (place, *order)], F.lit(True).alias(name))
    both = settled(first(expected, "e").join(first(actual, "a"), [*exact, "n_"], "full_outer"), "exact")
    pairs = both.where("e AND a").select(*exact, F.lit("exact").alias("match"), F.col(f"e_{place}").alias("expected_at"), F.col(f"a_{place}").alias("actual_at"))
    rest = [c for c in exact if c not in loose]

    def left(name: str, other: str) -> DataFrame:
        rows = both.where(f"{name} AND {other} IS NULL").select(*exact, *[F.col(f"{name}_{c}").alias(c) for c in (place, *order)])
        rows = numbered_dealt(rows, loose, [*rest, place, *order], "n_")
        return rows.select(*loose, "n_", *[F.col(c).alias(f"{name}_{c}") for c in rest], F.col(place).alias(f"{name}_at"), F.lit(True).alias(name))

    more = left("e", "a").join(left("a", "e"), [*loose, "n_"], "full_outer")
    kind = F.when(F.col("e") & F.col("a"), "loose").when(F.col("e"), "missed").otherwise("extra")
    more = more.select(*[F.coalesce(f"e_{c}", f"a_{c}").alias(c) if c in rest else F.col(c) for c in exact], kind.alias("match"), F.col("e_at").alias("expected_at"), F.col("a_at").alias("actual_at"))
    return pairs.unionByName(more)


def figures(pairs: DataFrame, by: Sequence[str], tolerance: int = 1) -> DataFrame:
    """by, exact, loose, missed, extra, precision, recall, location_accuracy (of exact pairs) of what `matched` tells; a
    share of nothing is 1."""
    n = lambda m: F.count_if(F.col("match") == m)
    near = F.count_if((F.col("match") == "exact") & (F.abs(F.col("expected_at") - F.col("actual_at")) <= tolerance))
    share = lambda a, b: F.round(F.when(b == 0, F.lit(1.0)).otherwise(a / b), 6)
    found = n("exact") + n("loose")
    return pairs.groupBy(*by).agg(
        n("exact").alias("exact"), n("loose").alias("loose"), n("missed").alias("missed"), n("extra").alias("extra"), share(found, found + n("extra")).alias("precision"),
        share(found, found + n("missed")).alias("recall"), share(near, n("exact")).alias("location_accuracy"),
    )
