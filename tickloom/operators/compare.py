"""Comparing tables and recognising repeated snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 0.01) -> DataFrame:
    """Differences in long form: (keys, column, left_value, right_value, kind).

    Numbers differ from ``tol`` on; rows on one side only are reported once.
    """
    values = [c for c in a.columns if c not in keys]
    numeric = {
        f.name for f in a.schema.fields if isinstance(f.dataType, T.NumericType)
    }
    left = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(c).alias(f"a_{c}") for c in values])
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(c).alias(f"b_{c}") for c in values])
    both = left.join(right, keys, "full_outer")

    def item(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differs = ~x.eqNullSafe(y)
        if c in numeric:
            differs = F.coalesce(F.abs(x - y) >= tol, differs)
        return F.when(
            differs,
            F.struct(
                F.lit(c).alias("column"),
                x.cast("string").alias("left_value"),
                y.cast("string").alias("right_value"),
                F.lit("mismatch").alias("kind"),
            ),
        )

    def one_sided(kind: str):
        none = F.lit(None).cast("string")
        return F.array(
            F.struct(
                F.lit("*").alias("column"),
                none.alias("left_value"),
                none.alias("right_value"),
                F.lit(kind).alias("kind"),
            )
        )

    found = (
        F.when(F.col("_in_b").isNull(), one_sided("missing_right"))
        .when(F.col("_in_a").isNull(), one_sided("missing_left"))
        .otherwise(F.array_compact(F.array(*[item(c) for c in values])))
    )
    return both.select(*keys, F.inline(found))


def drop_repeat_snapshots(df: DataFrame, group: str, order: str, content: list[str]) -> DataFrame:
    """Drop a snapshot whose rows equal those of the one before it in its group.

    Each snapshot shrinks to a count and two order-free content sums before any
    ordering, so the ordered step sees one row per snapshot.
    """
    row = F.xxhash64(*content)
    again = F.xxhash64(F.lit(7), *content)
    prints = df.groupBy(group, order).agg(
        F.count("*").alias("n"),
        F.sum(row.cast("decimal(38,0)")).alias("h1"),
        F.sum(again.cast("decimal(38,0)")).alias("h2"),
    )
    w = Window.partitionBy(group).orderBy(order)
    same = reduce(
        lambda x, y: x & y, [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("n", "h1", "h2")]
    )
    repeats = prints.select(group, order, same.alias("same")).filter("same").drop("same")
    return df.join(repeats, [group, order], "left_anti")
