"""Composite series keys and hierarchies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators suggested when the wanted one occurs in a key, in this order.
SUGGESTED = ("-", ".", "::", "__", "#")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("NULL"))


def validate_separator(df: DataFrame, ids: list[str], separator: str = "|") -> DataFrame:
    """One row: separator, is_valid, n_conflicts, conflicting_values (sorted), message.

    A value conflicts if it holds the separator. The message names the suggested separators that no value holds.
    """
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in ids])).alias("v")).where(F.col("v").isNotNull())
    has = lambda s: F.contains("v", F.lit(s))
    others = [s for s in SUGGESTED if s != separator]
    # Only values with some separator go on; they are made distinct before anything meets in one place.
    odd = values.where(reduce(lambda a, b: a | b, [has(s) for s in (separator, *others)])).distinct()
    used = odd.agg(F.array_sort(F.collect_list(F.when(has(separator), F.col("v")))).alias("bad"), *[F.coalesce(F.bool_or(has(s)), F.lit(False)).alias(f"u{i}") for i, s in enumerate(others)])
    free = F.array_compact(F.array(*[F.when(~F.col(f"u{i}"), F.concat(F.lit("'"), F.lit(s), F.lit("'"))) for i, s in enumerate(others)]))
    n = F.size("bad").cast("long")
    advice = F.when(F.size(free) > 0, F.concat(F.lit(". Free: "), F.array_join(free, ", "))).otherwise(F.lit(""))
    message = F.when(n == 0, F.lit("Separator is safe to use")).otherwise(F.concat(F.lit("Separator found in "), n.cast("string"), F.lit(" value(s)"), advice))
    return used.select(F.lit(separator).alias("separator"), (n == 0).alias("is_valid"), n.alias("n_conflicts"), F.col("bad").alias("conflicting_values"), message.alias("message"))


def combine_keys(df: DataFrame, date: str, value: str, ids: list[str], separator: str = "|") -> DataFrame:
    """unique_id, date, value; a null part is written NULL."""
    return df.select(F.concat_ws(separator, *map(_text, ids)).alias("unique_id"), date, F.col(value).cast("double").alias(value))


def aggregate_hierarchy(df: DataFrame, date: str, value: str, ids: list[str], separator: str = "|", keyword: str = "AGGREGATED") -> DataFrame:
    """unique_id, date, value: sums at every prefix level of the ids, dropped ones replaced by the keyword.

    Null values count as 0; rows without a date are left out. Levels whose ids are written alike are one. The rows are
    summed at the lowest level first, so what is multiplied by the number of levels is already small.
    """
    parts = [_text(c) for c in ids]
    base = df.where(F.col(date).isNotNull()).select(*[p.alias(f"_p{i}") for i, p in enumerate(parts)], date, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    names = [f"_p{i}" for i in range(len(ids))]
    low = base.groupBy(*names, date).agg(F.sum("_v").alias("_v"))
    level = [F.concat_ws(separator, *[F.col(n) if i < k else F.lit(keyword) for i, n in enumerate(names)]) for k in range(len(ids) + 1)]
    return low.select(F.explode(F.array(*level)).alias("unique_id"), date, "_v").groupBy("unique_id", date).agg(F.sum("_v").alias(value))


def split_keys(df: DataFrame, unique_id: str, date: str, value: str, separator: str = "|", columns: list[str] | None = None) -> DataFrame:
    """The parts of unique_id as columns (id_part_1 to 3, or as named), then date and value. Missing parts are empty,
    further ones are dropped, rows with a null id are left out."""
    columns = columns or ["id_part_1", "id_part_2", "id_part_3"]
    part = F.split(F.col(unique_id), re.escape(separator), -1)
    return df.where(F.col(unique_id).isNotNull()).select(*[F.coalesce(F.get(part, i), F.lit("")).alias(c) for i, c in enumerate(columns)], date, value)
