"""Preparation of long tables of series: filters, imputation, gaps, unknown values, timestamp checks.

All operators are relational. Filters by group are one window over the group, so the source is scanned and shuffled
once; filters above them that use the group key only still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import frequency as fq


def _number(value: str, df: DataFrame) -> Column:
    return F.expr(f"try_cast(`{value}` as double)") if df.schema[value].dataType.simpleString() == "string" else F.col(value).cast("double")


def _keep(df: DataFrame, group: str, condition) -> DataFrame:
    """Rows where condition(window over the group) is true."""
    w = Window.partitionBy(group)
    name = "_keep" + "_" * max(len(c) for c in df.columns)  # longer than any column's name
    return df.withColumn(name, condition(w)).where(F.col(name)).drop(name)


# ------------------------------------------------------------------ filters


def drop_constant(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one value; groups without any value stay."""
    return _keep(df, group, lambda w: (F.min(value).over(w) != F.max(value).over(w)) | F.min(value).over(w).isNull())


def drop_short(df: DataFrame, group: str, min_length: int) -> DataFrame:
    """Groups of at least min_length rows."""
    return _keep(df, group, lambda w: F.count(F.lit(1)).over(w) >= min_length)


def drop_gappy(df: DataFrame, group: str, value: str, max_gap_ratio: float) -> DataFrame:
    """Groups with a share of null values of at most max_gap_ratio."""
    return _keep(df, group, lambda w: F.avg(F.col(value).isNull().cast("double")).over(w) <= max_gap_ratio)


def drop_zeros(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with any value that is not zero."""
    return _keep(df, group, lambda w: F.coalesce(F.max((F.col(value) != 0).cast("int")).over(w), F.lit(0)) == 1)


def _edge(df: DataFrame, group: str, date: str, value: str, lead: bool, trail: bool) -> DataFrame:
    at = F.when(F.col(value) != 0, F.col(date))
    test = lambda w: (F.col(date) >= F.min(at).over(w) if lead else F.lit(True)) & (F.col(date) <= F.max(at).over(w) if trail else F.lit(True))
    return _keep(df, group, test)


def drop_leading_zeros(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Rows from the first value that is not zero; groups without one vanish."""
    return _edge(df, group, date, value, True, False)


def drop_trailing_zeros(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    return _edge(df, group, date, value, False, True)


def drop_edge_zeros(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    return _edge(df, group, date, value, True, True)


# ------------------------------------------------------------------ imputation


def fill_nulls_const(df: DataFrame, group: str, date: str, value: str, fill: float) -> DataFrame:
    """Adds filled_value."""
    return df.withColumn("filled_value", F.coalesce(F.col(value).cast("double"), F.lit(float(fill))))


def fill_nulls_forward(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Adds filled_value: the last value at or before the row."""
    w = Window.partitionBy(group).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("filled_value", F.last(F.col(value).cast("double"), True).over(w))


def fill_nulls_backward(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Adds filled_value: the first value at or after the row."""
    w = Window.partitionBy(group).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("filled_value", F.first(F.col(value).cast("double"), True).over(w))


def fill_nulls_mean(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Adds filled_value: nulls become the group's mean."""
    v = F.col(value).cast("double")
    return df.withColumn("filled_value", F.coalesce(v, F.avg(v).over(Window.partitionBy(group))))


def diff(df: DataFrame, group: str, date: str, value: str, order: int = 1) -> DataFrame:
    """Adds diff_value: the value less that of `order` rows before."""
    if order < 1:
        raise ValueError("the order of a difference is 1 or more")
    v = F.col(value).cast("double")
    return df.withColumn("diff_value", v - F.lag(v, order).over(Window.partitionBy(group).orderBy(date)))


# ------------------------------------------------------------------ gaps


#: Points that a gap gives at once, and the start of working columns' names.
PIECE, _MORE = 10_000, "__fill_gaps_"


def fill_gaps(df: DataFrame, group: str, date: str, value: str, freq: str | int) -> DataFrame:
    """The three columns, with a null value at every grid date that is missing between two rows of a group.

    A fixed step inserts previous + k steps, so rows off the grid stay. Months, quarters and years insert each period's
    first day; the count of periods in the frequency is not used for filling. Rows without a date are left out.
    """
    kind, f = fq.check_date(df, date), fq.parse(freq)
    rows = df.select(group, date, F.col(value).cast("double").alias(value)).where(F.col(date).isNotNull())
    nxt = F.lead(date).over(Window.partitionBy(group).orderBy(date))
    rows = rows.withColumn("_next", nxt)
    if f.calendar and not fq.is_integer(kind):
        unit = f.unit
        first = F.trunc(F.col(date).cast("date"), unit)
        upto = F.trunc(F.col("_next").cast("date"), unit)
        months = fq.CALENDAR[unit]
        n = F.months_between(upto, first).cast("int").__truediv__(months).cast("int") - 1
        at = lambda k: F.add_months(first, (k * months).cast("int")).cast(kind)
    else:
        step = fq.number_step(f, kind)
        gap = fq.as_number(F.col("_next"), kind) - fq.as_number(F.col(date), kind)
        # k < gap / step: a point that the next row itself takes is not inserted
        n = F.ceil(gap / F.lit(step)).cast("long") - 1
        at = lambda k: fq.shift(F.col(date), f, kind, k)
    # The points of a gap come in pieces, so that no array grows with the gap; the first piece has the row itself.
    n = F.greatest(F.coalesce(n.cast("long"), F.lit(0)), F.lit(0))
    piece = F.col(f"{_MORE}p")
    n_of, one = F.col(f"{_MORE}n"), F.array(F.lit(0).cast("long"))
    rows = rows.withColumn(f"{_MORE}n", n).drop("_next")
    rows = rows.select("*", F.explode(F.when(n_of > PIECE, F.sequence(F.lit(0).cast("long"), F.floor((n_of - 1) / PIECE))).otherwise(one)).alias(f"{_MORE}p"))
    here = F.struct(F.col(date).alias("d"), F.col(value).alias("v"))
    none = F.lit(None).cast("double")
    grid = F.sequence(piece * PIECE + 1, F.least(n_of, (piece + 1) * PIECE))
    more = F.transform(grid, lambda k: F.struct(at(k).alias("d"), none.alias("v")))
    whole = F.when(n_of == 0, F.array(here)).when(piece == 0, F.concat(F.array(here), more)).otherwise(more)
    out = rows.select(group, F.inline(whole))
    return out.select(group, F.col("d").alias(date), F.col("v").alias(value))


def fill_forward(df: DataFrame, group: str, date: str, value: str, target, freq: str | int) -> DataFrame:
    """The three columns, extended with null values on the grid from each group's last date up to target."""
    kind, f = fq.check_date(df, date), fq.parse(freq)
    rows = df.select(group, date, F.col(value).cast("double").alias(value)).where(F.col(date).isNotNull())
    goal = fq.literal(target, kind)
    last = rows.groupBy(group).agg(F.max(date).alias("_last"))
    if f.calendar and not fq.is_integer(kind):
        n = F.floor(F.months_between(goal.cast("date"), F.col("_last").cast("date")) / fq.CALENDAR[f.unit]).cast("int") + 1
        f = fq.Frequency(1, f.unit)
    else:
        n = F.floor((fq.as_number(goal, kind) - fq.as_number(F.col("_last"), kind)) / F.lit(fq.number_step(f, kind))).cast("int")
    grid = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda k: fq.shift(F.col("_last"), f, kind, k)))
    extra = last.select(group, F.explode(grid).alias(date)).where(F.col(date) <= goal).withColumn(value, F.lit(None).cast("double"))
    return rows.unionByName(extra)


def detect_frequency(df: DataFrame, group: str, date: str) -> DataFrame:
    """group, step: the most frequent difference of consecutive dates (the smallest of equals), in days, microseconds or
    integer units."""
    kind = fq.check_date(df, date)
    w = Window.partitionBy(group).orderBy(date)
    steps = df.where(F.col(date).isNotNull()).select(group, (fq.as_number(F.col(date), kind) - F.lag(fq.as_number(F.col(date), kind)).over(w)).alias("step")).where("step > 0")
    counted = steps.groupBy(group, "step").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(group).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("step"))


# ------------------------------------------------------------------ unknown values


def mark_unknown(df: DataFrame, group: str, date: str, cutoff) -> DataFrame:
    """Adds is_unknown (the date is after the cutoff) and last_known_date of the group."""
    kind = fq.check_date(df, date)
    after = F.col(date) > fq.literal(cutoff, kind)
    known = F.max(F.when(~after, F.col(date))).over(Window.partitionBy(group))
    return df.withColumn("is_unknown", after).withColumn("last_known_date", known)


def fill_unknown(df: DataFrame, group: str, date: str, value: str, cutoff, strategy: str = "last_value", fill: float = 0.0) -> DataFrame:
    """group_col, date_col, value_col: values after the cutoff become the group's last known value, null or `fill`.

    strategy: 'last_value', 'null' or 'default'."""
    if strategy not in ("last_value", "null", "default"):
        raise ValueError(f"no strategy: {strategy!r}")
    kind = fq.check_date(df, date)
    v, known = F.col(value).cast("double"), F.col(date) <= fq.literal(cutoff, kind)
    w = Window.partitionBy(group).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    new = {"last_value": F.last(F.when(known, v), True).over(w), "null": F.lit(None).cast("double"), "default": F.lit(float(fill))}[strategy]
    return df.select(F.col(group).alias("group_col"), F.col(date).alias("date_col"), F.when(known, v).otherwise(new).alias("value_col"))


# ------------------------------------------------------------------ timestamp checks


def validate_timestamps(df: DataFrame, group: str, date: str, expected: list) -> DataFrame:
    """group_col, is_valid, n_expected, n_found, n_missing, missing_timestamps (sorted; null if none) for each group.

    The expected dates are a list of the caller's and travel as a literal; rows are aggregated before the shuffle.
    """
    kind = fq.check_date(df, date)
    wanted = F.array_sort(F.array_distinct(F.array(*[fq.literal(x, kind) for x in expected]))) if expected else F.array().cast(f"array<{kind.simpleString()}>")
    found = df.select(F.col(group).alias("group_col"), F.when(F.array_contains(wanted, F.col(date)), F.col(date)).alias("d")).groupBy("group_col").agg(F.collect_set("d").alias("found"))
    missing = F.array_except(wanted, F.col("found"))
    return found.select("group_col", (F.size(missing) == 0).alias("is_valid"), F.size(wanted).cast("long").alias("n_expected"), F.size("found").cast("long").alias("n_found"), F.size(missing).cast("long").alias("n_missing"), F.when(F.size(missing) > 0, F.array_sort(missing)).alias("missing_timestamps"))


def validate_timestamps_summary(df: DataFrame, group: str, date: str, expected: list) -> DataFrame:
    """One row: all_valid, n_groups, n_valid_groups, n_invalid_groups, invalid_groups (sorted; null if none)."""
    each = validate_timestamps(df, group, date, expected)
    good = F.sum(F.col("is_valid").cast("long"))
    bad = F.array_sort(F.collect_list(F.when(~F.col("is_valid"), F.col("group_col"))))
    return each.agg(F.bool_and("is_valid").alias("all_valid"), F.count(F.lit(1)).alias("n_groups"), good.alias("n_valid_groups"), (F.count(F.lit(1)) - good).alias("n_invalid_groups"), F.when(F.size(bad) > 0, bad).alias("invalid_groups"))
