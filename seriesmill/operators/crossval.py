"""Cross-validation folds by position or by date, hydration of features, leakage counts.

Positions come from one window over the group. A row is put into the folds that hold it by exploding the folds that
it belongs to, so no row times fold product is made and filtered afterwards.
"""

from __future__ import annotations

from datetime import date as Date
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import frequency as fq

WINDOWS = ("expanding", "fixed", "sliding")


def _options(params: dict | None, allowed: dict) -> dict:
    """Options by lower-case, trimmed name; an unknown name is an error."""
    given = {str(k).strip().lower(): v for k, v in (params or {}).items()}
    if bad := sorted(set(given) - set(allowed)):
        raise ValueError(f"unknown parameters: {bad}; allowed: {sorted(allowed)}")
    out = {k: type(v)(given[k]) if k in given and v is not None else given.get(k, v) for k, v in allowed.items()}
    if out.get("window_type", "expanding") not in WINDOWS:
        raise ValueError(f"window_type must be one of {WINDOWS}")
    return out


def _placed(df: DataFrame, group: str, date: str, target: str) -> DataFrame:
    """group, date, target, _pos (from 0 by date) and _n of the group."""
    w = Window.partitionBy(group)
    rows = df.select(group, date, F.col(target).cast("double").alias(target)).where(F.col(date).isNotNull())
    return rows.withColumn("_pos", F.row_number().over(w.orderBy(date, target)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))


def _tagged(rows: DataFrame, folds: Column, names: list[str]) -> DataFrame:
    """rows once for each fold struct (fold_id, lo, train_end, test_lo, test_hi) that has their _pos."""
    pos = F.col("_pos")
    split = lambda f: F.when((pos >= f["lo"]) & (pos <= f["train_end"]), "train").when((pos >= f["test_lo"]) & (pos <= f["test_hi"]), "test")
    mine = F.filter(F.transform(folds, lambda f: F.struct(f["fold_id"].cast("long").alias("fold_id"), split(f).alias("split"))), lambda x: x["split"].isNotNull())
    return rows.select(*names, F.inline(mine))


def cv_folds(df: DataFrame, group: str, date: str, target: str, n_folds: int, horizon: int, params: dict | None = None) -> DataFrame:
    """group, date, target, fold_id, split: folds by position within each group.

    Options: gap, embargo (accepted, without effect on positions unless apply_embargo), window_type, min_train_size,
    initial_train_size, skip_length, clip_horizon. Folds end with the first that does not fit.
    """
    if n_folds < 1 or horizon < 1:
        raise ValueError("n_folds and horizon are 1 or more")
    o = _options(params, {"gap": 0, "embargo": 0, "window_type": "expanding", "min_train_size": 1, "initial_train_size": None, "skip_length": None, "clip_horizon": False, "apply_embargo": False})
    rows, n = _placed(df, group, date, target), F.col("_n")
    skip = int(o["skip_length"] or horizon)
    init = F.lit(int(o["initial_train_size"])) if o["initial_train_size"] else F.greatest(n - n_folds * horizon, F.lit(1))
    folds = []
    for k in range(n_folds):
        end = init - 1 + k * skip
        lo = F.lit(0) if o["window_type"] == "expanding" else F.greatest(end + 1 - int(o["min_train_size"]), F.lit(0))
        first = end + 1 + int(o["gap"])
        last = first + horizon - 1
        if o["apply_embargo"] and k:
            lo = F.greatest(lo, init - 1 + (k - 1) * skip + 1 + int(o["gap"]) + horizon + int(o["embargo"]))
        fits = first < n if o["clip_horizon"] else last < n
        folds.append(F.when(fits, F.struct(F.lit(k + 1).alias("fold_id"), lo.cast("long").alias("lo"), end.cast("long").alias("train_end"), first.cast("long").alias("test_lo"), F.least(last, n - 1).cast("long").alias("test_hi"))))
    return _tagged(rows, F.array_compact(F.array(*folds)), [group, date, target])


def cv_split(df: DataFrame, group: str, date: str, target: str, training_end_times: list, horizon: int, params: dict | None = None) -> DataFrame:
    """group, date, target, fold_id, split: training ends at the last row at or before each given time, and the next
    `horizon` rows (after the gap) are the test. A group without such a row is left out of the fold."""
    kind = fq.check_date(df, date)
    o = _options(params, {"gap": 0, "embargo": 0, "window_type": "expanding", "min_train_size": 1})
    rows, w = _placed(df, group, date, target), Window.partitionBy(group)
    ends = [F.max(F.when(F.col(date) <= fq.literal(t, kind), F.col("_pos"))).over(w) for t in sorted(training_end_times)]
    rows = rows.withColumns({f"_e{k}": e for k, e in enumerate(ends)})
    folds = []
    for k in range(len(ends)):
        end = F.col(f"_e{k}")
        lo = F.lit(0) if o["window_type"] == "expanding" else F.greatest(end + 1 - int(o["min_train_size"]), F.lit(0))
        first = end + 1 + int(o["gap"])
        folds.append(F.when(end.isNotNull(), F.struct(F.lit(k + 1).alias("fold_id"), lo.cast("long").alias("lo"), end.cast("long").alias("train_end"), first.cast("long").alias("test_lo"), (first + horizon - 1).cast("long").alias("test_hi"))))
    return _tagged(rows, F.array_compact(F.array(*folds)), [group, date, target])


def _as_time(value):
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    return datetime(value.year, value.month, value.day) if isinstance(value, Date) and not isinstance(value, datetime) else value


def cv_split_folds(df: DataFrame, date: str, training_end_times: list, horizon: int, freq: str | int, params: dict | None = None) -> DataFrame:
    """fold_id, train_start, train_end, test_start, test_end, horizon, gap, embargo: bounds by date arithmetic.

    The number of folds is the caller's list's; the source is read once for its first date.
    """
    o, f = _options(params, {"gap": 0, "embargo": 0}), fq.parse(freq)
    first = df.agg(F.min(F.date_trunc("second", F.col(date).cast("timestamp_ntz")).cast("timestamp_ntz")).alias("_first"))
    ends = F.array(*[F.lit(_as_time(t)).cast("timestamp_ntz") for t in sorted(map(_as_time, training_end_times))])
    move = lambda at, k: _shift_time(at, f, k)
    rows = first.select("_first", F.posexplode(ends).alias("_k", "train_end"))
    rows = rows.select("_first", (F.col("_k") + 1).cast("long").alias("fold_id"), "train_end", move(F.col("train_end"), o["gap"] + 1).alias("test_start"), move(F.col("train_end"), o["gap"] + horizon).alias("test_end"))
    if o["embargo"] > 0:
        before = F.lag("test_end").over(Window.orderBy("fold_id"))  # a row a fold
        start = F.greatest("_first", F.coalesce(move(before, o["embargo"]), F.col("_first")))
    else:
        start = F.col("_first")
    return rows.select("fold_id", start.alias("train_start"), "train_end", "test_start", "test_end", F.lit(horizon).cast("long").alias("horizon"), F.lit(o["gap"]).cast("long").alias("gap"), F.lit(o["embargo"]).cast("long").alias("embargo"))


def _shift_time(at: Column, f: fq.Frequency, k: int) -> Column:
    if f.calendar:
        return at + F.make_ym_interval(F.lit(0), F.lit(k * f.months))
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(k * f.seconds).cast("decimal(18,6)"))


def cv_split_index(df: DataFrame, group: str, date: str, training_end_times: list, horizon: int, freq: str | int, params: dict | None = None) -> DataFrame:
    """group_col, date_col, fold_id, split of the distinct (group, date): folds by date, without the target."""
    o, f = _options(params, {"gap": 0, "embargo": 0, "window_type": "expanding", "min_train_size": 1}), fq.parse(freq)
    at = F.date_trunc("second", F.col(date).cast("timestamp_ntz")).cast("timestamp_ntz")
    src = df.select(F.col(group).alias("group_col"), at.alias("date_col")).distinct()
    folds = []
    times = sorted(map(_as_time, training_end_times))
    for k, t in enumerate(times):
        end = F.lit(t).cast("timestamp_ntz")
        lo = None if o["window_type"] == "expanding" else _shift_time(end, f, -o["min_train_size"])
        if o["embargo"] > 0 and k:
            cut = _shift_time(F.lit(times[k - 1]).cast("timestamp_ntz"), f, o["gap"] + horizon + o["embargo"])
            lo = cut if lo is None else F.greatest(lo, cut)
        d = F.col("date_col")
        train = (d <= end) if lo is None else (d >= lo) & (d <= end)
        test = (d >= _shift_time(end, f, o["gap"] + 1)) & (d <= _shift_time(end, f, o["gap"] + horizon))
        folds.append(F.struct(F.lit(k + 1).cast("long").alias("fold_id"), F.when(train, "train").when(test, "test").alias("split")))
    mine = F.filter(F.array(*folds), lambda x: x["split"].isNotNull())
    return src.select("group_col", "date_col", F.inline(mine))


def cv_hydrate(folds: DataFrame, source: DataFrame, group: str, date: str, unknown_features: list[str], params: dict | None = None) -> DataFrame:
    """The fold rows with each feature as text: its own value in training rows; in test rows the fold's last training
    value ('last_value'), null ('null') or fill_value ('default'). Rows without a source row are left out."""
    o = _options(params, {"strategy": "last_value", "fill_value": ""})
    if o["strategy"] not in ("last_value", "null", "default"):
        raise ValueError(f"no strategy: {o['strategy']!r}")
    picked = source.groupBy(group, date).agg(*[F.min(F.struct(*[F.col(c).cast("string").alias(c) for c in unknown_features])).alias("_f")])
    joined = folds.join(picked, [group, date]).select(*folds.columns, "_f")
    train = F.col("split") == "train"
    w = Window.partitionBy(group, "fold_id").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    blank = lambda c: F.when(c != "", c)
    test = {"last_value": F.last(F.when(train, F.col("_f")), True).over(w), "null": None, "default": None}[o["strategy"]]
    joined = joined.withColumn("_last", test) if test is not None else joined
    value = lambda c: blank(F.when(train, F.col("_f")[c]).otherwise(F.col("_last")[c] if test is not None else F.lit(None if o["strategy"] == "null" else str(o["fill_value"]))))
    return joined.select(*folds.columns, *[value(c).alias(c) for c in unknown_features])


def check_leakage(df: DataFrame, is_test: str) -> DataFrame:
    """status, test_row_count, train_row_count, recommendation."""
    t = F.col(is_test).cast("boolean")
    return df.agg(F.lit("Leakage check complete").alias("status"), F.sum(F.when(t, 1)).cast("long").alias("test_row_count"), F.sum(F.when(~t, 1)).cast("long").alias("train_row_count"), F.lit("Mask unknown features with cv_hydrate and select columns explicitly").alias("recommendation"))
