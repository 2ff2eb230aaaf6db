"""One row a series, and numeric kernels over it.

`collect` turns a long table into ordered arrays, one row a group. `apply` runs a Python kernel on each array inside
Arrow batches and gives its result as a struct column; a kernel that raises or returns None gives null for that series
alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import frequency as fq

#: Series a batch: their arrays are in a worker's memory together. Kernels of many series take larger ones, of so many
#: values at most (or one series).
BATCH, BATCH_TOGETHER, VALUES_TOGETHER = 256, 10_000, 2_000_000


def collect(df: DataFrame, group: list[str] | str | None, date: str, value: str, extra: dict[str, str] | None = None, fill: tuple[fq.Frequency, float] | None = None, dealt: bool = False) -> DataFrame:
    """group columns, _d (ordered dates), _v (values as doubles, nulls kept), and the `extra` columns as arrays by the
    same order. Rows without a date are left out; equal dates are ordered by value.

    With `fill`, a frequency and a number, the arrays are those of prep.fill_gaps with the number for every null, but
    the points are made in each series' own row and not as rows of the table. With `dealt`, the rows have been dealt out
    by the group before (`spread`) and stay where they are.
    """
    kind = fq.check_date(df, date)
    keys = [] if group is None else [group] if isinstance(group, str) else list(group)
    text = isinstance(df.schema[value].dataType, T.StringType)
    v = F.expr(f"try_cast(`{value}` as double)") if text else F.col(value).cast("double")
    if fill is not None:
        v = F.coalesce(v, F.lit(float(fill[1])))
    more = {k: F.col(c).cast("double") for k, c in (extra or {}).items()}
    rows = df.where(F.col(date).isNotNull()).select(*keys, F.struct(F.col(date).alias("d"), v.alias("v"), *[c.alias(k) for k, c in more.items()]).alias("_s"))
    listed = (rows if dealt else spread(rows, keys)).groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_s")).where(F.size("_s") > 0)
    if fill is None:
        return listed.select(*keys, F.col("_s.d").alias("_d"), F.col("_s.v").alias("_v"), *[F.col(f"_s.{k}").alias(k) for k in more])
    s = F.col("_s")
    gap = F.zip_with("_s", F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a["d"].alias("d"), a["v"].alias("v"), F.coalesce(fq.between(a["d"], b["d"], fill[0], kind), F.lit(0)).alias("n")))
    listed = listed.select(*keys, gap.alias("_s"))
    point = lambda x: F.concat(F.array(x["d"]), F.when(x["n"] > 0, F.transform(F.sequence(F.lit(1), x["n"]), lambda k: fq.inserted(x["d"], k, fill[0], kind))).otherwise(F.array().cast(f"array<{kind.simpleString()}>")))
    dates = F.flatten(F.transform("_s", point))
    values = F.flatten(F.transform("_s", lambda x: F.concat(F.array(x["v"]), F.array_repeat(F.lit(float(fill[1])), x["n"]))))
    return listed.select(*keys, dates.alias("_d"), values.alias("_v"))


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The exchange that the grouping needs anyway, but with a stated number of partitions: rows are few bytes next to
    the work that a kernel does on them, and adaptive execution would put them into a few tasks by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else rows


def to_numpy(column: pa.Array) -> list[np.ndarray]:
    """Double arrays of a list column; a null element is NaN, a null list is empty."""
    flat = column.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan)) if flat.null_count else np.asarray(flat)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], int)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def structs(rows: list[dict | None], kind: pa.StructType) -> pa.Array:
    """A struct array built field by field, which is much faster than row by row for wide structs."""
    fields = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([r is None for r in rows]))


def columns(present: np.ndarray, values: dict, missing: dict, kind: pa.StructType) -> pa.Array:
    """The same from arrays by field name: rows that are present, values, and which of them are missing."""
    gone = ~present
    fields = [pa.array(np.asarray(values[f.name]), mask=missing[f.name] | gone).cast(f.type) for f in kind]
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array(gone))


def null_marks(column: pa.Array) -> list[np.ndarray]:
    """1.0 where an element of a list column is null, else 0.0."""
    flat = column.flatten().is_null()
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], int)
    return np.split(np.asarray(flat.cast(pa.float64())), np.cumsum(sizes)[:-1]) if len(sizes) else []


def apply(df: DataFrame, columns_in: list[str], kernel: Callable, schema: str, out: str = "_r", together: bool = False, nulls: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns `keep`, with struct column `out`: kernel(*arrays of `columns_in`, as numpy) as a dict by field
    name. With `nulls`, the marks of the first column's nulls follow the arrays.

    An error with the attribute `fatal` stops the query; all others give null. With `together` the kernel takes lists
    of arrays and returns a list of dicts or None, for the series of a batch at once, or the arguments of `columns`.
    """
    kept = df.schema if keep is None else T.StructType([df.schema[c] for c in keep])
    struct = T._parse_datatype_string(schema)
    result = to_arrow_schema(T.StructType([T.StructField(out, struct)])).field(0).type
    at = [df.columns.index(c) for c in columns_in]
    back = [df.columns.index(c) for c in kept.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = BATCH
            if together:
                values = sum(len(whole.column(k).flatten()) for k in at if pa.types.is_list(whole.column(k).type))
                size = max(1, min(BATCH_TOGETHER, VALUES_TOGETHER * whole.num_rows // max(values, 1)))
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                arrays = [to_numpy(b.column(k)) if pa.types.is_list(b.column(k).type) or pa.types.is_large_list(b.column(k).type) else b.column(k).to_pylist() for k in at]
                if nulls:
                    arrays.append(null_marks(b.column(at[0])))
                rows = kernel(*arrays) if together else []
                for args in () if together else zip(*arrays):
                    try:
                        rows.append(kernel(*args))
                    except Exception as e:
                        if getattr(e, "fatal", False):
                            raise
                        rows.append(None)
                made = columns(*rows, result) if isinstance(rows, tuple) else structs(list(rows), result)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in back), made], [*kept.names, out])

    return df.mapInArrow(run, T.StructType([*kept.fields, T.StructField(out, struct)]))


def flatten(df: DataFrame, out: str = "_r", drop: tuple[str, ...] = ("_d", "_v")) -> DataFrame:
    """The struct's fields as columns, series that failed left out."""
    return df.where(F.col(out).isNotNull()).select(*[c for c in df.columns if c not in (*drop, out)], f"{out}.*")


def explode(df: DataFrame, field: str, out: str = "_r", drop: tuple[str, ...] = ("_d", "_v")) -> DataFrame:
    """One row for each struct of the array field of `out`."""
    return df.where(F.col(out).isNotNull()).select(*[c for c in df.columns if c not in (*drop, out)], F.inline(F.col(out)[field]))
