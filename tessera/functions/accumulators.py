"""Accumulators of $group, and the same names and more as window functions.

Order-dependent ones follow the keys of the last $sort (ties by value), since a shuffle keeps no order; without a $sort they
follow their values. Those that give one value ($first, $top, ...) are aggregates with partial results; those that give arrays
collect a group.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import udfs
from tessera.functions.expressions import column, compile_expression
from tessera.functions.scope import PipelineError, Scope, Typed, path

_REVERSIBLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def order_key(keys: list[tuple[str, int]], s: Scope, *ties: Column) -> tuple[Column, bool]:
    """(a struct that sorts as the keys do, whether it sorts the other way round)."""
    down = {d == 1 for _, d in keys} == {False}
    parts = []
    for name, direction in keys:
        value = path(name, s)
        if direction == 1 or down:
            parts.append(value.column)
        elif isinstance(value.type, _REVERSIBLE):
            number = F.unix_micros(value.column.cast("timestamp")) if isinstance(value.type, (T.DateType, T.TimestampType, T.TimestampNTZType)) else value.column.cast("double")
            parts += [value.column.isNull(), -number]
        else:
            raise PipelineError(f"cannot mix directions with {name}: only numbers and dates can run against the other keys")
    names = [c.alias(f"k{i}") for i, c in enumerate([*parts, *ties])]
    return F.struct(*(names or [F.lit(0).alias("k0")])), down


def _number(e: Any, s: Scope) -> Column:
    value = compile_expression(e, s)
    kind = s.type_of(value)
    return value.column.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def _sum(e: Any, s: Scope) -> Column:
    if isinstance(e, int) and not isinstance(e, bool):
        return F.count(F.lit(1)) * F.lit(e).cast("long")
    return F.coalesce(F.sum(_number(e, s)), F.lit(0.0))


def _ordered(e: Any, s: Scope, keys: list[tuple[str, int]]) -> Column:
    """All values of a group in order, nulls kept."""
    value = column(e, s)
    key, down = order_key(keys, s, value)
    rows = F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v"))), asc=not down) if keys else F.collect_list(F.struct(F.lit(0).alias("k"), value.alias("v")))
    return F.transform(rows, lambda x: x["v"])


def _end(e: Any, s: Scope, keys: list[tuple[str, int]], last: bool) -> Column:
    value = column(e, s)
    key, down = order_key(keys, s, value)
    pick = F.max_by if last != down else F.min_by
    return pick(F.struct(value.alias("v")), key).getField("v")


def _keys(spec: dict) -> list[tuple[str, int]]:
    return list(spec["sortBy"].items())


def _merged(e: Any, s: Scope) -> Column:
    value = compile_expression(e, s)
    kind = s.type_of(value)
    if not isinstance(kind, T.StructType):
        raise PipelineError("$mergeObjects needs documents")
    out = []
    for f in kind.fields:
        field = value.column.getField(f.name)
        key, down = order_key(list(s.order), s, field)
        pick = F.min_by if down else F.max_by
        out.append(pick(field, F.when(field.isNotNull(), key)).alias(f.name))
    return F.struct(*out)


def accumulate(op: str, e: Any, s: Scope) -> Column:
    """An accumulator as an aggregate Column."""
    order = list(s.order)
    plain = {
        "$sum": lambda: _sum(e, s),
        "$avg": lambda: F.avg(_number(e, s)),
        "$min": lambda: F.min(column(e, s)),
        "$max": lambda: F.max(column(e, s)),
        "$count": lambda: F.count(F.lit(1)).cast("int"),
        "$stdDevPop": lambda: F.stddev_pop(_number(e, s)),
        "$stdDevSamp": lambda: F.stddev_samp(_number(e, s)),
        "$first": lambda: _end(e, s, order, False),
        "$last": lambda: _end(e, s, order, True),
        "$push": lambda: _ordered(e, s, order),
        "$addToSet": lambda: F.array_distinct(_ordered(e, s, order)),
        "$mergeObjects": lambda: _merged(e, s),
        "$top": lambda: _end(e["output"], s, _keys(e), False),
        "$bottom": lambda: _end(e["output"], s, _keys(e), True),
        "$topN": lambda: F.slice(_ordered(e["output"], s, _keys(e)), F.lit(1), _how_many(e["n"], s)),
        "$bottomN": lambda: _tail(_ordered(e["output"], s, _keys(e)), _how_many(e["n"], s)),
        "$firstN": lambda: F.slice(_ordered(e["input"], s, order), F.lit(1), _how_many(e["n"], s)),
        "$lastN": lambda: _tail(_ordered(e["input"], s, order), _how_many(e["n"], s)),
        "$maxN": lambda: F.slice(F.sort_array(F.collect_list(column(e["input"], s)), asc=False), F.lit(1), _how_many(e["n"], s)),
        "$minN": lambda: F.slice(F.sort_array(F.collect_list(column(e["input"], s))), F.lit(1), _how_many(e["n"], s)),
        "$accumulator": lambda: _custom(e, s),
    }
    if op not in plain:
        raise PipelineError(f"unknown accumulator {op}", 15952)
    return plain[op]()


def _how_many(n: Any, s: Scope) -> Column:
    return F.lit(n) if isinstance(n, int) else F.max(column(n, s)).cast("int")


def _tail(rows: Column, n: Column) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, n)


#: Accumulators of the first values of a group.
RANKED = {"$topN", "$bottomN", "$firstN", "$lastN", "$maxN", "$minN"}


def first_rows(op: str, e: dict, s: Scope, by: Column) -> tuple[DataFrame, Column]:
    """((_id, values) of the groups that have any, the empty array): the values of an accumulator of RANKED with a fixed n.

    Rows are ranked within their group and only n of them stay. Spark limits each group to n rows in every task before the shuffle, so no
    task and no array holds a whole group.
    """
    value = column(e["output"] if "output" in e else e["input"], s)
    rows = s.df.select(by.alias("_id"), value.alias("v"), *_order_columns(op, e, s, value))
    if op in ("$maxN", "$minN"):
        rows = rows.where("v is not null")
    falling = op == "$maxN"
    if op in ("$topN", "$bottomN", "$firstN", "$lastN"):
        falling = order_key(_keys(e) if "sortBy" in e else list(s.order), s, value)[1]
    from_end = op in ("$bottomN", "$lastN")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("k").desc() if falling != from_end else F.col("k").asc()))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= e["n"])
    values = F.transform(F.sort_array(F.collect_list(F.struct("k", "v")), asc=not falling), lambda x: x["v"])
    return few.groupBy("_id").agg(values.alias("values")), F.array().cast(T.ArrayType(rows.schema["v"].dataType))


def _order_columns(op: str, e: dict, s: Scope, value: Column) -> list[Column]:
    if op in ("$maxN", "$minN"):
        return [F.struct(value.alias("k0")).alias("k")]
    return [order_key(_keys(e) if "sortBy" in e else list(s.order), s, value)[0].alias("k")]


def _custom(e: dict, s: Scope) -> Column:
    """A registered accumulator, run over a group in Python, one value after another."""
    known = udfs.accumulator(e["init"])
    init_args = e.get("initArgs", [])

    def fold(*series):
        state = known.init(*init_args)
        for values in zip(*series, strict=True):
            state = known.accumulate(state, *values)
        return known.finalize(state)

    return F.pandas_udf(fold, known.returns, F.PandasUDFType.GROUPED_AGG)(*[column(x, s) for x in e["accumulateArgs"]])


def _bound(value: Any, unbounded: int) -> int:
    return unbounded if value == "unbounded" else 0 if value == "current" else int(value)


def window_of(partition: list[Column], order: list[Column]) -> Any:
    w = Window.partitionBy(*partition)
    return w.orderBy(*order) if order else w


#: Microseconds of a unit of time.
_UNIT = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6, "week": 604_800 * 10**6}


def windowed(op: str, e: Any, frame: dict | None, s: Scope, partition: list[Column], keys: list[tuple[str, int]]) -> Column:
    """A window operator as a Column. Without ``frame`` the whole partition counts."""
    order = [path(n, s).column.asc() if d == 1 else path(n, s).column.desc() for n, d in keys]
    base = window_of(partition, order)
    lo, hi = Window.unboundedPreceding, Window.unboundedFollowing
    w = base.rowsBetween(lo, hi)
    if frame and "documents" in frame:
        lo, hi = _bound(frame["documents"][0], lo), _bound(frame["documents"][1], hi)
        w = base.rowsBetween(lo, hi)
    elif frame and "range" in frame:
        (name, direction), unit = keys[0], _UNIT.get(frame.get("unit", ""), 1)
        key = path(name, s)
        by = F.unix_micros(key.column.cast("timestamp")) if isinstance(key.type, (T.TimestampType, T.TimestampNTZType, T.DateType)) else key.column
        a, b = (_bound(v, u) for v, u in zip(frame["range"], (lo, hi), strict=True))
        a, b = (v if v in (lo, hi) else v * unit for v in (a, b))
        w = window_of(partition, [by.asc() if direction == 1 else by.desc()]).rangeBetween(a, b)
    running = base.rowsBetween(Window.unboundedPreceding, 0)
    ranked = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}
    if op in ranked:
        return ranked[op]().over(base)
    if op == "$shift":
        default = e.get("default")
        by = int(e["by"])
        value = column(e["output"], s)
        moved = (F.lead if by >= 0 else F.lag)(value, abs(by), default)
        return moved.over(base)
    if op == "$expMovingAvg":
        alpha = float(e["alpha"]) if "alpha" in e else 2.0 / (int(e["N"]) + 1)
        return _moving_average(_number(e["input"], s), alpha, base)
    if op == "$derivative":
        x = _number(e["input"], s)
        return x - F.lag(x).over(base)
    if op == "$integral":
        x = _number(e["input"], s)
        area = (x + F.lead(x).over(base)) / 2
        return _Late(lambda a: F.coalesce(F.sum(a).over(base.rowsBetween(lo, hi - 1 if hi != Window.unboundedFollowing else hi)), F.lit(0.0)), area)
    if op in ("$covariancePop", "$covarianceSamp"):
        x, y = (_number(v, s) for v in e)
        return (F.covar_pop if op == "$covariancePop" else F.covar_samp)(x, y).over(w)
    if op == "$locf":
        return F.last(column(e, s), ignorenulls=True).over(running)
    if op == "$linearFill":
        return _Late(lambda n: _linear_fill(_number(e, s), n, base), F.row_number().over(base))
    if op == "$sum":
        if isinstance(e, int) and not isinstance(e, bool):
            return F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)) * F.lit(e).cast("long")
        return F.coalesce(F.sum(_number(e, s)).over(w), F.lit(0.0))
    if op in ("$push", "$addToSet"):
        rows = F.collect_list(F.struct(column(e, s).alias("v"))).over(w)
        values = F.transform(rows, lambda x: x["v"])
        return F.array_distinct(values) if op == "$addToSet" else values
    if op in ("$first", "$last"):
        return (F.first if op == "$first" else F.last)(column(e, s)).over(w)
    simple = {"$avg": (F.avg, _number), "$min": (F.min, column), "$max": (F.max, column), "$stdDevPop": (F.stddev_pop, _number), "$stdDevSamp": (F.stddev_samp, _number)}
    if op in simple:
        f, read = simple[op]
        return f(read(e, s)).over(w)
    if op == "$count":
        return F.count(F.lit(1)).over(w).cast("int")
    raise PipelineError(f"unknown window operator {op}")


class _Late:
    """A window function over another one: ``inner`` becomes a column first."""

    def __init__(self, finish, inner: Column):
        self.finish, self.inner = finish, inner


def _linear_fill(x: Column, n: Column, base) -> Column:
    """Between the nearest values on both sides by row position; null outside of them."""
    point = F.when(x.isNotNull(), F.struct(n.alias("n"), x.alias("x")))
    before = F.last(point, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(base.rowsBetween(0, Window.unboundedFollowing))
    between = before["x"] + (after["x"] - before["x"]) * (n - before["n"]) / (after["n"] - before["n"])
    return F.coalesce(x, between)


def _moving_average(x: Column, alpha: float, base) -> Column:
    """average = alpha * x + (1 - alpha) * average before, from the first number on; nulls carry it.

    As a sum of weighted values it needs no state: the running sum of x / (1 - alpha) ** k would overflow, so the frame is
    cut where weights fall under 1e-17 of the current one, beyond double precision. The first value weighs 1 instead of alpha.
    """
    from math import ceil, log

    if not 0 < alpha < 1:
        return F.last(x, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0)) if alpha == 1 else F.lit(None)
    far = ceil(log(1e-17) / log(1 - alpha)) + 1
    values = F.collect_list(x).over(base.rowsBetween(-far, 0))  # numbers only: collect_list leaves nulls out
    start = F.struct(F.lit(None).cast("double").alias("v"))
    folded = F.aggregate(values, start, lambda a, v: F.struct(F.when(a["v"].isNull(), v).otherwise(v * alpha + a["v"] * (1 - alpha)).alias("v")), lambda a: a["v"])
    return F.coalesce(folded, F.last(x, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0)))
