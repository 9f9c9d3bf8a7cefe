"""Updates, inserts, deletes and merges: each gives the new table as a DataFrame."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import literal
from tessera.functions.filters import _leaf, compile_filter
from tessera.functions.scope import PipelineError, Scope, Typed, drop_path, path, set_path
from tessera.operators.stages import run_pipeline, sort_columns


def _typed(value: Any, kind: T.DataType | None) -> Column:
    c = literal(value).column
    return c if kind is None or isinstance(kind, T.NullType) else c.cast(kind)


def _bits(c: Column, spec: dict) -> Column:
    for op, n in spec.items():
        c = {"and": c.bitwiseAND, "or": c.bitwiseOR, "xor": c.bitwiseXOR}[op](F.lit(n))
    return c


def _pushed(old: Typed, arg: Any) -> Column:
    """$push: position, then sort, then slice."""
    spec = arg if isinstance(arg, dict) and "$each" in arg else {"$each": [arg]}
    kind = old.type if isinstance(old.type, T.ArrayType) else None
    new = _typed(spec["$each"], kind)
    base = F.coalesce(old.column, F.array().cast(kind)) if kind else F.array().cast(literal(spec["$each"]).type)
    if "$position" in spec:
        at = F.lit(spec["$position"]) if spec["$position"] >= 0 else F.greatest(F.size(base) + spec["$position"], F.lit(0))
        made = F.concat(F.slice(base, F.lit(1), at), new, F.slice(base, at + 1, F.size(base)))
    else:
        made = F.concat(base, new)
    by = spec.get("$sort")
    if isinstance(by, dict):
        (name, direction), *_ = by.items()
        made = F.transform(F.sort_array(F.transform(made, lambda x: F.struct(x.getField(name).alias("k"), x.alias("v"))), asc=direction == 1), lambda x: x["v"])
    elif by is not None:
        made = F.sort_array(made, asc=by == 1)
    if "$slice" in spec:
        n = spec["$slice"]
        made = F.slice(made, F.lit(1), F.lit(n)) if n >= 0 else F.slice(made, F.greatest(F.size(made) + n, F.lit(0)) + 1, F.lit(-n))
    return made


def _pulled(old: Typed, arg: Any, s: Scope) -> Column:
    element = old.type.elementType
    if isinstance(arg, dict) and arg and next(iter(arg)).startswith("$"):
        drop = lambda x: reduce(lambda a, b: a & b, [F.coalesce(_leaf(Typed(x, element), o, v, s, "", arg), F.lit(False)) for o, v in arg.items()])
    elif isinstance(arg, dict) and isinstance(element, T.StructType):
        drop = lambda x: compile_filter(arg, s.at(s.df, root=Typed(x, element)), False)
    else:
        drop = lambda x: x.eqNullSafe(_typed(arg, element))
    return F.filter(old.column, lambda x: ~drop(x))


def _none_of(values: Column):
    return lambda x: ~F.exists(values, lambda y: y.eqNullSafe(x))


def check_operators(update: dict) -> None:
    if not update or not all(k.startswith("$") for k in update):
        raise PipelineError("an update must have operators", 9)


def update_columns(update: dict, s: Scope, inserting: bool = False) -> list[tuple[str, Column | None]]:
    """(path, new value) for each field an update document changes; None removes the field."""
    out: list[tuple[str, Column | None]] = []
    check_operators(update)
    for op, fields in update.items():
        for name, arg in fields.items():
            if name == "_id" and op != "$setOnInsert":
                raise PipelineError("_id cannot be changed", 66)
            old = path(name, s)
            c, kind = old.column, old.type
            number = F.coalesce(c, F.lit(0)) if not isinstance(kind, T.NullType) else F.lit(0)
            keep = lambda x, k=kind: x.cast(k) if isinstance(k, T.NumericType) else x
            if op == "$set" or (op == "$setOnInsert" and inserting):
                out.append((name, _typed(arg, kind)))
            elif op == "$unset":
                out.append((name, None))
            elif op == "$inc":
                out.append((name, keep(number + F.lit(arg))))
            elif op == "$mul":
                out.append((name, keep(number * F.lit(arg))))
            elif op in ("$min", "$max"):
                out.append((name, (F.least if op == "$min" else F.greatest)(c, _typed(arg, kind))))
            elif op == "$rename":
                if not isinstance(kind, T.NullType):
                    out += [(arg, c), (name, None)]
            elif op == "$currentDate":
                out.append((name, F.current_timestamp()))
            elif op == "$push":
                out.append((name, _pushed(old, arg)))
            elif op in ("$pull", "$pullAll", "$pop", "$bit", "$addToSet") and isinstance(kind, T.NullType):
                continue
            elif op == "$pull":
                out.append((name, _pulled(old, arg, s)))
            elif op == "$pullAll":
                out.append((name, F.filter(c, _none_of(_typed(list(arg), kind)))))
            elif op == "$addToSet":
                made = F.coalesce(c, F.array().cast(kind))
                for v in arg["$each"] if isinstance(arg, dict) and "$each" in arg else [arg]:
                    new = _typed(v, kind.elementType)
                    made = F.when(F.exists(made, new.eqNullSafe), made).otherwise(F.array_append(made, new))
                out.append((name, made))
            elif op == "$pop":
                out.append((name, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))) if arg == -1 else F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))))
            elif op == "$bit":
                out.append((name, _bits(c, arg)))
    return out


def _apply(df: DataFrame, s: Scope, match: Column, change: dict) -> DataFrame:
    """One operator and field after another, so that each sees what those before it left."""
    check_operators(change)
    df = df.withColumn("_match", match)
    for op, fields in change.items():
        for field, arg in fields.items():
            for name, new in update_columns({op: {field: arg}}, s.at(df, hidden=s.hidden | {"_match"})):
                old = path(name, s.at(df))
                there = not isinstance(old.type, T.NullType)
                if new is None and there:
                    df = set_path(df, name, F.when(~F.col("_match"), old.column))
                elif new is not None:
                    df = set_path(df, name, F.when(F.col("_match"), new).otherwise(old.column if there else F.lit(None)))
    return df.drop("_match")


def first_match(df: DataFrame, s: Scope, match: Column, sort: dict | None, key: str = "_id") -> Column:
    """Narrows ``match`` to one row: the first by ``sort``, else by ``key``. Its key is found by a distributed top-1."""
    order = sort_columns(s, sort or {key: 1})
    row = df.where(match).orderBy(*order).limit(1).select(key).first()
    if row is None:
        return F.lit(False)
    picked = F.col(key).eqNullSafe(F.lit(row[0]))
    if df.where(picked).limit(2).count() > 1:
        raise PipelineError(f"{key} doesn't tell the rows apart, so one of them can't be picked", 11000)
    return picked


def update(df: DataFrame, filter_: dict, change: dict | list, *, one: bool = False, upsert: bool = False, key: str = "_id", sort: dict | None = None, s: Scope | None = None) -> DataFrame:
    s = (s or Scope(df)).at(df)
    match = compile_filter(filter_, s, False)
    if one:
        match = first_match(df, s, match, sort, key)
    if isinstance(change, list):
        hit = run_pipeline(s.at(df.where(match)), change).df
        return df.where(~match).unionByName(hit, allowMissingColumns=True)
    out = _apply(df, s, match, change)
    if upsert and df.where(match).isEmpty():
        return out.unionByName(_new_row(df, filter_, change, s), allowMissingColumns=True)
    return out


def _new_row(df: DataFrame, filter_: dict, change: dict, s: Scope) -> DataFrame:
    """The document of an upsert: the filter's equalities, then the update."""
    equal = {k: v["$eq"] if isinstance(v, dict) else v for k, v in filter_.items() if not k.startswith("$") and (not isinstance(v, dict) or "$eq" in v)}
    row = df.sparkSession.range(1).select(*[_typed(equal.get(f.name), f.dataType).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    for op, fields in change.items():
        for field, arg in fields.items():
            for name, new in update_columns({op: {field: arg}}, s.at(row), inserting=True):
                row = drop_path(row, name) if new is None else set_path(row, name, new)
    return row


def replace(df: DataFrame, filter_: dict, new: dict, *, upsert: bool = False, key: str = "_id") -> DataFrame:
    if any(k.startswith("$") for k in new):
        raise PipelineError("a replacement can't have operators", 2)
    s = Scope(df)
    match = first_match(df, s, compile_filter(filter_, s, False), None, key)
    if df.where(match).isEmpty():
        return insert(df, [{**{k: v for k, v in filter_.items() if not k.startswith("$") and not isinstance(v, dict)}, **new}]) if upsert else df
    keep = {f.name: _typed(new.get(f.name), f.dataType).cast(f.dataType) if f.name != key else df[f"`{key}`"] for f in df.schema.fields}
    hit = df.where(match).select(*[c.alias(k) for k, c in keep.items()], *[literal(v).column.alias(k) for k, v in new.items() if k not in keep])
    return df.where(~match).unionByName(hit, allowMissingColumns=True)


def delete(df: DataFrame, filter_: dict, *, one: bool = False, key: str = "_id") -> DataFrame:
    s = Scope(df)
    match = compile_filter(filter_, s, False)
    return df.where(~(first_match(df, s, match, None, key) if one else match))


def insert(df: DataFrame, rows: list[dict] | DataFrame, key: str = "_id") -> DataFrame:
    """Appends rows; keys are made where they are missing, and one that is there already is an error (11000) when the result is read."""
    spark = df.sparkSession
    if isinstance(rows, DataFrame):
        new = rows
    else:
        types = {f.name: f.dataType for f in df.schema.fields}
        fields = list(dict.fromkeys(k for r in rows for k in r))
        each = [F.struct(*[(_typed(r[k], types.get(k)) if k in r else F.lit(None)).alias(k) for k in fields]) for r in rows]
        new = spark.range(1).select(F.inline(F.array(*each)))  # one node of the plan for any number of rows
    if key not in new.columns:
        new = new.withColumn(key, F.substring(F.md5(F.uuid()), 1, 24))
    both = df.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    check_unique(both, [key])
    return both.drop("_new")


def check_unique(df: DataFrame, keys: list[str], partial: Column | None = None, sparse: bool = False) -> None:
    rows = df if partial is None else df.where(partial)
    if sparse:
        rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise PipelineError(f"duplicate key on {', '.join(keys)}", 11000)


def merge_into(target: DataFrame, fresh: DataFrame, on: list[str], matched: Any = "merge", unmatched: str = "insert") -> DataFrame:
    """Upsert by one full outer join. A key that ``fresh`` holds twice is an error (11000); its fields, null ones too, overwrite."""
    check_unique(fresh, on)
    names = [*target.columns, *[c for c in fresh.columns if c not in target.columns]]
    t = target.select(F.lit(True).alias("_t"), F.struct("*").alias("old"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(on)])
    f = fresh.select(F.lit(True).alias("_f"), F.struct("*").alias("new"), *[F.col(k).alias(f"_n{i}") for i, k in enumerate(on)])
    j = t.join(f, reduce(lambda a, b: a & b, [F.col(f"_o{i}") == F.col(f"_n{i}") for i in range(len(on))]), "full")
    both, only_new = F.col("_t").isNotNull() & F.col("_f").isNotNull(), F.col("_t").isNull()
    if matched == "fail" or unmatched == "fail":
        bad = (both if matched == "fail" else F.lit(False)) | (only_new if unmatched == "fail" else F.lit(False))
        j = j.where(F.when(bad, F.raise_error(F.lit("$merge: whenMatched or whenNotMatched is fail")).cast("boolean")).otherwise(True))
    if unmatched == "discard":
        j = j.where(~only_new)

    def value(name: str) -> Column:
        old = F.col("old").getField(name) if name in target.columns else F.lit(None)
        new = F.col("new").getField(name) if name in fresh.columns else F.lit(None)
        hit = old if matched == "keepExisting" or name not in fresh.columns and matched == "merge" else new
        return F.when(both, hit).when(only_new, new).otherwise(old).alias(name)

    return j.select(*[value(n) for n in names])

