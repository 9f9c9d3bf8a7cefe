"""Pipeline stages: each takes a DataFrame and gives a DataFrame, so a pipeline is one plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.accumulators import RANKED, _Late, accumulate, first_rows, windowed
from tessera.functions.expressions import column, compile_expression, literal
from tessera.functions.filters import compile_filter
from tessera.functions.scope import PipelineError, Scope, Typed, drop_path, path, set_path
from tessera.sources.scratch import global_row_number, written

STAGES: dict[str, Callable[[Scope, Any], Scope]] = {}


def stage(*names: str):
    def add(f):
        STAGES.update(dict.fromkeys(names, f))
        return f

    return add


#: Nodes of a plan that shuffle or sort all rows.
SHUFFLES = re.compile(r"\b(Aggregate|Join|Window|Sort|Repartition\w*|GlobalLimit|Distinct)\b")
#: Stages that take the order from the scope or not at all, so that rows need no sort before them.
UNSORTED = {"$group", "$sort", "$count", "$sortByCount", "$bucket", "$bucketAuto", "$setWindowFields"}


def run_pipeline(s: Scope, stages: list[dict]) -> Scope:
    from tessera.operators import joins  # registers its stages

    at = 0
    while at < len(stages):
        fused = joins.fused(s, stages, at)
        if fused is not None:
            s, used = fused
            at += used
            continue
        (name, spec), *more = stages[at].items()
        if more:
            raise PipelineError("a stage has exactly one field", 40323)
        if name not in STAGES:
            raise PipelineError(f"unrecognized pipeline stage {name}", 40324)
        if name == "$sort" and at + 1 < len(stages) and next(iter(stages[at + 1])) in UNSORTED:
            s, at = s.at(s.df, order=tuple(spec.items())), at + 1  # the next stage orders by keys itself
            continue
        s = STAGES[name](s, spec)
        at += 1
    return s


def sort_columns(s: Scope, keys: dict) -> list[Column]:
    """Missing and null sort lowest, as Spark does by default."""
    return [path(k, s).column.asc() if d == 1 else path(k, s).column.desc() for k, d in keys.items()]


@stage("$match")
def match(s: Scope, spec: dict) -> Scope:
    return s.at(s.df.where(compile_filter(spec, s)))


def _is_flag(v: Any) -> bool:
    return isinstance(v, (bool, int, float)) or (isinstance(v, str) and not v.startswith("$"))


@stage("$project")
def project(s: Scope, spec: dict) -> Scope:
    including = any(not _is_flag(v) or (bool(v) and (k != "_id" or len(spec) == 1)) for k, v in spec.items())
    if not including:
        df = s.df
        for k, v in spec.items():
            df = drop_path(df, k)
        return s.at(df)
    chosen: dict[str, Column] = {}
    if "_id" in s.names and spec.get("_id", 1) not in (0, False):
        chosen["_id"] = path("_id", s).column
    nested: dict[str, dict] = {}
    for k, v in spec.items():
        if k == "_id" and _is_flag(v):
            continue
        value = path(k, s).column if _is_flag(v) else column(v, s)
        if "." in k:
            nested.setdefault(k.split(".")[0], {})[k] = value
        else:
            chosen[k] = value
    made = s.df.select(*[s.df[f"`{n}`"] for n in s.hidden], *[c.alias(k) for k, c in chosen.items()], *[_tree(first, parts).alias(first) for first, parts in nested.items()])
    return s.at(made)


def _tree(first: str, parts: dict[str, Column]) -> Column:
    by: dict[str, dict[str, Column]] = {}
    leaves: dict[str, Column] = {}
    for k, c in parts.items():
        head, *rest = k.split(".")[1:]
        if rest:
            by.setdefault(head, {})[".".join([head, *rest])] = c
        else:
            leaves[head] = c
    return F.struct(*[c.alias(k) for k, c in leaves.items()], *[_tree(k, sub).alias(k) for k, sub in by.items()])


@stage("$addFields", "$set")
def add_fields(s: Scope, spec: dict) -> Scope:
    """All expressions see the original document."""
    made = {k: column(v, s) for k, v in spec.items()}
    flat = {k: c for k, c in made.items() if "." not in k}
    df = s.df.withColumns(flat) if flat else s.df
    for k, c in made.items():
        if "." in k:
            df = set_path(df, k, c)
    return s.at(df)


@stage("$unset")
def unset(s: Scope, spec: Any) -> Scope:
    return s.at(reduce(drop_path, [spec] if isinstance(spec, str) else spec, s.df))


@stage("$replaceRoot", "$replaceWith")
def replace_root(s: Scope, spec: Any) -> Scope:
    e = spec["newRoot"] if isinstance(spec, dict) and set(spec) == {"newRoot"} else spec
    made = compile_expression(e, s)
    hidden = [s.df[f"`{n}`"] for n in s.hidden]
    if isinstance(e, dict) and not next(iter(e), "").startswith("$"):
        fields = {k: column(v, s) for k, v in e.items()}
        return s.at(s.df.select(*hidden, *[c.alias(k) for k, c in fields.items()]), order=())
    kind = s.type_of(made)
    if not isinstance(kind, T.StructType):
        raise PipelineError("the new root must be a document", 40228)
    guarded = F.when(made.column.isNull(), F.raise_error(F.lit("the new root must be a document")).cast(kind)).otherwise(made.column)
    return s.at(s.df.select(*hidden, guarded.alias("_root")).select(*s.hidden, "_root.*"), order=())


@stage("$redact")
def redact(s: Scope, spec: Any) -> Scope:
    """$$KEEP keeps a document, $$PRUNE drops it, $$DESCEND asks again for each document inside it."""
    decision = compile_expression(spec, s)
    df = s.df.where(F.coalesce(decision.column != "PRUNE", F.lit(True)))
    below = s.at(df)
    made = {}
    for f in below.fields:
        value = Typed(below.field(f.name), f.dataType)
        inner = _redacted(value, spec, below)
        if inner is not None:
            made[f.name] = F.when(column(spec, below) == "DESCEND", inner).otherwise(value.column)
    return s.at(df.withColumns(made) if made else df)


def _redacted(value: Typed, spec: Any, s: Scope) -> Column | None:
    if isinstance(value.type, T.StructType):
        inner = s.at(s.df, root=value)
        decision = column(spec, inner)
        parts = []
        for f in value.type.fields:
            field = Typed(value.column.getField(f.name), f.dataType)
            deeper = _redacted(field, spec, s)
            parts.append((field.column if deeper is None else F.when(decision == "DESCEND", deeper).otherwise(field.column)).alias(f.name))
        return F.when(F.coalesce(decision != "PRUNE", F.lit(True)) & value.column.isNotNull(), F.struct(*parts))
    if isinstance(value.type, T.ArrayType) and isinstance(value.type.elementType, T.StructType):
        kept = F.transform(value.column, lambda x: _redacted(Typed(x, value.type.elementType), spec, s))
        return F.filter(kept, lambda x: x.isNotNull())
    return None


@stage("$unwind")
def unwind(s: Scope, spec: Any) -> Scope:
    spec = {"path": spec} if isinstance(spec, str) else spec
    name, keep, index = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    value = path(name, s)
    if not isinstance(value.type, T.ArrayType):
        df = s.df if keep else s.df.where("false")
        return s.at(df.withColumn(index, F.lit(None).cast("long")) if index else df)
    explode = F.posexplode_outer if keep else F.posexplode
    df = s.df.select("*", explode(value.column).alias("_at", "_item"))
    df = set_path(df, name, df["_item"])
    df = df.withColumn(index, df["_at"].cast("long")) if index else df
    return s.at(df.drop("_at", "_item"))


@stage("$sort")
def sort(s: Scope, spec: dict) -> Scope:
    return s.at(s.df.orderBy(*sort_columns(s, spec)), order=tuple(spec.items()))


@stage("$limit")
def limit(s: Scope, n: int) -> Scope:
    return s.at(s.df.limit(int(n)))


@stage("$skip")
def skip(s: Scope, n: int) -> Scope:
    return s.at(s.df.offset(int(n)))


@stage("$sample")
def sample(s: Scope, spec: dict) -> Scope:
    return s.at(s.df.orderBy(F.rand()).limit(int(spec["size"])), order=())


def _group(s: Scope, by: Column, outputs: dict) -> DataFrame:
    """Aggregates by ``by``; the accumulators of the first n values join a table of n rows a group, see ``first_rows``."""
    ops = {k: next(iter(spec.items())) for k, spec in outputs.items()}
    few = {k: (op, e) for k, (op, e) in ops.items() if op in RANKED and isinstance(e["n"], int)}
    made = [accumulate(op, e, s).alias(k) for k, (op, e) in ops.items() if k not in few]
    out = s.df.groupBy(by.alias("_id")).agg(*(made or [F.count(F.lit(1)).alias("_n")]))
    for k, (op, e) in few.items():
        listed, empty = first_rows(op, e, s, by)
        listed = listed.select(F.col("_id").alias("_few"), F.col("values").alias(k))
        out = out.join(listed, out["_id"].eqNullSafe(listed["_few"]), "left").drop("_few").withColumn(k, F.coalesce(F.col(f"`{k}`"), empty))
    return out.select("_id", *[F.col(f"`{k}`") for k in ops])


@stage("$group")
def group(s: Scope, spec: dict) -> Scope:
    """No row for empty input, whatever _id is."""
    key = spec["_id"]
    if isinstance(key, dict) and key and not next(iter(key)).startswith("$"):
        by = F.struct(*[column(v, s).alias(k) for k, v in key.items()])
    else:
        by = F.lit(None).cast("string") if key is None else column(key, s)
    return s.at(_group(s, by, {k: v for k, v in spec.items() if k != "_id"}), order=())


@stage("$count")
def count(s: Scope, name: str) -> Scope:
    return s.at(s.df.agg(F.count(F.lit(1)).cast("int").alias(name)), order=())


@stage("$sortByCount")
def sort_by_count(s: Scope, e: Any) -> Scope:
    df = s.df.groupBy(column(e, s).alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("count"))
    return s.at(df.orderBy(F.desc("count"), "_id"), order=(("count", -1), ("_id", 1)))


def bucket_of(s: Scope, spec: dict) -> Column:
    value, bounds = column(spec["groupBy"], s), spec["boundaries"]
    made = reduce(lambda c, b: c.when((value >= b[0]) & (value < b[1]), literal(b[0]).column), zip(bounds, bounds[1:], strict=False), F)
    fallback = literal(spec["default"]).column if "default" in spec else F.raise_error(F.lit("$bucket: a value fits no bucket and there is no default"))
    return made.otherwise(fallback)


@stage("$bucket")
def bucket(s: Scope, spec: dict) -> Scope:
    return s.at(_group(s, bucket_of(s, spec), spec.get("output", {"count": {"$sum": 1}})), order=())


@stage("$bucketAuto")
def bucket_auto(s: Scope, spec: dict) -> Scope:
    """Chunks of ceil(n / buckets) rows by position; ties may straddle. A bucket ends where the next one begins."""
    value = column(spec["groupBy"], s)
    rows = global_row_number(s.df.select(value.alias("_v")), [F.col("_v").asc()], "_n")
    n = rows.count()
    size = -(-n // int(spec["buckets"])) or 1
    by = rows.groupBy(F.floor((F.col("_n") - 1) / size).cast("long").alias("_b")).agg(F.min("_v").alias("min"), F.max("_v").alias("last"), F.count(F.lit(1)).cast("int").alias("count"))
    after = by.select((F.col("_b") - 1).alias("_b"), F.col("min").alias("next"))
    out = by.join(after, "_b", "left").select(F.struct("min", F.coalesce("next", "last").alias("max")).alias("_id"), "count")
    return s.at(out, order=())


@stage("$facet")
def facet(s: Scope, spec: dict) -> Scope:
    """One row with an array for each branch.

    Each branch reads the input by itself, so its filters and columns reach the scan. An input that took a shuffle is written first.
    """
    source = s.at(written(s.df, "facet")) if len(spec) > 1 and SHUFFLES.search(s.df._jdf.queryExecution().optimizedPlan().toString()) else s
    rows = []
    for name, stages in spec.items():
        out = run_pipeline(source, stages)
        key = F.struct(F.lit(0).alias("k"), F.struct(*[out.df[f"`{n}`"] for n in out.names]).alias("v"))
        if out.order:
            from tessera.functions.accumulators import order_key

            k, down = order_key(list(out.order), out)
            key = F.struct(k.alias("k"), F.struct(*[out.df[f"`{n}`"] for n in out.names]).alias("v"))
            listed = F.transform(F.sort_array(F.collect_list(key), asc=not down), lambda x: x["v"])
        else:
            listed = F.transform(F.collect_list(key), lambda x: x["v"])
        rows.append(out.df.agg(listed.alias(name)))
    return s.at(reduce(lambda a, b: a.crossJoin(b), rows), order=())  # one row each


@stage("$setWindowFields")
def set_window_fields(s: Scope, spec: dict) -> Scope:
    partition = [column(spec["partitionBy"], s)] if spec.get("partitionBy") is not None else []
    keys = list(spec.get("sortBy", {}).items())
    made, late = {}, {}
    for name, out in spec["output"].items():
        frame = out.get("window")
        op, e = next((k, v) for k, v in out.items() if k != "window")
        found = windowed(op, e, frame, s, partition, keys)
        if isinstance(found, _Late):
            late[name] = found
        else:
            made[name] = found
    df = s.df.withColumns({f"_w_{k}": v.inner for k, v in late.items()}) if late else s.df
    df = df.withColumns(made | {k: v.finish(F.col(f"_w_{k}")) for k, v in late.items()}).drop(*[f"_w_{k}" for k in late])
    return s.at(df)


@stage("$densify")
def densify(s: Scope, spec: dict) -> Scope:
    """Steps from each value up to the next one; new rows hold the field (and the partition's fields) only."""
    name, step, by = spec["field"], spec["range"]["step"], spec.get("partitionByFields", [])
    from pyspark.sql import Window

    value = path(name, s)
    w = Window.partitionBy(*by).orderBy(name)
    keys = s.df.select(*by, value.column.alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("_next", F.lead(name).over(w))
    unit = spec["range"].get("unit")
    if unit:
        width = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit] * int(step) * 1_000_000
        start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in (name, "_next"))
        steps = F.ceil((end - start) / width).cast("long") - 1
        new = F.timestamp_micros(start + F.col("_k") * width).cast(value.type)
    else:
        steps = (F.ceil((F.col("_next") - F.col(name)) / step) - 1).cast("long")
        new = (F.col(name) + F.col("_k") * F.lit(step)).cast(value.type)
    gaps = keys.withColumn("_n", steps).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return s.at(s.df.unionByName(gaps.select(*by, new.alias(name)), allowMissingColumns=True), order=())


@stage("$fill")
def fill(s: Scope, spec: dict) -> Scope:
    """Per output field a value, or the last one that isn't null, or interpolation by row position."""
    parts = [column(spec["partitionBy"], s)] if "partitionBy" in spec else [path(n, s).column for n in spec.get("partitionByFields", [])]
    keys = list(spec.get("sortBy", {}).items())
    output = {}
    for name, rule in spec["output"].items():
        if "value" in rule:
            output[name] = F.coalesce(path(name, s).column, column(rule["value"], s))
        else:
            op = {"locf": "$locf", "linear": "$linearFill"}[rule["method"]]
            output[name] = windowed(op, f"${name}", None, s, parts, keys)
    late = {k: v for k, v in output.items() if isinstance(v, _Late)}
    df = s.df.withColumns({f"_w_{k}": v.inner for k, v in late.items()}) if late else s.df
    return s.at(df.withColumns({k: v.finish(F.col(f"_w_{k}")) if k in late else v for k, v in output.items()}).drop(*[f"_w_{k}" for k in late]))


@stage("$documents")
def documents(s: Scope, rows: list[dict]) -> Scope:
    """All rows as one array of structs, so a plan of any number of rows has one node. A field that a row lacks is null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    each = [F.struct(*[(column(r[k], s) if k in r else F.lit(None)).alias(k) for k in names]) for r in rows]
    return s.at(s.df.sparkSession.range(1).select(F.inline(F.array(*each))), order=())


@stage("$geoNear")
def geo_near(s: Scope, spec: dict) -> Scope:
    at = spec["near"]["coordinates"] if isinstance(spec["near"], dict) else spec["near"]
    name = spec.get("key") or next((f.name for f in s.fields if _is_place(f.dataType)), None)
    if name is None:
        raise PipelineError("$geoNear found no field with a place")
    d = geo.distance(path(name, s), *at)
    df = s.df.where(compile_filter(spec["query"], s)) if spec.get("query") else s.df
    df = df.withColumn("_d", d).where(F.col("_d").isNotNull())
    if "minDistance" in spec:
        df = df.where(F.col("_d") >= float(spec["minDistance"]))
    if "maxDistance" in spec:
        df = df.where(F.col("_d") <= float(spec["maxDistance"]))
    field = spec["distanceField"]
    df = set_path(df, field, F.col("_d") * float(spec.get("distanceMultiplier", 1.0)))
    if "includeLocs" in spec:
        df = set_path(df, spec["includeLocs"], path(name, s).column)
    out = s.at(df.drop("_d"), order=((field, 1),))
    return out.at(out.df.orderBy(*sort_columns(out, {field: 1})))


def _is_place(t: T.DataType) -> bool:
    return (isinstance(t, T.StructType) and "coordinates" in t.names) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.DoubleType, T.FloatType)))


@stage("$search")
def search(s: Scope, spec: dict) -> Scope:
    """text, phrase and wildcard: a substring of the path or of any top-level string, in any case; adds score."""
    kind = next((k for k in ("text", "phrase", "wildcard") if k in spec), None)
    if kind is None:
        return s
    rule = spec[kind]
    paths = rule.get("path", "*")
    names = [f.name for f in s.fields if isinstance(f.dataType, T.StringType)] if paths in ("*", {"wildcard": "*"}) else [paths] if isinstance(paths, str) else paths
    queries = [rule["query"]] if isinstance(rule["query"], str) else rule["query"]
    found = [F.coalesce(F.lower(path(n, s).column).contains(q.lower().strip("*")), F.lit(False)) for n in names for q in queries]
    return s.at(s.df.where(reduce(lambda a, b: a | b, found)).withColumn("score", F.lit(1.0)))


@stage("$searchMeta")
def search_meta(s: Scope, spec: dict) -> Scope:
    n = F.count(F.lit(1)).cast("long")
    return s.at(s.df.agg(F.struct(n.alias("lowerBound"), n.alias("total")).alias("count")), order=())


@stage("$vectorSearch")
def vector_search(s: Scope, spec: dict) -> Scope:
    """Exact cosine; vectors of another length are passed over. The best ``limit`` rows by a distributed top-k."""
    query = [float(x) for x in spec["queryVector"]]
    v = path(spec["path"], s).column.cast("array<double>")
    q = F.array(*[F.lit(x) for x in query])
    df = s.df.where(compile_filter(spec["filter"], s)) if spec.get("filter") else s.df
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    dot, norm = total(F.zip_with(v, q, lambda a, b: a * b)), F.sqrt(total(F.transform(v, lambda a: a * a)))
    size = sum(x * x for x in query) ** 0.5
    score = F.when(norm * size > 0, dot / (norm * F.lit(size))).otherwise(0.0)
    df = df.where(F.size(v) == len(query)).withColumn("__vectorSearchScore", score)
    return s.at(df.orderBy(F.desc("__vectorSearchScore")).limit(int(spec.get("limit", 10))), order=(("__vectorSearchScore", -1),))


@stage("$collStats")
def coll_stats(s: Scope, spec: dict) -> Scope:
    n = F.count(F.lit(1))
    return s.at(s.df.agg(F.struct(n.alias("count"), F.lit(False).alias("capped")).alias("storageStats"), n.alias("count")), order=())


@stage("$indexStats")
def index_stats(s: Scope, spec: dict) -> Scope:
    return s.at(s.df.sparkSession.range(1).select(F.lit("_id_").alias("name"), F.struct(F.lit(1).alias("_id")).alias("key")), order=())


@stage("$out")
def out(s: Scope, spec: Any) -> Scope:
    name = spec if isinstance(spec, str) else spec["coll"]
    result = written(s.df, "out")
    s.database.replace(name, result)
    return s.at(result)


@stage("$merge")
def merge(s: Scope, spec: Any) -> Scope:
    from tessera.operators.updates import merge_into

    spec = {"into": spec} if isinstance(spec, str) else spec
    name = spec["into"] if isinstance(spec["into"], str) else spec["into"]["coll"]
    on = spec.get("on", "_id")
    fresh = written(s.df, "merge")
    target = s.database.find_table(name)
    merged = fresh if target is None else merge_into(target, fresh, [on] if isinstance(on, str) else on, spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert"))
    s.database.replace(name, written(merged, "merged"))
    return s.at(fresh)

