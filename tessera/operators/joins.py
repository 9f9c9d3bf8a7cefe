"""$lookup, $graphLookup and $unionWith as joins over the whole table instead of a search for each row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.accumulators import accumulate, order_key
from tessera.functions.expressions import column, compile_expression
from tessera.functions.filters import compile_filter
from tessera.functions.scope import PipelineError, Scope, Typed, path
from tessera.operators.stages import STAGES, bucket_of, run_pipeline, set_path, stage
from tessera.sources.scratch import written


def foreign(s: Scope, name: Any) -> Scope:
    """The other collection; an unknown one is empty."""
    db, coll = (name.get("db"), name["coll"]) if isinstance(name, dict) else (None, name)
    database = s.database if db is None else s.database.sibling(db)
    table = database.find_table(coll)
    return s.at(s.df.sparkSession.createDataFrame([], "_id string") if table is None else table, order=(), database=database)


def _whole(s: Scope) -> Column:
    return F.struct(*[s.df[f"`{n}`"] for n in s.names])


def fused(s: Scope, stages: list[dict], at: int) -> tuple[Scope, int] | None:
    """$lookup with $unwind or an emptiness $match of its array right after it: an inner, outer, semi or anti join, with no arrays."""
    if at + 1 >= len(stages) or "$lookup" not in stages[at]:
        return None
    spec, (name, after) = stages[at]["$lookup"], next(iter(stages[at + 1].items()))
    if "pipeline" in spec or "localField" not in spec:
        return None
    other = foreign(s, spec["from"])
    key, match_on = path(spec["localField"], s), path(spec["foreignField"], other)
    if isinstance(key.type, T.ArrayType) or isinstance(match_on.type, T.ArrayType):
        return None
    if name == "$unwind":
        after = {"path": after} if isinstance(after, str) else after
        if after["path"] != f"${spec['as']}" or after.get("includeArrayIndex"):
            return None
        right = other.df.select(match_on.column.alias("_key"), _whole(other).alias(spec["as"]))
        how = "left" if after.get("preserveNullAndEmptyArrays") else "inner"
        joined = s.df.drop(spec["as"]).join(right, key.column.eqNullSafe(right["_key"]), how).drop("_key")
        return s.at(joined), 2
    if name == "$match" and set(after) == {spec["as"]} and at + 2 < len(stages):
        test = after[spec["as"]]
        how = {"$ne": "left_semi", "$eq": "left_anti"}.get(next(iter(test))) if isinstance(test, dict) and list(test.values()) == [[]] else "left_anti" if test in ([], {"$size": 0}) else None
        drops = stages[at + 2].get("$unset")
        if how and drops in (spec["as"], [spec["as"]]):
            right = other.df.select(match_on.column.alias("_key"))
            return s.at(s.df.join(right, key.column.eqNullSafe(right["_key"]), how)), 3
    return None


def _inside(s: Scope, run: Callable[[Scope], Scope]) -> Scope:
    """A join within the sub-pipeline of another one: the outer row id is put aside under another name meanwhile."""
    if "_row" not in s.hidden:
        return run(s)
    aside = f"_row_{len(s.hidden)}"
    out = run(s.at(s.df.withColumnRenamed("_row", aside), hidden=s.hidden - {"_row"} | {aside}))
    return out.at(out.df.withColumnRenamed(aside, "_row"), hidden=s.hidden)


@stage("$lookup")
def lookup(s: Scope, spec: dict) -> Scope:
    return _inside(s, lambda inner: _lookup(inner, spec))


def _lookup(s: Scope, spec: dict) -> Scope:
    if "pipeline" in spec:
        return _correlated(s, spec)
    other = foreign(s, spec["from"])
    key, on = path(spec["localField"], s), path(spec["foreignField"], other)
    right = other.df.select(on.column.alias("_key"), _whole(other).alias("_doc"))
    arrays, many = isinstance(on.type, T.ArrayType), isinstance(key.type, T.ArrayType)
    empty = F.array().cast(T.ArrayType(right.schema["_doc"].dataType))
    if arrays and many:
        right = written(right.withColumn("_number", F.monotonically_increasing_id()), "foreign")  # tells equal foreign rows apart
    exploded = right.withColumn("_key", F.explode_outer(F.array_distinct("_key"))) if arrays else right
    lists = exploded.groupBy("_key").agg(F.collect_list("_doc").alias("_docs"))
    if not many:
        joined = s.df.join(lists, key.column.eqNullSafe(lists["_key"]), "left")
        return s.at(set_path(joined, spec["as"], F.coalesce(F.col("_docs"), empty)).drop("_key", "_docs"))
    numbered = written(s.df.withColumn("_row", F.monotonically_increasing_id()), "lookup")
    local = s.at(numbered, hidden=s.hidden | {"_row"})
    keys = numbered.select("_row", F.explode_outer(F.array_distinct(path(spec["localField"], local).column)).alias("_local"))
    keys = keys.distinct() if any(x in key.type.simpleString() for x in ("float", "double")) else keys  # array_distinct keeps 0.0 beside -0.0
    same = F.col("_local").eqNullSafe(F.col("_key"))
    if arrays:  # a row and a foreign row may share several keys: pairs of ids are made distinct before documents join them
        found = keys.join(exploded.select("_key", "_number"), same).select("_row", "_number").distinct()
        found = found.join(right.select("_number", F.array("_doc").alias("_docs")), "_number")
    else:
        found = keys.join(lists, same)
    # dealt by row first: lists made within the join's tasks would hold all documents that these meet
    found = found.select("_row", "_docs").repartition("_row").groupBy("_row").agg(F.flatten(F.collect_list("_docs")).alias("_docs"))
    joined = numbered.join(found, "_row", "left")
    return s.at(set_path(joined, spec["as"], F.coalesce(F.col("_docs"), empty)).drop("_row", "_docs"))


def _equalities(pipeline: list[dict]) -> list[dict]:
    """The $expr parts of the first $match, if there is one: they become the join's condition."""
    if not pipeline or "$match" not in pipeline[0]:
        return []
    e = pipeline[0]["$match"].get("$expr")
    return [] if e is None else list(e["$and"]) if isinstance(e, dict) and "$and" in e else [e]


def _correlated(s: Scope, spec: dict) -> Scope:
    """A sub-pipeline for every row, as one join: rows get an id, the first $match is the join's condition, and the stages after it work by row id.

    Variables are seen by all stages. Equalities between a variable and a field make it a hash join.
    """
    other, stages = foreign(s, spec["from"]), list(spec["pipeline"])
    if not spec.get("let") and "localField" not in spec:
        return _same_for_all(s, run_pipeline(other, stages), spec["as"])
    rows = written(s.df.withColumn("_row", F.monotonically_increasing_id()), "lookup")
    local = s.at(rows, hidden=s.hidden | {"_row"})
    variables = {k: compile_expression(v, local) for k, v in spec.get("let", {}).items()}
    left = rows.select("_row", *[v.column.alias(f"_let_{k}") for k, v in variables.items()], *([path(spec["localField"], local).column.alias("_local")] if "localField" in spec else []))
    right = other.df.select(*[F.col(f"`{n}`").alias(f"_f_{n}") for n in other.names])
    types = {f.name: f.dataType for f in other.df.schema.fields}
    both = Scope(left, {**s.variables, **{k: Typed(F.col(f"_let_{k}"), local.type_of(v)) for k, v in variables.items()}}, (), other.database, Typed(F.struct(*[F.col(f"_f_{n}").alias(n) for n in other.names]), T.StructType(other.df.schema.fields)))
    condition = F.lit(True)
    if _equalities(stages):
        for part in _equalities(stages):
            condition = condition & _condition(part, both, types)
        rest = {k: v for k, v in stages[0]["$match"].items() if k != "$expr"}
        stages = ([{"$match": rest}] if rest else []) + stages[1:]
    if "localField" in spec:
        condition = condition & F.col("_local").eqNullSafe(F.col(f"_f_{spec['foreignField']}"))
    while stages and "$match" in stages[0] and "$expr" not in stages[0]["$match"]:
        right = right.select(*[F.col(f"_f_{n}").alias(n) for n in other.names])
        right = right.where(compile_filter(stages.pop(0)["$match"], other.at(right))).select(*[F.col(f"`{n}`").alias(f"_f_{n}") for n in other.names])
    joined = left.join(right, condition, "inner")
    hidden = frozenset(["_row", *[f"_let_{k}" for k in variables]])
    sub = Scope(joined.select(*hidden, *[F.col(f"_f_{n}").alias(n) for n in other.names]), {**s.variables, **{k: Typed(F.col(f"_let_{k}"), local.type_of(v)) for k, v in variables.items()}}, (), other.database, None, hidden)
    for st in stages:
        sub = _by_row(sub, st)
    lists = sub.df.groupBy("_row").agg(_listed(sub).alias("_docs"))
    out = rows.join(lists, "_row", "left")
    out = set_path(out, spec["as"], F.coalesce(F.col("_docs"), F.array().cast(lists.schema["_docs"].dataType)))
    return s.at(out.drop("_row", "_docs"))


def _listed(sub: Scope) -> Column:
    """All documents of a sub-pipeline as an array, in its order if it has one."""
    whole = _whole(sub)
    if not sub.order:
        return F.collect_list(whole)
    key, down = order_key(list(sub.order), sub)
    return F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), whole.alias("v"))), asc=not down), lambda x: x["v"])


def _same_for_all(s: Scope, sub: Scope, name: str) -> Scope:
    """A sub-pipeline that sees nothing of the row runs once, and its one array joins every row."""
    once = sub.df.agg(_listed(sub).alias("_docs"))
    joined = s.df.crossJoin(F.broadcast(once))  # one row
    return s.at(set_path(joined, name, F.col("_docs")).drop("_docs"))


def _condition(e: Any, both: Scope, types: dict) -> Column:
    """One part of a join condition; an equality is built on bare columns, so that Spark joins by hash."""
    if isinstance(e, dict) and "$eq" in e:
        sides = [F.col(f"_f_{x[1:]}") if isinstance(x, str) and x.startswith("$") and x[1:] in types else column(x, both) for x in e["$eq"]]
        return sides[0].eqNullSafe(sides[1])
    from tessera.functions.expressions import truthy

    return truthy(compile_expression(e, both), both)


def _by_row(sub: Scope, st: dict) -> Scope:
    """A stage of a sub-pipeline, for all rows at once."""
    (name, spec), *_ = st.items()
    if name in ("$match", "$addFields", "$set", "$unset", "$unwind", "$project", "$replaceRoot", "$replaceWith", "$redact", "$lookup", "$graphLookup"):
        return STAGES[name](sub, spec)
    if name == "$setWindowFields":
        return _windowed_by_row(sub, spec)
    if name == "$sample":
        n = F.row_number().over(Window.partitionBy("_row").orderBy("_random"))
        df = sub.df.withColumn("_random", F.rand()).withColumn("_n", n)
        return sub.at(df.where(F.col("_n") <= int(spec["size"])).drop("_n", "_random"), order=())
    if name == "$sortByCount":
        grouped = _by_row(sub, {"$group": {"_id": spec, "count": {"$count": {}}}})
        return grouped.at(grouped.df, order=(("count", -1), ("_id", 1)))
    if name == "$bucket":
        return _grouped_by_row(sub, bucket_of(sub, spec), spec.get("output", {"count": {"$sum": 1}}))
    if name == "$sort":
        return sub.at(sub.df, order=tuple(spec.items()))
    if name in ("$limit", "$skip"):
        order = [path(k, sub).column.asc() if d == 1 else path(k, sub).column.desc() for k, d in sub.order] or [F.lit(0)]
        n = F.row_number().over(Window.partitionBy("_row").orderBy(*order))
        df = sub.df.withColumn("_n", n)
        return sub.at(df.where(F.col("_n") <= int(spec) if name == "$limit" else F.col("_n") > int(spec)).drop("_n"))
    if name == "$group":
        key = spec["_id"]
        by = F.lit(None).cast("string") if key is None else column(key, sub)
        return _grouped_by_row(sub, by, {k: v for k, v in spec.items() if k != "_id"})
    if name == "$count":
        return sub.at(sub.df.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias(spec), *[F.first(c).alias(c) for c in sub.hidden if c != "_row"]), order=())
    raise PipelineError(f"{name} isn't supported inside a correlated $lookup")


def _grouped_by_row(sub: Scope, by: Column, outputs: dict) -> Scope:
    made = [accumulate(*next(iter(v.items())), sub).alias(k) for k, v in outputs.items()]
    keep = [F.first(c).alias(c) for c in sub.hidden if c != "_row"]
    return sub.at(sub.df.groupBy("_row", by.alias("_id")).agg(*made, *keep), order=())


def _windowed_by_row(sub: Scope, spec: dict) -> Scope:
    """The window of each row's own documents: the row is one more partition key."""
    seen = sub.at(sub.df, hidden=sub.hidden - {"_row"})
    by = spec.get("partitionBy")
    out = STAGES["$setWindowFields"](seen, spec | {"partitionBy": {"$concatArrays": [[{"$toString": "$_row"}], [{"$toString": by}]]} if by is not None else "$_row"})
    return sub.at(out.df)


@stage("$unionWith")
def union_with(s: Scope, spec: Any) -> Scope:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = foreign(s, spec["coll"]) if "coll" in spec else s
    other = run_pipeline(other, spec.get("pipeline", []))
    return s.at(s.df.unionByName(other.df, allowMissingColumns=True), order=())


@stage("$graphLookup")
def graph_lookup(s: Scope, spec: dict) -> Scope:
    return _inside(s, lambda inner: _graph_lookup(inner, spec))


def _graph_lookup(s: Scope, spec: dict) -> Scope:
    """Breadth first for all rows at once: one join a level, values seen before left out, until a level is empty.

    Every level is written, so a level that is lost is not computed from the first one again.
    """
    other = foreign(s, spec["from"])
    if spec.get("restrictSearchWithMatch"):
        other = other.at(other.df.where(compile_filter(spec["restrictSearchWithMatch"], other)))
    rows = written(s.df.withColumn("_row", F.monotonically_increasing_id()), "graph")
    local = s.at(rows, hidden=s.hidden | {"_row"})

    def spread(c: Column, kind: T.DataType | None) -> Column:
        return F.explode(c) if isinstance(kind, T.ArrayType) else c

    start = compile_expression(spec["startWith"], local)
    to, onward = path(spec["connectToField"], other), path(spec["connectFromField"], other)
    docs = other.df.select(spread(to.column, to.type).alias("_to"), (onward.column if isinstance(onward.type, T.ArrayType) else F.array(onward.column)).alias("_from"), _whole(other).alias("_doc"))
    frontier = rows.select("_row", spread(start.column, local.type_of(start)).alias("_value")).where("_value is not null").distinct()
    seen, levels, depth, most = frontier, [], 0, spec.get("maxDepth")
    while True:
        level = written(frontier.join(docs, F.col("_value") == F.col("_to")).select("_row", "_doc", "_from", F.lit(depth).cast("long").alias("_depth")), "level")
        levels.append(level)
        if depth == most:
            break
        fresh = level.select("_row", F.explode("_from").alias("_value")).where("_value is not null").distinct()
        frontier = written(fresh.join(seen, ["_row", "_value"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        depth += 1
    found: DataFrame = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    first = found.groupBy("_row", "_doc").agg(F.min("_depth").alias("_depth"))
    doc = F.col("_doc").withField(spec["depthField"], F.col("_depth")) if "depthField" in spec else F.col("_doc")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_depth").alias("d"), doc.alias("v")))), lambda x: x["v"])
    lists = first.groupBy("_row").agg(listed.alias("_docs"))
    joined = rows.join(lists, "_row", "left")
    return s.at(set_path(joined, spec["as"], F.coalesce(F.col("_docs"), F.array().cast(lists.schema["_docs"].dataType))).drop("_row", "_docs"))
