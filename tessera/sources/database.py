"""Databases of collections: Parquet tables, registered DataFrames and views, with the calls of a document database."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.filters import compile_filter, json_schema, text_score
from tessera.functions.scope import PipelineError, Scope, Typed, drop_path, path
from tessera.operators import updates
from tessera.operators.stages import _tree, run_pipeline, sort_columns
from tessera.sources.scratch import written


class Database:
    """Collections by name. ``root`` is a folder of <name>.parquet tables, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str | None = None, name: str = "db", siblings: dict[str, Database] | None = None):
        self.spark, self.root, self.name = spark, root, name
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, tuple[str, list[dict]]] = {}
        self.rules: dict[str, dict] = {}
        self.siblings = {} if siblings is None else siblings
        self.siblings[name] = self

    def sibling(self, name: str) -> Database:
        return self.siblings[name]

    def _stored(self, name: str) -> str | None:
        if self.root is None:
            return None
        where = f"{self.root}/{name}.parquet"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return where if there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there) else None

    def find_table(self, name: str) -> DataFrame | None:
        """The collection as a DataFrame, views expanded; None if there is none."""
        if name in self.views:
            source, stages = self.views[name]
            return self.collection(source).aggregate(stages)
        if name in self.tables:
            df = self.tables[name]
        else:
            where = self._stored(name)
            df = None if where is None else self.spark.read.parquet(where)
        rule = self.rules.get(name, {})
        if df is not None and "ttl" in rule:
            field, seconds = rule["ttl"]
            value = path(field, Scope(df))
            at = F.array_min(value.column) if isinstance(value.type, T.ArrayType) else value.column
            df = df.where(at.isNull() | (F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + seconds) > F.current_timestamp()))
        return df

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    __getitem__ = collection

    def register(self, name: str, df: DataFrame) -> Collection:
        self.tables[name] = df
        return Collection(self, name)

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def create(self, name: str, *, validator: dict | None = None, unique: list[list[str] | dict] | None = None, ttl: tuple[str, int] | None = None, capped: dict | None = None, view_on: str | None = None, pipeline: list[dict] | None = None) -> Collection:
        """validator: a filter; capped: {"max": rows, "by": order field}; view_on and pipeline make a view.

        unique: lists of fields, or {"keys": fields, "sparse": True, "partial": filter} for those rows alone that have all the fields, or that fit.
        """
        if view_on is not None:
            self.views[name] = (view_on, pipeline or [])
        else:
            given = {"validator": validator, "unique": unique, "ttl": ttl, "capped": capped}
            self.rules[name] = {k: v for k, v in given.items() if v is not None}
        return Collection(self, name)

    def drop(self, name: str) -> None:
        for known in (self.tables, self.views, self.rules):
            known.pop(name, None)

    def rename(self, old: str, new: str) -> None:
        if new in self.tables or new in self.views:
            raise PipelineError(f"{new} exists", 48)
        if old not in self.tables:
            raise PipelineError(f"{old} doesn't exist", 26)
        self.tables[new] = self.tables.pop(old)
        self.rules[new] = self.rules.pop(old, {})

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.views})

    def aggregate(self, stages: list[dict]) -> DataFrame:
        """A pipeline without a collection: it starts from $documents."""
        return run_pipeline(Scope(self.spark.range(1).drop("id"), database=self), stages).df

    def run_command(self, command: dict) -> Any:
        kind, target = next(iter(command.items()))
        if kind == "count":
            return {"n": self[target].count(command.get("query", {})), "ok": 1}
        if kind == "distinct":
            return self[target].distinct(command["key"], command.get("query", {}))
        if kind == "aggregate":
            return self[target].aggregate(command["pipeline"])
        if kind == "explain":
            inner = command["explain"]
            return self[inner["aggregate"]].aggregate(inner["pipeline"])._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        if kind == "listCollections":
            return self.names()
        if kind == "create":
            return self.create(target, **{k: v for k, v in command.items() if k != "create"})
        if kind == "drop":
            return self.drop(target)
        if kind == "ping":
            return {"ok": 1}
        raise PipelineError(f"no such command: {kind}", 59)

    def export(self, folder: str) -> None:
        """Every registered collection as JSON lines, by the executors."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").json(f"{folder}/{name}.json")

    def load(self, folder: str, schemas: dict[str, T.StructType]) -> None:
        for name, schema in schemas.items():
            self.tables[name] = self.spark.read.schema(schema).json(f"{folder}/{name}.json")


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name

    @property
    def frame(self) -> DataFrame:
        df = self.database.find_table(self.name)
        if df is None:
            raise PipelineError(f"no collection {self.name}", 26)
        return df

    def scope(self, variables: dict[str, Typed] | None = None) -> Scope:
        return Scope(self.frame, variables or {}, (), self.database)

    def aggregate(self, stages: list[dict]) -> DataFrame:
        return run_pipeline(self.scope(), stages).df

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """Filter, sort, skip, limit, then projection."""
        s = self.scope()
        df = s.df.where(compile_filter(filter, s)) if filter else s.df
        score = text_score(filter["$text"], s) if filter and "$text" in filter else F.lit(0.0)
        if any(isinstance(v, dict) and "$meta" in v for v in (projection or {}).values()):
            df = df.withColumn("_score", score)
        df = df.orderBy(*sort_columns(s.at(df), sort)) if sort else df
        df = df.offset(skip) if skip else df
        df = df.limit(limit) if limit else df
        return find_projection(s.at(df), projection) if projection else df

    def count(self, filter: dict | None = None) -> int:
        return self.find(filter).count()

    def distinct(self, field: str, filter: dict | None = None) -> DataFrame:
        df = self.find(filter)
        return df.select(path(field, Scope(df)).column.alias(field)).where(F.col(f"`{field}`").isNotNull()).distinct()

    def distinct_many(self, field: str, filter: dict | None = None) -> DataFrame:
        df = self.find(filter)
        return df.select(F.explode(path(field, Scope(df)).column).alias(field)).where(F.col(f"`{field}`").isNotNull()).distinct()

    def _put(self, df: DataFrame) -> DataFrame:
        """The new table, checked against the collection's rules and written."""
        rule = self.database.rules.get(self.name, {})
        new = written(df, self.name)
        for given in rule.get("unique", []):
            given = given if isinstance(given, dict) else {"keys": given}
            partial = compile_filter(given["partial"], Scope(new), False) if "partial" in given else None
            updates.check_unique(new, given["keys"], partial, given.get("sparse", False))
        if "validator" in rule:
            s = Scope(new)
            fits = json_schema(rule["validator"]["$jsonSchema"], s.document()) if set(rule["validator"]) == {"$jsonSchema"} else compile_filter(rule["validator"], s, False)
            if not new.where(~F.coalesce(fits, F.lit(False))).isEmpty():
                raise PipelineError("a document failed validation", 121)
        if "capped" in rule:
            new = new.orderBy(F.desc(rule["capped"]["by"])).limit(rule["capped"]["max"])
            new = written(new, self.name)
        self.database.replace(self.name, new)
        return new

    def insert_many(self, rows: list[dict] | DataFrame, key: str = "_id") -> DataFrame:
        old = self.database.find_table(self.name)
        if old is None:
            old = self.database.spark.createDataFrame([], rows.schema) if isinstance(rows, DataFrame) else self.database.spark.range(1).select(*[F.lit(v).alias(k) for k, v in rows[0].items()]).where("false")
        return self._put(updates.insert(old, rows, key))

    def update_many(self, filter: dict, change: dict | list, *, upsert: bool = False, key: str = "_id") -> DataFrame:
        return self._put(updates.update(self.frame, filter, change, upsert=upsert, key=key, s=self.scope()))

    def update_one(self, filter: dict, change: dict | list, *, upsert: bool = False, key: str = "_id", sort: dict | None = None) -> DataFrame:
        return self._put(updates.update(self.frame, filter, change, one=True, upsert=upsert, key=key, sort=sort, s=self.scope()))

    def replace_one(self, filter: dict, new: dict, *, upsert: bool = False, key: str = "_id") -> DataFrame:
        return self._put(updates.replace(self.frame, filter, new, upsert=upsert, key=key))

    def delete_many(self, filter: dict) -> DataFrame:
        if "capped" in self.database.rules.get(self.name, {}):
            raise PipelineError("a capped collection has no deletes", 20)
        return self._put(updates.delete(self.frame, filter))

    def delete_one(self, filter: dict, key: str = "_id") -> DataFrame:
        return self._put(updates.delete(self.frame, filter, one=True, key=key))

    def find_one_and(self, action: str, filter: dict, change: Any = None, *, sort: dict | None = None, after: bool = False, key: str = "_id") -> DataFrame:
        """update, replace or delete of the first match; gives that row before or after."""
        s = self.scope()
        match = updates.first_match(s.df, s, compile_filter(filter, s, False), sort, key)
        before = written(s.df.where(match), "found")
        row = before.select(key).first()
        if row is None:
            return before
        pick = {key: row[0]}
        if action == "delete":
            self.delete_many(pick)
            return before
        new = self.update_many(pick, change, key=key) if action == "update" else self.replace_one(pick, change, key=key)
        return new.where(F.col(key).eqNullSafe(F.lit(row[0]))) if after else before

    def bulk_write(self, writes: list[tuple]) -> DataFrame:
        """(method, *arguments) in order; the first error ends it."""
        out = None
        for method, *args in writes:
            out = getattr(self, method)(*args)
        return out


def _matching(value: Typed, spec: dict, s: Scope) -> Column:
    return F.filter(value.column, lambda x: compile_filter(spec, s.at(s.df, root=Typed(x, value.type.elementType)), False))


def find_projection(s: Scope, spec: dict) -> DataFrame:
    """$slice, $elemMatch and $meta besides plain fields; the first key that isn't _id decides between including and excluding."""
    made: dict[str, Column] = {}
    for k, v in spec.items():
        if isinstance(v, dict):
            (op, arg), *_ = v.items()
            value = path(k, s)
            if op == "$slice":
                start, n = (F.lit(1), abs(arg)) if not isinstance(arg, list) and arg >= 0 else (F.greatest(F.size(value.column) + arg, F.lit(0)) + 1, -arg) if not isinstance(arg, list) else (F.lit(arg[0] + 1) if arg[0] >= 0 else F.greatest(F.size(value.column) + arg[0], F.lit(0)) + 1, arg[1])
                made[k] = F.slice(value.column, start, F.lit(n))
            elif op == "$elemMatch":
                hits = _matching(value, arg, s)
                made[k] = F.when(F.size(hits) > 0, F.slice(hits, F.lit(1), F.lit(1)))
            elif op == "$meta":
                made[k] = s.df["_score"]
            else:
                raise PipelineError(f"unknown projection operator {op}")
    flags = {k: v for k, v in spec.items() if not isinstance(v, dict) and k != "_id"}
    if flags and not next(iter(flags.values())) or (not flags and not any("$elemMatch" in v or "$meta" in v for v in spec.values() if isinstance(v, dict))):
        df = s.df.withColumns(made) if made else s.df
        return reduce(drop_path, [k for k, v in spec.items() if v in (0, False)], df).drop("_score")
    plain = {k: path(k, s).column for k in flags}
    nested: dict[str, dict[str, Column]] = {}
    for k in [k for k in plain if "." in k]:
        nested.setdefault(k.split(".")[0], {})[k] = plain.pop(k)
    first = {"_id": path("_id", s).column} if "_id" in s.names and spec.get("_id", 1) not in (0, False) else {}
    return s.df.select(*[c.alias(k) for k, c in {**first, **plain, **made}.items()], *[_tree(k, parts).alias(k) for k, parts in nested.items()])

