"""What an expression is compiled against: a DataFrame's schema, variables and the current order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PipelineError(ValueError):
    """A stage, operator or argument that can't be compiled. ``code`` follows the documented error numbers."""

    def __init__(self, message: str, code: int = 2):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Typed:
    """A column with its type, None where only Spark's analyser could tell."""

    column: Column
    type: T.DataType | None = None


@dataclass(frozen=True)
class Scope:
    df: DataFrame
    #: name -> value, for $$name
    variables: dict[str, Typed] = field(default_factory=dict)
    #: keys of the last $sort, as (path, 1 or -1)
    order: tuple[tuple[str, int], ...] = ()
    #: the database that foreign collections are looked up in
    database: Any = None
    #: column that paths start from instead of the DataFrame's columns
    root: Typed | None = None
    #: fields of the DataFrame that no path sees
    hidden: frozenset[str] = frozenset()

    def at(self, df: DataFrame, **changes) -> Scope:
        return replace(self, df=df, **changes)

    def having(self, **variables: Typed) -> Scope:
        return replace(self, variables=self.variables | variables)

    @property
    def fields(self) -> list[T.StructField]:
        if self.root is not None:
            return list(self.root.type.fields) if isinstance(self.root.type, T.StructType) else []
        return [f for f in self.df.schema.fields if f.name not in self.hidden]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Column:
        return self.root.column.getField(name) if self.root is not None else self.df[_quoted(name)]

    def document(self) -> Typed:
        """The whole document, as a struct."""
        if self.root is not None:
            return self.root
        return Typed(F.struct(*[self.field(n).alias(n) for n in self.names]), T.StructType(self.fields))

    def type_of(self, value: Typed) -> T.DataType | None:
        if value.type is None:
            try:
                return self.df.select(value.column).schema[0].dataType
            except Exception as e:  # a lambda variable has no meaning outside its lambda
                if "UNRESOLVED" not in str(e) and "lambda" not in str(e).lower():
                    raise
        return value.type


def _quoted(name: str) -> str:
    return f"`{name}`"


def null() -> Typed:
    return Typed(F.lit(None), T.NullType())


def walk(value: Typed, parts: list[str]) -> Typed:
    """Follow a dotted path; arrays by numeric index only. A step that the type doesn't have gives null."""
    for part in parts:
        t = value.type
        if isinstance(t, T.StructType) and part in t.names:
            value = Typed(value.column.getField(part), t[part].dataType)
        elif isinstance(t, T.ArrayType) and part.isdigit():
            value = Typed(F.get(value.column, int(part)), t.elementType)
        elif isinstance(t, T.MapType):
            value = Typed(value.column.getItem(part), t.valueType)
        else:
            return null()
    return value


def path(name: str, scope: Scope) -> Typed:
    first, *rest = name.split(".")
    by_name = {f.name: f.dataType for f in scope.fields}
    if name in by_name:
        return Typed(scope.field(name), by_name[name])
    return walk(Typed(scope.field(first), by_name[first]), rest) if first in by_name else null()


def exists(name: str, scope: Scope) -> bool:
    return not isinstance(path(name, scope).type, T.NullType)


def set_path(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a possibly dotted field set; missing structs are made, scalars on the way are replaced."""
    first, *rest = name.split(".")
    return df.withColumn(first, _set(Typed(df[_quoted(first)], df.schema[first].dataType) if first in df.columns else null(), rest, value))


def _set(target: Typed, parts: list[str], value: Column) -> Column:
    if not parts:
        return value
    head, rest = parts[0], parts[1:]
    old = target.type if isinstance(target.type, T.StructType) else T.StructType([])
    names = [*old.names, *([] if head in old.names else [head])]
    inner = lambda n: Typed(target.column.getField(n), old[n].dataType) if n in old.names else null()
    return F.struct(*[(_set(inner(n), rest, value) if n == head else inner(n).column).alias(n) for n in names])


def drop_path(df: DataFrame, name: str) -> DataFrame:
    first, *rest = name.split(".")
    if first not in df.columns:
        return df
    if not rest:
        return df.drop(first)
    target = Typed(df[_quoted(first)], df.schema[first].dataType)
    return df.withColumn(first, _drop(target, rest)) if isinstance(target.type, T.StructType) else df


def _drop(target: Typed, parts: list[str]) -> Column:
    head, rest = parts[0], parts[1:]
    kept = []
    for f in target.type.fields:
        inner = Typed(target.column.getField(f.name), f.dataType)
        if f.name != head:
            kept.append(inner.column.alias(f.name))
        elif rest and isinstance(f.dataType, T.StructType):
            kept.append(_drop(inner, rest).alias(f.name))
    return F.when(target.column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
