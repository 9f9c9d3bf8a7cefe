"""Expression documents as Columns: ``{"$add": ["$a", 1]}`` is ``col("a") + 1``.

A string ``"$a.b"`` is a path and ``"$$v"`` a variable; other scalars are literals, and so is a document whose first key has no
``$``. Missing fields are null. Arithmetic gives doubles, null if an argument is. Nothing is evaluated in Python but $function.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import udfs
from tessera.functions.scope import PipelineError, Scope, Typed, null, path, walk

DOUBLE, LONG, INT, STRING, BOOL = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def literal(value: Any) -> Typed:
    if value is None:
        return null()
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        return Typed(F.struct(*[p.column.alias(k) for k, p in parts.items()]), T.StructType([T.StructField(k, p.type) for k, p in parts.items()]))
    if isinstance(value, (list, tuple)):
        parts = [literal(v) for v in value]
        kinds = [p.type for p in parts if not isinstance(p.type, T.NullType)]
        return Typed(F.array(*[p.column for p in parts]), T.ArrayType(max(kinds, key=_width) if kinds else T.NullType()))
    kind = {bool: BOOL, int: INT if isinstance(value, int) and -(1 << 31) <= value < 1 << 31 else LONG, float: DOUBLE, str: STRING, bytes: T.BinaryType(), datetime.datetime: T.TimestampType(), datetime.date: T.DateType(), Decimal: T.DecimalType(38, 18)}
    return Typed(F.lit(value), kind.get(type(value)))


def _width(t: T.DataType) -> int:
    return [INT, LONG, DOUBLE].index(t) if t in (INT, LONG, DOUBLE) else 9


def compile_expression(e: Any, s: Scope) -> Typed:
    if isinstance(e, Column):
        return Typed(e)
    if isinstance(e, str) and e.startswith("$$"):
        return _variable(e[2:], s)
    if isinstance(e, str) and e.startswith("$") and len(e) > 1:
        return path(e[1:], s)
    if isinstance(e, (list, tuple)):
        parts = [compile_expression(x, s) for x in e]
        kinds = [p.type for p in parts]
        known = kinds and all(k is not None and k == kinds[0] for k in kinds)
        return Typed(F.array(*[p.column for p in parts]), T.ArrayType(kinds[0]) if known else None)
    if isinstance(e, dict) and e and next(iter(e)).startswith("$"):
        name, args = next(iter(e.items()))
        if name not in OPERATORS:
            raise PipelineError(f"unknown expression operator {name}", 168)
        return OPERATORS[name](args, s)
    return literal(e)


def column(e: Any, s: Scope) -> Column:
    return compile_expression(e, s).column


def _variable(name: str, s: Scope) -> Typed:
    first, *rest = name.split(".")
    if first in s.variables:
        return walk(s.variables[first], rest)
    if first in ("ROOT", "CURRENT"):
        return path(".".join(rest), s) if rest else s.document()
    if first in ("NOW", "CLUSTER_TIME"):
        return Typed(F.current_timestamp(), T.TimestampType())
    if first == "REMOVE":
        return null()
    if first in ("KEEP", "PRUNE", "DESCEND"):
        return literal(first)
    raise PipelineError(f"undefined variable $${first}", 17276)


def truthy(value: Typed, s: Scope) -> Column:
    """False for null, false and 0; true for all else."""
    kind = s.type_of(value)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.column, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.column != 0, F.lit(False))
    return value.column.isNotNull()


def _list(args: Any) -> list:
    return list(args) if isinstance(args, (list, tuple)) else [args]


def _only(args: Any) -> Any:
    """Unary operators take x or [x]."""
    return args[0] if isinstance(args, (list, tuple)) and len(args) == 1 else args


OPERATORS: dict[str, Callable[[Any, Scope], Typed]] = {}


def operator(*names: str):
    def add(f):
        OPERATORS.update(dict.fromkeys(names, f))
        return f

    return add


def unary(name: str, f: Callable[[Column], Column], returns: T.DataType | None, cast: T.DataType | None = None) -> None:
    def build(args, s):
        c = column(_only(args), s)
        return Typed(f(c.cast(cast) if cast is not None else c), returns)

    OPERATORS[name] = build


def binary(name: str, f: Callable[[Column, Column], Column], returns: T.DataType | None, cast: T.DataType | None = None) -> None:
    def build(args, s):
        a, b = (column(x, s) for x in _list(args))
        return Typed(f(a.cast(cast), b.cast(cast)) if cast is not None else f(a, b), returns)

    OPERATORS[name] = build


def variadic(name: str, f: Callable[[Column, Column], Column], returns: T.DataType | None, cast: T.DataType | None = None) -> None:
    def build(args, s):
        parts = [column(x, s) for x in _list(args)]
        return Typed(reduce(f, [p.cast(cast) if cast is not None else p for p in parts]), returns)

    OPERATORS[name] = build


# arithmetic
variadic("$add", lambda a, b: a + b, DOUBLE, DOUBLE)
variadic("$multiply", lambda a, b: a * b, DOUBLE, DOUBLE)
binary("$subtract", lambda a, b: a - b, DOUBLE, DOUBLE)
binary("$divide", lambda a, b: a / b, DOUBLE, DOUBLE)
binary("$mod", lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b)), DOUBLE, DOUBLE)
binary("$pow", F.pow, DOUBLE, DOUBLE)
binary("$atan2", F.atan2, DOUBLE, DOUBLE)
for _name, _f in {"$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$sqrt": F.sqrt, "$exp": F.exp, "$sin": F.sin, "$cos": F.cos, "$tan": F.tan, "$asin": F.asin, "$acos": F.acos, "$atan": F.atan, "$degreesToRadians": F.radians, "$radiansToDegrees": F.degrees}.items():
    unary(_name, lambda c, f=_f: f(c).cast("double"), DOUBLE, DOUBLE)


def _log_guard(f):
    return lambda c: F.when(c > 0, f(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


binary("$log", lambda x, base: _log_guard(F.ln)(x) / _log_guard(F.ln)(base), DOUBLE, DOUBLE)
unary("$ln", _log_guard(F.ln), DOUBLE, DOUBLE)
unary("$log10", _log_guard(F.log10), DOUBLE, DOUBLE)


@operator("$round")
def _round(args, s):
    x, *places = _list(args)
    return Typed(F.round(column(x, s).cast("double"), int(places[0]) if places else 0), DOUBLE)


@operator("$trunc")
def _trunc(args, s):
    x, *places = _list(args)
    c, scale = column(x, s).cast("double"), 10.0 ** (int(places[0]) if places else 0)
    return Typed(F.signum(c) * F.floor(F.abs(c) * scale) / scale, DOUBLE)


@operator("$rand")
def _rand(args, s):
    return Typed(F.rand(), DOUBLE)


@operator("$sampleRate")
def _sample_rate(args, s):
    return Typed(F.rand() < float(args), BOOL)


# strings
variadic("$concat", lambda a, b: F.concat(a, b), STRING, STRING)
unary("$toLower", lambda c: F.coalesce(F.lower(c), F.lit("")), STRING, STRING)
unary("$toUpper", lambda c: F.coalesce(F.upper(c), F.lit("")), STRING, STRING)
unary("$strLenBytes", F.octet_length, INT, STRING)
unary("$strLenCP", F.length, INT, STRING)
binary("$strcasecmp", lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0), INT, STRING)


def _trimmer(side: str):
    def build(args, s):
        spec = args if isinstance(args, dict) and "input" in args else {"input": _only(args)}
        c = column(spec["input"], s).cast("string")
        f = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side]
        if "chars" in spec:
            return Typed(f(c, column(spec["chars"], s)), STRING)
        return Typed(f(c, F.lit(" \t\n\x0b\f\r ")), STRING)

    return build


OPERATORS |= {"$trim": _trimmer("both"), "$ltrim": _trimmer("leading"), "$rtrim": _trimmer("trailing")}


@operator("$substr", "$substrBytes", "$substrCP")
def _substr(args, s):
    text, start, length = (column(x, s) for x in _list(args))
    start, length = start.cast("int"), length.cast("int")
    return Typed(F.coalesce(F.when(length < 0, F.substring(text.cast("string"), start + 1, F.lit(2**31 - 1))).otherwise(F.substring(text.cast("string"), start + 1, length)), F.lit("")), STRING)


@operator("$indexOfBytes", "$indexOfCP")
def _index_of(args, s):
    text, sub, *ends = (column(x, s) for x in _list(args))
    text = F.substring(text, F.lit(1), ends[1].cast("int")) if len(ends) > 1 else text
    return Typed(F.position(sub, text, ends[0].cast("int") + 1) - 1 if ends else F.instr(text, sub) - 1, INT)


@operator("$split")
def _split(args, s):
    text, by = (column(x, s) for x in _list(args))
    return Typed(F.split(text, F.concat(F.lit("\\Q"), by, F.lit("\\E"))), T.ArrayType(STRING))


@operator("$replaceOne")
def _replace_one(args, s):
    text, find, by = (column(args[k], s) for k in ("input", "find", "replacement"))
    at = F.instr(text, find)
    return Typed(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(find), F.length(text)))).otherwise(text), STRING)


@operator("$replaceAll")
def _replace_all(args, s):
    return Typed(F.replace(*(column(args[k], s) for k in ("input", "find", "replacement"))), STRING)


def regex_of(pattern: Any, options: str = "") -> str:
    if isinstance(pattern, re.Pattern):
        options += "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & bit)
        pattern = pattern.pattern
    return f"(?{options}){pattern}" if options else pattern


def _regex_args(args, s) -> tuple[Column, str]:
    return column(args["input"], s), regex_of(args["regex"], args.get("options", ""))


@operator("$regexMatch")
def _regex_match(args, s):
    text, pattern = _regex_args(args, s)
    return Typed(F.coalesce(text.rlike(pattern), F.lit(False)), BOOL)


_FOUND = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING))])


@operator("$regexFind")
def _regex_find(args, s):
    text, pattern = _regex_args(args, s)
    found = F.struct(F.regexp_extract(text, pattern, 0).alias("match"), (F.regexp_instr(text, F.lit(pattern)) - 1).alias("idx"), F.array().cast("array<string>").alias("captures"))
    return Typed(F.when(text.rlike(pattern), found), _FOUND)


@operator("$regexFindAll")
def _regex_find_all(args, s):
    text, pattern = _regex_args(args, s)
    text = F.coalesce(text, F.lit(""))
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        begin = a["at"] + F.length(x["1"])
        return F.struct((begin + F.length(x["0"])).alias("at"), F.array_append(a["out"], begin).alias("out"))

    at = F.aggregate(F.slice(F.arrays_zip(found.alias("0"), F.slice(rest, F.lit(1), F.size(found)).alias("1")), F.lit(1), F.size(found)), start, step, lambda a: a["out"])
    zipped = F.transform(F.arrays_zip(found.alias("m"), at.alias("i")), lambda x: F.struct(x["m"].alias("match"), x["i"].alias("idx"), F.array().cast("array<string>").alias("captures")))
    return Typed(zipped, T.ArrayType(_FOUND))


# comparison: null is the lowest value
def _nulls_lowest(name: str, a: Column, b: Column) -> Column:
    return {
        "$eq": lambda: a.eqNullSafe(b),
        "$ne": lambda: ~a.eqNullSafe(b),
        "$gt": lambda: F.coalesce(a > b, a.isNotNull() & b.isNull()),
        "$gte": lambda: F.coalesce(a >= b, b.isNull()),
        "$lt": lambda: F.coalesce(a < b, a.isNull() & b.isNotNull()),
        "$lte": lambda: F.coalesce(a <= b, a.isNull()),
    }[name]()


for _name in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
    binary(_name, lambda a, b, n=_name: _nulls_lowest(n, a, b), BOOL)
binary("$cmp", lambda a, b: F.when(_nulls_lowest("$lt", a, b), -1).when(_nulls_lowest("$gt", a, b), 1).otherwise(0), INT)


@operator("$and")
def _and(args, s):
    return Typed(reduce(lambda a, b: a & b, [truthy(compile_expression(x, s), s) for x in _list(args)], F.lit(True)), BOOL)


@operator("$or")
def _or(args, s):
    return Typed(reduce(lambda a, b: a | b, [truthy(compile_expression(x, s), s) for x in _list(args)], F.lit(False)), BOOL)


@operator("$not")
def _not(args, s):
    return Typed(~truthy(compile_expression(_only(args), s), s), BOOL)


@operator("$cond")
def _cond(args, s):
    test, then, other = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
    then, other = compile_expression(then, s), compile_expression(other, s)
    return Typed(F.when(truthy(compile_expression(test, s), s), then.column).otherwise(other.column), then.type if then.type == other.type else None)


@operator("$ifNull")
def _if_null(args, s):
    return Typed(F.coalesce(*[column(x, s) for x in _list(args)]))


@operator("$switch")
def _switch(args, s):
    out = F
    for b in args["branches"]:
        out = out.when(truthy(compile_expression(b["case"], s), s), column(b["then"], s))
    return Typed(out.otherwise(column(args["default"], s) if "default" in args else F.raise_error(F.lit("$switch: no branch matches and there is no default"))))


# arrays
def _element_type(value: Typed, s: Scope) -> T.DataType | None:
    kind = s.type_of(value)
    return kind.elementType if isinstance(kind, T.ArrayType) else None


@operator("$arrayElemAt")
def _elem_at(args, s):
    array, at = compile_expression(args[0], s), column(args[1], s).cast("int")
    return Typed(F.when(at >= 0, F.get(array.column, at)).otherwise(F.try_element_at(array.column, F.when(at < 0, at).otherwise(-1))), _element_type(array, s))


def _end(at: int):
    def build(args, s):
        array = compile_expression(_only(args), s)
        return Typed(F.try_element_at(array.column, F.lit(at)), _element_type(array, s))

    return build


OPERATORS |= {"$first": _end(1), "$last": _end(-1)}
unary("$size", F.size, INT)
unary("$reverseArray", F.reverse, None)


@operator("$isArray")
def _is_array(args, s):
    value = compile_expression(_only(args), s)
    return Typed(value.column.isNotNull() if isinstance(s.type_of(value), T.ArrayType) else F.lit(False), BOOL)


@operator("$concatArrays")
def _concat_arrays(args, s):
    return Typed(F.concat(*[column(x, s) for x in _list(args)]))


@operator("$in")
def _in(args, s):
    value, array = (column(x, s) for x in args)
    return Typed(F.coalesce(F.exists(array, lambda x: x.eqNullSafe(value)), F.lit(False)), BOOL)


@operator("$filter")
def _filter(args, s):
    array, name = compile_expression(args["input"], s), args.get("as", "this")
    element = _element_type(array, s)
    kept = F.filter(array.column, lambda x: truthy(compile_expression(args["cond"], s.having(**{name: Typed(x, element)})), s))
    return Typed(F.slice(kept, F.lit(1), column(args["limit"], s).cast("int")) if args.get("limit") is not None else kept, array.type)


@operator("$map")
def _map(args, s):
    array, name = compile_expression(args["input"], s), args.get("as", "this")
    element, seen = _element_type(array, s), []

    def body(x):
        made = compile_expression(args["in"], s.having(**{name: Typed(x, element)}))
        seen.append(made.type)
        return made.column

    return Typed(F.transform(array.column, body), T.ArrayType(seen[0]) if seen and seen[0] is not None else None)


@operator("$reduce")
def _reduce(args, s):
    array, start = compile_expression(args["input"], s), compile_expression(args["initialValue"], s)
    element, kind = _element_type(array, s), s.type_of(start)
    kind = DOUBLE if isinstance(kind, T.NumericType) else kind
    first = start.column.cast(kind) if not isinstance(kind, T.NullType) else start.column
    return Typed(F.aggregate(array.column, first, lambda a, x: column(args["in"], s.having(value=Typed(a, kind), this=Typed(x, element))).cast(kind)), kind)


@operator("$range")
def _range(args, s):
    a, b, *step = (column(x, s).cast("int") for x in args)
    step = step[0] if step else F.lit(1)
    last = b - F.signum(step).cast("int")
    return Typed(F.when(((step > 0) & (a < b)) | ((step < 0) & (a > b)), F.sequence(a, last, step)).otherwise(F.array().cast("array<int>")), T.ArrayType(INT))


@operator("$slice")
def _slice(args, s):
    array, first, *count = args
    value, n = compile_expression(array, s), column(first, s).cast("int")
    size = F.size(value.column)
    if count:
        start = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(n)
        return Typed(F.slice(value.column, start + 1, column(count[0], s).cast("int")), value.type)
    return Typed(F.when(n >= 0, F.slice(value.column, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(value.column, F.greatest(size + n, F.lit(0)) + 1, F.abs(n))), value.type)


@operator("$sortArray")
def _sort_array(args, s):
    array, by = compile_expression(args["input"], s), args["sortBy"]
    if not isinstance(by, dict):
        return Typed(F.sort_array(array.column, by == 1), array.type)
    element = _element_type(array, s)

    def compare(x, y):
        out = F.lit(0)
        for key, direction in reversed(list(by.items())):
            a, b = walk(Typed(x, element), key.split(".")).column, walk(Typed(y, element), key.split(".")).column
            out = F.when(_nulls_lowest("$lt", a, b), -1 if direction == 1 else 1).when(_nulls_lowest("$gt", a, b), 1 if direction == 1 else -1).otherwise(out)
        return out

    return Typed(F.array_sort(array.column, compare), array.type)


@operator("$objectToArray")
def _object_to_array(args, s):
    value = compile_expression(_only(args), s)
    kind = s.type_of(value)
    if isinstance(kind, T.MapType):
        return Typed(F.transform(F.map_entries(value.column), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))))
    kinds = {f.dataType for f in kind.fields}
    as_text = len(kinds) > 1
    parts = [F.struct(F.lit(f.name).alias("k"), (value.column.getField(f.name).cast("string") if as_text else value.column.getField(f.name)).alias("v")) for f in kind.fields]
    return Typed(F.array(*parts), T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", STRING if as_text else next(iter(kinds)))])))


@operator("$arrayToObject")
def _array_to_object(args, s):
    value = compile_expression(_only(args), s)
    element = _element_type(value, s)
    if isinstance(element, T.StructType):
        return Typed(F.map_from_entries(F.transform(value.column, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))))
    return Typed(F.map_from_entries(F.transform(value.column, lambda x: F.struct(F.get(x, 0).alias("key"), F.get(x, 1).alias("value")))))


@operator("$zip")
def _zip(args, s):
    arrays = [column(x, s) for x in args["inputs"]]
    size = F.size(arrays[0]) if len(arrays) == 1 else (F.greatest if args.get("useLongestLength") else F.least)(*[F.size(a) for a in arrays])
    spare = [column(x, s) for x in args.get("defaults", [])] or [F.lit(None)] * len(arrays)
    whole = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return Typed(F.transform(whole, lambda i: F.array(*[F.when(i < F.size(a), F.get(a, i)).otherwise(d) for a, d in zip(arrays, spare, strict=True)])))


# types
_NAMES = [(T.BooleanType, "bool"), (T.IntegerType, "int"), (T.ShortType, "int"), (T.ByteType, "int"), (T.LongType, "long"), (T.DecimalType, "decimal"), (T.FloatType, "double"), (T.DoubleType, "double"), (T.StringType, "string"), (T.DateType, "date"), (T.TimestampNTZType, "date"), (T.TimestampType, "date"), (T.BinaryType, "binData"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object")]
_CASTS = {"double": DOUBLE, "int": INT, "long": LONG, "decimal": T.DecimalType(38, 18), "string": STRING, "bool": BOOL, "date": T.TimestampType(), "objectId": STRING}
CODES = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 16: "int", 18: "long", 19: "decimal"}


def type_name(kind: T.DataType | None) -> str:
    return next((name for cls, name in _NAMES if isinstance(kind, cls)), "null")


@operator("$type")
def _type(args, s):
    value = compile_expression(_only(args), s)
    return Typed(F.when(value.column.isNull(), "null").otherwise(type_name(s.type_of(value))), STRING)


@operator("$isNumber")
def _is_number(args, s):
    value = compile_expression(_only(args), s)
    return Typed(value.column.isNotNull() if isinstance(s.type_of(value), T.NumericType) else F.lit(False), BOOL)


@operator("$toBool")
def _to_bool(args, s):
    return Typed(truthy(compile_expression(_only(args), s), s), BOOL)


for _name, _kind in {"$toInt": INT, "$toLong": LONG, "$toDouble": DOUBLE, "$toDecimal": T.DecimalType(38, 18), "$toString": STRING}.items():
    unary(_name, lambda c, k=_kind: c.cast(k), _kind)


@operator("$toDate")
def _to_date(args, s):
    return Typed(_as_time(compile_expression(_only(args), s), s), T.TimestampType())


def _as_time(value: Typed, s: Scope) -> Column:
    kind = s.type_of(value)
    return F.timestamp_millis(value.column.cast("long")) if isinstance(kind, T.NumericType) else value.column.cast("timestamp")


@operator("$toObjectId")
def _to_object_id(args, s):
    c = column(_only(args), s)
    return Typed(F.when(c.isNull() | c.rlike("^[0-9a-fA-F]{24}$"), F.lower(c)).otherwise(F.raise_error(F.lit("not an object id"))), STRING)


@operator("$convert")
def _convert(args, s):
    value, to = compile_expression(args["input"], s), args["to"]
    to = CODES.get(to, to)
    if to not in _CASTS:
        raise PipelineError(f"$convert: unknown type {to}")
    if to == "bool":
        made = F.when(value.column.isNotNull(), truthy(value, s))
    elif to == "date":
        made = F.try_to_timestamp(value.column) if isinstance(s.type_of(value), T.StringType) and "onError" in args else _as_time(value, s)
    else:
        made = value.column.try_cast(_CASTS[to]) if "onError" in args else value.column.cast(_CASTS[to])
    if "onError" in args:
        made = F.when(value.column.isNotNull(), F.coalesce(made, column(args["onError"], s).cast(_CASTS[to])))
    return Typed(made, _CASTS[to])


# dates, all UTC
def _date_part(f: Callable[[Column], Column]):
    def build(args, s):
        value = args["date"] if isinstance(args, dict) and "date" in args else _only(args)
        return Typed(f(column(value, s)).cast("int"), INT)

    return build


_millis = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
OPERATORS |= {n: _date_part(f) for n, f in {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$millisecond": lambda c: F.pmod(F.floor(_millis(c)), F.lit(1000))}.items()}
#: Format letters and their Spark patterns.
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "j": "DDD"}


def date_pattern(text: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)", text):
        out += (_FORMATS.get(m[1]) or ("%" if m[1] == "%" else "")) if m[1] else re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2].replace("'", "''"))
    return out


@operator("$dateToString")
def _date_to_string(args, s):
    made = F.date_format(column(args["date"], s), date_pattern(args.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))
    return Typed(F.coalesce(made, column(args["onNull"], s)) if "onNull" in args else made, STRING)


@operator("$dateFromString")
def _date_from_string(args, s):
    text = column(args["dateString"], s)
    made = F.try_to_timestamp(text) if "onError" in args else text.cast("timestamp")
    if "onError" in args:
        made = F.when(text.isNotNull(), F.coalesce(made, column(args["onError"], s).cast("timestamp")))
    return Typed(F.coalesce(made, column(args["onNull"], s).cast("timestamp")) if "onNull" in args else made, T.TimestampType())


def _date_shift(sign: int):
    def build(args, s):
        value = compile_expression(args["startDate"], s)
        kind = s.type_of(value)
        made = F.timestamp_add(args["unit"].upper(), (column(args["amount"], s) * sign).cast("int"), value.column)
        return Typed(made, kind if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType())

    return build


OPERATORS |= {"$dateAdd": _date_shift(1), "$dateSubtract": _date_shift(-1)}
#: Milliseconds of a unit.
_UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


@operator("$dateDiff")
def _date_diff(args, s):
    a, b, unit = column(args["startDate"], s), column(args["endDate"], s), args["unit"]
    if unit in ("year", "quarter", "month"):
        years = F.year(b) - F.year(a)
        return Typed({"year": years, "quarter": 4 * years + F.quarter(b) - F.quarter(a), "month": 12 * years + F.month(b) - F.month(a)}[unit].cast("long"), LONG)
    elapsed = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return Typed((elapsed / (1000 * _UNIT_MS[unit])).cast("long"), LONG)


# documents and the rest
@operator("$mergeObjects")
def _merge_objects(args, s):
    parts = [compile_expression(x, s) for x in _list(args)]
    kinds = [s.type_of(p) for p in parts]
    if all(isinstance(k, T.MapType) for k in kinds):
        empty = F.create_map().cast(kinds[0])
        merged = reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b), [F.coalesce(p.column, empty) for p in parts])
        return Typed(merged, kinds[0])
    fields: dict[str, list[Typed]] = {}
    for p, k in zip(parts, kinds, strict=True):
        for f in k.fields if isinstance(k, T.StructType) else ():
            fields.setdefault(f.name, []).insert(0, Typed(p.column.getField(f.name), f.dataType))
    made = F.struct(*[F.coalesce(*[v.column for v in vs]).alias(n) for n, vs in fields.items()])
    return Typed(made, T.StructType([T.StructField(n, vs[0].type) for n, vs in fields.items()]))


@operator("$getField")
def _get_field(args, s):
    name, value = (args["field"], compile_expression(args.get("input", "$$CURRENT"), s)) if isinstance(args, dict) else (args, s.document())
    return walk(Typed(value.column, s.type_of(value)), [name])


@operator("$setField")
def _set_field(args, s):
    value, new = compile_expression(args["input"], s), compile_expression(args["value"], s)
    return Typed(value.column.withField(args["field"], new.column))


@operator("$literal")
def _literal(args, s):
    return literal(args)


@operator("$let")
def _let(args, s):
    return compile_expression(args["in"], s.having(**{k: compile_expression(v, s) for k, v in args["vars"].items()}))


unary("$binarySize", F.octet_length, INT)
unary("$toHashedIndexKey", F.xxhash64, LONG)
OPERATORS["$tsSecond"] = lambda args, s: Typed(column(_only(args), s).getField("t").cast("long"), LONG)
OPERATORS["$tsIncrement"] = lambda args, s: Typed(column(_only(args), s).getField("i").cast("long"), LONG)


def _stored_size(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value in the documented binary layout: fixed widths, strings with length and end, documents and arrays with one header a field."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [F.when(c.getField(f.name).isNull(), F.lit(2 + len(f.name.encode()))).otherwise(2 + len(f.name.encode()) + _stored_size(c.getField(f.name), f.dataType)) for f in kind.fields], F.lit(5))
    if isinstance(kind, T.ArrayType):
        sizes = F.transform(c, lambda x, i: F.length(i.cast("string")) + 2 + F.coalesce(_stored_size(x, kind.elementType), F.lit(0)))
        return F.aggregate(sizes, F.lit(5), lambda a, x: a + x)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c) + 5
    widths = {T.BooleanType: 1, T.IntegerType: 4, T.DecimalType: 16}
    return F.lit(widths.get(type(kind), 8))


@operator("$bsonSize")
def _bson_size(args, s):
    value = compile_expression(_only(args), s)
    return Typed(F.when(value.column.isNotNull(), _stored_size(value.column, s.type_of(value)).cast("int")), INT)


@operator("$function")
def _function(args, s):
    known = udfs.function(args["body"])
    return Typed(F.pandas_udf(known.call, known.returns)(*[column(x, s) for x in args.get("args", [])]))


# cheap supersets: set operators
binary("$setIntersection", F.array_intersect, None)
binary("$setDifference", F.array_except, None)
binary("$setUnion", F.array_union, None)
