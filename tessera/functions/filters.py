"""Filter documents as boolean Columns. Filters have two values: a comparison with null or a missing field is false.

Bare comparisons stand at the top level, where null rejects a row anyway, so that they are pushed down to the files;
under $or, $nor and $not every leaf is made false where it is null.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, udfs
from tessera.functions.expressions import CODES, compile_expression, literal, regex_of, truthy, type_name
from tessera.functions.scope import PipelineError, Scope, Typed, exists, path


def compile_filter(spec: dict, s: Scope, bare: bool = True) -> Column:
    parts = [_clause(k, v, s, bare) for k, v in spec.items()]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _clause(key: str, value: Any, s: Scope, bare: bool) -> Column:
    if key == "$and":
        return reduce(lambda a, b: a & b, [compile_filter(v, s, bare) for v in value])
    if key == "$or":
        return reduce(lambda a, b: a | b, [compile_filter(v, s, False) for v in value])
    if key == "$nor":
        return ~reduce(lambda a, b: a | b, [compile_filter(v, s, False) for v in value])
    if key == "$expr":
        return truthy(compile_expression(value, s), s)
    if key == "$jsonSchema":
        return _sure(json_schema(value, s.document()))
    if key == "$text":
        return _sure(text_match(value, s))
    if key == "$where":
        known = udfs.function(value)
        return _sure(F.pandas_udf(known.call, known.returns)(s.document().column))
    if key in ("$comment",):
        return F.lit(True)
    if key.startswith("$"):
        raise PipelineError(f"unknown top level operator {key}")
    if isinstance(value, dict) and value and next(iter(value)).startswith("$"):
        found = [_leaf(path(key, s), op, arg, s, key, value) for op, arg in value.items() if op not in ("$options", "$maxDistance", "$minDistance")]
        made = reduce(lambda a, b: a & b, found)
    else:
        made = _leaf(path(key, s), "$regex" if isinstance(value, re.Pattern) else "$eq", value, s, key, {})
    return made if bare else _sure(made)


def _equal(value: Typed, to: Any) -> Column:
    """Null equals null and missing; an array equals the value as a whole or by one of its elements."""
    if to is None:
        return value.column.isNull() if not isinstance(value.type, T.NullType) else F.lit(True)
    if isinstance(value.type, T.NullType):
        return F.lit(False)
    if isinstance(value.type, T.ArrayType) and not isinstance(to, (list, tuple)):
        return F.exists(value.column, lambda x: _sure(x == literal(to).column))
    return value.column == literal(to).column


def _positions(arg: Any) -> int:
    return sum(1 << p for p in arg) if isinstance(arg, (list, tuple)) else int(arg)


def _leaf(value: Typed, op: str, arg: Any, s: Scope, name: str, siblings: dict) -> Column:
    c, kind = value.column, value.type
    missing = isinstance(kind, T.NullType)
    if op == "$eq":
        return _equal(value, arg)
    if op == "$ne":
        return ~_sure(_equal(value, arg))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if missing:
            return F.lit(False)
        other = literal(arg).column
        return {"$gt": c > other, "$gte": c >= other, "$lt": c < other, "$lte": c <= other}[op]
    if op in ("$in", "$nin"):
        plain = [v for v in arg if v is not None and not isinstance(v, re.Pattern)]
        found = [_equal(value, None)] if None in arg else []
        if plain and not missing:
            found.append(F.exists(c, lambda x: _sure(x.isin(plain))) if isinstance(kind, T.ArrayType) else c.isin(plain))
        found += [c.rlike(regex_of(v)) for v in arg if isinstance(v, re.Pattern) and not missing]
        made = reduce(lambda a, b: a | b, [_sure(f) for f in found], F.lit(False)) if len(found) != 1 else found[0]
        return made if op == "$in" else ~_sure(made)
    if op == "$exists":
        there = c.isNotNull() if exists(name, s) or not missing else F.lit(False)
        return there if arg else ~there
    if op == "$type":
        wanted = {CODES.get(a, a) for a in (arg if isinstance(arg, (list, tuple)) else [arg])}
        have = type_name(kind)
        fits = have in wanted or ("number" in wanted and have in ("int", "long", "double", "decimal"))
        return (c.isNotNull() & F.lit(fits)) | (c.isNull() & F.lit("null" in wanted))
    if op == "$not":
        if isinstance(arg, re.Pattern):
            return ~_sure(_leaf(value, "$regex", arg, s, name, {}))
        return ~reduce(lambda a, b: a & b, [_sure(_leaf(value, o, v, s, name, arg)) for o, v in arg.items() if o != "$options"])
    if op == "$regex":
        pattern = regex_of(arg, siblings.get("$options", ""))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.exists(c, lambda x: _sure(x.rlike(pattern)))
        return c.rlike(pattern) if isinstance(kind, T.StringType) else F.lit(False)
    if op == "$all":
        return reduce(lambda a, b: a & b, [_sure(_equal(value, v)) for v in arg]) if isinstance(kind, T.ArrayType) and arg else F.lit(False)
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        if isinstance(kind.elementType, T.StructType) and not next(iter(arg)).startswith("$"):
            return F.exists(c, lambda x: compile_filter(arg, s.at(s.df, root=Typed(x, kind.elementType)), False))
        return F.exists(c, lambda x: reduce(lambda a, b: a & b, [_sure(_leaf(Typed(x, kind.elementType), o, v, s, name, arg)) for o, v in arg.items()]))
    if op == "$size":
        return (F.size(c) == int(arg)) if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$mod":
        divisor, remainder = arg
        return F.abs(c.cast("double") % float(divisor) - float(remainder)) < 1e-4 if isinstance(kind, T.NumericType) else F.lit(False)
    if op.startswith("$bits"):
        if not isinstance(kind, T.NumericType):
            return F.lit(False)
        mask = _positions(arg)
        got = c.cast("long").bitwiseAND(F.lit(mask).cast("long"))
        return {"$bitsAllSet": got == mask, "$bitsAllClear": got == 0, "$bitsAnySet": got != 0, "$bitsAnyClear": got != mask}[op]
    if op == "$geoWithin":
        return geo.within(name, arg, s)
    if op == "$geoIntersects":
        return geo.intersects(name, arg, s)
    if op in ("$near", "$nearSphere"):
        return geo.near(name, arg, s, siblings)
    raise PipelineError(f"unknown operator {op}")


def _strings(value: Typed) -> list[Column]:
    """All strings of a document, nested ones and arrays too; fields that begin with _ aren't searched."""
    if isinstance(value.type, T.StringType):
        return [value.column]
    if isinstance(value.type, T.ArrayType) and isinstance(value.type.elementType, T.StringType):
        return [F.array_join(value.column, "\n")]
    if isinstance(value.type, T.StructType):
        return [c for f in value.type.fields if not f.name.startswith("_") for c in _strings(Typed(value.column.getField(f.name), f.dataType))]
    return []


def _terms(search: str) -> tuple[list[str], list[str], list[str]]:
    """(terms, phrases, negated terms) of a search string."""
    phrases = re.findall(r'"([^"]+)"', search)
    words = re.sub(r'"[^"]*"', " ", search).split()
    return [w for w in words if not w.startswith("-")], phrases, [w[1:] for w in words if w.startswith("-") and len(w) > 1]


def _searched(spec: dict, s: Scope) -> tuple[Column, Any]:
    fold = (lambda x: x) if spec.get("$caseSensitive") else str.lower
    text = F.concat_ws("\n", *[c for n in s.names if not n.startswith("_") for c in _strings(path(n, s))])
    return (text if spec.get("$caseSensitive") else F.lower(text)), fold


def text_match(spec: dict, s: Scope) -> Column:
    """Substring search: any term, all phrases, no negated term."""
    text, fold = _searched(spec, s)
    terms, phrases, negated = _terms(spec["$search"])
    keep = reduce(lambda a, b: a | b, [text.contains(fold(t)) for t in terms]) if terms else F.lit(bool(phrases or negated))
    for p in phrases:
        keep = keep & text.contains(fold(p))
    for n in negated:
        keep = keep & ~text.contains(fold(n))
    return keep


def text_score(spec: dict, s: Scope) -> Column:
    """1 for each occurrence of a term, 5 for each phrase that occurs."""
    text, fold = _searched(spec, s)
    terms, phrases, _ = _terms(spec["$search"])
    score = F.lit(0.0)
    for t in terms:
        score = score + (F.length(text) - F.length(F.replace(text, F.lit(fold(t)), F.lit("")))) / len(t)
    for p in phrases:
        score = score + F.when(text.contains(fold(p)), 5.0).otherwise(0.0)
    return score


def _of_type(names: Any, kind: T.DataType) -> bool:
    have = type_name(kind)
    return any(n == have or (n in ("number",) and have in ("int", "long", "double", "decimal")) or (n == "boolean" and have == "bool") or (n == "integer" and have in ("int", "long")) for n in (names if isinstance(names, list) else [names]))


def json_schema(spec: dict, doc: Typed) -> Column:
    """Whether a document fits: what its type settles is settled here, the rest becomes conditions."""
    kind = doc.type if isinstance(doc.type, T.StructType) else T.StructType([])
    value = lambda n: Typed(doc.column.getField(n), kind[n].dataType) if n in kind.names else Typed(F.lit(None), T.NullType())
    keep = F.lit(True)
    for name in spec.get("required", []):
        keep = keep & value(name).column.isNotNull()
    for name, rule in spec.get("properties", {}).items():
        if name in kind.names:
            keep = keep & (value(name).column.isNull() | _sure(_property(rule, value(name))))
    if spec.get("additionalProperties") is False:
        for name in kind.names:
            if name not in spec.get("properties", {}) and name != "_id":
                keep = keep & value(name).column.isNull()
    present = reduce(lambda a, b: a + b, [value(n).column.isNotNull().cast("int") for n in kind.names], F.lit(0))
    if "minProperties" in spec:
        keep = keep & (present >= spec["minProperties"])
    if "maxProperties" in spec:
        keep = keep & (present <= spec["maxProperties"])
    return keep


def _property(rule: dict, value: Typed) -> Column:
    c, kind = value.column, value.type
    names = rule.get("bsonType", rule.get("type"))
    keep = F.lit(names is None or _of_type(names, kind))
    if "enum" in rule:
        keep = keep & c.isin([v for v in rule["enum"] if v is not None])
    if isinstance(kind, T.NumericType):
        low, high = rule.get("exclusiveMinimum"), rule.get("exclusiveMaximum")
        if "minimum" in rule:
            keep = keep & (c > rule["minimum"] if low is True else c >= rule["minimum"])
        if "maximum" in rule:
            keep = keep & (c < rule["maximum"] if high is True else c <= rule["maximum"])
        if low is not None and low is not True and low is not False:
            keep = keep & (c > low)
        if high is not None and high is not True and high is not False:
            keep = keep & (c < high)
    if isinstance(kind, T.StringType):
        if "minLength" in rule:
            keep = keep & (F.length(c) >= rule["minLength"])
        if "maxLength" in rule:
            keep = keep & (F.length(c) <= rule["maxLength"])
        if "pattern" in rule:
            keep = keep & c.rlike(rule["pattern"])
    if isinstance(kind, T.ArrayType):
        if "minItems" in rule:
            keep = keep & (F.size(c) >= rule["minItems"])
        if "maxItems" in rule:
            keep = keep & (F.size(c) <= rule["maxItems"])
        if rule.get("uniqueItems"):
            keep = keep & (F.size(F.array_distinct(c)) == F.size(c))
        if "items" in rule:
            keep = keep & F.forall(c, lambda x: x.isNull() | _sure(_property(rule["items"], Typed(x, kind.elementType))))
    if isinstance(kind, T.StructType) and ({"properties", "required"} & set(rule)):
        keep = keep & json_schema(rule, value)
    return keep
