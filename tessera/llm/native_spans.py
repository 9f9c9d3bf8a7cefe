"""Positions of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a chunk of an array: running sums and searches go chunk by chunk, so many matches in one text don't cost their square.
CHUNK = 256


def _running_sums(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """``df`` with the running sums (each element's own included) of int arrays as arrays of the names given."""
    df = df.select("*", *[F.expr(f"if(size({a}) = 0, cast(array() as array<array<int>>), transform(sequence(0, (size({a}) - 1) div {CHUNK}), c -> slice({a}, cast(c as int) * {CHUNK} + 1, {CHUNK})))").alias(f"_chunks_{n}") for n, a in arrays.items()])
    df = df.select("*", *[F.expr(f"aggregate(_chunks_{n}, array(0), (a, c) -> array_append(a, element_at(a, -1) + aggregate(c, 0, (s, x) -> s + x)))").alias(f"_bases_{n}") for n in arrays])
    inner = "flatten(transform(_chunks_{n}, (c, k) -> slice(aggregate(c, array(_bases_{n}[k]), (a, x) -> array_append(a, element_at(a, -1) + x)), 2, size(c))))"
    return df.select("*", *[F.expr(inner.format(n=n)).alias(n) for n in arrays]).drop(*[f"_{x}_{n}" for x in ("chunks", "bases") for n in arrays])


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with an array of (start, end, from, to, s) for each name of ``patterns``: leftmost non-overlapping matches.

    start and end are code points, from and to bytes, ends exclusive. They come from the lengths of the matches and of what splitting at
    them leaves. Each step is a projection of its own, so that no expression is evaluated twice. Texts must not be null, patterns must not
    match the empty string.
    """
    df = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_f_{k}") for k, p in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"_f_{k}") > 0, F.split(text, p, -1)).alias(f"_p_{k}") for k, p in patterns.items()])
    for kind, length in (("c", "length"), ("b", "octet_length")):
        df = df.select("*", *[F.expr(f"transform(_f_{k}, (f, i) -> {length}(_p_{k}[i]) + {length}(f))").alias(f"_l{kind}_{k}") for k in patterns])
    df = _running_sums(df, {f"_e{kind}_{k}": f"_l{kind}_{k}" for kind in "cb" for k in patterns})
    made = [F.expr(f"transform(_f_{k}, (f, i) -> struct(_ec_{k}[i] - length(f) as start, _ec_{k}[i] as end, _eb_{k}[i] - octet_length(f) as from, _eb_{k}[i] as to, f as s))").alias(k) for k in patterns]
    return df.select("*", *made).drop(*[f"_{x}_{k}" for x in ("f", "p", "lc", "lb", "ec", "eb") for k in patterns])


def with_blocks(df: DataFrame, spans: str, name: str) -> DataFrame:
    """``df`` with the spans in order of their start as chunks (lo, hi, items), for ``overlaps``."""
    df = df.withColumn(f"_sorted_{name}", F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"]))))
    chunks = f"""if(size(_sorted_{name}) = 0, cast(array() as array<struct<lo:int,hi:int,items:array<struct<start:int,end:int>>>>),
        transform(transform(sequence(0, (size(_sorted_{name}) - 1) div {CHUNK}), c -> slice(_sorted_{name}, cast(c as int) * {CHUNK} + 1, {CHUNK})),
            c -> struct(c[0].start as lo, aggregate(c, 0, (a, x) -> greatest(a, x.end)) as hi, c as items)))"""
    return df.withColumn(name, F.expr(chunks)).drop(f"_sorted_{name}")


def overlaps(blocks: str, x: str = "x") -> str:
    """SQL: whether the span ``x`` overlaps one of ``with_blocks``."""
    return f"exists({blocks}, c -> c.lo < {x}.end and {x}.start < c.hi and exists(c.items, b -> b.start < {x}.end and {x}.start < b.end))"


def digest(spans: str, order: str) -> str:
    """SQL of the text kind:start:end,... of an array of (start, rank, end, kind), sorted by ``order`` (two of its fields)."""
    first, second = order.split()
    return f"array_join(transform(array_sort(transform({spans}, x -> struct(x.{first} as a, x.{second} as b, x.end as end, x.kind as kind, x.start as start))), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
