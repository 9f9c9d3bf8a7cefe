"""Secret scans: three patterns, and sliding-window Shannon entropy per character class. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.native_spans import digest, overlaps, with_blocks, with_spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``access`` and ``hex`` with their least lengths inside: shorter maximal runs have no longer match within.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "entropy": r"[A-Za-z0-9+/_=-]{20,}"}
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window, and the least entropy in bits of a window that is a secret, by class of the candidate.
WINDOW = 20
LEAST = {"hex": 3.0, "base64": 3.75}
#: Candidates that are never secrets as a whole: UUIDs, dates and numbers with separators, words joined by separators.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]*$",
    r"^([A-Za-z]+|[0-9]{1,4})([+/_=-]([A-Za-z]+|[0-9]{1,4}))*$",
)
#: Nor is a part of high entropy that reads as a placeholder.
PLACEHOLDERS = "(?i)example|sample|placeholder|changeme|xxxx|0000000|1234567|abcdefg"


def _entropy_spans() -> str:
    """SQL: the parts of the candidates ``entropy`` whose windows reach their class's entropy, as (start, end, s).

    One pass over a candidate's characters keeps the counts of the current window and the sum of c log2 c over
    them, changed by the character that enters and the one that leaves; a window's entropy is log2(W) less the W-th part of it.
    The counts of all 128 characters are fields of 5 bits in eleven numbers, so a step adds to one of them and takes from one.
    """
    change = "(if({c} + 1 > 1, ({c} + 1) * log2({c} + 1), 0D) - if({c} > 1, {c} * log2({c}), 0D))"
    field = "(shiftright(a.counts[x.codes[{i}] div 12], cast(5 * (x.codes[{i}] % 12) as int)) & 31L)"
    one = "shiftleft(1L, cast(5 * (x.codes[{i}] % 12) as int))"
    into, out, gone = field.format(i="i"), field.format(i=f"i - {WINDOW}"), f"i - {WINDOW}"
    # the character that leaves goes first, then the other enters: their counts are looked up in turn
    left = f"if(i < {WINDOW}, a.total, a.total - {change.format(c='(' + out + ' - 1)')})"
    entered = f"({into} - if(i >= {WINDOW} and x.codes[i] = x.codes[{gone}], 1, 0))"
    total = f"({left} + {change.format(c=entered)})"
    high = f"(i >= {WINDOW - 1} and log2({WINDOW}D) - {total} / {WINDOW} >= x.least)"
    step = f"""struct(transform(a.counts, (c, k) -> c + if(k = x.codes[i] div 12, {one.format(i="i")}, 0L) - if(i >= {WINDOW}, if(k = x.codes[{gone}] div 12, {one.format(i=gone)}, 0L), 0L)) as counts,
        {total} as total, if({high} and a.lo < 0, i - {WINDOW - 1}, a.lo) as lo, if({high}, i + 1, a.hi) as hi)"""
    scan = f"""aggregate(sequence(0, size(x.codes) - 1), struct(array_repeat(0L, 11) as counts, 0D as total, -1 as lo, -1 as hi), (a, i) -> {step},
        a -> struct(x.start + a.lo as start, x.start + a.hi as end, a.lo as lo, substring(x.s, a.lo + 1, a.hi - a.lo) as s))"""
    return f"filter(transform(_candidates, x -> {scan}), x -> x.lo >= 0 and not x.s rlike '{PLACEHOLDERS}')"


def find_secrets(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, spans array of (start, rank, end, kind)) for every row of ``docs``; rank is the kind's place in KINDS. With the text if asked.

    Positions are code points, ends exclusive. ``entropy`` spans are added where a candidate run of 20 characters or more mixes letters
    and digits, isn't on the allow-list, overlaps no other span and has a window of enough entropy for its class (hex digits or
    base64) that isn't a placeholder itself. A null text counts as empty; a row with a null doc_id or a repeated row gets its own result. Other columns are not read.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    more = ["text"] if keep_text else []
    df = with_spans(df, "text", PATTERNS)
    group = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    typed = "cast({n} as int) as rank, x.end as end, '{k}' as kind"
    kept = [f"transform(filter(assign, x -> length(regexp_extract(x.s, '{group}', 2)) >= 6), x -> struct(x.start as start, {typed.format(n=0, k='assign')}))"]
    kept += [f"transform({k}, x -> struct(x.start as start, {typed.format(n=n, k=k)}))" for n, k in ((1, "access"), (2, "hex"))]
    df = df.select("doc_id", *more, "entropy", F.expr(f"concat({', '.join(kept)})").alias("base"))
    allowed = " or ".join(f"x.s rlike '{p}'" for p in (a.replace("\\", "\\\\") for a in ALLOWED))
    df = with_blocks(df, "base", "_blocks")
    free = f"filter(entropy, x -> not ({allowed}) and not {overlaps('_blocks')})"
    least = f"if(x.s rlike '^[0-9a-fA-F]+$', {LEAST['hex']}D, {LEAST['base64']}D)"
    df = df.select("doc_id", *more, "base", F.expr(f"transform({free}, x -> struct(x.start as start, x.s as s, transform(split(x.s, ''), c -> ascii(c)) as codes, {least} as least))").alias("_candidates"))
    df = df.select("doc_id", *more, "base", F.expr(f"transform({_entropy_spans()}, x -> struct(x.start as start, cast(3 as int) as rank, x.end as end, 'entropy' as kind))").alias("added"))
    return df.select("doc_id", *more, F.concat("base", "added").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy): counts and a digest of the spans of ``find_secrets``."""
    found = find_secrets(docs).withColumn("base", F.expr("filter(spans, x -> x.rank < 3)"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.rank = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts[:3], F.sha2(F.expr(digest("base", "start rank")), 256).alias("base_sha256"), F.expr(digest("spans", "start rank")).alias("spans"), counts[3])


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """(doc_id, text) with every span replaced by ``mark``, overlapping ones once. A null text becomes empty."""
    cut = f"""aggregate(array_sort(spans), struct('' as done, 0 as at), (a, x) -> if(x.start < a.at, struct(a.done as done, greatest(a.at, x.end) as at),
        struct(concat(a.done, substring(text, a.at + 1, x.start - a.at), '{mark}') as done, x.end as at)), a -> concat(a.done, substring(text, a.at + 1)))"""
    return find_secrets(docs, keep_text=True).select("doc_id", F.expr(cut).alias("text"))
