"""Benchmark decontamination: a broadcast hash set of benchmark windows scanned over the documents' words.

Words and windows are hashed for a whole Arrow batch at once with numpy (prefix sums of a polynomial, so every
window's hash is one subtraction). A window found in the set is verified word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text for one broadcast set, of about five times that size; a larger benchmark is scanned for in several sets.
SET_BYTES = 64_000_000
#: Bytes of document text that are scanned at once, but never less than a whole document.
SCAN_BYTES = 4_000_000

U = np.uint64
#: A bitmap by the first 20 bits of a hash turns most windows away before the search.
SLOT = U(44)
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MIX = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.concatenate(([U(1)], np.cumprod(np.full(n - 1, self.base, U))))
            self.down = np.concatenate(([U(1)], np.cumprod(np.full(n - 1, pow(self.base, -1, 1 << 64), U))))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_ODD), _Powers(_STEP)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Words:
    """Words of several texts: hash, text, first and last byte of each."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray):
        self.low = _LOWER[data]
        word = _IS_WORD[self.low]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = word
        starts_text = np.zeros(len(data) + 1, bool)
        starts_text[text_starts] = True
        first = word & ((inside[:-2] == 0) | starts_text[:-1])
        last = word & ((inside[2:] == 0) | starts_text[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(text_starts, self.start, "right") - 1
        up, down = _BYTES.get(len(data) + 1)
        sums = np.concatenate(([U(0)], np.cumsum(_MIX[self.low] * up[: len(data)])))
        self.hash = _spread((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, and whether they are of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, bool)
        up, down = _WORDS.get(len(self.hash) + 1)
        sums = np.concatenate(([U(0)], np.cumsum(self.hash * up[: len(self.hash)])))
        return _spread((sums[k:] - sums[:-k]) * down[:n]), self.text[:n] == self.text[k - 1 :]

    def key(self, at: int, k: int) -> bytes:
        """The k words from word ``at`` on, for verifying."""
        base = int(self.start[at])
        raw = self.low[base : self.end[at + k - 1]].tobytes()
        return b" ".join(raw[s - base : e - base] for s, e in zip(self.start[at : at + k].tolist(), self.end[at : at + k].tolist(), strict=True))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1].astype(np.int64)


class Windows:
    """The windows of k words of benchmark items, in the order of their hashes: arrays, and the items' words as one text.

    Window i is ``text[start[i] : end[i]]`` of item ``item[i]``; equal windows of several items stand next to each other. ``seen`` has the
    first bits of all hashes.
    """

    def __init__(self, hashes: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray, text: bytes):
        order = np.lexsort((start, hashes))
        self.hashes, self.item, self.start, self.end, self.text = hashes[order], item[order], start[order], end[order], text
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> SLOT).astype(np.int64)] = True

    def items_of(self, h: int, key: bytes) -> set[int]:
        """Numbers of the items that have the window ``key``, whose hash is ``h``."""
        lo, hi = np.searchsorted(self.hashes, U(h), "left"), np.searchsorted(self.hashes, U(h), "right")
        return {int(self.item[i]) for i in range(lo, hi) if self.text[self.start[i] : self.end[i]] == key}


def window_set(items: list[tuple[str, bytes]]) -> tuple[list[str], dict[int, Windows]]:
    """(item ids, {words of a window: windows}). An item of fewer words than WINDOW, but not none, is one window."""
    found: dict[int, list[tuple]] = {}
    bodies, at = [], 0
    for number, (_, text) in enumerate(items):
        words = Words(*_joined([text]))
        k = min(WINDOW, len(words.hash))
        if k:
            hashes, _ = words.windows(k)
            body = words.key(0, len(words.hash))
            lengths = words.end - words.start
            starts = at + np.cumsum(lengths + 1) - (lengths + 1)
            n = len(hashes)
            found.setdefault(k, []).append((hashes, np.full(n, number, np.int32), starts[:n], starts[k - 1 :] + lengths[k - 1 :]))
            bodies.append(body)
            at += len(body) + 1
    text = b" ".join(bodies)
    return [i for i, _ in items], {k: Windows(*(np.concatenate(c) for c in zip(*parts, strict=True)), text) for k, parts in found.items()}


def scan(texts: list[bytes], sets: tuple[list[str], dict[int, Windows]]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """(words of each text, {text: (runs of hit words as (first, end), item ids)})."""
    words = Words(*_joined(texts)) if texts else None
    if words is None:
        return [], {}
    ids, windows = sets
    n_words = np.bincount(words.text, minlength=len(texts)).tolist()
    first_word = np.searchsorted(words.text, np.arange(len(texts)))
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for k, known in windows.items():
        at, one_text = words.windows(k)
        if not len(at):
            continue
        maybe = np.flatnonzero(known.seen[(at >> SLOT).astype(np.int64)] & one_text)
        place = np.minimum(np.searchsorted(known.hashes, at[maybe]), len(known.hashes) - 1)
        for i in maybe[known.hashes[place] == at[maybe]].tolist():
            hit = known.items_of(int(at[i]), words.key(i, k))
            if hit:
                t = int(words.text[i])
                runs, items = found.setdefault(t, ([], set()))
                runs.append((i - int(first_word[t]), i - int(first_word[t]) + k))
                items.update(ids[n] for n in hit)
    return n_words, {t: (union(runs), items) for t, (runs, items) in found.items()}


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = "doc_id bigint, n_words bigint, hits array<struct<first:bigint,end:bigint>>, items array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]


def _scan_rows(sets, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sets.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SCAN_BYTES):
                    size += len(texts[end])
                    end += 1
                n_words, found = scan(texts[at:end], value)
                rows = [found.get(i, ([], ())) for i in range(end - at)]
                hits = [[{"first": a, "end": b} for a, b in r] for r, _ in rows]
                cols = [batch.column(0).slice(at, end - at), pa.array(n_words, _TYPES[1]), pa.array(hits, _TYPES[2]), pa.array([sorted(i) for _, i in rows], _TYPES[3])]
                names = ["doc_id", "n_words", "hits", "items"]
                if with_text:
                    cols.append(batch.column(1).slice(at, end - at))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names)
                at = end

    return work


def _sets(benchmark: DataFrame):
    """(number of sets, function from a set's number to its broadcast): as many as keep each near SET_BYTES of text."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("item")).where("item is not null")
    n_sets = -(-(bench.agg(F.sum(F.octet_length("item"))).first()[0] or 0) // SET_BYTES) or 1

    def one(k: int):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(n_sets)) == k) if n_sets > 1 else bench
        return benchmark.sparkSession.sparkContext.broadcast(window_set([(r["item_id"], r["item"].encode()) for r in part.toLocalIterator()]))

    return n_sets, one


def find_contamination(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of ``docs``: runs of hit words (first, end) and the ids of the items hit.

    The benchmark's size is checked first. Up to SET_BYTES of text it is one broadcast set and the documents are
    scanned once, without a shuffle. A larger one is split by item into sets of about that size; the documents are scanned
    for each and the results are joined on (doc_id, hash of the text). Null or wordless items have no windows,
    null or wordless documents no hits. Repeated items count once for each item_id; a null item_id counts as the string
    "null". Each repeated document row gets its own row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_sets, one = _sets(benchmark)
    schema = SCHEMA + (", text string" if with_text else "")
    if n_sets == 1:
        return rows.mapInArrow(_scan_rows(one(0), with_text), schema)
    found = None
    for k in range(n_sets):
        # all rows of one doc_id and text get the same hits, so one of each is enough
        part = rows.mapInArrow(_scan_rows(one(k), True), SCHEMA + ", text string").where(F.size("items") > 0).select("doc_id", F.sha2("text", 256).alias("text_key"), "hits", "items")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("hits")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = docs.sparkSession.sparkContext.broadcast(([], {}))
    base = rows.mapInArrow(_scan_rows(empty, True), SCHEMA + ", text string").select("doc_id", "n_words", "text").withColumn("text_key", F.sha2("text", 256))
    joined = base.join(merged, base["doc_id"].eqNullSafe(merged["doc_id"]) & (base["text_key"] == merged["text_key"]), "left").select(base["doc_id"], "n_words", "runs", "items", "text")
    step = """aggregate(array_sort(runs), cast(array() as array<struct<first:bigint,end:bigint>>), (done, x) ->
        if(size(done) > 0 and x.first <= element_at(done, -1).end,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).first as first, greatest(x.end, element_at(done, -1).end) as end))),
           array_append(done, struct(x.first as first, x.end as end))))"""
    out = joined.select("doc_id", "n_words", F.expr(f"coalesce({step}, cast(array() as array<struct<first:bigint,end:bigint>>))").alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text")
    return out if with_text else out.drop("text")


def n_hit(hits: str = "hits"):
    return F.aggregate(F.col(hits), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def digest_items(ids: list[str]) -> str:
    return sha256(",".join(sorted(ids)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): the report of the contamination rule.

    A document is contaminated if a twentieth of its words or more, and at least one, is hit.
    """
    found = find_contamination(docs, benchmark).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, n_hit): the documents with the hit words removed, and the bytes between the words of a run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text and hits:
                    raw = text.encode()
                    words, kept, at = Words(*_joined([raw])), [], 0
                    for h in hits:
                        kept.append(raw[at : words.start[h["first"]]])
                        at = int(words.end[h["end"] - 1])
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3)], ["doc_id", "text", "n_hit"])

    found = find_contamination(docs, benchmark, with_text=True).select("doc_id", "text", "hits", n_hit().alias("n_hit"))
    return found.mapInArrow(cut, "doc_id bigint, text string, n_hit bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated documents. Same columns; the rules are those of ``contamination``."""
    n_sets, one = _sets(benchmark)
    if n_sets == 1:
        value, place = one(0), docs.columns.index("text")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for text in batch.column(place).cast(pa.string()).cast(pa.binary()):
                    n_words, found = scan([text.as_py() or b""], value.value)
                    n = sum(b - a for a, b in found[0][0]) if found else 0
                    keep.append(not n or 20 * n < n_words[0])
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(work, docs.schema)
    found = find_contamination(docs, benchmark, with_text=True).withColumn("n_hit", n_hit())
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("_dc_id"), F.sha2("text", 256).alias("_dc_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_dc_id")) & (F.sha2(F.col("text").cast("string"), 256) == F.col("_dc_text"))
    return docs.join(bad, same, "left_anti")
