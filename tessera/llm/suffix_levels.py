"""Substring dedup with logarithmic families of sparse suffix arrays.

A byte goes if some 200-byte string that covers it also starts anywhere else. Each start belongs to an anchor: the leftmost smallest
hash among the 64-byte strings that begin in its first 137 places. Equal 200-byte strings have equal anchors, so sampling
the suffixes at anchors (about one in 69) loses no match. Consecutive starts with one anchor are a segment,
of 137 starts at most.

1.  Tasks sort the anchors of each batch of documents. Those that repeat inside are known at once; the others, and one witness for
    each repeated one, go to shards by anchor. A shard keeps sorted levels: a new batch is merge-scanned against every
    level, and levels of equal size merge.
2.  Segments with a repeated anchor whose whole text repeats (told by two hashes of 64 bits) are removed as a whole. The others, at the edges of matches, are
    fetched with one copy of each repeated segment of their anchor. A shard makes an array of the suffixes at all their starts, sorted by
    their first 200 bytes (by a hash of them; equal neighbours are compared byte by byte), and again scans it against its levels and
    merges equal ones.
3.  The repeated starts return to their documents, where the bytes they cover are cut out. Texts travel compressed.

Anchors with very many different segments are compared by hashes of their 200-byte strings instead, which spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

U = np.uint64
LENGTH, GRAM = 200, 64
PLACES = LENGTH - GRAM + 1
#: Bits of a position; the others of a hash decide which one is smallest, and the leftmost of equal ones does.
POSITION = U(31)
#: Bytes of text whose anchors are found at once (longer texts come in overlapping pieces), and segments in the array of a new batch.
TEXT_BYTES, ARRAY_ROWS = 500_000, 4_000
#: Bytes of segments that a shard takes on average, and different segments of one anchor at most.
SHARD_BYTES, SHARD_SEGMENTS = 8_000_000, 2_000

_GRAM_BYTES, _SEGMENT_BYTES = (np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) for k in (64, 200))
_GRAM_BASE, _SEGMENT_BASE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prefix_hash(data: np.ndarray, values: np.ndarray, base: int):
    """A function (starts, ends) -> hash of each slice, by prefix sums of a polynomial modulo 2**64."""
    n = len(data) + 1
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = tuple(np.concatenate(([U(1)], np.cumprod(np.full(n, b, U)))) for b in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    sums = np.concatenate(([U(0)], np.cumsum(values[data] * up[: n - 1])))

    def of(starts, ends) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * down[starts]
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(32))

    return of


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of all texts: anchor h, XXH3 hash c of the text of the segment (all bytes of its starts' strings), text number, first start, starts."""
    import xxhash

    none = {k: np.empty(0, np.int64) for k in ("h", "c", "text", "at", "n")}
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return none
    begin = np.cumsum(lengths) - lengths
    grams = _prefix_hash(data, _GRAM_BYTES, _GRAM_BASE)(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
    low = grams >> POSITION << POSITION | np.arange(len(grams), dtype=U)
    width = 1
    while 2 * width <= PLACES:  # minima of windows of doubling width
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (PLACES - width)], low[PLACES - width :])
    text = np.repeat(np.arange(len(texts)), np.maximum(lengths - LENGTH + 1, 0))
    count = np.maximum(lengths - LENGTH + 1, 0)
    if not len(text):
        return none
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[text] + place
    anchor = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    body, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    c = np.array([digest(body[a:b]) for a, b in zip(at[first].tolist(), (at[first] + run + LENGTH - 1).tolist(), strict=True)], U)
    h = grams[(anchor[first] & ((U(1) << POSITION) - U(1))).astype(np.int64)]
    return {"h": h.view(np.int64), "c": c.view(np.int64), "text": text[first], "at": place[first], "n": run}


class Levels:
    """A logarithmic family: items in sorted levels whose sizes about double, each with a mark for "found elsewhere"."""

    def __init__(self, scan, merge, size):
        self.scan, self.merge, self.size, self.levels = scan, merge, size, []

    def add(self, batch) -> None:
        """Scan a new batch against every level (both sides get marks), then merge levels of equal size."""
        for level in self.levels:
            self.scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and self.size(self.levels[-1]) * 2 > self.size(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(a, b))


def sorted_anchors(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.argsort(columns["h"], kind="stable")
    out = {k: v[order] for k, v in columns.items()}
    same = out["h"][1:] == out["h"][:-1]
    out["hit"] = out["hit"].copy()
    out["hit"][1:] |= same
    out["hit"][:-1] |= same
    return out


def scan_anchors(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> None:
    for x, y in ((a, b), (b, a)):
        if len(x["h"]) and len(y["h"]):
            place = np.minimum(np.searchsorted(y["h"], x["h"]), len(y["h"]) - 1)
            x["hit"] |= y["h"][place] == x["h"]


def anchor_levels() -> Levels:
    return Levels(scan_anchors, lambda a, b: sorted_anchors({k: np.concatenate((a[k], b[k])) for k in a}), lambda x: len(x["h"]))


class Segments:
    """Suffixes at the starts of some segments, sorted by a hash of their first LENGTH bytes; ``hit`` marks those found elsewhere."""

    def __init__(self, data: np.ndarray, rows: dict[str, np.ndarray], begin: np.ndarray, keys: np.ndarray, place: np.ndarray, hit: np.ndarray):
        self.data, self.rows, self.begin, self.keys, self.place, self.hit = data, rows, begin, keys, place, hit

    @classmethod
    def of(cls, data: np.ndarray, rows: dict[str, np.ndarray]) -> Segments:
        """``data``: the segments' bytes, n + LENGTH - 1 each, one after another; ``rows``: key, tag, at, n and asks of each."""
        n = rows["n"].astype(np.int64)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = _prefix_hash(data, _SEGMENT_BYTES, _SEGMENT_BASE)(place, place + LENGTH)
        order = np.argsort(keys, kind="stable")
        made = cls(data, rows, begin, keys[order], place[order], np.zeros(len(order), bool))
        equal = np.flatnonzero(made.keys[1:] == made.keys[:-1])
        equal = equal[_same_bytes(data, made.place[equal], data, made.place[equal + 1])]
        made.hit[equal] = made.hit[equal + 1] = True
        return made

    def scan(self, other: Segments) -> None:
        if len(self.keys) and len(other.keys):
            at = np.minimum(np.searchsorted(other.keys, self.keys), len(other.keys) - 1)
            equal = np.flatnonzero(other.keys[at] == self.keys)
            equal = equal[_same_bytes(self.data, self.place[equal], other.data, other.place[at[equal]])]
            self.hit[equal] = other.hit[at[equal]] = True

    def merge(self, other: Segments) -> Segments:
        keys = np.concatenate((self.keys, other.keys))
        order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
        return Segments(
            np.concatenate((self.data, other.data)), {k: np.concatenate((v, other.rows[k])) for k, v in self.rows.items()}, np.concatenate((self.begin, other.begin + len(self.data))),
            keys[order], np.concatenate((self.place, other.place + len(self.data)))[order], np.concatenate((self.hit, other.hit))[order],
        )

    def runs(self) -> pa.RecordBatch:
        """(key, tag, first, end) of the runs of marked starts of the segments that ask."""
        place = np.sort(self.place[self.hit])
        row = np.searchsorted(self.begin, place, "right") - 1
        asked = self.rows["asks"][row].astype(bool)
        place, row = place[asked], row[asked]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(place)))
        start = (self.rows["at"][row[first]] + place[first] - self.begin[row[first]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.rows["key"][row[first]]), pa.array(self.rows["tag"][row[first]]), pa.array(start), pa.array((start + length).astype(np.int32))], ["key", "tag", "first", "end"])


def _same_bytes(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes of ``a`` at each i equal those of ``b`` at the same j."""
    same = np.ones(len(i), bool)
    for at in range(0, len(i), 20_000):
        x, y = (np.lib.stride_tricks.sliding_window_view(d, LENGTH)[k[at : at + 20_000]] for d, k in ((a, i), (b, j)))
        same[at : at + 20_000] = (x == y).all(axis=1)
    return same


def segment_levels() -> Levels:
    return Levels(lambda a, b: a.scan(b), lambda a, b: a.merge(b), lambda x: len(x.data))


#: key: doc_id, or a hash of the text where that is null; tag: a hash of the text, which tells rows with one doc_id apart.
ANCHORS = "h bigint, c bigint, key bigint, tag int, at int, n int, copies int"
_COLUMNS = (("h", "i8"), ("c", "i8"), ("key", "i8"), ("tag", "i4"), ("at", "i4"), ("n", "i4"), ("copies", "i4"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.hash("text", F.lit("tag")).alias("tag"), "text")


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text number, first start, bytes): texts whole, or cut so that every start is in one piece with its whole string."""
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), TEXT_BYTES):
            yield i, at, text[at : at + TEXT_BYTES + LENGTH - 1]


def _anchors(docs: DataFrame, alone: bool) -> DataFrame:
    """Segments of the documents whose anchor is alone in its batch, with a witness (n = 0) for each other one; or else the others.

    copies pre-aggregates a batch: of equal segments the first has their number and the others 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, key, tag = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, held, size = [], [], 0
            for piece in [*_pieces(texts), None]:
                if held and (piece is None or size + len(piece[2]) > TEXT_BYTES):
                    part = segments([p[2] for p in held])
                    where = np.array([p[:2] for p in held], np.int64)
                    parts.append(part | {"text": where[part["text"], 0], "at": part["at"] + where[part["text"], 1]})
                    held, size = [], 0
                if piece is not None:
                    held.append(piece)
                    size += len(piece[2])
            s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else segments([])
            s |= {"key": key[s["text"]], "tag": tag[s["text"]]}
            _, first, inverse, counts = np.unique(s["h"], return_index=True, return_inverse=True, return_counts=True)
            single = counts[inverse] == 1
            order = np.lexsort((s["c"], s["h"]))
            new = np.ones(len(order), bool)
            new[1:] = (s["h"][order[1:]] != s["h"][order[:-1]]) | (s["c"][order[1:]] != s["c"][order[:-1]])
            leads = np.flatnonzero(new)
            s["copies"] = np.zeros(len(order), np.int64)
            s["copies"][order[leads]] = np.diff(np.append(leads, len(order)))
            take = np.flatnonzero(single if alone else ~single)
            if alone:
                witness = first[counts > 1]
                s["n"] = s["n"].copy()
                s["n"][witness] = 0
                take = np.concatenate((take, witness))
            yield pa.RecordBatch.from_arrays([pa.array(s[k][take].astype(t)) for k, t in _COLUMNS], [k for k, _ in _COLUMNS])

    return docs.select("key", "tag", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(work, ANCHORS)


def _repeated(anchors: DataFrame) -> DataFrame:
    """Rows of ``anchors``, dealt by h, whose h another row has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = anchor_levels()
        for batch in batches:
            columns = {f.name: batch.column(k).to_numpy() for k, f in enumerate(batch.schema)}
            family.add(sorted_anchors(columns | {"hit": columns["n"] == 0}))
        for level in family.levels:
            take = level["hit"] & (level["n"] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(level[k][take]) for k, _ in _COLUMNS], [k for k, _ in _COLUMNS])

    return anchors.repartition(F.col("h")).mapInArrow(work, ANCHORS)


RUNS = "key bigint, tag int, first int, end int"


def _edge_runs(rows: DataFrame, shards: int) -> DataFrame:
    """(key, tag, first, end): runs of repeated starts of the segments that ask, from rows dealt by h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = segment_levels()
        for batch in batches:
            for at in range(0, batch.num_rows, ARRAY_ROWS):
                part = batch.slice(at, ARRAY_ROWS)
                body = b"".join(part.column(5).to_pylist())
                names = ("key", "tag", "at", "n", "asks")
                family.add(Segments.of(np.frombuffer(body, np.uint8), {k: part.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}))
        for level in family.levels:
            yield level.runs()

    return rows.select("h", "key", "tag", "at", "n", "asks", "body").repartition(shards, F.col("h")).drop("h").mapInArrow(work, RUNS)


def _spread_runs(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: their strings meet by hash, wherever they are."""
    each = rows.select("h", "key", "tag", "at", "asks", "body", F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    string = F.substring("body", F.col("o") + 1, F.lit(LENGTH))
    each = each.select("h", F.xxhash64(string).alias("x"), F.xxhash64(string, F.lit(1)).alias("y"), "key", "tag", (F.col("at") + F.col("o")).alias("first"), "asks")
    twice = each.groupBy("h", "x", "y").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "x", "y")
    return each.where("asks").join(twice, ["h", "x", "y"]).select("key", "tag", "first", (F.col("first") + 1).alias("end"))


def repeated_starts(keyed: DataFrame) -> DataFrame:
    """(key, tag, first, end): runs of starts of LENGTH-byte strings that start anywhere else too."""
    flagged = written(_repeated(_anchors(keyed, True)).unionByName(_anchors(keyed, False)), "segments")
    kinds = flagged.where("copies > 0").groupBy("h", "c").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "tag", "at", "n")).alias("one"))
    kinds = written(kinds, "kinds")
    joined = flagged.where("copies = 1").join(kinds.where("copies > 1").select("h", "c"), ["h", "c"])
    whole = flagged.where("copies != 1").unionByName(joined).select("key", "tag", F.col("at").alias("first"), (F.col("at") + F.col("n")).alias("end"))
    asking = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least")).where("least = 1 and kinds > 1").select("h", "kinds")
    needed = kinds.join(asking, "h").select("h", "kinds", "one.*", (F.col("copies") == 1).alias("asks"))
    by_text = needed.groupBy("key", "tag").agg(F.collect_list(F.struct("h", "kinds", "at", "n", "asks")).alias("need"))
    fetched = _fetched(_packed(keyed).join(by_text, ["key", "tag"]).select("key", "tag", "packed", "need"))
    fetched = written(fetched, "edges")
    size = needed.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    near = _edge_runs(fetched.where(F.col("kinds") <= SHARD_SEGMENTS), -(-size // SHARD_BYTES) or 1)
    return whole.unionByName(near).unionByName(_spread_runs(fetched.where(F.col("kinds") > SHARD_SEGMENTS)))


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed for a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(t.as_buffer()) for t in batch.column(3).cast(pa.binary())], pa.binary())], ["doc_id", "key", "tag", "packed"])

    return keyed.mapInArrow(work, "doc_id bigint, key bigint, tag int, packed binary")


def _fetched(rows: DataFrame) -> DataFrame:
    """The bytes of the needed segments of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = ("h", "kinds", "key", "tag", "at", "n", "asks", "body")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for key, tag, packed, need in zip(*(batch.column(k).slice(at, 200).to_pylist() for k in range(4)), strict=True):
                    text = unpack(packed)
                    out += [(x["h"], x["kinds"], key, tag, x["at"], x["n"], x["asks"], text[x["at"] : x["at"] + x["n"] + LENGTH - 1]) for x in need]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 8, types, strict=True)], list(names))

    return rows.mapInArrow(work, "h bigint, kinds bigint, key bigint, tag int, at int, n int, asks boolean, body binary")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``: spans array of (start, end) in bytes, kept the remaining bytes.

    All documents count, and each repeated row as one more; null texts count as empty, texts under LENGTH bytes keep all. Removal is judged on
    the input, so all occurrences of a string go, the first one too. What is kept may end inside a UTF-8 character. Other columns are not read.
    """
    keyed = _keyed(docs)
    runs = repeated_starts(keyed).groupBy("key", "tag").agg(F.collect_set(F.struct("first", "end")).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for packed, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = unpack(packed)
                own: list[list[int]] = []
                for first, end in sorted((r["first"], r["end"] + LENGTH - 1) for r in runs or ()):
                    if own and first <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([first, end])
                n_bytes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)], strict=True)))
            types = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((n_bytes, spans, kept), types, strict=True))], ["doc_id", "n_bytes", "spans", "kept"])

    joined = _packed(keyed).join(runs, ["key", "tag"], "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(work, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``drop_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return drop_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
