"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition cuts its documents into pieces and packs them best-fit, longest first. Bins that are nearly full are
done. Underfull bins become items themselves: they carry their pieces along, move to fewer partitions and are packed
again, round by round, up a tree. Tokens are never shuffled, only the pieces' numbers of underfull bins are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: The ids of a document end with this one.
END = 2
#: Pieces that a task packs at once; more are packed in runs of so many.
RUN = 200_000
#: Underfull bins that a task gets on average: in the first round of merging, and at most in later ones.
FIRST, MERGE = 2_500, 20_000

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BINS = f"fill int, members array<{PIECE}>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(exact, fast): the tokenizer of the file, and an encoder with its vocabulary as ranks that gives the same ids.

    The second is several times as fast. Its ranks are the vocabulary itself, whose ids follow the order of the merges.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.loads(exact.to_str())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return exact, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, path: str) -> np.ndarray:
    exact, fast = _encoders(path)
    if len(text) < 1_000_000:
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: whole if they fit, else ``size`` each with a shorter first one."""
    from zlib import crc32

    first = len(ids) % size or min(size, len(ids))
    start, end, k = 0, first, 0
    while start < len(ids):
        yield k, start, end - start, crc32(ids[start:end].tobytes())
        start, end, k = end, end + size, k + 1


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins) by best fit, longest first; items of equal length stay in order."""
    order = np.argsort(-lengths, kind="stable")
    room: list[int] = []  # rooms that some bin has, ascending
    bins: dict[int, list[int]] = {}
    out, n = np.empty(len(lengths), np.int64), 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(room, length)
        if at < len(room):
            left = room[at]
            of = bins[left]
            k = of.pop()
            if not of:
                del bins[left], room[at]
        else:
            left, k, n = size, n, n + 1
        out[i] = k
        left -= length
        if left:
            if left not in bins:
                insort(room, left)
                bins[left] = []
            bins[left].append(k)
    return out, n


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _emit(fill: np.ndarray, members: pa.StructArray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), members)
    yield pa.RecordBatch.from_arrays([pa.array(fill.astype(np.int32)), lists], ["fill", "members"])


def _bins_of(groups: np.ndarray, n: int, sizes: np.ndarray, members: pa.StructArray, counts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Bins from items of ``counts`` members each, item i in bin groups[i]."""
    order = np.argsort(groups, kind="stable")
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    c = counts[order]
    take = np.repeat(starts[order] - np.concatenate(([0], np.cumsum(c)))[:-1], c) + np.arange(int(c.sum()))
    fill = np.bincount(groups, sizes, n).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(groups, counts, n)))).astype(np.int64)
    yield from _emit(fill, members.take(pa.array(take)), ends)


def local_bins(docs: DataFrame, path: str, size: int = 1024) -> DataFrame:
    """First round, in the tasks that read the documents: (fill, members) of each bin."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows, strict=True))
                rows.clear()
                members = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _MEMBER, strict=True)], fields=list(_MEMBER))
                lengths = np.array(cols[3], np.int64)
                groups, n = best_fit(lengths, size)
                yield from _bins_of(groups, n, lengths, members, np.ones(len(lengths), np.int64), size)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", path), np.uint32(END)).astype("<u4", copy=False)
                rows.extend((doc_id, *p) for p in pieces(ids, size))
                if len(rows) >= RUN:
                    yield from packed()
        yield from packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, BINS)


def merged_bins(bins: DataFrame, size: int = 1024) -> DataFrame:
    """A later round: each partition packs its underfull bins as items, or their pieces where those need fewer bins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def packed() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                fill = t.column(0).to_numpy().astype(np.int64)
                counts = np.diff(t.column(1).offsets.to_numpy())
                members = t.column(1).flatten()
                groups, k = best_fit(fill, size)
                lengths = members.field("length").to_numpy(zero_copy_only=False)
                apart, fewer = best_fit(lengths, size)
                if fewer < k:
                    fill, counts, groups, k = lengths, np.ones(len(lengths), np.int64), apart, fewer
                yield from _bins_of(groups, k, fill, members, counts, size)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column(1).flatten())
            if n >= RUN:
                yield from packed()
                n = 0
        yield from packed()

    return bins.mapInArrow(work, BINS)


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, full: float = 0.98, rounds: int = 6, fan: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of every document.

    A null text counts as empty: its document is the single id 2. Each row of a repeated document is packed. A
    document with a null doc_id is packed under it. Other columns are not read. ``path`` names the tokenizer's file. Bins of
    ``full`` x ``size`` ids or more are done after a round; the rest is merged on ``fan`` times fewer partitions, but
    on one for each MERGE bins at least, until a round joins less than a thousandth of them. A task holds RUN items at most.
    """
    path = path or default_tokenizer()
    bins = written(local_bins(docs, path, size), "bins")
    limit = int(full * size)
    done, left = bins.where(F.col("fill") >= limit), bins.where(F.col("fill") < limit)
    n = left.count()
    parts = -(-n // FIRST) * fan
    for r in range(rounds):
        if not n:
            break
        parts = max(-(-parts // fan), -(-n // MERGE))
        first = F.col("members")[0]
        now = written(merged_bins(left.repartition(parts, F.xxhash64(first["doc_id"], first["piece"], F.lit(r))), size), "bins")
        fresh, left = now.where(F.col("fill") >= limit), now.where(F.col("fill") < limit)
        done = done.unionByName(fresh)
        before, n = n, left.count()
        if parts == 1 or before - n - fresh.count() < before / 1000:
            break
    return placed(done.unionByName(left).withColumn("sequence_id", F.monotonically_increasing_id()))


def placed(bins: DataFrame) -> DataFrame:
    """A row for each member of each bin, with its offset: the lengths before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat, counts = lists.flatten(), np.diff(ends)
            length = flat.field("length").to_numpy(zero_copy_only=False)
            before = np.cumsum(length) - length
            base = np.repeat(before[(ends[:-1] - ends[0])[counts > 0]], counts[counts > 0])
            ids = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([*(flat.field(f.name) for f in _MEMBER), pa.array(ids), pa.array(before - base)], [*(f.name for f in _MEMBER), "sequence_id", "offset"])

    return bins.select("sequence_id", "members").mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
