"""SimHash near-dedup with a bit-sliced comparison.

A fingerprint has 64 bits, one for each bit of the XXH64 (seed 42) of the word shingles that is set in over
half of them. Equal fingerprints are one class from the start. Two different ones within the radius must agree on
enough of ``blocks`` bit ranges (pigeonhole), so each class enters one bucket for each choice of ranges and
only buckets are compared. In a bucket the fingerprints stand vertically: plane i holds bit i of 64
fingerprints in one word, so that one XOR gives bit i of 64 distances, which carry-save counters sum. A unit of
64 x 64 comparisons is abandoned once all its distances exceed the radius.

For a similarity of word shingles instead of a radius, sketches have several words of 64 bits. Two documents meet where a band of
their bits is equal; the same comparison of the first word sorts out most pairs, all words make candidates of the rest. Candidates
come as components, within which all pairs are compared by their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import block_pairs, blocks
from tessera.llm.common import written
from tessera.llm.components import connected_components

#: Items of a block; two blocks are what a comparison holds at once.
BLOCK = 4096
#: Units of 64 x 64 comparisons at once.
UNITS = 512
_ODD = np.random.default_rng(64).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words of a UTF-8 text, of all words if they are fewer, of nothing if there are none."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, and 0x20 and 0x09 to 0x0D only
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, 42)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(words: np.ndarray) -> np.ndarray:
    """The bits that more than half of the rows have set, for rows of 64-bit words; 0 for no rows."""
    counts = np.zeros(64 * words.shape[1], np.int64)
    for at in range(0, len(words), 255):  # so many fit a byte
        part = np.ascontiguousarray(words[at : at + 255])
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(words), bitorder="little").view("<u8")


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned int; 0 for null and for a text without words."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def sketch(text: bytes | None, shingle: int, n_words: int) -> np.ndarray:
    """``n_words`` independent fingerprints of one set of shingles, each shingle counted once."""
    return sketch_of(np.unique(shingle_hashes(text, shingle)), n_words)


def sketch_of(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """The sketch of a set of shingle hashes."""
    h = hashes[:, None] * _ODD[:n_words]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return majority(h ^ (h >> np.uint64(29)))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def choose_ranges(n: int, radius: int, block: int = BLOCK) -> tuple[int, int]:
    """(ranges, to agree on): the fewest buckets to enter whose expected size for ``n`` fingerprints is within a block."""
    agree = 1
    while True:
        ranges = radius + agree
        if n / 2.0 ** (64 * agree // ranges) <= block or comb(ranges + 1, agree + 1) > 500:
            return ranges, agree
        agree += 1


def masks(ranges: int, agree: int) -> list[int]:
    """One signed 64-bit mask for each choice of ``agree`` of ``ranges`` bit ranges."""
    cuts = [64 * i // ranges for i in range(ranges + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    found = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _laid(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of values as rows of 64 lanes: (lane -> index of the value or -1, first row of each list, rows of each list)."""
    rows = (lengths + 63) // 64
    first = np.concatenate(([0], np.cumsum(rows)))[:-1]
    lanes = np.full(int(rows.sum()) * 64, -1, np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    lanes[np.repeat(first * 64 - starts, lengths) + np.arange(len(values))] = np.arange(len(values))
    return lanes.reshape(-1, 64), first, rows


def _planes(lanes: np.ndarray) -> np.ndarray:
    """Vertical bit planes: word [r, i] holds bit i of the 64 values of row r."""
    out = np.empty(lanes.shape, np.uint64)
    for at in range(0, len(lanes), 1024):
        part = np.ascontiguousarray(lanes[at : at + 1024])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
        out[at : at + 1024] = packed.view("<u8")[:, :, 0]
    return out


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """queries (u, 64) values against planes (u, 64): word [u, q] has bit l set if value l of unit u is within ``radius`` of query q.

    Distances of all lanes grow together in carry-save counters, as many bits as the radius has and one that stays once they are
    passed. Units whose lanes all exceed the radius are abandoned after every fourth plane.
    """
    out = np.zeros(queries.shape, np.uint64)
    alive = np.arange(len(queries))
    counters = [np.zeros(queries.shape, np.uint64) for _ in range(max(radius.bit_length(), 1))]
    over = np.zeros(queries.shape, np.uint64)
    for bit in range(64):
        asked = np.uint64(0) - ((queries >> np.uint64(bit)) & np.uint64(1))
        carry = planes[:, bit : bit + 1] ^ asked
        for k, counter in enumerate(counters):
            both = counter & carry
            counters[k] = counter ^ carry
            carry = both
        over |= carry
        if bit % 4 == 3 and bit >= 2 * radius + 3 or bit == 63:
            beyond, equal = over.copy(), ~over
            for k in range(len(counters) - 1, -1, -1):  # is the count larger than the radius, from its highest bit down
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    beyond |= equal & counters[k]
                    equal &= ~counters[k]
            if bit == 63:
                out[alive] = ~beyond
                break
            keep = ~(beyond == ~np.uint64(0)).all(axis=1)
            if not keep.any():
                break
            if keep.sum() < 0.8 * len(keep):
                alive, queries, planes, over = alive[keep], queries[keep], planes[keep], over[keep]
                counters = [c[keep] for c in counters]
    return out


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Word q has the bits of the lanes after q.
_LATER = np.array([(~((1 << (q + 1)) - 1)) & ((1 << 64) - 1) for q in range(64)], np.uint64)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), as one link from each node to the smallest of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _links(batch: pa.RecordBatch, radius: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a batch of block pairs, a few units at a time: within ``radius`` in the first word, and within ``most`` in all words."""
    sides = []
    for name in ("a", "b"):
        lists = batch.column(batch.schema.get_field_index(name))
        flat = lists.flatten()
        lengths = np.diff(lists.offsets.to_numpy()) * ~np.asarray(lists.is_null())
        words = flat.field("words")
        fps = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        fps = fps.reshape(len(words), -1) if len(words) else fps.reshape(0, 1)
        sides.append((fps, flat.field("rep").to_numpy(zero_copy_only=False), *_laid(fps, lengths)))
    (fa, ra, la, first_a, rows_a), (fb, rb, lb, first_b, rows_b) = sides
    split = len(la)
    width = max(fa.shape[1], fb.shape[1])
    fps, reps = np.concatenate((fa.reshape(-1, width), fb.reshape(-1, width), np.zeros((1, width), np.uint64))), np.concatenate((ra, rb, [0]))
    lanes = np.concatenate((la, np.where(lb >= 0, lb + len(fa), -1)))
    valid = ((lanes >= 0) * _BIT).sum(axis=1, dtype=np.uint64)
    values = fps[:, 0][lanes]
    planes = _planes(values)
    q, p = [], []
    for k in range(len(rows_a)):
        x = np.arange(first_a[k], first_a[k] + rows_a[k])
        if rows_b[k]:
            y = split + np.arange(first_b[k], first_b[k] + rows_b[k])
            q.append(np.repeat(x, len(y)))
            p.append(np.tile(y, len(x)))
        elif len(x) == 1:
            q.append(x)
            p.append(x)
        else:
            i, j = np.triu_indices(len(x))
            q.append(x[i])
            p.append(x[j])
    q, p = np.concatenate(q or [np.empty(0, np.int64)]), np.concatenate(p or [np.empty(0, np.int64)])
    for at in range(0, len(q), UNITS):
        uq, up = q[at : at + UNITS], p[at : at + UNITS]
        hits = within(values[uq], planes[up], radius) & valid[up][:, None]
        hits[lanes[uq] < 0] = 0
        same = uq == up
        hits[same] &= _LATER
        u, lane_q = np.nonzero(hits)
        found = np.unpackbits(hits[u, lane_q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, lane_p = np.nonzero(found)
        x, y = lanes[uq[u[w]], lane_q[w]], lanes[up[u[w]], lane_p]
        for k in range(0, len(x), 200_000) if most is not None else ():
            far = np.bitwise_count(fps[x[k : k + 200_000]] ^ fps[y[k : k + 200_000]]).sum(axis=1, dtype=np.int64) > most
            x[k : k + 200_000][far] = -1
        x, y = x[x >= 0], y[x >= 0]
        yield reps[x], reps[y]


def hamming_links(classes: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """(a, b): links that connect the same classes as all pairs of ``classes`` (fp, rep) within ``radius`` bits do.

    Within a pair of blocks the links come as stars, so their number is that of the fingerprints at most,
    however dense a group of near copies is.
    """
    n = classes.count() if n is None else n
    ranges, agree = choose_ranges(n, radius)
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(ranges, agree))])
    rows = classes.select("fp", "rep", F.explode(entries).alias("e")).select("fp", "rep", "e.t", "e.key")
    return _linked(block_pairs(rows, ["t", "key"], F.struct(F.array("fp").alias("words"), "rep"), F.xxhash64("fp"), BLOCK), radius)


def _linked(pairs: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """(a, b): links of all block pairs, as stars within each few hundred of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
                for x, y in _links(batch.slice(at, 512), radius, most):
                    if len(x):
                        a, b = stars(np.concatenate((a, x)), np.concatenate((b, y)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, its own included; two documents are linked if their
    fingerprints differ in ``radius`` bits or fewer. A null, empty or wordless text has fingerprint zero and is linked like
    any other. Rows with the same doc_id are one document with several fingerprints. A null doc_id keeps its
    row, is no one's component and gets the component of its fingerprint. Other columns are not read.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = hamming_links(classes.where("rep is not null"), radius)
    ids = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("doc_id")
    twice = fps.join(ids, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(links.union(twice))
    found = classes.join(comps, classes["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Least bits of a band, and recall of a pair at the wanted similarity through the bands.
BAND, BAND_RECALL = 8, 0.999
#: Radius in the first word: above that of a similar pair by more than four standard deviations.
FIRST_WORD = 22
#: Pairs are candidates up to a distance of so many standard deviations above that of the wanted similarity.
MARGIN = 4.5
#: Shingles of a block, shingles that a document counts for at least, and documents from which a shingle gets a matrix column.
SHINGLES, LEAST_SHINGLES, COLUMN = 1 << 17, 128, 32
#: Rounds in which the documents of a large candidate component meet in other blocks before the groups that are left are compared whole.
MIXINGS = 2


def expected_distance(similarity: float) -> float:
    """The share of bits in which sketches of shingle sets of this Jaccard similarity differ on average, for sets of equal size (the worst case)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def band_recall(bits: int, each: int, words: int, distance: float) -> float:
    """The probability that two sketches agree on all bits of some band, for ``each`` bands of random bits in every word."""
    miss = sum(comb(64, x) * distance**x * (1 - distance) ** (64 - x) * (1 - comb(64 - x, bits) / comb(64, bits)) ** each for x in range(65))
    return 1 - miss**words


def plan_bands(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a band, bands in a word, words of a sketch) for ``n`` documents.

    A cell of a band has BLOCK documents or fewer on average, and pairs at ``similarity`` meet with BAND_RECALL, however large n is.
    Among the choices the one whose entries take the least space is made.
    """
    bits = max(BAND, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    distance, best = expected_distance(similarity), None
    for words in range(8, 33, 4):
        each = 1
        while band_recall(bits, each, words, distance) < BAND_RECALL:
            each += max(1, each // 20)
        cost = words * each * (words + 2)
        if best is None or cost < best[0]:
            best = cost, each, words
    return bits, best[1], best[2]


def band_masks(bits: int, each: int, words: int) -> list[int]:
    """A signed mask of ``bits`` bits for each band, ``each`` for every word in turn; as many as fit have no bit in common."""
    out = []
    for w in range(words):
        rng = np.random.default_rng((bits, w))
        order: list[int] = []
        for _ in range(each):
            if len(order) < bits:
                order = rng.permutation(64).tolist()
            mask = sum(1 << b for b in order[:bits])
            order = order[bits:]
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def similar_pairs(sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sets with this Jaccard similarity or more: i before ``split`` and j not, or all i < j if nothing is behind it."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, doc = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.lexsort((doc, values))
    values, doc = values[order], doc[order]
    _, shingle, often = np.unique(values, return_inverse=True, return_counts=True)
    dense = often >= COLUMN
    column = (np.cumsum(dense) - 1)[shingle]
    common = np.zeros((n, n), np.int64)
    wide = dense[shingle]
    for at in range(0, int(dense.sum()), 2048):
        some = wide & (column >= at) & (column < at + 2048)
        part = np.zeros((n, 2048), np.float32)
        part[doc[some], column[some] - at] = 1
        if split < n:
            common[:split, split:] += (part[:split] @ part[split:].T).astype(np.int64)
        else:
            common += (part @ part.T).astype(np.int64)
    shingle, doc = shingle[~wide], doc[~wide]
    for k in range(1, COLUMN):
        same = np.flatnonzero(shingle[k:] == shingle[:-k])
        if not len(same):
            break
        np.add.at(common, (doc[same], doc[same + k]), 1)
    i, j = np.nonzero(common)
    right = (i < split) & (j >= split) if split < n else i < j
    i, j = i[right], j[right]
    both = common[i, j]
    close = both / (sizes[i] + sizes[j] - both) >= similarity
    return i[close], j[close]


def _compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the sets of pairs of blocks (a, b), as stars within each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(k)[row].values for k in (0, 1) if batch.column(k)[row].is_valid]
                ids = np.concatenate([x.field("node").to_numpy(zero_copy_only=False) for x in sides])
                each = [s.values.to_numpy(zero_copy_only=False) for x in sides for s in x.field("s")]
                i, j = similar_pairs(each, len(sides[0]), similarity)
                a, b = stars(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(compare, "a long, b long")


def _all_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the same nodes of ``sets`` (component, node, s) as all pairs within a component with this similarity do.

    A component of one block is compared whole. The nodes of a larger one first meet in random blocks, which costs in proportion to
    their number and joins most of a group of copies. Then only nodes of different groups are compared, so a component that has become
    one group costs nothing more.
    """
    weight = F.greatest(F.size("s"), F.lit(LEAST_SHINGLES)).cast("long")
    item = F.struct("node", "s")
    alone = lambda rows, k: _compared(blocks(rows, ["component"], item, F.xxhash64("node", F.lit(k)), SHINGLES, weight).withColumn("b", F.lit(None).cast("array<struct<node:bigint,s:array<bigint>>>")), similarity)
    links = written(alone(sets, 0), "links")
    large = sets.groupBy("component").agg(F.sum(weight).alias("whole")).where(F.col("whole") > SHINGLES).select("component")
    hot = written(sets.join(large, "component"), "hot")
    if hot.isEmpty():
        return links
    for k in range(1, MIXINGS + 1):
        links = links.union(written(alone(hot, k), "links"))
    groups = connected_components(links).select("node", F.col("component").alias("label"))
    hot = hot.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = written(hot.groupBy("component", "label").agg(F.sum(weight).alias("whole")), "groups")
    many = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    own = sizes.join(many, "component").select("component", "label", F.when(F.col("whole") > SHINGLES, F.col("label")).otherwise(-1).alias("own"))
    made = blocks(hot.join(own, ["component", "label"]), ["component", "own"], item, F.xxhash64("node"), SHINGLES, weight, least=1)
    made = written(made.withColumn("id", F.monotonically_increasing_id()), "blocks")
    ids = made.select("component", "own", "id")
    other = ids.select("component", F.col("own").alias("own_b"), F.col("id").alias("id_b"))
    pairs = ids.join(other, "component").where("id < id_b and (own != own_b or own = -1)").select("id", "id_b")  # ids of blocks, not of documents
    left, right = made.select("id", "a").hint("merge"), made.select(F.col("id").alias("id_b"), F.col("a").alias("b")).hint("merge")  # near copies make small files
    across = pairs.join(left, "id").join(right, "id_b").select("a", "b")
    inside = made.where("own = -1").select("a", F.lit(None).cast(made.schema["a"].dataType).alias("b"))
    return links.union(_compared(across.union(inside), similarity))


def _row_keys() -> list:
    """Columns that tell the texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("t"), F.hash(text).alias("u")]


def _similar_classes(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h1, h2) of every row, (h1, h2, group, rep, one) of every set of shingles).

    h1 and h2 are hashes of the set. rep is the smallest doc_id of its rows, one their first by doc_id and text, with the number n of rows
    that are equal in both. Sets with one group are connected by links.
    """
    bits, each, n_words = plan_bands(docs.count(), similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, made = [], []
            for t in batch.column(3).cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py(), shingle))
                made.append(sketch_of(hashes, n_words).view(np.int64))
                ids.append((xxhash.xxh64_intdigest(hashes.tobytes(), 1), xxhash.xxh64_intdigest(hashes.tobytes(), 2)))
            flat = np.concatenate(made) if made else np.empty(0, np.int64)
            h = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * n_words), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "t", "u", "words", "h1", "h2"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_keys(), F.col("text").cast("string").alias("text"))
    made = written(keyed.mapInArrow(work, "doc_id long, t long, u int, words array<bigint>, h1 long, h2 long"), "sketches")
    once = made.groupBy("h1", "h2", "words", "doc_id", "t", "u").agg(F.count(F.lit(1)).alias("n"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "u", "n"))
    classes = written(once.groupBy("h1", "h2", "words").agg(one.alias("one")).withColumn("node", F.monotonically_increasing_id()), "classes")
    masks = F.array(*[F.lit(m) for m in band_masks(bits, each, n_words)])
    rows = classes.select("node", "words", F.posexplode(masks).alias("band", "mask"))
    rows = rows.select("node", "words", "band", F.get("words", F.floor(F.col("band") / each).cast("int")).bitwiseAND(F.col("mask")).alias("key"))
    pairs = block_pairs(rows, ["band", "key"], F.struct("words", F.col("node").alias("rep")), F.xxhash64("node"), BLOCK // 4)
    share, n_bits = expected_distance(similarity), 64 * n_words
    candidates = _linked(pairs, FIRST_WORD, int(n_bits * share + MARGIN * (n_bits * share * (1 - share)) ** 0.5))
    comps = written(connected_components(candidates), "candidates")
    members = comps.select("node", "component").union(comps.select(F.col("component").alias("node"), "component").distinct())
    members = members.join(classes, "node").select("node", "component", F.col("one.doc_id").alias("_id"), F.col("one.t").alias("_t"), F.col("one.u").alias("_u"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u"))
    texts = keyed.join(members, same).select("component", "node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(2).cast(pa.binary())]
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["component", "node", "s"])

    sets = texts.mapInArrow(read, "component long, node long, s array<bigint>")
    links = _all_links(written(sets.dropDuplicates(["component", "node"]), "shingles"), similarity)
    groups = connected_components(links)
    found = classes.join(groups, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("group"), F.col("one.doc_id").alias("rep"), "one")
    return made.select("doc_id", "h1", "h2"), written(found, "found")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: rows linked where their similarity is ``similarity`` or more.

    component_id is the smallest doc_id that links reach, null if none of the rows has one. The similarity is the Jaccard coefficient of the sets
    of ``shingle``-word shingles. Sketches only find candidates, down to a lower similarity; a link is always verified on the sets. Texts
    with fewer words are one shingle, those without words (null ones too) are alike. Rows with the same doc_id, or none, are linked by
    their own texts. Other columns are not read.
    """
    rows, classes = _similar_classes(docs, shingle, similarity)
    least = classes.groupBy("group").agg(F.min("rep").alias("component_id"))
    return rows.join(classes.join(least, "group").select("h1", "h2", "component_id"), ["h1", "h2"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_documents``: the one with the smallest doc_id. Same columns.

    Rows without a doc_id come last. Of different texts with one doc_id, each is in the group of its own text; where several of them are in one
    group, the order of a hash of the text decides, and between rows equal in both the least by all columns stays, so every run keeps
    the same rows.
    """
    _, classes = _similar_classes(docs, shingle, similarity)
    keep = classes.groupBy(F.col("group").alias("_group")).agg(F.min("one").alias("_one"))
    t, u = _row_keys()
    keyed = docs.withColumn("_nd_t", t).withColumn("_nd_u", u)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_one.doc_id")) & (F.col("_nd_t") == F.col("_one.t")) & (F.col("_nd_u") == F.col("_one.u"))
    joined = keyed.join(keep, same)
    names = [F.col(f"`{n}`") for n in docs.columns]
    again = joined.where("_one.n > 1").groupBy("_group").agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    return joined.where("_one.n = 1").select(*names).unionByName(again)
