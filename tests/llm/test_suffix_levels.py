from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import suffix_levels as m
from tessera.llm.queries import queries


def slow(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + 200] for _, t in texts for s in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = 1
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def made(seed, n=80):
    """Passages around the limit, near copies, copies inside a document, periodic texts, multi-byte characters, repeated rows."""
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("abcdefgh é"), k))
    passages = [text(int(k)) for k in (150, 190, 199, 200, 201, 230, 420, 900)]
    rows = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 400)))]
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            at = int(rng.integers(0, 60))
            parts += [p[at:] if rng.random() < 0.4 else p, text(int(rng.integers(0, 150)))]
        rows.append((i, "".join(parts)))
    base = text(2500)
    for i in range(12):
        at = int(rng.integers(0, 2400))
        rows.append((1000 + i, base[:at] + "#" * int(rng.integers(0, 3)) + base[at + 1 :]))
    rows += [(2000, "x" * 1500), (2001, "xy" * 400), (2002, "x" * 200), (2003, "x" * 199), (2004, None), (2005, ""), (2006, base), (2006, base), (None, text(300)), (None, passages[7]), (2007, passages[7])]
    return rows


@pytest.mark.parametrize("seed,shard,size", [(1, 2000, 500_000), (2, 3, 500_000), (3, 2000, 3000)])
def test_against_brute_force(spark, monkeypatch, seed, shard, size):
    monkeypatch.setattr(m, "SHARD_SEGMENTS", shard)
    monkeypatch.setattr(m, "ARRAY_ROWS", size // 300)
    monkeypatch.setattr(m, "SHARD_BYTES", 10 * size)
    monkeypatch.setattr(m, "TEXT_BYTES", size)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(m.report(docs)) == slow(rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(queries()["op8_suffix_dedup"](spark, sf_dir))
    assert got == slow(rows) and any(r[2] for r in got)


def test_levels_merge_geometrically():
    family = m.anchor_levels()
    rng = np.random.default_rng(0)
    seen = Counter()
    for _ in range(64):
        h = rng.integers(0, 20_000, 50)
        seen.update(h.tolist())
        family.add(m.sorted_anchors({"h": h, "hit": np.zeros(50, bool)}))
        assert len(family.levels) <= 8
    for level in family.levels:
        assert [bool(x) for x in level["hit"]] == [seen[int(h)] > 1 for h in level["h"]]


def test_suffix_arrays():
    """Marks after any order of batches are those of all strings together."""
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 5000).astype(np.uint8)
    text[3000:3500], text[4200:4450] = text[100:600], text[150:400]
    family, rows = m.segment_levels(), []
    for k in range(40):
        at, n = int(rng.integers(0, 4700)), int(rng.integers(1, 90))
        rows.append((k, at, n, bool(k % 3)))
        columns = {"key": np.array([k]), "tag": np.array([0], np.int32), "at": np.array([at], np.int32), "n": np.array([n], np.int32), "asks": np.array([bool(k % 3)])}
        family.add(m.Segments.of(text[at : at + n + 199], columns))
    assert len(family.levels) <= 12
    raw = text.tobytes()
    seen = Counter(raw[at + o : at + o + 200] for _, at, n, _ in rows for o in range(n))
    want = {(k, at + o) for k, at, n, asks in rows for o in range(n) if asks and seen[raw[at + o : at + o + 200]] > 1}
    got = set()
    for level in family.levels:
        for r in level.runs().to_pylist():
            got |= {(r["key"], p) for p in range(r["first"], r["end"])}
    assert got == want and want


def test_odd_rows(odd, empty):
    rows = m.report(odd).collect()
    assert len(rows) == odd.count() and m.report(empty).count() == 0
    assert {r["n_removed"] for r in rows if r["doc_id"] == 5} == {300_000}
