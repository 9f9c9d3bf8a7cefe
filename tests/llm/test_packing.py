from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as m
from tessera.llm.queries import queries


def check(rows, texts, size=1024):
    """Every contract rule: pieces, ids, gapless sequences. Returns the number of sequences."""
    exact = Tokenizer.from_file(m.default_tokenizer())
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert len(got) == -(-len(ids) // size) and all(r["length"] == size for r in got[1:])
        at = 0
        for r in got:
            assert r["start"] == at and r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op2_best_fit_packing"](spark, sf_dir).collect()
    n = check(rows, texts)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_merging_rounds(spark, monkeypatch):
    """Many partitions and short runs: underfull bins of one partition are filled with those of others."""
    monkeypatch.setattr(m, "RUN", 150)
    monkeypatch.setattr(m, "FIRST", 20)
    texts = {i: "word " * (37 * i % 900) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(16)
    rows = m.pack(docs).collect()
    one_task, _ = m.best_fit(m.np.array([r["length"] for r in rows]), 1024)
    assert check(rows, texts) <= 1.03 * (one_task.max() + 1)


def test_ids_are_the_tokenizers(sf_dir, spark):
    exact = Tokenizer.from_file(m.default_tokenizer())
    odd = ["", " ", "a<|endoftext|>b", "   x", "it's IT'S", "१२३ ٣", "🙂🙂 é é", "\r\n\n  x\t", "x" * 5000, " " * 3000, "\x00\x01", "a\u0085b", "ǅ ſ"]
    for text in odd:
        assert m.encode(text, m.default_tokenizer()).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts():
    exact, path = Tokenizer.from_file(m.default_tokenizer()), m.default_tokenizer()
    rng = np.random.default_rng(6)
    parts = [*map(chr, range(0x250)), *"\u0301\u0661\u2003\u2028\u3000\u4e2d\uac00\ufeff😀", "'s", " re", "<|endoftext|>", "  ", "\n\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 25))))
        assert m.encode(text, path).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_ids_of_every_code_point():
    """Each code point after a letter, after a space and alone among others, by both encoders."""
    exact, path = Tokenizer.from_file(m.default_tokenizer()), m.default_tokenizer()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in points[at : at + 20_000])
        assert m.encode(text, path).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 3000)
    bins, n = m.best_fit(lengths, 1024)
    assert np.bincount(bins, lengths).max() <= 1024 and len(np.unique(bins)) == n
    assert n <= 1.03 * lengths.sum() / 1024 + 1  # items over half a bin leave room that nothing fits


def test_odd_rows(odd, empty):
    rows = m.pack(odd).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert next(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert m.pack(empty).count() == 0


@pytest.mark.parametrize("n,size", [(1, 4), (4, 4), (5, 4), (8, 4), (11, 4)])
def test_pieces(n, size):
    got = list(m.pieces(np.arange(n, dtype="<u4"), size))
    assert [p[0] for p in got] == list(range(len(got))) and sum(p[2] for p in got) == n and all(p[2] == size for p in got[1:]) and 1 <= got[0][2] <= size
