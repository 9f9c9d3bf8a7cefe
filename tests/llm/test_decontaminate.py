import re
from hashlib import sha256

import pytest

from tessera.llm import decontaminate as m
from tessera.llm.queries import queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def slow(docs, items):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(13, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def rows_of(df):
    return {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = rows_of(queries()["op3_decontamination"](spark, sf_dir))
    assert got == slow(docs, items)
    assert any(r[4] for r in got.values())


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Tiny ITEM"), (3, None), (4, "..."), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"), (2, "tiny item"), (11, "ünï 7")]
DOCS = [(1, f"a b {LONG.upper()} c"), (2, "a tiny-item, tiny item"), (3, None), (4, ""), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (6, "x " * 500 + "ünï_7"), (7, "ÜNÏ 7"), (8, "w39 tiny"), (9, "item")]


@pytest.mark.parametrize("set_bytes", [m.SET_BYTES, 60])
def test_rules_and_split_sets(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(m, "SET_BYTES", set_bytes)
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(m.contamination(docs, items)) == slow(DOCS, ITEMS)


def test_small_scans(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(m, "SCAN_BYTES", 1)
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(m.contamination(docs, items)) == slow(DOCS, ITEMS)


def test_spans_removed(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in m.without_spans(docs, items).collect()}
    assert got[1] == "a b  c" and got[2] == "a " and got[3] is None and got[5] == DOCS[4][1]


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert m.contamination(odd, items).count() == odd.count()
    assert m.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in m.contamination(odd, items.where("false")).collect()} == {0}


@pytest.mark.parametrize("set_bytes", [m.SET_BYTES, 60])
def test_documents_removed(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(m, "SET_BYTES", set_bytes)
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string").selectExpr("*", "1 as n_words", "2 as hits"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = {i for i, x in slow(DOCS, ITEMS).items() if not x[4]}
    got = m.drop_contaminated(docs, items)
    assert {r["doc_id"] for r in got.collect()} == want and got.columns == docs.columns
