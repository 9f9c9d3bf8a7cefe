import re
import time
from collections import Counter
from hashlib import sha256

import numpy as np
import regex

from tessera.llm import private as m
from tessera.llm.queries import queries


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", x) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", x) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in x[0].split("."))]
    found += [("card", x) for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(x[0])) <= 19 and luhn(digits(x[0]))]
    found += [("phone", x) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(x[0])) <= 15]
    n = Counter(k for k, _ in found)
    base = [f"{k}:{x.start()}:{x.end()}" for k, x in found]
    return *(n[k] for k in m.KINDS[:4]), sha256(",".join(base).encode()).hexdigest(), base


def fields(r):
    return r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], [s for s in r["spans"].split(",") if s and not s.startswith("weak")]


CASES = [
    "a@b.com x.y+z@mail-1.example.co.uk bad@host @x.y a@b.c_d@e.f a@b@c.de --@--.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3 0000.00000.0.0 99999999999999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 1  4111111111111111 79927398713 5500005555555559-1",
    "+1 (555) 555-0100 +49 30 1234567. ++1 +1 555 +123456789 +12345678 +1 234 567 890 123 456 +1( ) ( )2",
    "🙂 é@b.com ünï@x.de +1 (555) 555-0100 🙂 4111111111111111",
    "",
    "a.b@c.d.e.f 1.1.1.1@a.b 10.0.0.1:80 v1.2.3.4-5",
]


def test_rules(spark):
    docs = spark.createDataFrame(list(enumerate([*CASES, None])), "doc_id long, text string")
    got = {r["doc_id"]: fields(r) for r in m.report(docs).collect()}
    assert got == {i: slow(t) for i, t in enumerate([*CASES, None])}


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: fields(r) for r in queries()["op10_private_data"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: slow(r["text"]) for r in docs}
    assert any(g[0] for g in got.values())


def test_no_python_in_plan(spark, sf_dir):
    plan = m.spans_and_candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reliabilities_are_estimated():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.25
    right, speaks = [0.95, 0.8, 0.6, 0.9, 0.9, 0.7], [0.9, 0.6, 0.8, 0.5, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < s, np.where(rng.random(len(truth)) < r, truth, ~truth), -1) for r, s in zip(right, speaks)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, share, table = m.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.25) < 0.03
    for k, r in enumerate(right):
        assert abs(table[k, 1, 1] / table[k, 1, :2].sum() - r) < 0.06


def test_weak_spans(spark):
    rows = [(i, f"Please call me, phone: ({200 + i}) 555-{1000 + i}. Released in version 2024-01-{10 + i % 20}, total 1234567{i}.") for i in range(200)]
    rows += [(1000, "write to jane.doe [at] example [dot] org now")]
    got = {r["doc_id"]: r["spans"] for r in m.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[5][1].index("(205)")
    assert got[5] == f"weak:{at}:{at + 14}"


def test_odd_rows(odd, empty):
    assert m.report(odd).count() == odd.count() and m.report(empty).count() == 0


def test_many_matches_in_one_text(spark):
    part = "mail a@b.com or call +1 (555) 555-0100, phone: (212) 555-1000. é "
    docs = spark.createDataFrame([(1, part * 8_000)], "doc_id long, text string")
    began = time.monotonic()
    (r,) = m.report(docs).collect()
    assert time.monotonic() - began < 90 and r["n_email"] == r["n_phone"] == 8_000
    assert fields(r) == slow(part * 8_000)


def slow_candidates(text):
    """Runs that overlap no base span, with what stands around them: (start, end, before, after)."""
    base = [tuple(map(int, x.split(":")[1:])) for x in slow(text)[5]]
    found = [x.span() for p in (m.NUMBER, m.WRITTEN) for x in regex.finditer(p, text)]
    return sorted((a, b, text[max(a - 24, 0) : a], text[b : b + 2]) for a, b in found if not any(x < b and a < y for x, y in base))


def test_weak_candidates_and_votes_against_brute_force(spark):
    """Which runs are candidates, and the votes of the labelers that look around them."""
    texts = [*CASES, "🙂 écrire à Jean: 0123 456 789, ISBN 978-3-16-148410-0 page 1234567 " * 40, "Maria (212) 555-0100 Berlin 212-555-0101 price 2024-01-02 jane [at] x [dot] org, x@y.z 1.2.3.4 00491234567"]
    got = {r["doc_id"]: r["candidates"] for r in m.spans_and_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    names = list(m.LABELERS)
    for i, text in enumerate(texts):
        weak = sorted((c["start"], c["end"], c["votes"]) for c in got[i] if c["rank"] == 4)
        want = slow_candidates(text)
        assert [(a, b) for a, b, _ in weak] == [(a, b) for a, b, _, _ in want]
        for (_, _, votes), (_, _, before, _) in zip(weak, want, strict=True):
            assert votes[names.index("pattern")] == -1
            assert (votes[names.index("names")] == 1) == bool(regex.search(rf"(?i)(^|[^\p{{L}}])({m.NAMES})([^\p{{L}}]|$)", before))
            assert (votes[names.index("cue")] == 1) == bool(regex.search(rf"(?i)(^|[^\p{{L}}])({m.CUES})[^\p{{L}}]{{0,8}}$", before))
        assert sum(c["rank"] < 4 and c["votes"][names.index("pattern")] == 1 for c in got[i]) == len(slow(text)[5])
