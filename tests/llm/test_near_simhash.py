import numpy as np
import pytest
import xxhash

from tessera.llm import near_simhash as m
from tessera.llm.blocks import block_pairs
from tessera.llm.components import connected_components
from tessera.llm.queries import queries


def slow_fingerprint(text):
    words = bytes(text or "", "utf8").lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def slow_components(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def slow_groups(fps, radius=4):
    ids = list(fps)
    return slow_components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= radius], ids)


def test_fingerprint():
    for text in (None, "", " \n", "A b", "A b c d", "the The THE the the", "é À b c d e f g"):
        assert m.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    want = slow_groups(fps)
    got = queries()["op5_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert len(got) == len(docs)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 20])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = base[rng.integers(0, 4, (5, 64))]
    for _ in range(6):
        values = values ^ np.where(rng.random(values.shape) < 0.5, np.uint64(1) << rng.integers(0, 64, values.shape).astype(np.uint64), np.uint64(0))
    got = m.within(values, m._planes(values[::-1]), radius)
    for u in range(5):
        for q in range(64):
            for lane in range(64):
                assert bool(int(got[u, q]) >> lane & 1) == (int(values[u, q] ^ values[4 - u, lane]).bit_count() <= radius)


@pytest.mark.parametrize("block", [64, 100, 4096])
@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_links_of_a_dense_group(spark, monkeypatch, block, n):
    """Buckets far above the block size, and every choice of ranges, give the components of all pairs."""
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for center in rng.integers(0, 1 << 63, 3).tolist():
        for _ in range(150):
            fps.add(center ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())))
    fps = dict(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    links = [(r["a"], r["b"]) for r in m.hamming_links(classes, 4, n).collect()]
    assert slow_components(links, list(fps)) == slow_groups(fps)
    assert all((a, b) in {(a, b)} and a != b for a, b in links)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    want = slow_components(pairs, sorted({x for p in pairs for x in p}))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_blocks_hold_every_pair(spark):
    rows = spark.range(500).selectExpr("id % 3 as k", "id as v").unionByName(spark.range(1000, 1001).selectExpr("9 as k", "id as v"))
    import pyspark.sql.functions as F

    got = set()
    for r in block_pairs(rows, ["k"], F.col("v"), F.xxhash64("v"), 40).collect():
        pairs = {(min(x, y), max(x, y)) for x in r["a"] for y in (r["b"] or r["a"]) if x != y}
        assert not pairs & got and len(r["a"]) < 120
        got |= pairs
    assert got == {(a, b) for a in range(500) for b in range(a + 1, 500) if a % 3 == b % 3}


def test_odd_rows(odd, empty):
    rows = m.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1 and by[1]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == 4 and by[None] is not None
    assert m.near_duplicates(empty).count() == 0


def jaccard(a, b, k=5):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def test_sketch_distance_tells_similarity():
    rng = np.random.default_rng(2)
    for target in (0.5, 0.8, 0.95):
        got = []
        for _ in range(30):
            common = rng.integers(0, 1 << 40, 2000)
            own = rng.integers(1 << 41, 1 << 42, (2, int(1000 * (1 / target - 1))))
            a, b = (m.majority(_mixed(np.concatenate((common, o)), 8)) for o in own)
            got.append(np.bitwise_count(a ^ b).sum() / 512)
        n = 2000 + int(1000 * (1 / target - 1))
        assert abs(np.mean(got) - m.expected_distance(2000 / (2 * n - 2000))) < 0.02


def _mixed(h, n):
    h = h.astype(np.uint64)[:, None] * m._ODD[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def test_similar_documents(spark):
    """Clear copies are found, clear strangers aren't, whatever the size of the group."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, base = [], []
    for g in range(30):
        words = [word() for _ in range(int(rng.integers(60, 300)))]
        base.append(g * 100)
        for c in range(5):
            copy = list(words)
            for _ in range(c and max(1, len(words) // 250)):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((g * 100 + c, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " ")]
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[i] // 100 == i // 100 for i in got if i < 9000), "strangers stay apart"
    same = [got[i] == i // 100 * 100 for i, t in rows if i < 9000 and jaccard(t, rows[[r[0] for r in rows].index(i // 100 * 100)][1]) >= 0.9]
    assert np.mean(same) > 0.97 and {got[i] for i in (9000, 9001, 9002)} == {9000}


def test_similarity_is_exact(spark, monkeypatch):
    """Against brute force around 0.8, and with a chain of documents at 0.72 to 0.78, also in small blocks."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(150):
        words = [f"w{g}x{k}" for k in range(int(rng.integers(40, 400)))]
        for c in range(4):
            copy = list(words)
            for k in range(int(rng.integers(0, 1 + len(words) // 35)) if c else 0):
                copy[int(rng.integers(len(copy)))] = f"c{g}x{c}x{k}"
            rows.append((g * 10 + c, " ".join(copy)))
    for c in range(40):
        rows.append((5000 + c, " ".join(f"line{k}" if k < 280 else f"own{c}x{k}" for k in range(325))))
    texts = dict(rows)
    pairs = [(a, b) for a in texts for b in texts if a < b and (a // 10 == b // 10 or a >= 5000) and jaccard(texts[a], texts[b]) >= 0.8]
    want = slow_components(pairs, list(texts))
    assert all(want[5000 + c] == 5000 + c for c in range(40))
    for size in (1 << 17, 2000):
        monkeypatch.setattr(m, "SHINGLES", size, raising=False)
        got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        wrong = [i for i in got if got[i] != want[i]]
        assert len(got) == len(rows) and all(want[i] != got[i] >= i - 9 for i in wrong) and len(wrong) <= 2, wrong


@pytest.mark.parametrize("split", [40, 90])
def test_similar_pairs(split):
    rng = np.random.default_rng(split)
    sets = [np.unique(np.concatenate((np.arange(80), rng.integers(0, 300, rng.integers(0, 40))))) for _ in range(80)] + [np.arange(500, 500 + n) for n in range(10)]
    i, j = m.similar_pairs(sets, split, 0.8)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if (split == 90 or a < split <= b) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) > 0}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("rows", [1, 2, 63, 1024, 1025, 2049])
def test_planes_of_any_number_of_rows(rows):
    values = np.random.default_rng(rows).integers(0, 1 << 63, (rows, 64), dtype=np.uint64)
    planes = m._planes(values)
    for bit in (0, 17, 62):
        want = [sum(1 << lane for lane in range(64) if int(v[lane]) >> bit & 1) for v in (values[0], values[-1])]
        assert [int(planes[0, bit]), int(planes[-1, bit])] == want


def test_one_bucket(spark):
    """Two or three unrelated texts that share an id or a bit range."""
    word = lambda k: f"w{k * 7919 % 1009}"
    texts = [" ".join(word(k + 1000 * g) for k in range(60)) for g in range(3)]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert sorted(tuple(r) for r in m.drop_near_duplicates(docs).collect()) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2])])
    assert {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    classes = spark.createDataFrame([(5, 1), (5 + (0xFFFF << 40), 2)], "fp long, rep long")
    assert m.hamming_links(classes).count() == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**8, 10**9, 10**10, 10**11])
def test_planned_recall_holds_at_every_size(n):
    bits, each, words = m.plan_bands(n, 0.8)
    assert n / 2.0**bits <= m.BLOCK and m.band_recall(bits, each, words, m.expected_distance(0.8)) >= m.BAND_RECALL
    masks = m.band_masks(bits, each, words)
    assert len(masks) == each * words and all((x & ((1 << 64) - 1)).bit_count() == bits for x in masks)


@pytest.mark.parametrize("n", [10**6, 10**9])
def test_measured_recall_of_bands(n):
    """Sketches of real sets at a similarity of 0.8 meet in some band of the plan for ``n`` documents."""
    rng = np.random.default_rng(9)
    bits, each, words = m.plan_bands(n, 0.8)
    masks = np.array(m.band_masks(bits, each, words), np.int64).view(np.uint64).reshape(words, each)
    met = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 62, 160, dtype=np.uint64), rng.integers(0, 1 << 62, (2, 20), dtype=np.uint64)
        a, b = (m.sketch_of(np.concatenate((common, o)), words) for o in own)
        met += bool((((a ^ b)[:, None] & masks) == 0).any())
    assert met >= 0.98 * 300


def test_repeated_ids_in_the_stage(spark):
    """Each text under one id is judged by itself, copies of one text leave one row, and every run keeps the same rows."""
    text = lambda g: " ".join(f"g{g}w{k}" for k in range(50))
    rows = [(7, text(1), "b"), (7, text(1), "a"), (7, text(2), "c"), (3, text(2), "d"), (None, text(2), "e"), (None, text(3), "g"), (None, text(3), "f"), (9, text(4) + " x", "h"), (9, text(4), "i")]
    for part in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, one string").repartition(part)
        got = sorted((r["doc_id"] or 0, r["one"]) for r in m.drop_near_duplicates(docs).collect())
        assert got[:3] == [(0, "f"), (3, "d"), (7, "a")] and len(got) == 4 and got[3][0] == 9
        assert part == 1 or got == first
        first = got


@pytest.mark.parametrize("shingles", [1 << 17, 3000])
def test_a_large_group_of_near_copies(spark, monkeypatch, shingles):
    """More near copies than a block holds, beside others that share candidates but reach 0.8 with none of them."""
    monkeypatch.setattr(m, "SHINGLES", shingles)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in range(120)]
        words[int(rng.integers(120))] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([f"w{k}" for k in range(100)] + [f"other{i}x{k}" for k in range(35)])) for i in range(30)]
    texts = dict(rows)
    ids = list(texts)
    want = slow_components([(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b]) >= 0.8], ids)
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_stage_on_odd_rows(odd, empty):
    out = m.drop_near_duplicates(odd)
    assert out.columns == odd.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "4", "5", "6", "7", "None"]
    assert m.drop_near_duplicates(empty).count() == 0


def test_blocks_are_not_broadcast(spark, tmp_path):
    """Spark takes blocks of exploded rows for as large as the file behind them, and a broadcast planned so stays."""
    import pyspark.sql.functions as F

    from tests.llm.test_line_templates import broadcasts

    spark.range(600).selectExpr("id as v").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).select("v", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    pairs = block_pairs(rows, ["k"], F.struct("v"), F.xxhash64("v"), 100)
    assert not [x for x in broadcasts(pairs._jdf.queryExecution().executedPlan().toString()) if "collect_list" in x]
    assert pairs.count() == 40 * 21
