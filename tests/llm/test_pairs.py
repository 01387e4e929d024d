"""Operators on pairs and the pipeline: brute force over all pairs, hot groups, odd tables."""

import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from bindery.llm import common, simhash, vectors


def roots_by_hand(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(3, 3), (9, 4), (4, 9), (7, 9), (2, 1)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots_by_hand(nodes, [e for e in edges if e[0] != e[1]])


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_forest(pairs):
    a, b = np.array(pairs).T
    own = {n for p in pairs for n in p}
    x, y = common.forest(a, b)
    assert roots_by_hand(own, list(zip(x.tolist(), y.tolist(), strict=True))) == roots_by_hand(own, pairs)
    assert len(x) <= len(own)


def fingerprint_by_hand(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashed = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed)) if hashed else 0


TEXTS = [None, "", " \n\t", "one", "One TWO three", "a b c d e f g h", "A b C d e f g h", "é\u0085x ſ y Ä b c d e", "w " * 5000]


def test_fingerprints():
    assert simhash.fingerprints_of(TEXTS).tolist() == [fingerprint_by_hand(t) for t in TEXTS]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 200), st.integers(0, 6))
def test_bit_sliced_distances(seed, n, radius):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64, n, np.uint64)
    fps[n // 2 :] = fps[: n - n // 2]
    for _ in range(4):
        fps[rng.random(n) < 0.5] ^= np.uint64(1) << rng.integers(0, 64, 1, np.uint64)[0]
    width = -(-n // 64)
    padded = np.zeros((1, width * 64), np.uint64)
    padded[0, :n] = fps
    valid = np.packbits(np.arange(width * 64) < n, bitorder="little").view(np.uint64)[None, :]
    q, to = simhash.near(fps, np.zeros(n, int), simhash._planes(padded), valid, radius)
    want = {(i, j) for i in range(n) for j in range(n) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert set(zip(q.tolist(), to.tolist(), strict=True)) == want and len(q) == len(want)


@pytest.mark.parametrize(("n", "tables"), [(10, 5), (10**7, 15), (10**10, 35)])
def test_tables_never_miss(n, tables):
    masks = simhash.tables(n)
    assert len(masks) == tables
    rng = np.random.default_rng(1)
    for _ in range(300):
        differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & differ == 0 for m in masks)


def test_simhash_on_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: fingerprint_by_hand(t) for i, t in docs.items()}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots_by_hand(fps, pairs)
    rows = simhash.op8(spark, SMALL).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_simhash_chunks_of_a_hot_bucket(spark):
    """A chain and a cloud of fingerprints around one centre, in chunks of three: components as from all pairs."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(60)} | {centre ^ ((1 << k) - 1) for k in range(0, 40, 3)})
    nodes = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(nodes, "fp long, id long"), chunk=3)
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = roots_by_hand(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_simhash_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, TEXTS[5]), (None, "nothing like it in the table at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "id": F.lit("x"), "component_id": F.lit(2)})
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fp == 0} == {0}
    assert [r.component_id for r in got if r.doc_id is None] in ([5, None], [None, 5])
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 2 and 0 in ids and 1 not in ids and 6 not in ids
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """One row of each group stays: where an id stands for two texts, where rows repeat, and where ids are null."""
    x, y, z, w = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyzw")
    rows = [(1, x), (5, x), (5, y), (7, y), (8, z), (8, w), (8, w), (None, x), (None, "null " + y), (None, "null " + y), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df, keep_null_ids=False, radius=0).collect()), key=str)
    assert got == sorted([(1, x), (5, y), (8, z), (8, w), (None, "null " + y), (None, None)], key=str)
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df, radius=0).where("doc_id is not null").collect()) == sorted([(1, x), (5, y), (8, z), (8, w)])
    roots = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).where("doc_id in (1, 7)").collect()}
    assert roots == {(1, 1), (7, 5)}


def links_by_hand(rows, t=0.98):
    ok = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                pairs.append((ok[a][0], ok[b][0]))
    n = {i: sum(i in p for p in pairs) for i, _, _ in rows}
    return n, roots_by_hand([r[0] for r in rows], pairs)


def cloud(rng, n, dim, spread):
    x = rng.normal(size=dim)
    return [(x + spread * rng.normal(size=dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_vectors_by_hand(spark, chunk):
    rng = np.random.default_rng(2)
    vs = [v for s in (0.05, 0.09, 0.1, 0.12, 0.15) for v in cloud(rng, 40, 24, s)] + [cloud(rng, 1, 24, 1)[0]] * 6
    rows = [(i, v, i % 2) for i, v in enumerate(vs)]
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [float("inf")] + [1.0] * 23, 1), (1004, vs[0], None), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [], 1), (1008, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "vector": F.lit(2), "x": F.lit(3)})
    got = {r.vec_id: r for r in vectors.near_vectors(df, chunk=chunk).collect()}
    n, root = links_by_hand(rows)
    assert len(got) == len(rows) == len(n)
    found, there = sum(r.n_links for r in got.values()), sum(n.values())
    assert found <= there and found >= 0.97 * there and there > 500
    assert all(r.n_links <= n[i] for i, r in got.items())
    assert np.mean([r.component_id == root[i] for i, r in got.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[1006].component_id == 1005 and got[1004].n_links == 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_recall_at_the_threshold():
    """Pairs at exactly the threshold, in many dimensions: the share found is at least what the count is set for."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=(400, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    other = rng.normal(size=q.shape)
    other -= (other * q).sum(1)[:, None] * q
    d = 0.98 * q + np.sqrt(1 - 0.98**2) * other / np.linalg.norm(other, axis=1)[:, None]
    i, j = vectors.candidates(q, d, vectors.WINDOW * np.sqrt(2 - 2 * 0.98), vectors.needed())
    assert np.mean(np.isin(np.arange(400), i[i == j])) >= 0.97
    assert len(i) < 400 * 400 * 0.01


def test_vectors_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(4, v, 1), (4, v, 1), (None, v, 1), (None, [9.0, 1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 0, None, False)], key=str)


def test_vectors_linked_over_null_ids(spark):
    """Vectors without any id are linked and link others, also where they lie between two that have one."""
    step = np.pi / 20  # cosine 0.988 between neighbours, 0.951 between the next but one
    at = lambda k: [float(np.cos(k * step)), float(np.sin(k * step))]
    df = spark.createDataFrame([(7, at(0), 1), (None, at(1), 1), (3, at(2), 1), (None, at(12), 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(7, 1, 3, False), (None, 2, 3, False), (3, 1, 3, True), (None, 0, None, False)], key=str)


@pytest.mark.parametrize("k", [3, 4])
def test_cells_of_more_lines(spark, k):
    rng = np.random.default_rng(8)
    rows = [(i, v, 0) for i, v in enumerate(v for s in (0.05, 0.1, 0.13) for v in cloud(rng, 50, 24, s))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n, _ = links_by_hand(rows)
    found = sum(r.n_links for r in vectors.near_vectors(df, lines=k).collect())
    assert 0.97 * sum(n.values()) <= found <= sum(n.values())
    assert [vectors.cell_lines(n) for n in (0, 1000, 50_000, 10**6, 10**9)] == sorted(vectors.cell_lines(n) for n in (0, 1000, 50_000, 10**6, 10**9))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "x", 0), (902, "12 34", "en", "x", 5), (None, "a null id and a text of its own, in english words that the table has not", "en", "x", 9)], docs.schema)
    now = docs.unionByName(odd)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    sizes = []
    for name, step in corpus_pipeline.STAGES:
        got = common.stage(step(spark, now, SMALL), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        sizes.append(got.count())
        before, now = now, got
    assert sizes[0] >= 195 and sizes == sorted(sizes, reverse=True)
    texts = {(r.doc_id, r.text) for r in before.collect()}
    import hashlib

    assert {(r.doc_id, r.decoded_sha256) for r in now.collect()} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SMALL)
    assert empty.count() == 0


CLASHING = ["a.b", "__id", "__mark", "__dropped", "__text", "rest", "id", "mark", "c0", "`q`", "words", "label"]


def test_pipeline_carries_columns_of_any_name(spark):
    """Names that operators make themselves, names with dots and marks, and a nested field of such a name."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHING)], F.struct(F.col("doc_id").alias("x.y"), F.lit("v").alias("e-f")).alias("nested"))
    plain, now = docs, more
    for name, step in corpus_pipeline.STAGES[:-1]:
        plain, now = common.stage(step(spark, plain, SMALL), name), common.stage(step(spark, now, SMALL), name)
        assert now.columns == more.columns
        got = now.collect()
        assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((r.doc_id, r.text, r.n_chars) for r in plain.collect())
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) and r["nested"]["x.y"] == r.doc_id for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count() == len(got)


def test_pipeline_reads_a_text_over_a_megabyte(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = docs.where("lang = 'en' and length(text) > 400").orderBy("doc_id").first()
    long = "\n".join(f"{base.text} number {n} of many, {n * 7919 % 1013}" for n in range(1_300_000 // len(base.text)))
    assert len(long) > 1_000_000
    now = docs.unionByName(spark.createDataFrame([(10**9, long, "en", "x", len(long))], docs.schema))
    for name, step in corpus_pipeline.STAGES:
        now = common.stage(step(spark, now, SMALL), name)
    row = now.where("doc_id = 1000000000").collect()
    assert len(row) == 1 and row[0].n_tokens > 1000


def test_pipeline_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
    assert rows.count() > 150 and rows.select("doc_id").distinct().count() == rows.count()
