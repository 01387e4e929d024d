"""Exact dedup, vector codes and whitening: against brute force, and on odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from bindery.llm import codes, exact, integers, whiten

DOCS = "doc_id long, text string, `a.b` int, digest string, row int"
VECTORS = "vec_id long, embedding array<float>, label int, x int, id string"


def _digest(i: int) -> bytes:
    return hashlib.sha256(str(i).encode()).digest()


def test_shard_inserts_deletes_and_resizes():
    shard, live, rng = exact.Shard(buckets=2), {}, random.Random(1)
    for step in range(6000):
        i = rng.randrange(1500)
        if rng.random() < 0.35 and live:
            assert shard.delete(_digest(i), 1) == (i in live)
            live.pop(i, None)
        else:
            shard.insert(_digest(i), 1, 1, (step, step))
            live[i] = live.get(i, 0) + 1
    assert shard.resized > 3 and shard.live == len(live)
    assert {k[0]: k[2] for k in shard.keys if k} == {_digest(i): n for i, n in live.items()}
    assert all((shard.find(_digest(i), 1) >= 0) == (i in live) for i in range(3000))
    assert shard.find(_digest(next(iter(live))), 2) == -1  # same digest, other length


def test_hits_are_checked_against_stored_keys():
    """Digests that share fingerprint and buckets and differ after them."""
    shard = exact.Shard(buckets=2)
    twins = [_digest(1)[:10] + bytes([n]) * 22 for n in range(8)]
    for n, d in enumerate(twins):
        shard.insert(d, 1, 1, (n, n))
    assert shard.live == 8 and shard.refuted > 0
    assert shard.delete(twins[3], 1) and shard.find(twins[3], 1) == -1 and shard.find(twins[4], 1) >= 0


def _plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i is None, i or 0, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows), key=repr)


def test_dedup_on_odd_rows(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (None, "a"), (2, None), (3, ""), (None, "only"), (None, "only"), (7, "é"), (8, "é"), (9, "x" * 300_000), (10, "x" * 300_000), (11, "a ")]
    docs = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], DOCS).repartition(3)
    got = exact.dedup(docs).collect()
    assert sorted(((r.id is None, r.id or 0, r.keep_id, r.group_size) for r in got), key=repr) == _plain(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.id == r.keep_id for r in got if r.kept)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})
    assert exact.dedup(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


def test_hot_texts_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_DOCS", 50)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 200).cast("string"))).alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    index = exact.build(docs, shard_docs=64)
    assert index.shards == 15 and index.filters.count() <= 15
    got = exact.decisions(index).collect()
    assert sorted(((False, r.id, r.keep_id, r.group_size) for r in got), key=repr) == _plain(rows)


def test_index_takes_and_gives_up_documents(spark):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(200)], "doc_id long, text string")
    index = exact.build(docs, shard_docs=16)
    more = exact.insert(index, spark.createDataFrame([(500, "t1"), (501, "new"), (502, "new")], "doc_id long, text string"))
    less = exact.delete(more, spark.createDataFrame([(500,), (501,), *[(i,) for i in range(200) if i % 40 == 2], (999,)], "doc_id long"))
    assert less.filters.agg(F.sum("live")).first()[0] == less.keys.count() == 40  # t2 is gone, new is there
    want = {"t1": 161, "new": 502, "t3": 163}
    asked = exact.lookup(less, spark.createDataFrame([(1, "t1"), (2, "new"), (3, "t3"), (4, "t2"), (5, "never"), (6, None), (7, "t3")], "doc_id long, text string"))
    got = {r.id: (r.found, r.keep_id) for r in asked.collect()}
    assert got == {1: (True, want["t1"]), 2: (True, 502), 3: (True, want["t3"]), 7: (True, want["t3"]), 4: (False, None), 5: (False, None), 6: (False, None)}
    again = {(r.id, r.keep_id, r.group_size) for r in exact.decisions(less).collect()}
    left = [(i, f"t{i % 40}") for i in range(200) if i % 40 != 2] + [(502, "new")]
    assert {(i, k, n) for _, i, k, n in _plain(left)} == again


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "id") for i, v, l in rows], VECTORS)


def _plain_lloyd(x, parts, entries, rounds):
    width = x.shape[1] // parts
    books, code = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)], []
    for r in range(rounds + 1):
        code, dist = [], []
        for p in range(parts):
            d = ((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2)
            code.append(d.argmin(1))
            dist.append(d.min(1))
            if r < rounds:
                for e in range(len(books[p])):
                    own = x[code[p] == e, p * width : (p + 1) * width]
                    if len(own):
                        books[p][e] = own.sum(0) // len(own)
    return np.array(code).T, np.array(dist).T, np.array(books)


@pytest.mark.parametrize("scale", [4, 1024, 1 << 26])
def test_codes_equal_plain_rounds(spark, scale):
    """Coarse entries make ties, large ones leave the exact range of doubles."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(700, 8)).astype(np.float32)
    got, books = codes.compress(_vectors(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(values)]).repartition(5), parts=2, entries=40, rounds=5, scale=scale)
    rows = sorted(got.collect(), key=lambda r: r.id)
    code, dist, want = _plain_lloyd(np.floor(values.astype(float) * scale).astype(np.int64), 2, 40, 5)
    assert [r.code for r in rows] == code.tolist() and [r.dist for r in rows] == dist.tolist()
    assert (books == want).all()


def test_moved_entries_alone_give_what_all_entries_give():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(500, 2))
    book = rng.integers(-3, 4, size=(12, 2))
    code, dist = codes.assign(x, book, True)
    for _ in range(20):
        new = book.copy()
        at = rng.integers(0, 12, 3)
        new[at] += rng.integers(-1, 2, size=(3, 2))
        moved = (new != book).any(1)
        code, dist = codes.assign(x, new, True, code, dist, moved)
        book = new
        want = codes.assign(x, book, False)
        assert (code == want[0]).all() and (dist == want[1]).all()


ODD = [(1, None, 1), (2, [1.0, float("nan")], 1), (3, [1.0, float("inf")], None), (4, [1.0, None], 1), (5, [], 2)]


def test_codes_on_odd_rows(spark):
    good = [(9, [0.5, -0.5], None), (9, [0.5, -0.5], None), (None, [0.1, 0.2], 1), (8, [0.0, 0.0], 1)]
    got, books = codes.compress(_vectors(spark, ODD + good), parts=2)
    assert sorted((r.id or -1, r.code) for r in got.collect()) == [(-1, [3, 3]), (8, [0, 0]), (9, [1, 1]), (9, [1, 1])]
    assert books.tolist() == [[[0], [512], [512], [102]], [[0], [-512], [-512], [204]]]
    assert codes.compress(_vectors(spark, ODD))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(_vectors(spark, good))
    with pytest.raises(ValueError, match="in one table"):
        codes.compress(_vectors(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]), parts=1)
    with pytest.raises(ValueError, match="64 bits"):
        codes.compress(_vectors(spark, [(1, [1e9], 1), (2, [3e38], 1)]), parts=1)


def test_op11_floors_negative_values_and_sums_null_labels(spark, tmp_path):
    _vectors(spark, [(1, [-0.0001, 0.0, 0.0, 0.0], None), (2, [0.5, 0.0, 0.0, 0.0], None), (3, [0.5, 0.0, 0.0, 1.0], 4)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in codes.op11(spark, str(tmp_path)).collect()}
    want = hashlib.sha256(",".join(map(str, [-1, 512, 512, 0, 0, 0, 0, 0, 0, 0, 0, 1024])).encode()).hexdigest()
    assert {i: (r.code, r.error, r.label_error) for i, r in got.items()} == {1: ("00000000", 0, 0), 2: ("01000000", 0, 0), 3: ("01000002", 0, 0)}
    assert {r.codebooks_sha256 for r in got.values()} == {want}


def _whitened(x, k):
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e


def test_op13_equals_the_covariance_s_eigenvectors(spark):
    rows = whiten.op13(spark, SMALL).toPandas()
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack(vectors.embedding).astype(float)) + 100_000
    want, e = _whitened(x, 8)
    trace = ((x - x.mean(0)) ** 2).sum() / len(x)
    for k in range(8):
        own = rows[rows.component == k + 1].sort_values("vec_id")
        assert own.vec_id.tolist() == vectors.vec_id.tolist()
        a = own.whitened.to_numpy()
        assert min(abs(a - want[:, k]).max(), abs(a + want[:, k]).max()) < 1e-9
        assert abs(own.explained.iloc[0] / (e[k] / trace) - 1) < 1e-10
    exactly = ((len(x) * x.astype(int) - x.astype(int).sum(0)) ** 2).sum(1)
    assert rows[rows.component == 1].sort_values("vec_id").deviation.tolist() == exactly.tolist()
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9 and set(rows.n) == {len(x)}


def test_whitening_of_few_directions_and_equal_eigenvalues(spark):
    """Two directions of equal extent and one of none: breakdown of the recurrence, and a fresh start vector."""
    corners = [(i, [float(a), float(b), 3.0], 0) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    rows, model = whiten.whiten(_vectors(spark, corners))
    assert len(model.eigenvalues) == 2 and np.allclose(model.eigenvalues, 1024**2) and np.allclose(model.trace, 2 * 1024**2)
    assert all(abs(sum(w * w for w in r.whitened) - 2) < 1e-9 and r.identity_error < 1e-9 for r in rows.collect())
    assert {int(r.deviation) for r in rows.collect()} == {2 * 4096**2}


def test_whitening_on_odd_rows(spark):
    good = [(1, [0.5, -0.25], 1), (None, [0.25, 0.75], None), (1, [0.5, -0.25], 1)]
    rows, model = whiten.whiten(_vectors(spark, ODD + good))
    got = rows.collect()
    assert len(got) == 3 and model.count == 3 and len(model.eigenvalues) == 1 and got[0].identity_error < 1e-9
    assert whiten.whiten(_vectors(spark, ODD))[0].count() == 0
    alone, of_one = whiten.whiten(_vectors(spark, [(1, [0.5, 0.5], 1)]))
    assert len(of_one.eigenvalues) == 0 and alone.first().whitened == []


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[1 << 40, -(1 << 40)]])
    assert whiten.deviations(x, 1 << 30, [1, 2]) == [((1 << 70) - 1) ** 2 + ((1 << 70) + 2) ** 2]


def test_op13_keeps_the_contract_without_components(spark, tmp_path):
    _vectors(spark, [(1, [0.5, 0.5], 1)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whiten.op13(spark, str(tmp_path)).count() == 0


def test_scaled_ignores_clashing_names(spark):
    table = integers.scaled(_vectors(spark, [(1, [0.5], 7)]), "vec_id", "label", "embedding", 2, 3)
    assert table.rows.collect() == [(1, 7, [4])]
