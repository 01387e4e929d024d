"""Learned operators: held-out accuracy, contracts, odd tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import common, langid, quality, toxicity, urls

TABLE = "/root/testdata/sf0.01"
ROWS = [(1, "the of and to", "en"), (None, "null id", "en"), (2, None, "de"), (3, "", "de"), (4, "12 34 !?", "de"), (4, "12 34 !?", "de"), (5, "word " * 40_000, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "score": F.lit("s"), "label": F.lit(2), "machine": F.lit(3)})


def rate(df, ok):
    return df.where("held_out").agg(F.avg(ok.cast("double"))).first()[0]


def test_language_held_out(spark):
    got = langid.op2(spark, TABLE).join(spark.read.parquet(f"{TABLE}/documents.parquet"), "doc_id")
    assert got.count() == 1000
    assert rate(got, F.col("lang") == F.col("lang_pred")) > 0.98
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_odd(spark, odd):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ROWS)
    by_text = {ROWS[i][1]: None for i in range(len(ROWS))}
    for r in got:
        if r.doc_id in (2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert by_text
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 4)").count() == 0
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), one).collect()} == {"fr"}


def test_language_rejection(spark):
    """Junk and foreign text go, nearly all labelled documents that no model has seen stay, and so do short ones."""
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    model = langid.fit(docs)
    habits = langid.calibrate(docs, model)
    junk = ["xqzkj vbnmw qwrtp zxcvb plkjh fghjk mnbvc " * 5, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, "人人生而自由在尊严和权利上一律平等" * 5, "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. " * 3, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 3, "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0aGlz" * 3, "qx" * (1 << 20)]
    rows = spark.createDataFrame([*enumerate(junk), (50, "the of and to"), (51, "a"), (52, "de la"), (53, "12")], "doc_id long, text string")
    assert {r.doc_id for r in langid.accepted(rows, model, habits=habits).collect()} == {50, 51, 52}
    unseen = docs.where(common.held_out())
    assert langid.accepted(unseen, model, habits=habits).count() >= 0.99 * unseen.count()
    one = langid.fit(docs.where("lang = 'fr'"))
    assert langid.accepted(rows.where("doc_id < 50"), one, habits=langid.calibrate(docs.where("lang = 'fr'"), one)).count() == 0


def test_three_languages_of_one_family(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").withColumn("lang", F.when(F.col("lang") == "en", "it").otherwise(F.col("lang")))
    got = langid.predict(docs, langid.fit(docs)).join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_prediction_ignores_block_borders(spark):
    texts = [r.text for r in spark.read.parquet(f"{TABLE}/documents.parquet").limit(20).collect()]
    model = langid.fit(spark.read.parquet(f"{TABLE}/documents.parquet"), sample_rows=50)
    together = model.predict(pa.array(texts, pa.string()))
    alone = [model.predict(pa.array([t], pa.string())) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert together[1] == pytest.approx([a[1][0] for a in alone], abs=1e-4)


def test_long_texts_are_read_in_runs(monkeypatch):
    rng = np.random.default_rng(1)
    texts = pa.array(["", "é" * 700, "".join(rng.choice(list("abc dé"), 5000)), "a", None, "b" * 1000], pa.string())
    weights = rng.normal(size=(langid.FEATURES, 3)).astype(np.float32)
    whole = langid.gram_sums(texts, weights)
    for run in (3, 700, 1000):
        monkeypatch.setattr(langid, "RUN", run)
        assert np.allclose(langid.gram_sums(texts, weights), whole)


def test_quality_held_out(spark):
    """Both labels' shares that are found, apart."""
    got = quality.op4(spark, TABLE)
    assert got.count() == 1000
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    known = got.join(spark.read.parquet(f"{TABLE}/labels.parquet"), "doc_id")
    for label in (0, 1):
        assert rate(known.where(F.col("quality") == label), F.col("quality") == F.col("predicted")) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, odd, module):
    docs, labels = spark.read.parquet(f"{TABLE}/documents.parquet"), spark.read.parquet(f"{TABLE}/labels.parquet")
    model = module.fit(docs, labels.withColumn("text", F.lit("clash")), sample_rows=100)
    got = module.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert module.score(odd.limit(0), model).count() == 0
    assert module.fit(docs, labels.limit(0)) is None
    assert module.fit(docs, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})) is None
    assert module.score(odd, None).count() == len(ROWS)


def invented(rng, n, toxic, lengths):
    """Texts of invented words; toxic ones hold one of six words (or of two beginnings) in forty, two at least."""
    parts = ["an", "er", "th", "on", "in", "re", "ou", "st", "ti", "ea", "ng", "ha", "le", "ed", "or", "sh"]
    bad = ["gromble", "vexnark", "drizzik", "plumfuk", "skorbat", "wuzzlop", "klomp*", "jarvi*"]
    out = []
    for _ in range(n):
        k = int(rng.choice(lengths))
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(k)]
        if toxic:
            for _ in range(max(2, k // 40)):
                w = str(rng.choice(bad))
                words.insert(int(rng.integers(0, len(words) + 1)), w.replace("*", "".join(rng.choice(parts, 2))))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def compressed():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = invented(rng, 600, True, [30, 100, 300]) + invented(rng, 1200, False, [30, 100, 300])
    return rng, toxicity.train(texts, np.repeat([1, 0], [600, 1200]))


@pytest.mark.parametrize("length", [30, 120, 500, 4000])
def test_planted_toxic_texts(compressed, length):
    """Recall and false alarms apart, on texts of one length each."""
    rng, model = compressed
    n = min(100, 40_000 // length)
    assert (model.score(invented(rng, n, True, [length])) >= 0.5).mean() >= 0.85
    assert (model.score(invented(rng, 2 * n, False, [length])) >= 0.5).mean() <= 0.06


def test_toxicity_of_long_texts(compressed):
    """Length alone is no sign, with or without blanks; a text that is toxic throughout is seen at any length."""
    rng, model = compressed
    clean, toxic = invented(rng, 1, False, [250_000])[0], invented(rng, 1, True, [50_000])[0]
    assert len(clean) > 1_000_000
    assert (model.score([clean, "".join(clean.split()), clean[:700_000]]) < 0.5).all()
    assert model.score([toxic])[0] > 0.5
    assert max(len(w) for n in toxicity.WINDOWS for w in toxicity._windows("".join(clean.split()).encode(), n)) <= max(toxicity.WINDOWS) + toxicity.MORE


def test_toxicity_by_hand(spark, compressed):
    """The whole table against a plain scorer: window by window, each compressed alone."""
    import numpy as np

    _, model = compressed
    plain, toxic = (toxicity._compressor(d) for d in (model.ordinary, model.toxic))

    def by_hand(text):
        ws = [w for n in toxicity.WINDOWS for w in toxicity._windows(toxicity._fold(text), n)]
        mean = sum(float(model.ratio[min(max(len(plain.compress(w)) - len(toxic.compress(w)), 0), toxicity.MOST_SAVED)]) for w in ws) / (len(ws) + toxicity.BESIDES)
        return 1 / (1 + np.exp(-model.curve[0] * (mean - model.curve[1])))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i] == pytest.approx(by_hand(t), abs=1e-9) for i, t in texts.items())


def test_toxicity_held_out(spark):
    """Of the toxic texts of this table 45 of 97 held out hold none of the words in which the others differ from ordinary text; what can
    be told is told of the rest."""
    words = "trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron"
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.coalesce(F.lower("text").rlike(words), F.lit(False)).alias("marked"))
    got = toxicity.op9(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").join(texts, "doc_id").where("held_out")
    toxic = F.col("toxic") == 1
    caught, of_marked, false = got.agg(F.avg(F.when(toxic, F.col("predicted"))), F.avg(F.when(toxic & F.col("marked"), F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert caught >= 0.45 and of_marked >= 0.85 and false <= 0.04  # 350 toxic texts to learn from


def test_quality_by_hand(spark):
    """The whole table, each text alone and passage by passage, and in slices, against the batched scores."""
    import numpy as np

    rng = np.random.default_rng(1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    net = quality.train(list(texts.values())[:60], rng.integers(0, 2, 60).astype(np.float32), np.ones(60, np.float32), epochs=2)

    def by_hand(text):
        x, n = quality.passages(pa.array([text], pa.string()))
        assert n.tolist() == [max(1, -(-len(text.encode()) // quality.PASSAGE))]
        p = net.p
        h = np.tanh((x - p["mean"]) / p["std"] @ p["W"] + p["b"])
        s = np.array([float((np.tanh(row @ p["V"]) / (1 + np.exp(-(row @ p["U"])))) @ p["w"]) for row in h])
        a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        return 1 / (1 + np.exp(-(sum(w * row for w, row in zip(a, h, strict=True)) @ p["c"] + p["c0"])))

    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i] == pytest.approx(by_hand(t), abs=1e-5) for i, t in texts.items())
    long = "".join(texts.values())
    long = pa.array([long * (1 + 3_000_000 // len(long))])
    assert net.score(long)[0] == pytest.approx(net.forward(*quality.passages(long))["y"][0], abs=1e-4)


def test_language_by_hand(spark):
    """The whole table against one dot product a machine on each text's own n-gram counts."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, sample_rows=40)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    of = langid.families_of(model.langs)

    def winner(x, level, names):
        votes = dict.fromkeys(names, 0.0)
        for j, (own, a, b) in enumerate(model.machines):
            if own == level:
                votes[a if x @ model.w[:, j] + model.b[j] > 0 else b] += 1
        return max(sorted(votes), key=votes.get)

    for r in docs.collect():
        x = langid._features([r.text])[0].astype(np.float64)
        family = winner(x, "family", set(of.values()))
        assert got[r.doc_id] == winner(x, family, {k for k, f in of.items() if f == family})


def test_label_values_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "text", f"x{i}") for i in range(12)], "doc_id long, text string, lang string")
    monkeypatch.setattr(common, "MOST_VALUES", 5)
    with pytest.raises(ValueError, match="over 5 values"):
        langid.fit(docs)
    langs = [f"q{i:03d}" for i in range(100)]
    assert len(set(langid.families_of([*langs, "en"]).values())) == 1 + -(-100 // langid.TOGETHER)
    assert len(langid._machines(langs)) < 1000
    monkeypatch.setattr(langid, "MOST_MODEL_BYTES", 1)
    with pytest.raises(ValueError, match="machines"):
        langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), sample_rows=10)


def test_excerpt_covers_the_whole_text(spark):
    df = spark.createDataFrame([("".join(f"{i:06d}" for i in range(100_000)),), ("short",), (None,)], "t string")
    long, short, none = (r[0] for r in df.select(common.excerpt(F.col("t"), 6400)).collect())
    assert len(long) == 6400 and long.startswith("000000") and long.endswith("099999") and short == "short" and none is None


def test_attention_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = ["abc def " * k for k in range(1, 6)]
    net = quality.train(texts, np.array([0, 1, 0, 1, 1.0], np.float32), np.ones(5, np.float32), epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = quality.passages(pa.array(["x y " * 400, "Z! " * 100]))
    y, w = np.array([1.0, 0.0]), np.ones(2)
    loss = lambda: -(w / w.sum() * (y * np.log(net.forward(x, n)["y"]) + (1 - y) * np.log(1 - net.forward(x, n)["y"]))).sum()
    grad = net.gradients(x.astype(np.float64), n, y, w)
    for k in ("W", "V", "U", "w", "c"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_urls_by_hand(spark):
    odd = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "HTTP://A.Example.NET/en/x?y#z"), (5, "HTTP://A.Example.NET/en/x?y#z"), (6, "http://net?x"), (7, "http://net/"), (8, "http://é.ORG/fr/\nx"), (9, "a://b://c/d"), (None, "http://example.com/de/"), (10, "http://notexample.com/de/"), (11, "x://h.net/" + "a" * 5000)]
    pages = spark.read.parquet(f"{TABLE}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string")).withColumns({"host": F.lit(1), "rule": F.lit(2), "features": F.lit(3)})
    said = {h + p: v for v, h, p in urls.RULES}
    rows = urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score").collect()
    want = sorted(((r.page_id, *judged(r.url)) for r in pages.collect()), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=str) == want
    assert all(r.verdict == said[r.rule] if r.rule else r.verdict == ("block" if r.score > 0.5 else "allow") for r in rows)
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")).collect()} == {"allow"}


def test_url_trees_learn(spark):
    """Labelled urls that the rules say nothing about by name: digits in the path mean a block."""
    rows = [(i, f"http://h{i % 7}.{'net' if i % 2 else 'org'}/fr/{'9' * 12 if i % 2 else 'abc'}") for i in range(400)]
    rows += [(1000 + i, f"http://h{i}.com/fr/{'9' * 12 if i % 2 else 'abc'}") for i in range(40)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 36


@pytest.mark.parametrize("texts", ["one", "many"])
def test_samples_are_bounded_however_often_an_id_repeats(spark, texts):
    """One id on 20,000 rows, with one text or as many texts."""
    from pyspark.sql import functions as F

    from bindery.llm import common

    text = F.lit("the same words") if texts == "one" else F.concat(F.lit("words number "), F.col("id").cast("string"))
    hot = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    few = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.concat(F.lit("andere "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    docs = hot.unionByName(few)
    assert not docs.where("doc_id = 3").select(common.held_out().alias("h")).first()["h"]
    got = {r["label"]: r["count"] for r in common.labelled_sample(docs, "lang", 500, "doc_id", "text").groupBy("label").count().collect()}
    assert got["en"] == 1 if texts == "one" else 350 < got["en"] < 650
    assert 30 < got["de"] <= 60
    labels = docs.select("doc_id").distinct().withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    ids, counts = common.sampled_labels(labels, "quality", 1500, "doc_id")
    sample = common.labelled_texts(docs, ids, "doc_id", "text")
    assert sample.count() == ids.count() == sample.select("id").distinct().count() == sum(counts.values())
    assert sample.where("id = 3").count() == 1


def test_language_learns_from_every_labelled_text(spark):
    """Words that one of 900 texts alone has move a machine and the habits, and ends of long texts count."""
    from pyspark.sql import functions as F

    words = F.concat(F.lit("the same words "), F.col("id").cast("string"))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), words.alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang")).where(~common.held_out())
    one = docs.where("lang = 'en'").agg(F.max("doc_id")).first()[0]
    end = F.when(F.col("doc_id") == one, F.concat(F.repeat(F.lit("a b "), 40_000), F.lit("zqzqzqzq"))).otherwise(F.col("text"))
    more = docs.withColumn("text", end)
    at = int(np.unique(langid._hashes(np.frombuffer(b"qzq", np.uint8))[2][1])[0])
    plain, moved = (langid.fit(x, sample_rows=50) for x in (docs, more))
    assert plain.w[at].max() == plain.w[at].min() == 0
    assert moved.w[at].any()
    seen = sum(len(langid.learned_from(x).collect()) for x in (docs, more))
    assert seen == 2 * docs.count()
    dealt, blocks = langid._dealt(langid.learned_from(docs), common.key_counts(langid.learned_from(docs), "label", "mark"), 50)
    assert blocks > 3 and dealt.select("label", "mark").distinct().count() == docs.count()
    assert dealt.select("block", "label").distinct().count() == 2 * blocks
