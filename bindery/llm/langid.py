"""Language identification by hierarchical discrimination.

A first level of linear support vector machines tells language families apart, one against one; within a family,
one-versus-one machines separate its languages. Features are hashed letter n-grams of one to three bytes, relative to the
text's length. All labelled texts are dealt to blocks; Spark tasks fit every machine on each block, and what the blocks found is
averaged. The machines are applied in one pass over the texts.

Machines always name a winner, however foreign the text. What is rejected is told by ``Habits``: how likely a text's
trigrams are in the language that won, against limits calibrated on labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import give_back, held_out, joined_bytes, key_counts, text_blocks
from bindery.operators.ranks import numbered

#: Families by language code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
}
FEATURES = 1 << 13
#: Bytes of text that are worked on at once; longer texts are read in runs of as many.
RUN = 1 << 20
#: Texts of the commonest language, about, that are learned from at once, in a block; and of a rare one at least, if it has
#: as many: its texts are in several blocks, so that none is without.
SAMPLE_ROWS, LEAST_ROWS = 200, 20
#: Parts that an array of FEATURES is added up in; languages of fewer texts learn and judge by all of them.
SLICES, FEW = 16, 16
UNKNOWN = "und"
#: Score under which a document is rejected whatever its trigrams; no winner of one machine a level is under it.
LEAST_SCORE = 0.25
#: Quantile of a language's own documents that its limit starts from; standard errors that short texts have to spare.
LOW, ERRORS = 0.01, 3.0

_LETTER = regex.compile(r"\p{L}")
#: A-Z lowered, other bytes under 128 that are no letters to blanks.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)
_GRAMS = ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D))


#: Languages without a known family that make up one of their own, so that machines don't grow with their square.
TOGETHER = 16
#: Bytes of weights that may go to every task; more languages than that allows stop the job.
MOST_MODEL_BYTES = 256 << 20


def families_of(langs: list[str]) -> dict[str, str]:
    """Family of each language; codes without a known one are put together by their order."""
    known = {x: f for f, own in FAMILIES.items() for x in own}
    rest = sorted(x for x in langs if x not in known)
    few = len(rest) <= TOGETHER
    return {x: known.get(x) or (x if few else f"others {rest.index(x) // TOGETHER}") for x in langs}


def _hashes(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(n, bucket at each start) of the n-grams of one run of bytes."""
    folded = _FOLD[data]
    out, gram = [], np.zeros(len(folded), np.uint32)
    for n, seed in _GRAMS:
        if len(folded) < n:
            break
        gram = gram[: len(folded) - n + 1] * np.uint32(257) + folded[n - 1 :]
        out.append((n, ((gram * np.uint32(seed)) >> np.uint32(32 - 13)).astype(np.int32)))
    return out


def gram_sums(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """(texts, columns): mean weight of the n-grams of each text, summed over the n-gram lengths; weights by bucket."""
    data, offsets = joined_bytes(texts)
    sums = np.zeros((len(texts), weights.shape[1]))
    for start in range(0, len(data), RUN):
        for n, at in _hashes(data[start : start + RUN + len(_GRAMS) - 1]):
            at = at[:RUN]
            lens = np.maximum(np.diff(offsets) - n + 1, 0)
            # n-grams that reach into the next text belong to none
            first, end = np.clip(offsets[:-1] - start, 0, len(at)), np.clip(offsets[:-1] + lens - start, 0, len(at))
            some = np.flatnonzero(first < end)
            if not len(some):
                continue
            edges = np.stack([first[some], end[some]], 1).ravel()
            for c in range(weights.shape[1]):
                sums[some, c] += np.add.reduceat(np.append(weights[:, c][at], 0), edges)[::2] / lens[some]
    return sums


def _features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts, sizes = np.zeros((len(_GRAMS), FEATURES)), np.zeros(len(_GRAMS))
        for start in range(0, len(raw), RUN):
            for n, at in _hashes(raw[start : start + RUN + len(_GRAMS) - 1]):
                counts[n - 1] += np.bincount(at[:RUN], minlength=FEATURES)
                sizes[n - 1] += len(at[:RUN])
        for own, size in zip(counts, sizes, strict=True):
            out[row] += own / max(size, 1)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent on the Gram matrix; y is 1 or -1. Scales ``x`` in place."""
    scale = float(np.sqrt(np.einsum("ij,ij->i", x, x).mean())) or 1.0
    x /= np.float32(scale)
    gram = (x @ x.T).astype(np.float64)
    gram += 1.0
    top = c * len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # classes count alike
    alpha, out = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * out[i] - 1) / gram[i, i], 0.0), top[i])
            if (d := new - alpha[i]) != 0:
                out += d * y[i] * gram[:, i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    # in the type of x: a product of mixed types would hold all of x a second time, twice as large
    return (alpha * y).astype(x.dtype) @ x / np.float32(scale), float((alpha * y).sum())


def _machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(level, positive, negative): families one against one, then languages within a family."""
    of = families_of(langs)
    families = sorted(set(of.values()))
    out = [("family", a, b) for a, b in combinations(families, 2)]
    return out + [(f, a, b) for f in families for a, b in combinations(sorted(x for x in langs if of[x] == f), 2)]


def _pieces(key: str, n: float, values: np.ndarray, bias: float = 0.0) -> pa.RecordBatch:
    """Rows of ADDED: an array in SLICES parts, and one more with a number."""
    parts = [*np.split(values.astype(np.float64), SLICES), np.array([bias])]
    return pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([float(n)] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "part", "n", "w"])


ADDED = "key string, part int, n double, w binary"


def _totals(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, float]]:
    """Of each key the sums of what tasks found, as (n, array, number); tasks give a row for each part at most, whatever they read."""

    def add(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("w")  # one order, so that sums don't depend on that of the tasks
        w = np.sum([np.frombuffer(x) for x in own["w"]], axis=0)
        return pd.DataFrame({"key": [own["key"].iloc[0]], "part": [own["part"].iloc[0]], "n": [own["n"].sum()], "w": [w.tobytes()]})

    got: dict[str, dict[int, tuple[float, np.ndarray]]] = {}
    for r in rows.groupBy("key", "part").applyInPandas(add, ADDED).collect():
        got.setdefault(r["key"], {})[r["part"]] = r["n"], np.frombuffer(r["w"])
    return {k: (v[0][0], np.concatenate([v[x][1] for x in range(SLICES)]), float(v[SLICES][1][0])) for k, v in got.items()}


def _fit_blocks(classes: list[dict[str, int]]):
    """Rows (block, label, mark, text), sorted, to ADDED: of each machine the sum over blocks of weights, times the block's rows.

    ``classes`` has for each machine the class, 1 or -1, of the labels that it tells apart. A row that repeats counts once. Texts go as soon as
    their n-grams are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: dict[int, np.ndarray] = {}
        b, seen = np.zeros(len(classes)), np.zeros(len(classes))
        held: list[tuple[str, np.ndarray, np.ndarray]] = []
        now, last = None, None

        def learn() -> None:
            for k, of in enumerate(classes):
                own = [x for x in held if x[0] in of]
                y = np.array([of[x[0]] for x in own], float)
                if len(set(y)) < 2:
                    continue
                x = np.zeros((len(own), FEATURES), np.float32)
                for row, (_, at, values) in enumerate(own):
                    x[row, at] = values
                weights, bias = fit_svm(x, y)
                w[k] = w.get(k, 0.0) + len(own) * weights.astype(np.float64)
                b[k] += len(own) * bias
                seen[k] += len(own)
            held.clear()

        for batch in batches:
            for block, label, mark, text in zip(*[batch.column(c) for c in range(4)], strict=True):
                block, key = block.as_py(), (label.as_py(), mark.as_py())
                if block != now:
                    learn()
                    now, last = block, None
                if key != last:
                    x = _features([text.as_py()])[0]
                    at = np.flatnonzero(x)
                    held.append((key[0], at, x[at]))
                    last = key
        learn()
        for k, x in w.items():
            yield _pieces(str(k), seen[k], x, b[k])
        give_back()

    return run


class Model:
    """Languages, machines and their weights; a few dozen KB for each machine."""

    def __init__(self, langs: list[str], machines: list[tuple[str, str, str]], w: np.ndarray, b: np.ndarray):
        self.langs, self.machines, self.w, self.b = langs, machines, w, b

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, [0.0] * n
        plain = texts.to_pylist()
        has = np.array([bool(t) and _LETTER.search(t) is not None for t in plain], bool)
        margin = gram_sums(texts, self.w) + self.b if len(self.machines) else np.zeros((n, 0))
        chance = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
        of = families_of(self.langs)
        families = sorted(set(of.values()))
        first, fscore = self._vote(margin, chance, "family", families)
        pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for k, family in enumerate(families):
            own = sorted(x for x in self.langs if of[x] == family)
            best, lscore = self._vote(margin, chance, family, own)
            at = has & (first == k)
            pred[at] = np.array(own, object)[best[at]]
            score[at] = (fscore * lscore)[at]
        return pred.tolist(), score.tolist()

    def _vote(self, margin: np.ndarray, chance: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes (ties: the larger sum of margins) and its mean chance."""
        n = len(margin)
        votes, sums, mean = (np.zeros((n, len(names))) for _ in range(3))
        for j, (of, a, b) in enumerate(self.machines):
            if of == level:
                a, b = names.index(a), names.index(b)
                votes[:, a] += margin[:, j] > 0
                votes[:, b] += margin[:, j] <= 0
                sums[:, a] += np.tanh(margin[:, j])
                sums[:, b] -= np.tanh(margin[:, j])
                mean[:, a] += chance[:, j] / max(1, len(names) - 1)
                mean[:, b] += (1 - chance[:, j]) / max(1, len(names) - 1)
        if len(names) == 1:
            mean[:] = 1.0
        best = (votes + sums / (2 * len(names) + 1)).argmax(1)
        return best, mean[np.arange(n), best]


def learned_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, label, mark) of every labelled text, whole, but those held out; mark is a hash of id and text."""
    text, label = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull() & label.isNotNull() & ~held_out(id_col))
    return rows.select(text.alias("text"), label.alias("label"), F.xxhash64(F.col(id_col), text).alias("mark"))


def _dealt(rows: DataFrame, counts: dict[str, int], each: int) -> tuple[DataFrame, int]:
    """``rows`` with ``block``, and how many blocks there are: every row is in one, those of rare labels in several."""
    blocks = max(1, -(-max(counts.values()) // each))
    times = F.lit(1)
    for label, n in counts.items():
        if (more := min(blocks, -(-LEAST_ROWS * blocks // n))) > 1:
            times = F.when(F.col("label") == F.lit(label), more).otherwise(times)
    turn = F.explode(F.sequence(F.lit(0), times - 1)).alias("turn")
    spread = rows.select("*", times.alias("times"), turn)
    block = F.pmod(F.pmod("mark", F.lit(blocks)) + F.floor(F.col("turn") * F.lit(blocks) / F.col("times")), F.lit(blocks))
    return spread.select(block.cast("int").alias("block"), "label", "mark", "text"), blocks


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit all machines on all labelled texts but those held out, in blocks of about ``sample_rows`` of the commonest language.

    A machine is the mean of those fitted on the blocks, by their rows. Machines number about as many as half the square of the
    families and eight times the languages; a model of over MOST_MODEL_BYTES stops the job, as it goes to every task.
    """
    rows = learned_from(docs, id_col, text_col, lang_col)
    counts = key_counts(rows, "label", "mark")
    langs = sorted(counts)
    machines = _machines(langs)
    if not machines:
        return Model(langs, [], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    if 4 * FEATURES * len(machines) > MOST_MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages need {len(machines)} machines, over {MOST_MODEL_BYTES} bytes")
    of = families_of(langs)
    kind = lambda level, x: of[x] if level == "family" else x
    classes = [{x: 1 if kind(level, x) == a else -1 for x in langs if kind(level, x) in (a, b)} for level, a, b in machines]
    dealt, blocks = _dealt(rows, counts, sample_rows)
    parts = min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = _totals(dealt.repartition(parts, "block").sortWithinPartitions("block", "label", "mark").mapInArrow(_fit_blocks(classes), ADDED))
    w, b = np.zeros((FEATURES, len(machines)), np.float32), np.zeros(len(machines))
    for k, (n, weights, bias) in got.items():
        w[:, int(k)], b[int(k)] = weights / n, bias / n
    return Model(langs, machines, w, b)


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams that aren't blank, in runs of bounded size."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(1, len(raw) - 2), RUN):
        run = raw[at : at + RUN + 2]
        if len(run) > 2:
            said = _FOLD[run] != 32
            yield _hashes(run)[2][1][said[:-2] | said[1:-1] | said[2:]]


class Habits:
    """Per language the log chance of each trigram, and the least mean of it that a text of the language has."""

    def __init__(self, langs: list[str], logs: np.ndarray, least: np.ndarray, error: np.ndarray):
        self.langs, self.logs, self.least, self.error = {x: j for j, x in enumerate(langs)}, logs, least, error

    def fits(self, text: str, lang: str) -> bool:
        """The text's trigrams are as likely as the language's own; too few to tell count as likely."""
        j = self.langs[lang]
        n, total = 0, 0.0
        for at in _trigrams(text):
            n, total = n + len(at), total + float(self.logs[j][at].sum(dtype=np.float64))
        return not n or total / n >= self.least[j] - ERRORS * self.error[j] / np.sqrt(n)


def _chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to ADDED: how often each trigram is in a task's texts of each label."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = counts.setdefault(label, np.zeros(FEATURES))
            for at in _trigrams(text.as_py()):
                own += np.bincount(at, minlength=FEATURES)
    for label, own in counts.items():
        yield _pieces(label, 1, own)
    give_back()


def _judged(model: Model, logs: dict[str, np.ndarray]):
    """(label, text) to (label, kind, value): of texts that the machines name right the mean (``own``) and deviation (``error``) of their
    trigrams' log chances, and the mean with the letters in random order (``junk``)."""

    def likely(text: str, of: np.ndarray) -> tuple[float, float] | None:
        """Of no text more than a run is held."""
        n, total, squares = 0, 0.0, 0.0
        for at in _trigrams(text):
            x = of[at]
            n, total, squares = n + len(x), total + float(x.sum()), squares + float(x @ x)
        return (total / n, max(0.0, squares / n - (total / n) ** 2) ** 0.5) if n else None

    def mixed(text: str) -> str:
        """All letters, in an order that depends on their number alone."""
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.random.default_rng(5).permutation(letters).tobytes().decode("utf-32-le", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, RUN):
            out = []
            for label, text, named in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), model.predict(batch.column(1))[0], strict=True):
                if named == label and (own := likely(text, logs[label])):
                    out += [(label, "own", own[0]), (label, "error", own[1])]
                    if junk := likely(mixed(text), logs[label]):
                        out.append((label, "junk", junk[0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["label", "kind", "value"])
        give_back()

    return run


def calibrate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Habits:
    """``Habits`` of the languages from all labelled texts but those held out.

    Half of them, by a hash, give the chances. The other half, where the machines name them right, says how likely own text is, and
    the same text with its letters in random order how likely junk is; the limit lies midway. Quantiles are exact, of all texts.
    """
    rows = learned_from(docs, id_col, text_col, lang_col)
    counts = key_counts(rows, "label", "mark")
    few = F.col("label").isin([x for x, n in counts.items() if n < FEW])
    half = F.pmod(F.xxhash64("mark"), F.lit(2)) == 0
    found = _totals(rows.where(few | half).select("label", "text").mapInArrow(_chances, ADDED))
    langs = sorted(counts)
    logs = {x: np.log((c := found[x][1] + 0.5 if x in found else np.full(FEATURES, 0.5)) / c.sum()) for x in langs}
    judged = rows.where(few | ~half).select("label", "text").mapInArrow(_judged(model, logs), "label string, kind string, value double")
    ranked = numbered(judged, ["label", "kind"], ["value"], number="at", total="n")
    place = (F.col("n") - 1) * F.when(F.col("kind") == "own", LOW).otherwise(0.5)
    near: dict[tuple[str, str], list[tuple[float, float]]] = {}
    for r in ranked.select("*", place.alias("place")).where("at - 1 in (floor(place), ceil(place))").collect():
        near.setdefault((r["label"], r["kind"]), []).append((r["value"], 1 - abs(r["place"] - (r["at"] - 1))))
    value = {k: sum(v * share for v, share in x) for k, x in near.items()}
    # without a text to judge by: what random trigrams give
    least = [(value.get((x, "own"), logs[x].mean()) + value.get((x, "junk"), logs[x].mean())) / 2 for x in langs]
    error = [value.get((x, "error"), logs[x].std()) for x in langs]
    return Habits(langs, np.stack([logs[x].astype(np.float32) for x in langs]) if langs else np.zeros((0, FEATURES), np.float32), np.array(least), np.array(error))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, lang_pred and score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as are all texts if no language was learned. Ids may be
    null or repeated; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, RUN):
            pred, score = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text", habits: Habits | None = None) -> DataFrame:
    """``docs`` with all columns, without the rows whose language is ``und`` or whose score is under ``least``.

    With ``habits`` texts go too that read unlike the language that won: junk, foreign text, texts largely of either. Null and
    empty texts and texts without a letter are ``und`` and go; rows with a null id, repeated rows and ties are judged one by
    one like any other; texts of any length are read whole; an empty table gives an empty result.
    """
    @F.arrow_udf("boolean")
    def accept(texts: pa.Array) -> pa.Array:
        out = []
        for block in text_blocks([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], ["id", "text"])], RUN):
            pred, score = model.predict(block.column(1))
            ok = [p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)]
            out += [k and (habits is None or habits.fits(t.as_py(), p)) for k, t, p in zip(ok, block.column(1), pred, strict=True)]
        give_back()
        return pa.array(out, pa.bool_())

    return docs.where(accept(F.col(text_col).cast("string")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
