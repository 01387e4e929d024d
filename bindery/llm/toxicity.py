"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text, held apart by
document. Every window of a text is compressed with either; what the toxic dictionary saves tells how toxic it reads. How
likely each saving is in toxic and in ordinary documents is calibrated on documents that the dictionary at hand has not
seen; the mean log ratio over a text's windows, so normalised to its length, is mapped to a chance by a monotone curve.

Both dictionaries end with the same background of ordinary text. Without it common words that only one of the two happens
to hold change a window's length by three bytes (standard deviation), as much as a toxic word does.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import held_out, labelled_texts, sampled_labels, text_blocks

#: Labelled texts of each label value, about, that are learned from.
SAMPLE_ROWS = 3000
#: Bytes of windows that are compared, each text being cut in both ways, and of those that dictionaries are trained on: up to
#: the end of the last word or so many bytes more. After a cut within a word the next window starts some bytes before it.
WINDOWS, TRAINED, MORE, OVERLAP = (128, 96), 32, 64, 48
#: Bytes of the background; of each training of a dictionary's own part, which is trained once with pieces of each of these
#: sizes, as one training alone misses some words; training windows.
BACKGROUND, OWN, PIECES, MOST_WINDOWS = 160 << 10, 3 << 10, (16, 20, 24), 20_000
#: How often the toxic windows are chosen anew, from dictionaries so many times as large: large ones first, which hold words
#: that later ones can choose windows by. The share of ordinary windows that may save as much as a chosen one.
ROUNDS, ORDINARY_SHARE = (6, 3, 2, 1), 0.01
#: Savings in bytes that are told apart, and windows that a text counts as having besides its own.
MOST_SAVED, BESIDES = 9, 8
#: What an ordinary text called toxic weighs, in toxic texts missed.
FALSE_WEIGHT = 2.0

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fold(text: str | None) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""


def _windows(folded: bytes, size: int) -> list[bytes]:
    """Windows of bounded size; words of up to OVERLAP bytes at a cut stand whole in one of two."""
    out, at, n = [], 0, len(folded)
    while at < n:
        end = min(n, at + size)
        if end < n:
            blank = min((x for x in (folded.find(b" ", end, end + MORE), folded.find(b"\n", end, end + MORE)) if x >= 0), default=-1)
            end = blank if blank >= 0 else min(n, end + MORE)
        out.append(folded[at:end])
        at = end
        if at < n and not folded[at : at + 1].isspace() and size > OVERLAP:
            at -= OVERLAP
    return out


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    # tables with room for every position of a dictionary, so that its parts don't hide one another's matches
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, window_log=18, hash_log=17, chain_log=18, search_log=6, min_match=4, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def _sizes(how: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """Compressed length of each window, in batches of bounded size."""
    parts = [np.array([len(x) for x in how.multi_compress_to_buffer(windows[a : a + 8192], threads=1)], np.int64) for a in range(0, len(windows), 8192)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _train(windows: list[bytes], size: int, piece: int = PIECES[1], seed: int = 1) -> bytes:
    """A trained dictionary's text; of windows too few to train on, the windows themselves."""
    some = [windows[i] for i in np.random.default_rng(seed).permutation(len(windows))[:MOST_WINDOWS]]
    try:
        return _content(zstandard.train_dictionary(min(size, max(256, sum(map(len, some)) // 4)), some, k=piece, d=6, f=20, accel=1).as_bytes(), some)
    except zstandard.ZstdError:
        return b"".join(some)[:size]


def _content(raw: bytes, samples: list[bytes]) -> bytes:
    """A trained dictionary without its header of entropy tables: from the first position on where its bytes are a sample's."""
    text = b"\0".join(samples)
    low, high = 8, len(raw) - 16
    while low < high and raw[low : low + 16] not in text:
        low += 1
    return raw[low:]


def _own(windows: list[bytes], times: int = 1) -> bytes:
    return b"".join(_train(windows, OWN * times, piece, seed) for seed, piece in enumerate(PIECES))


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies of earlier ones, by three minima over hashed five-word shingles."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.split()
        hashed = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
        keys = [(k, int((hashed ^ np.uint64(salt)).min())) for k, salt in enumerate((0, 0x5555555555555555, 0x3C3C3C3C3C3C3C3C))]
        if not any(k in seen for k in keys):
            out.append(text)
        seen.update(keys)
    return out


class Model:
    """Both dictionaries, the log ratio of each saving, and the curve: slope and middle."""

    def __init__(self, ordinary: bytes, toxic: bytes, ratio: np.ndarray, curve: tuple[float, float] = (1.0, 0.0)):
        self.ordinary, self.toxic, self.ratio, self.curve = ordinary, toxic, ratio, curve
        self._both: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_both": None}

    def saved(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, 0 to MOST_SAVED."""
        if self._both is None:
            self._both = _compressor(self.ordinary), _compressor(self.toxic)
        plain, toxic = (_sizes(c, windows) for c in self._both)
        return np.clip(plain - toxic, 0, MOST_SAVED)

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Mean log ratio of each folded text's windows."""
        sums, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        # windows of many texts are compressed together, those of a very long one in parts
        held: list[bytes] = []
        of: list[int] = []

        def flush() -> None:
            if held:
                np.add.at(sums, of, self.ratio[self.saved(held)])
                held.clear()
                of.clear()

        for row, text in enumerate(texts):
            for at in range(0, len(text), 1 << 20):
                own = [w for size in WINDOWS for w in _windows(text[max(0, at - OVERLAP) : at + (1 << 20)], size)]
                count[row] += len(own)
                held += own
                of += [row] * len(own)
                if len(held) >= 1 << 15:
                    flush()
        flush()
        return sums / (count + BESIDES)

    def score(self, texts: list[str | None]) -> np.ndarray:
        slope, middle = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * (self.means([_fold(t) for t in texts]) - middle), -30, 30)))


def _ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log of how much likelier each saving is in toxic documents; never falls, so that more saved never reads less toxic."""
    share = lambda x: (np.bincount(x, minlength=MOST_SAVED + 1) + 2) / (len(x) + 2 * MOST_SAVED + 2)
    return np.maximum.accumulate(np.log(share(toxic) / share(ordinary)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve; its middle is the cut with the fewest errors, as weighed."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    false = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    cost = missed + FALSE_WEIGHT * false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate([x[:1] - 1e-3, (x[1:] + x[:-1]) / 2, x[-1:] + 1e-3])
    spread = np.quantile(x, 0.9) - np.quantile(x, 0.1)
    return float(4 / max(spread, 1e-3)), float(edges[best].mean())


def train(texts: list[str], y: np.ndarray) -> Model:
    """Dictionaries, log ratios and curve from labelled texts.

    Toxic documents stand in two halves. Which windows make a document toxic is not labelled: each half's dictionary chooses
    the windows of the other half that save more than ORDINARY_SHARE of ordinary windows do, a new dictionary is trained on
    those, and so on. The ordinary documents are divided between background, own part and calibration.
    """
    folded = [_fold(t) for t in texts]
    toxic, plain = (_distinct([t for t, v in zip(folded, y, strict=True) if v == k]) for k in (1, 0))
    lines = Counter(x for t in toxic + plain for x in set(t.split(b"\n")))
    # lines that several documents share tell of copying
    cut = lambda docs: [w for t in docs for w in _windows(b"\n".join(x for x in t.split(b"\n") if lines[x] < 2), TRAINED)]
    parts = toxic[::2], toxic[1::2]
    windows = [cut(p) for p in parts]
    back, other, check = plain[::4] + plain[1::4], plain[2::4], plain[3::4]
    background = _train(cut(back), BACKGROUND)
    reserve = cut(other)
    ordinary = _own(reserve) + background
    usual = [w for t in check for w in _windows(t, TRAINED)]
    model = lambda own, times=1: Model(_own(reserve, times) + background if times > 1 else ordinary, _own(own, times) + background, np.zeros(MOST_SAVED + 1))
    if not (all(windows) and usual):
        return Model(ordinary, ordinary, np.zeros(MOST_SAVED + 1))
    chosen = windows
    for times in ROUNDS:
        now = [model(own, times) for own in chosen]
        limit = [np.quantile(m.saved(usual), 1 - ORDINARY_SHARE) for m in now]
        found = [[w for w, s in zip(windows[k], now[1 - k].saved(windows[k]), strict=True) if s > limit[1 - k]] for k in (0, 1)]
        if not all(found):
            break
        chosen = found
    now = [model(own) for own in chosen]
    whole = lambda docs: [w for t in docs for size in WINDOWS for w in _windows(t, size)]
    ratio = _ratios(np.concatenate([now[1].saved(whole(parts[0])), now[0].saved(whole(parts[1]))]), np.concatenate([m.saved(whole(check)) for m in now]))
    for m in now:
        m.ratio = ratio
    means = [now[1].means(parts[0]), now[0].means(parts[1]), *[m.means(check) for m in now]]
    last = model(chosen[0] + chosen[1])
    last.ratio = ratio
    last.curve = _curve(np.concatenate(means), np.repeat([1, 0], [len(means[0]) + len(means[1]), 2 * len(check)]))
    return last


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model learned from about ``sample_rows`` texts of each label value, in one task.

    Held-out ids, null labels and null texts are never seen; of texts over SAMPLE_CHARS the sample has parts spread over the
    whole length, so its bytes are bounded too. None if fewer than two label values are there.
    """
    ids, counts = sampled_labels(labels, label, sample_rows, id_col)
    if len(counts) < 2:
        return None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        m = train(rows["text"].tolist(), rows["label"].to_numpy())
        out = io.BytesIO()
        np.savez(out, ordinary=np.frombuffer(m.ordinary, np.uint8), toxic=np.frombuffer(m.toxic, np.uint8), ratio=m.ratio, curve=np.array(m.curve))
        return pd.DataFrame({"model": [out.getvalue()]})

    sample = labelled_texts(docs, ids, id_col, text_col)
    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    if not got:
        return None
    parts = np.load(io.BytesIO(got[0]["model"]))
    return Model(parts["ordinary"].tobytes(), parts["toxic"].tobytes(), parts["ratio"], tuple(parts["curve"].tolist()))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` and score (0 to 1), the chance of label 1; 0 everywhere without a model.

    Null and empty texts have no window and score as a text without any sign would; texts of any length are read whole, in
    parts. Ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            got = model.score(batch.column(1).to_pylist()) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
