"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from hashed byte pairs and a few counts, a gated attention layer
learned from document labels alone weighs the encodings, and the weighted sum is scored. The network is fitted in one
Spark task on a bounded sample and applied in one pass over whole texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import held_out, joined_bytes, labelled_texts, sampled_labels, text_blocks

#: Bytes of a passage; the last of a text may be shorter.
PASSAGE = 512
#: Bytes of a text that are encoded at once; longer texts go slice by slice, whole passages each.
SLICE = PASSAGE * 2048
#: Labelled texts of each label value, about, that the network learns from.
SAMPLE_ROWS = 1500
PAIRS, SPREAD, ENCODED, GATE = 256, 1024, 32, 16

#: Classes of bytes that are counted: upper, lower, digit, blank, line end, other ASCII, high.
_CLASS = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 4 if c in (10, 13) else 3 if c in (9, 32) else 6 if c >= 128 else 5 for c in range(256)])


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and the number of passages of each text, one at least."""
    return _encoded(*joined_bytes(texts))


def _encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    at = np.repeat(first, sizes) + (np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) // PASSAGE
    length = np.maximum(np.bincount(at, minlength=total), 1)[:, None]
    counts = np.bincount(at * 7 + _CLASS[data], minlength=total * 7).reshape(total, 7)
    pair = np.zeros(len(data), np.int64)
    wide = np.zeros(len(data), np.int64)
    if len(data) > 4:
        d = data.astype(np.uint32)
        pair[:-1] = ((d[:-1] * np.uint32(257) + d[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        four = ((d[:-3] * np.uint32(257) + d[1:-2]) * np.uint32(257) + d[2:-1]) * np.uint32(257) + d[3:]
        wide[:-3] = (four * np.uint32(0x85EBCA77)) >> np.uint32(22)
        for back in (1, 2, 3):  # pairs and fours that reach into the next text belong to none
            last = offsets[1:][sizes >= back] - back
            wide[last] = 0
            if back == 1:
                pair[last] = 0
    hist = np.bincount(at * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS)
    spread = np.count_nonzero(np.bincount(at * SPREAD + wide, minlength=total * SPREAD).reshape(total, SPREAD), axis=1)[:, None]
    share = hist / length
    extra = [counts / length, spread / length, spread / SPREAD, share.max(1)[:, None], (share**2).sum(1)[:, None], np.minimum(length, PASSAGE) / PASSAGE]
    return np.hstack([np.sqrt(share), *extra]).astype(np.float32), n


def _softmax_sum(s: np.ndarray, h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights within each bag and the weighted sums."""
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    a = e / np.repeat(np.add.reduceat(e, starts), n)
    return a, np.add.reduceat(a[:, None] * h, starts, axis=0)


class Network:
    """Encoder, gated attention and score; ``p`` maps names to arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - p["mean"]) / p["std"]
        starts = np.cumsum(n) - n
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a, z = _softmax_sum((t * g) @ p["w"], h, starts, n)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "starts": starts}

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, n)
        err = (f["y"] - y) * weight / weight.sum()
        up = np.repeat(err, n)
        dz = up[:, None] * p["c"]
        of = (dz * f["h"]).sum(1)
        ds = f["a"] * (of - np.repeat(np.add.reduceat(f["a"] * of, f["starts"]), n))
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "c0": err.sum()}

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts of any length: attention sums of a long text's slices are merged, as if it were one bag."""
        data, offsets = joined_bytes(texts)
        if not len(texts) or offsets[-1] <= SLICE:
            return self.forward(*_encoded(data, offsets))["y"].astype(np.float64) if len(texts) else np.zeros(0)
        out = np.zeros(len(texts))
        for row in range(len(texts)):
            own = data[offsets[row] : offsets[row + 1]]
            top, weight, total = -np.inf, 0.0, np.zeros(ENCODED)
            for at in range(0, max(1, len(own)), SLICE):
                part = own[at : at + SLICE]
                x, _ = _encoded(part, np.array([0, len(part)]))
                h, s = self._attend(x)
                new = max(top, float(s.max()))
                e = np.exp(s.astype(np.float64) - new)
                kept = np.exp(top - new)
                top, weight, total = new, weight * kept + e.sum(), total * kept + e @ h
            z = total / weight
            out[row] = 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["c0"], -30, 30)))
        return out

    def _attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention logits of passages."""
        p = self.p
        h = np.tanh(((x - p["mean"]) / p["std"]) @ p["W"] + p["b"])
        gate = 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        return h, (np.tanh(h @ p["V"]) * gate) @ p["w"]


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 25, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam over bags of passages, with a small weight decay."""
    parts = [passages(pa.array(texts[i : i + 64], pa.string())) for i in range(0, len(texts), 64)]
    x, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    r = np.random.default_rng(seed)
    d = x.shape[1]
    shapes = {"W": (d, ENCODED), "b": (ENCODED,), "V": (ENCODED, GATE), "U": (ENCODED, GATE), "w": (GATE,), "c": (ENCODED,), "c0": ()}
    p = {k: (r.normal(size=s) / np.sqrt(s[0] if s else 1)).astype(np.float32) if k.lower() != "b" and s else np.zeros(s, np.float32) for k, s in shapes.items()}
    net = Network(p | {"mean": x.mean(0), "std": x.std(0) + np.float32(0.02)})
    ends = np.cumsum(n)
    m1, m2, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    for epoch in range(epochs):
        for some in np.array_split(r.permutation(len(n)), max(1, len(n) // 64)):
            own = n[some]
            where = np.repeat(ends[some] - np.cumsum(own), own) + np.arange(own.sum())
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in net.gradients(x[where], own, y[some], weight[some]).items():
                g = g + 1e-4 * net.p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g**2
                net.p[k] = (net.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """The network learned from about ``sample_rows`` texts of each label value, weighed as the values stand in all labels.

    Held-out ids, null labels and null texts are never seen; of texts over SAMPLE_CHARS the sample has parts spread over the
    whole length, so its bytes are bounded too. None if fewer than two label values are there.
    """
    ids, counts = sampled_labels(labels, label, sample_rows, id_col)
    if len(counts) < 2:
        return None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        y = rows["label"].to_numpy(np.float32)
        weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum())).astype(np.float32)
        out = io.BytesIO()
        np.savez(out, **train(rows["text"].tolist(), y, weight).p)
        return pd.DataFrame({"model": [out.getvalue()]})

    sample = labelled_texts(docs, ids, id_col, text_col)
    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return Network(dict(np.load(io.BytesIO(got[0]["model"])))) if got else None


def score(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` and score (0 to 1), the chance of label 1; 0.5 everywhere without a model.

    Null and empty texts are one empty passage; long texts are read whole, in slices of bounded memory. Ids may be null or repeated; other columns are ignored; an empty table
    gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, SLICE):
            got = model.score(batch.column(1)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
