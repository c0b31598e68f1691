"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded from hashed byte bigrams and shape statistics; gated attention weighs
the passages, and the weighted representation is scored. Attention, encoder and
score are learned together, from document labels only, in numpy on at most
``sample_rows`` labelled texts (half of each label, chosen by hash); what comes
back to the driver are their encoded passages. Scoring runs over Arrow batches
without a shuffle.

Defined cases: null and blank texts are a bag of one passage without words;
without labels of both kinds every score is 0.5; of labels that repeat for a
document each row counts; repeated rows are scored each; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.kernel import byte_values, mix, owner, prefix_hashes, slices, span_hashes, words
from querygrove.llm.scratch import text_batches

PASSAGE_WORDS = 64
BIGRAMS = 256
SHAPE = 8
WIDTH = BIGRAMS + SHAPE

_VALUES = byte_values(3, lower=True)
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:'\"!?()-")] = 4
_CLASS[[b for b in range(33, 127) if not _CLASS[b]]] = 5
_CLASS[128:] = 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, bag numbers) of all passages of a slice; a text without words has one passage of zeros."""
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    count = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    per_text = np.maximum(1, -(-count // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(per_text)))
    bag = np.repeat(np.arange(n), per_text)
    out = np.zeros((base[-1], WIDTH), np.float32)
    if not len(starts):
        return out, bag
    passage = base[text] + (np.arange(len(starts)) - first[text]) // PASSAGE_WORDS
    word = np.clip(np.searchsorted(starts, np.arange(len(data)), "right") - 1, 0, None)
    where = passage[word]
    where = np.where(owner(offsets, np.arange(len(data))) == bag[where], where, base[owner(offsets, np.arange(len(data)))])
    pair = mix((data[:-1].astype(np.uint64) << np.uint64(8)) | data[1:]) % np.uint64(BIGRAMS)
    inside = where[:-1] == where[1:]
    grams = np.bincount((where[:-1] * BIGRAMS + pair.astype(np.int64))[inside], minlength=len(out) * BIGRAMS).reshape(-1, BIGRAMS)
    out[:, :BIGRAMS] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    kinds = np.bincount(where * 7 + _CLASS[data], minlength=len(out) * 7).reshape(-1, 7)
    out[:, BIGRAMS:BIGRAMS + 6] = kinds[:, 1:] / np.maximum(kinds[:, 1:].sum(1, keepdims=True), 1)
    hashes = span_hashes(prefix_hashes(data, _VALUES), starts, ends)
    in_passage = np.maximum(np.bincount(passage, minlength=len(out)), 1)
    again = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    out[:, -2] = np.bincount(passage[1:][again], minlength=len(out)) / in_passage
    order = np.lexsort((hashes, passage))
    twice = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    out[:, -1] = np.bincount(passage[order][1:][twice], minlength=len(out)) / in_passage
    return out, bag


@dataclass
class Model:
    """tanh encoder, gated attention, and a logistic score of the weighted representation."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward((x - self.mean) / self.scale, bag, n)["logit"], -30, 30)))

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.params
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = (t * g) @ p["w"]
        first = np.searchsorted(bag, np.arange(n))
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * a[:, None], first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}


def fit_bags(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 150, rate: float = 0.01, seed: int = 3) -> Model:
    """Trains on whole bags; ``bag`` is sorted and names every bag 0..n-1."""
    n, rng = len(y), np.random.default_rng(seed)
    if n == 0 or y.min() == y.max():
        zero = {"W": np.zeros((WIDTH, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.zeros(())}
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero)
    mean, scale = x.mean(0), x.std(0) + 0.01
    x = ((x - mean) / scale).astype(np.float32)
    shape = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "d": ()}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    model, m, v = Model(mean, scale, p), {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    weight = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max(n - y.sum(), 1))) / n
    for step in range(1, steps + 1):
        f = model._forward(x, bag, n)
        dlogit = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight
        grad = {"c": f["z"].T @ dlogit, "d": dlogit.sum()}
        dz = dlogit[:, None] * p["c"]
        dh = dz[bag] * f["a"][:, None]
        da = (dz[bag] * f["h"]).sum(1)
        da = f["a"] * (da - np.bincount(bag, f["a"] * da, minlength=n)[bag])
        grad["w"] = (f["t"] * f["g"]).T @ da
        dtg = da[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = x.T @ dh, dh.sum(0)
        for k in p:
            g = grad[k] + (1e-4 * p[k] if k in "WVUwc" else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text"), max_rows=1024):
            x, bag = passages(data, offsets)
            ends = np.searchsorted(bag, np.arange(high - low + 1))
            packed = [zlib.compress(x[a:b].astype(np.float16).tobytes(), 1) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(low, high - low), pa.array(packed, pa.binary())], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 2400) -> Model:
    """Trains on documents with a label of 0 or 1, at most ``sample_rows`` of them."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    # Labels may be of documents outside the table; the sample is drawn from those inside.
    known = docs.select("doc_id").join(known, "doc_id")
    # The first of each label in hash order: every task sends at most that many.
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    known = known.filter("y = 0").orderBy(*order).limit(sample_rows // 2).union(known.filter("y = 1").orderBy(*order).limit(sample_rows // 2))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("y", "text").limit(2 * sample_rows)
    got = sample.mapInArrow(_encoded, "y int, x binary").toArrow()
    bags = [np.frombuffer(zlib.decompress(v.as_py()), np.float16).reshape(-1, WIDTH) for v in got.column("x")]
    if not bags:
        return fit_bags(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit_bags(np.concatenate(bags).astype(np.float32), bag, np.array(got.column("y").to_pylist(), float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages and the largest attention weight, for every row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), max_rows=1024):
                n = high - low
                x, bag = passages(data, offsets)
                f = m._forward((x - m.mean) / m.scale, bag, n)
                first = np.searchsorted(bag, np.arange(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, n), pa.array(1 / (1 + np.exp(-np.clip(f["logit"], -30, 30).astype(float)))),
                     pa.array(np.bincount(bag, minlength=n)), pa.array(np.maximum.reduceat(f["a"], first).astype(float))],
                    names=["doc_id", "score", "n_passages", "top_attention"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, n_passages long, top_attention double")
