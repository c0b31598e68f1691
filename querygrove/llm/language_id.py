"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one logistic classifier per bit learns,
from hashed byte n-grams, which side of the bit a text is on. A text gets the
codeword with the least loss, each bit weighted by how well its classifier did
in training. A text whose two best codewords are close is flagged.

The classifiers are fitted in numpy on at most ``sample_rows`` labelled texts,
an equal share per language, chosen by hash (one of each where languages are more); what comes back to the driver are
their n-gram profiles. Prediction runs over Arrow batches without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any labelled text everything is ``und``; with one language every text
with a letter has it, with score 1; rows with a null lang teach nothing; repeated rows are
judged each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.llm.kernel import LOWER, mix, owner, slices
from querygrove.llm.scratch import text_batches

BUCKETS = 4096


def held_out(doc_id: str, divisor: int, remainder: int) -> Column:
    """Is crc32 of the id as text that remainder? A null id counts as no held-out row."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams of each text, A-Z as a-z."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if not len(data):
        return out
    low = LOWER[data].astype(np.uint64)
    text = owner(offsets, np.arange(len(data)))
    total = np.zeros(n * BUCKETS, np.int64)
    gram = low
    for size in (1, 2, 3):
        if size > 1:
            gram = (gram[:-1] << np.uint64(8)) | low[size - 1:]
        if not len(gram):
            break
        inside = text[:len(gram)] == text[size - 1:]
        bucket = (mix(gram + np.uint64(size << 40)) >> np.uint64(40)) % np.uint64(BUCKETS)
        total += np.bincount((text[:len(gram)] * BUCKETS + bucket.astype(np.int64))[inside], minlength=n * BUCKETS)
    out[:] = total.reshape(n, BUCKETS)
    np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1), out=out)
    return out


def codewords(n: int, seed: int = 10) -> np.ndarray:
    """One row of -1/+1 per language. Up to four languages get every split; more get the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 4:
        splits = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(splits, float).T
    rng, bits, best, found = np.random.default_rng(seed), max(15, 6 * int(np.ceil(np.log2(n)))), -1, None
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (n, bits))
        split = np.abs(code.sum(0)) < n
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n, dtype=int)
        score = apart.min() + split.all()
        if score > best:
            best, found = score, code
    return found


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :].astype(np.float32))
        return loss @ self.trust


def fit_codes(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fits all bit classifiers at once (Adam on the logistic loss)."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    target = codes[[languages.index(label) for label in labels]] if labels else np.zeros((0, 1))
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    if len(languages) > 1:
        x = x.astype(np.float32)
        moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(b), np.zeros_like(b)]]
        for step in range(1, steps + 1):
            pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(x)
            for value, grad, m in ((w, x.T @ pull + decay * w, moments[0]), (b, pull.sum(0), moments[1])):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.99 * m[1] + 0.01 * grad ** 2
                value -= (rate * 20 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        right = ((x @ w + b) * target > 0).mean(0)
        trust = np.maximum(right - 0.5, 0.01) * 2
    else:
        trust = np.ones(codes.shape[1])
    return Model(languages, codes, w, b, (trust / trust.sum()).astype(np.float32))


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text"), max_rows=256):
            packed = [zlib.compress(row.tobytes(), 1) for row in profiles(data, offsets).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(low, high - low), pa.array(packed, pa.binary())], names=["lang", "profile"])


def fit(labelled: DataFrame, sample_rows: int = 2400) -> Model:
    """Fits a model on (doc_id, lang, text) rows, on at most ``sample_rows`` of them or one per language, an equal share per language."""
    text_batches(labelled.sparkSession)
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    found = rows.select("lang").distinct().count()
    if not found:
        return fit_codes(np.zeros((0, BUCKETS), np.float32), [])
    share = max(1, sample_rows // found)
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= share).select("doc_id", F.col("lang").alias("_lang"))
    sample = rows.join(F.broadcast(picked), "doc_id").filter("lang = _lang").select("lang", "text").limit(2 * sample_rows + found)
    got = sample.mapInArrow(_profile_rows, "lang string, profile binary").toArrow()
    x = [np.frombuffer(zlib.decompress(p.as_py()), np.float16) for p in got.column("profile")]
    return fit_codes(np.stack(x), [str(v) for v in got.column("lang").to_pylist()])


def predict(docs: DataFrame, model: Model, close: float = 0.15) -> DataFrame:
    """doc_id, lang_pred, score and whether the decision is ambiguous, for every row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), max_rows=256):
                n, raw = high - low, data.tobytes()
                letters = np.concatenate(([0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))))
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(map(str.isalpha, raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")))
                names, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if m.languages and has.any():
                    loss = m.losses(profiles(data, offsets))
                    chance = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
                    chance /= chance.sum(1, keepdims=True)
                    best = chance.argmax(1)
                    names[has] = np.array(m.languages, object)[best][has]
                    score[has] = chance[np.arange(n), best][has]
                    if len(m.languages) > 1:
                        ranked = np.sort(chance, 1)
                        unsure = has & (ranked[:, -1] - ranked[:, -2] < close)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, n), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(unsure)],
                    names=["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
