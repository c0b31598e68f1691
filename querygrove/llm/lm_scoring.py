"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

Every word is predicted from the words on both sides of it, itself masked; the
log-probabilities of all words of a text add up to its score. Words are counted
one by one; the ``OWN_BUCKETS`` most frequent have a bucket of their own, the
others share buckets by hash. The most frequent buckets are classes of their
own and the others share classes of equal mass. The network predicts the class
and the bucket in its class from the words in the window, so that
log p(word | both sides) = log p(class | both sides)
+ log p(bucket | class, both sides) + log p(word | bucket), the last from the
word's own count. The ``OWN_INPUTS`` most frequent words are inputs of their
own, the others share inputs by hash.

Counts cover all documents and stay a distributed table of one row per word.
The ``HEAD_WORDS`` most frequent are broadcast; the other words of a document,
each once with its number, are joined to the table. So no word that is joined is
frequent in the corpus. A word that was not counted gets the part of its bucket
that ``UNSEEN`` occurrences have.

The network is written in numpy: it starts from a bounded sample of
``warm_rows`` texts, then every task trains a copy on all its documents and
Spark sums the copies, weighted by words: the average is the model. Sums of
floats depend on the order of tasks in their last digits.

Defined cases: texts that are null or without words have no words, score 0 and
a null mean; an empty table gives an empty result; repeated rows are scored
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.kernel import byte_values, prefix_hashes, slices, span_hashes, words
from querygrove.llm.scratch import text_batches, written

#: Outputs of the network: the most frequent words have one each, the others share the rest by hash.
BUCKETS = 1 << 13
OWN_BUCKETS = 3 * BUCKETS // 4
#: Words whose exact counts are broadcast; the counts of all others stay in a distributed table.
HEAD_WORDS = 1 << 17
#: Words whose counts a task holds before it sends them on.
HELD_WORDS = 1 << 20
OWN_CLASSES, SHARED_CLASSES = 95, 33
CLASSES = OWN_CLASSES + SHARED_CLASSES
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 24
#: Rate of the second level against the first, and the fewest words its mean is taken over.
INNER_RATE, INNER_WORDS = 0.5, 64
STEP_WORDS = 4096
#: Inputs of the network: buckets of the most frequent words, and others by hash.
OWN_INPUTS, INPUTS = 1536, 2048
#: Parameters in a row that tasks send.
CHUNK = 256
#: Bytes of texts whose words are hashed at once.
HASHED_BYTES = 1 << 16
#: What a word that was not counted counts.
UNSEEN = 0.5
#: Leading bits of a hash by which a task finds counted words.
BITS = 18
#: Squares of sums of exponentials beyond which (or below whose inverse) the largest logit of each row is taken off first.
_LARGE = 1e30
#: Words, and logits of them, that are held at once when texts are scored.
SCORED_WORDS = 16 * STEP_WORDS
_LOGITS = STEP_WORDS * CLASSES
#: Logits that a step holds at once, unless one class has more: they stay in the cache.
CACHED = 1 << 18
_ONES = np.ones(BUCKETS, np.float32)

_VALUES = byte_values(6, lower=True)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word of a slice, a few texts at a time: their sums stay in the memory that was used before."""
    hashes, texts, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + HASHED_BYTES, "right")) - 1)
        part = data[offsets[low]:offsets[high]]
        starts, ends, text = words(part, offsets[low:high + 1] - offsets[low])
        hashes.append(span_hashes(prefix_hashes(part, _VALUES), starts, ends).view(np.int64))
        texts.append(text + low)
        low = high
    return np.concatenate(hashes), np.concatenate(texts)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return word, np.bincount(where, np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            held.append(np.unique(word_hashes(data, offsets)[0], return_counts=True))
            if sum(len(w) for w, _ in held) > HELD_WORDS:
                held = [_merged(held)]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["word", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names=["word", "n"])


def word_table(docs: DataFrame) -> DataFrame:
    """word (64-bit hash) and n, its occurrences in all texts: a distributed table that grows with the vocabulary."""
    text_batches(docs.sparkSession)
    return written(docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


@dataclass
class Vocabulary:
    """Exact counts of the most frequent words, sorted by hash, and the occurrences of each bucket."""

    word: np.ndarray
    n: np.ndarray
    bucket: np.ndarray
    counts: np.ndarray
    own: int

    def __post_init__(self) -> None:
        self.first = np.searchsorted(self.word, np.arange(-(1 << BITS - 1), 1 << BITS - 1) << 64 - BITS).astype(np.int32)
        self.rest = -np.log(self.counts + UNSEEN)
        self.share = np.where(self.bucket < self.own, 0.0, np.log(self.n) + self.rest[self.bucket])
        self.ended = np.append(self.word, np.iinfo(np.int64).max)
        self.bucket_at, self.share_at = np.append(self.bucket, 0).astype(np.int16), np.append(self.share, 0.0)

    @classmethod
    def of(cls, table: DataFrame, head_words: int = HEAD_WORDS, own_buckets: int = OWN_BUCKETS) -> Vocabulary:
        # Whole steps of frequency are taken while they fit, so neither the driver nor a task ranks the table.
        step, lowest, taken = F.floor(F.log2("n") * 64), None, 0
        for row in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            taken += row["count"]
            if taken > head_words:
                break
            lowest = row["step"]
        got = table.filter(step >= lowest if lowest is not None else F.lit(False)).toArrow()
        word, n = got.column("word").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(word)
        word, n = word[order], n[order]
        top = np.lexsort((word, -n))[:own_buckets]
        bucket = cls._shared(word, own_buckets)
        counts = np.zeros(BUCKETS, np.int64)
        hashed = table.groupBy(F.pmod("word", F.lit(BUCKETS - own_buckets)).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
        counts[own_buckets + hashed.column("bucket").to_numpy().astype(np.int64)] = hashed.column("n").to_numpy()
        np.subtract.at(counts, bucket[top], n[top])
        bucket[top] = np.arange(len(top))
        counts[:len(top)] = n[top]
        return cls(word, n, bucket, counts, own_buckets)

    @staticmethod
    def _shared(word: np.ndarray, own: int) -> np.ndarray:
        return own + word % (BUCKETS - own)

    def _find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands among the counted ones, and whether it is one of them."""
        at = self.first[(word >> 64 - BITS) + (1 << BITS - 1)]
        below = np.flatnonzero(self.ended[at] < word)
        while len(below):  # as often as words share their leading bits
            at[below] += 1
            below = below[self.ended[at[below]] < word[below]]
        return at, (self.ended[at] == word) & (at < len(self.word))

    def buckets(self, word: np.ndarray) -> np.ndarray:
        """Bucket of each word."""
        at, known = self._find(word)
        return np.where(known, self.bucket_at[at], self._shared(word, self.own))

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each word, log share in its bucket, and whether its count is in the table only.

        The share of such a word lacks the logarithm of its count.
        """
        at, known = self._find(word)
        bucket = np.where(known, self.bucket_at[at], self._shared(word, self.own))
        return bucket, np.where(known, self.share_at[at], self.rest[bucket]), ~known


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in all texts."""
    return Vocabulary.of(word_table(docs)).counts


def _in_range(total: np.ndarray, inverse: np.ndarray) -> bool:
    """Whether no exponentials overflowed or vanished, by their sums."""
    return total.dot(total) < _LARGE and inverse.dot(inverse) < _LARGE


def _without_largest(h: np.ndarray, weights: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the exponentials of the logits to ``p``, the largest of each row taken off first; their sums, and what was taken off."""
    np.matmul(h, weights.T, out=p)
    top = p.max(1)
    p -= top[:, None]
    np.exp(p, out=p)
    return p @ _ONES[:len(weights)], top


def _space(room: np.ndarray | None, n: int) -> np.ndarray:
    """The first ``n`` places of ``room`` if it has as many, whose pages were used before, or new ones."""
    return np.empty(n, np.float32) if room is None or len(room) < n else room[:n]


def _log_softmax(h: np.ndarray, weights: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Logarithm of the probability of outcome ``at`` of each row. The last column of ``h`` is 1, that of ``weights`` the bias."""
    out, width = np.empty(len(h), np.float32), len(weights)
    rows = max(_LOGITS // width, 1)
    for low in range(0, len(h), rows):
        some = h[low:low + rows]
        p = np.matmul(some, weights.T, out=_space(room, len(some) * width).reshape(-1, width))
        own = p.reshape(-1)[np.arange(0, p.size, width) + at[low:low + rows]]
        np.exp(p, out=p)
        total = p @ _ONES[:width]
        if not _in_range(total, 1 / total):
            total, top = _without_largest(some, weights, p)
            own -= top
        out[low:low + rows] = own - np.log(total)
    return out


def _runs(groups: list[tuple[slice, int, int]]) -> Iterator[list[tuple[slice, int, int]]]:
    """Groups one after the other whose logits fit the cache together, or one whose logits don't."""
    run, held = [], 0
    for rows, a, b in groups:
        n = (rows.stop - rows.start) * (b - a)
        if run and held + n > CACHED:
            yield run
            run, held = [], 0
        run.append((rows, a, b))
        held += n
    yield run


def _step(h: np.ndarray, weights: np.ndarray, at: np.ndarray, rate: float | np.ndarray, room: np.ndarray | None = None,
          groups: list[tuple[slice, int, int]] | None = None) -> np.ndarray:
    """Moves ``weights`` along the gradient of the summed -log p of outcomes ``at``; the gradient of ``h`` without its last column, before that.

    Each of ``groups`` has outcomes of its own: its rows of ``h`` and the bounds of its outcomes; they cover all rows in order.
    ``rate`` is one for all or one for each row. What is done row by row is done for many small groups at once.
    """
    if groups is None:
        block = max(CACHED // len(weights), 1)
        groups = [(slice(low, min(low + block, len(h))), 0, len(weights)) for low in range(0, len(h), block)]
    pull, rate, changes = np.empty((len(h), weights.shape[1] - 1), np.float32), np.broadcast_to(np.asarray(rate, np.float32), len(h)), []
    for run in _runs(groups):
        every = slice(run[0][0].start, run[-1][0].stop)
        total, ps, low = np.empty(every.stop - every.start, np.float32), [], 0
        rows_of, widths = [rows.stop - rows.start for rows, _, _ in run], [b - a for _, a, b in run]
        flat = _space(room, sum(n * width for n, width in zip(rows_of, widths, strict=True)))
        for rows, a, b in run:
            n, first = rows.stop - rows.start, rows.start - every.start
            p = np.matmul(h[rows], weights[a:b].T, out=flat[low:low + n * (b - a)].reshape(n, b - a))
            np.exp(p, out=p)
            np.matmul(p, _ONES[:b - a], out=total[first:first + n])
            ps.append(p)
            low += n * (b - a)
        part = 1 / total
        if not _in_range(total, part):
            for p, (rows, a, b) in zip(ps, run, strict=True):
                total[rows.start - every.start:rows.stop - every.start] = _without_largest(h[rows], weights[a:b], p)[0]
            part = 1 / total
        width = np.repeat(widths, rows_of)
        flat[np.cumsum(width) - width - np.repeat([a for _, a, _ in run], rows_of) + at[every]] -= total
        # The narrow factors are divided, not the probabilities.
        moves = h[every] * (part * rate[every])[:, None]
        for p, (rows, a, b) in zip(ps, run, strict=True):
            np.matmul(p, weights[a:b, :-1], out=pull[rows])
            changes.append((a, b, p.T @ moves[rows.start - every.start:rows.stop - every.start]))
        pull[every] *= part[:, None]
    for a, b, change in changes:
        weights[a:b] -= change
    return pull


@dataclass
class WindowNetwork:
    """Class of each bucket, log share of each bucket in its class, place of each bucket among those sorted by class, bounds of classes, and the parameters."""

    classes: np.ndarray
    share: np.ndarray
    place: np.ndarray
    bounds: np.ndarray
    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 6) -> WindowNetwork:
        order = np.argsort(-counts, kind="stable")
        classes, place = np.empty(BUCKETS, np.int16), np.empty(BUCKETS, np.int64)  # short integers sort by radix
        classes[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
        rest = order[OWN_CLASSES:]
        mass = np.cumsum(counts[rest] + 0.5)
        classes[rest] = OWN_CLASSES + np.minimum((mass / mass[-1] * SHARED_CLASSES).astype(int), SHARED_CLASSES - 1)
        place[order] = np.arange(BUCKETS)
        smooth = counts + 0.5
        total = np.bincount(classes, smooth, minlength=CLASSES)
        share = np.log(smooth / np.maximum(total[classes], 1e-9)).astype(np.float32)
        rng = np.random.default_rng(seed)
        return cls(classes, share, place, np.searchsorted(classes[order], np.arange(CLASSES + 1)),
                   rng.normal(0, 0.3, (len(OFFSETS), INPUTS + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                   rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.log(np.maximum(total, 1) / max(total.sum(), 1)).astype(np.float32),
                   np.zeros((BUCKETS, HIDDEN), np.float32), share[order])

    @staticmethod
    def inputs(word: np.ndarray) -> np.ndarray:
        """Input of each bucket."""
        return np.where(word < OWN_INPUTS, word, OWN_INPUTS + word % (INPUTS - OWN_INPUTS))

    def context(self, inputs: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Inputs around each word, INPUTS beyond the ends of its text."""
        n, out = len(inputs), np.full((len(OFFSETS), len(inputs)), INPUTS, np.int16)
        for k, offset in enumerate(OFFSETS):
            d = abs(offset)
            if n > d:
                same = text[d:] == text[:-d]
                if offset < 0:
                    out[k, d:][same] = inputs[:-d][same]
                else:
                    out[k, :-d][same] = inputs[d:][same]
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(context[0], 0)
        total += self.bias
        for k in range(1, len(OFFSETS)):
            total += self.embed[k].take(context[k], 0)
        # The hyperbolic tangent, as 1 - 2 / (exp(2 x) + 1).
        total += total
        np.exp(total, out=total)
        total += 1
        np.divide(-2, total, out=total)
        total += 1
        return total

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the weights of classes and of buckets, a row each, the bias last."""
        return np.column_stack((self.out.T, self.out_bias)), np.column_stack((self.inner, self.inner_bias))

    @staticmethod
    def _with_one(hidden: np.ndarray) -> np.ndarray:
        h = np.empty((len(hidden), HIDDEN + 1), np.float32)
        h[:, :-1], h[:, -1] = hidden, 1
        return h

    def _groups(self, own: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, int, int]]]:
        """The words whose class has several buckets, by class; for each class where they stand, and its bounds."""
        order = np.flatnonzero((np.diff(self.bounds) > 1)[own])
        order = order[np.argsort(own[order], kind="stable")]
        at, bounds = np.searchsorted(own[order], np.arange(CLASSES + 1)).tolist(), self.bounds.tolist()
        return order, [(slice(low, high), a, b) for low, high, a, b in zip(at, at[1:], bounds, bounds[1:], strict=False) if high > low]

    @np.errstate(over="ignore", divide="ignore")
    def log_probability(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Log-probability of each bucket given both sides."""
        own, place = self.classes[word], self.place[word]
        context, out = self.context(self.inputs(word), text), np.empty(len(word), np.float32)
        outer, inner = self._weights()
        room, room_h = np.empty(_LOGITS, np.float32), np.ones((min(len(word), SCORED_WORDS), HIDDEN + 1), np.float32)
        for low in range(0, len(word), SCORED_WORDS):
            part = slice(low, low + SCORED_WORDS)
            h = room_h[:len(word) - low]
            for start in range(0, len(h), STEP_WORDS):  # a step at a time stays in the cache
                some = h[start:start + STEP_WORDS]
                some[:, :-1] = self.hidden(context[:, low + start:low + start + len(some)])
            found = _log_softmax(h, outer, own[part], room)
            order, groups = self._groups(own[part])
            mine, mine_at, more = h[order], place[part][order], np.zeros(len(order), np.float32)
            for rows, a, b in groups:
                more[rows] = _log_softmax(mine[rows], inner[a:b], mine_at[rows] - a, room)
            found[order] += more
            out[part] = found
        return out

    @np.errstate(over="ignore", divide="ignore")
    def train(self, word: np.ndarray, text: np.ndarray, rate: float) -> None:
        """One pass of stochastic gradient steps."""
        own, place = self.classes[word], self.place[word]
        context = self.context(self.inputs(word), text)
        outer, inner = self._weights()
        # Rows of all embeddings and of their gradients as pairs of numbers, which are summed at once; where the pairs of each row stand.
        pairs = self.embed.reshape(-1).view(np.complex64)
        places, first = np.arange(len(pairs)).reshape(-1, HIDDEN // 2), np.arange(len(OFFSETS))[:, None] * (INPUTS + 1)
        room = np.empty(CACHED, np.float32)
        for low in range(0, len(word), STEP_WORDS):
            part = slice(low, low + STEP_WORDS)
            around, target = context[:, part], own[part]
            slope = self.hidden(around)
            h = self._with_one(slope)
            scale = rate / len(h)
            pull = _step(h, outer, target, scale, room)
            order, groups = self._groups(target)
            if groups:
                # A class is an outcome of its own: its step is a mean over its words.
                seen = [rows.stop - rows.start for rows, _, _ in groups]
                rates = np.repeat(rate * INNER_RATE / np.maximum(seen, INNER_WORDS), seen)
                pull[order] += _step(h[order], inner, place[part][order], rates, room, groups)
            slope *= slope
            slope -= 1
            slope *= np.float32(scale)
            pull *= slope
            self.bias += pull.sum(0)
            moves = pull.reshape(-1).view(np.complex64)
            for row in first + around:
                np.add.at(pairs, places.take(row, 0).ravel(), moves)
        self.out[:], self.out_bias[:] = outer[:, :-1].T, outer[:, -1]
        self.inner[:], self.inner_bias[:] = inner[:, :-1], inner[:, -1]

    def _parameters(self) -> tuple[np.ndarray, ...]:
        return self.embed, self.bias, self.out, self.out_bias, self.inner, self.inner_bias

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._parameters()])

    def with_vector(self, flat: np.ndarray) -> WindowNetwork:
        parts, at = [], 0
        for x in self._parameters():
            parts.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return WindowNetwork(self.classes, self.share, self.place, self.bounds, *parts)


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the copies of each chunk, weighted by words."""
    total: dict[int, np.ndarray] = {}
    words_of: dict[int, int] = {}
    for batch in batches:
        for chunk, seen, v in zip(*(batch.column(c).to_pylist() for c in ("chunk", "seen", "v")), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(v, np.float32).astype(float) * seen
            words_of[chunk] = words_of.get(chunk, 0) + seen
    if total:
        means = [(v / words_of[chunk]).astype(np.float32).tobytes() for chunk, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(means, pa.binary())], names=["chunk", "v"])


@dataclass
class Model:
    network: WindowNetwork
    vocabulary: Vocabulary
    table: DataFrame


def fit(docs: DataFrame, warm_rows: int = 400, warm_passes: int = 6, rate: float = 4.0) -> Model:
    """Counts, a warm start, and one round of averaged training over all documents."""
    text_batches(docs.sparkSession)
    table = word_table(docs)
    vocabulary = Vocabulary.of(table)
    model = WindowNetwork.start(vocabulary.counts)
    # The first texts in hash order: hashes alone are sorted, and texts come once the last hash is known.
    known = docs.filter("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = known.select("h").orderBy("h").limit(warm_rows).agg(F.max("h")).first()[0]
    warm = known.filter(F.col("h") <= F.lit(last)).limit(warm_rows).toArrow().column("text").to_pylist() if last is not None else []
    for _ in range(warm_passes):
        for _, _, data, offsets in slices(pa.array(warm, pa.large_string())):
            word, text = word_hashes(data, offsets)
            model.train(vocabulary.buckets(word), text, rate)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known_words = shared.value
        own, seen = start.with_vector(start.vector().copy()), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                word, text = word_hashes(data, offsets)
                own.train(known_words.buckets(word), text, rate / 4)
                seen += len(word)
        if seen:
            flat = own.vector()
            parts = [flat[low:low + CHUNK].tobytes() for low in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), seen)), pa.array(parts, pa.binary())], names=["chunk", "seen", "v"])

    copies = docs.select("text").mapInArrow(learn, "chunk int, seen long, v binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = copies.repartition(n, "chunk").mapInArrow(_weighted, "chunk int, v binary").toArrow()
    if len(got):
        parts = dict(zip(got.column("chunk").to_pylist(), got.column("v").to_pylist(), strict=True))
        model = model.with_vector(np.concatenate([np.frombuffer(parts[k], np.float32) for k in range(len(parts))]))
    return Model(model, vocabulary, table)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over words) and mean_log_probability, for every row of ``docs``."""
    text_batches(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast((model.network, model.vocabulary)), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, vocabulary = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                word, text = word_hashes(data, offsets)
                bucket, share, open_ = vocabulary.look_up(word)
                n, total = np.bincount(text, minlength=high - low), np.zeros(high - low)
                if len(word):
                    total = np.bincount(text, network.log_probability(bucket, text) + share, minlength=high - low)
                # Words of a text whose counts the table has, each once.
                rare, owner = word[open_], text[open_]
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                first = np.flatnonzero((np.diff(rare, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0))
                times = np.diff(np.append(first, len(rare)))
                ends = np.searchsorted(owner[first], np.arange(high - low + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rare[first]), pa.array(times.astype(np.int64))], names=["word", "times"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), pairs)],
                                                 names=["doc_id", "n_words", "known", "rare"])

    source = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, known double, rare array<struct<word: long, times: long>>")
    # Written once, so that a row keeps its number in both branches.
    rows = written(source.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.inline("rare")).join(model.table, "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(more, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))
