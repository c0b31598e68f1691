"""Line dedup, importance resampling and ball k-means against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querygrove.llm import ball_kmeans, importance, line_dedup, minhash
from querygrove.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, words string, own string, run int, position int"


def documents(spark, rows):
    """Rows (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "w", "o", 1, 2) for d, t in rows], DOCS)


# --- line dedup -----------------------------------------------------------------------------

def kept_texts(rows, min_chars=40, min_docs=5):
    """(doc_id, number of lines, dropped lines, what is left) of every row."""
    keyed = [(d, [(line, line.strip(" \t\n\v\f\r").translate(UPPER)) for line in (t or "").split("\n")]) for d, t in rows]
    holders = {}
    for d, lines in keyed:
        for _, key in lines:
            if d is not None and len(key) >= min_chars:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, lines in keyed:
        kept = [line for line, key in lines if d is None or len(holders.get(key, ())) < min_docs or max(holders[key]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check_lines(spark, rows):
    got = line_dedup.dedup_lines(documents(spark, rows)).select("own.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert order(tuple(r) for r in got) == order(kept_texts(rows))


@pytest.fixture(scope="module")
def line_rows():
    rnd = random.Random(11)
    common = ["This line stands at the foot of very many pages.", "  ÄRGER mit Zeilen, die sich überall wiederholen \t", "x" * 39, "y" * 40, "é" * 40, "東京" * 25]
    rows = []
    for d in range(60):
        lines = [rnd.choice(common) if rnd.random() < 0.4 else " ".join(rnd.choices(["alpha", "beta", "gamma"], k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 12))]
        rows.append((d, "\n".join(lines)))
    rows += [(None, common[0]), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, f"{common[0]}\r\n{common[0].upper()}\n"), (204, common[3] + "\n" + common[3])]
    return rows


def test_lines_against_brute_force(spark, line_rows):
    check_lines(spark, line_rows)


def test_repeated_rows_and_shared_ids(spark, line_rows):
    check_lines(spark, [*line_rows, line_rows[3], line_rows[3], (3, "other text\n" + line_rows[4][1]), (900, "y" * 40)])


def test_a_line_of_most_documents_and_long_texts(spark):
    foot = "the same footer stands below each and every one of these pages"
    rows = [(d, f"only here {d} and nowhere else in this whole collection\n{foot}") for d in range(400)]
    rows.append((1000, "\n".join(f"{foot}" if i % 3 == 0 else f"line {i}" for i in range(20_000))))
    rows.append((999, "\n".join(f"{foot}" if i % 130 == 0 else f"line {i} of a long text that repeats nothing at all" for i in range(20_000))))
    check_lines(spark, rows)


def test_no_documents_and_columns_of_their_own(spark):
    rows = line_dedup.dedup_lines(documents(spark, []))
    assert rows.count() == 0
    one = line_dedup.dedup_lines(documents(spark, [(1, "a\nb")])).first()
    assert one.own.asDict() == {"doc_id": 1, "text": "a\nb", "words": "w", "own": "o", "run": 1, "position": 2} and one.words is None


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    foot = "the same footer stands below each and every one of these pages"
    rows = [(d, foot) for d in range(5)] + [(0, "\n" * 200 + foot)]
    got = {(r.doc_id, tuple((w.word, w.bits) for w in r.words)) for r in line_dedup.dropped_bits(documents(spark, rows).select("doc_id", "text")).collect()}
    assert got == {(0, ((0, 1),)), (0, ((3, 1 << 8),)), (1, ((0, 1),)), (2, ((0, 1),)), (3, ((0, 1),))}


def test_a_hot_line_spreads_over_ranges(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this line is shared by every single document"), F.lit("\n"), F.repeat(F.col("id").cast("string"), 12)).alias("text"))
    hashes = line_dedup.line_hashes(rows).repartitionByRange(8, "h1", "h2", F.desc("doc_id")).withColumn("run", F.spark_partition_id())
    hot = hashes.groupBy("h1", "run").count().groupBy("h1").agg(F.count(F.lit(1)).alias("runs"), F.sum("count").alias("n")).orderBy(F.desc("n")).first()
    assert hot.n == 20_000 and hot.runs >= 3


def test_line_dedup_runs_no_python(spark, sf):
    plan = QUERIES["op11_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


# --- importance resampling ------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def resampled(rows, target, percent, min_words, buckets, width):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in runs_of(text, width):
            s[crc(f)] += 1
    for text in target:
        for f in runs_of(text, width):
            t[crc(f)] += 1
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (sum(s) + float(buckets)) / ((float(s[b]) + 1) * (sum(t) + float(buckets))))) for b in range(buckets)]
    out = []
    for d, text in rows:
        found = runs_of(text, width)
        weight = sum(gain[crc(f)] for f in found)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(found), weight, score, None])
    able = sorted((r for r in out if r[0] is not None and r[1] >= min_words), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def word_rows():
    rnd = random.Random(4)
    words = ["Alpha", "beta2", "Straße", "ÉCOLE", "東京", "x" * 50, "gamma", "delta"]
    rows = [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, weights=range(1, 9), k=rnd.randint(0, 60)))) for i in range(150)]
    return rows + [(None, "alpha beta gamma " * 9), (400, None), (401, ""), (402, "!? ."), (-7, "alpha " * 30), (2**40, "beta2 " * 30)]


@pytest.mark.parametrize(("width", "percent"), [(1, 10), (2, 35)])
def test_resampling_against_brute_force(spark, word_rows, width, percent):
    target = ["alpha beta2 alpha", "école Straße", None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(documents(spark, word_rows), wanted, percent, 20, 500, width).collect()
    assert order(tuple(r) for r in got) == order(resampled(word_rows, target, percent, 20, 500, width))


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, []), none).count() == 0
    only = importance.resample(documents(spark, [(1, "a"), (1, "a")]), none, percent=100, min_words=1)
    assert sorted(r["rank"] for r in only.collect()) == [1, 2]


def test_radix_ranks_follow_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_BITS", 5)
    monkeypatch.setattr(importance, "DIGIT_BITS", 3)
    rnd = random.Random(8)
    for values in ([(rnd.choice([5, -3, 700]), rnd.randrange(-90, 90)) for _ in range(400)], [(1, 1)] * 70, [(0, -2**63), (0, 2**63 - 1), (-5, 0)]):
        rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "seq long, a long, b long")
        got = {r.seq: r.position for r in importance.radix_ranks(rows, "seq", [("a", True), ("b", False)]).collect()}
        wanted = sorted(range(len(values)), key=lambda i: (-values[i][0], values[i][1], i))
        assert [got[i] for i in wanted] == list(range(len(values)))


def test_crc_and_pieces_of_long_texts():
    words = [b"a", b"", b"word" * 8, b"longer" * 9, bytes(range(256))]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert importance.crc32s(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]
    text = np.frombuffer(b"one two three " * 50 + b"z" * 300 + b" end", np.uint8)
    parts = list(importance.pieces(text, 64))
    assert b"".join(text[a:b].tobytes() for a, b in parts) == text.tobytes()
    whole = sum((WORD.findall(text[a:b].tobytes().decode()) for a, b in parts), [])
    assert whole == WORD.findall(text.tobytes().decode())


def test_long_texts_are_counted_in_pieces():
    text = "Some Words, again. " * 40_000
    texts, found = zip(*[(t, f) for _, _, t, f in importance.batch_features(pa.array([text]), 97, 1)], strict=True)
    assert len(texts) > 1 and sum(len(t) for t in texts) == 120_000 and not any(t.any() for t in texts)
    assert np.bincount(np.concatenate(found), minlength=97)[zlib.crc32(b"some") % 97] >= 40_000


# --- ball k-means ---------------------------------------------------------------------------

def product_codes(vectors, parts, entries, rounds, scale=4096):
    """vec_id -> (codes, error), and the codebooks, by comparing everything with everything."""
    x = {i: [math.floor(scale * float(c)) for c in v] for i, v in vectors.items()}
    width = len(next(iter(x.values()))) // parts
    books = [[x[i][p * width:(p + 1) * width] for i in sorted(x)[:entries]] for p in range(parts)]

    def assign(v):
        out, error = [], 0
        for p in range(parts):
            piece = v[p * width:(p + 1) * width]
            d, e = min((sum((a - b) ** 2 for a, b in zip(piece, entry, strict=True)), e) for e, entry in enumerate(books[p]))
            out.append(e)
            error += d
        return out, error

    for _ in range(rounds):
        codes = {i: assign(v)[0] for i, v in x.items()}
        for p in range(parts):
            for e in range(len(books[p])):
                members = [x[i][p * width:(p + 1) * width] for i, c in codes.items() if c[p] == e]
                if members:
                    books[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    return {i: assign(v) for i, v in x.items()}, books


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, slot int")


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(9, 16))
    rows = [(int(i), (centres[i % 9] + 0.2 * rnd.normal(size=16)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)] + [(2000, [0.0] * 16), (2001, [-3.5] * 16), (2002, [8191.0] + [-8191.0] * 15)]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 6), (8, 3, 2), (1, 16, 1)])
def test_codes_against_brute_force(spark, vectors, parts, entries, rounds):
    bad = [(-1, None), (-2, [float("nan")] + [0.0] * 15), (-3, [float("inf")] * 16), (-4, [None] + [0.0] * 15), (5000, [1.0] * 15), (5001, [])]
    rows = [(i, v, i % 3 if i % 5 else None, "c", 1) for i, v in vectors + bad]
    got = ball_kmeans.coded(vectors_of(spark, rows), parts, entries, rounds).collect()
    wanted, books = product_codes(dict(vectors), parts, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: ("".join(f"{e:02x}" for e in c), d) for i, (c, d) in wanted.items()}
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()}
    totals = {}
    for i, (_, d) in wanted.items():
        label = i % 3 if i % 5 else None
        totals[label] = totals.get(label, 0) + d
    assert all(r.label_error == totals[r.vec_id % 3 if r.vec_id % 5 else None] for r in got)


def test_balls_equal_a_full_search():
    rnd = np.random.default_rng(2)
    for spread in (0, 1, 4, 60):
        x = rnd.integers(-spread - 1, spread + 2, (500, 4)).astype(np.int64)
        book = rnd.integers(-spread - 1, spread + 2, (16, 4)).astype(np.int64)
        code, best = ball_kmeans.nearest(x, book)
        full = np.square(x[:, None] - book[None]).sum(2)
        assert (code == full.argmin(1)).all() and (best == full.min(1)).all()
        from_any, found = ball_kmeans.ball_nearest(x, rnd.integers(0, 16, 500).astype(np.uint8), book)
        assert (from_any == code).all() and (found == best).all()


def test_vectors_without_a_usable_row(spark):
    assert ball_kmeans.coded(vectors_of(spark, [])).count() == 0
    assert ball_kmeans.coded(vectors_of(spark, [(1, None, 1, "c", 1), (2, [1.0] * 3, 1, "c", 1)])).count() == 0
    assert ball_kmeans.coded(vectors_of(spark, [(None, [1.0] * 8, 1, "c", 1)])).count() == 0
    few = ball_kmeans.coded(vectors_of(spark, [(None, [1.0] * 8, None, "c", 1), (3, [1.0] * 8, None, "c", 1), (3, [2.0] * 8, None, "c", 1)])).collect()
    assert sorted((r.vec_id or -1, r.code, r.error) for r in few) == [(-1, "00" * 8, 361), (3, "00" * 8, 361), (3, "00" * 8, 1444)] or len(few) == 3


# --- near copies ----------------------------------------------------------------------------

def test_many_short_near_copies_in_bounded_memory():
    """20 000 texts of about 180 bytes that differ in one word each."""
    import tracemalloc

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 26).astype(np.uint64)
    sets = []
    for i in range(minhash.BLOCK_TEXTS):
        own = base.copy()
        own[:2] = rnd.integers(0, 2**63, 2)
        sets.append(np.sort(own))
    ends = np.arange(len(sets) + 1) * 26
    signatures = minhash.packed(minhash.minima(np.concatenate(sets), ends))
    everything = np.arange(len(sets))
    tracemalloc.start()
    links = minhash.confirmed_links(sets, signatures, everything, everything, 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == len(sets) - 1 and peak < 200 << 20


def test_repeated_rows_stay_once(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long), (None, "without an id " * 9), (None, "without an id " * 9), (None, "another text without an id " * 9)]
    docs = spark.createDataFrame([(d, t, 1, {"k": "v"}) for d, t in rows], "doc_id long, text string, _gone int, `odd name` map<string,string>")
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns
    assert order((r.doc_id, r.text) for r in got.collect()) == order([rows[0], rows[3], rows[5]])
