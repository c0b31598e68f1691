"""Operators of the training-data subpackage against brute-force versions, libraries and edge cases."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from querygrove.llm import byte_bpe, chat_format, decontaminate, kernel, language_id, lm_scoring, minhash, quality_classifier, quality_rules, suffix_dedup, url_filter  # noqa: E402
from querygrove.llm.components import components  # noqa: E402
from querygrove.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids long, own string"


def documents(spark, rows):
    """Rows (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "x") for d, t in rows], DOCS)


@pytest.fixture(scope="session")
def larger():
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


@pytest.fixture(scope="session")
def texts():
    """Words from few syllables, so that windows repeat, with copies, near copies and edge cases."""
    rnd = random.Random(5)
    syllables = ["an", "the", "ing", "or", "é", "ü", "st"]
    base = [" ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(rnd.randint(30, 120))) for _ in range(25)]
    out = list(base)
    for text in base[:12]:
        out.append(text)
        words = text.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(base[20][:230] + " " + text[:90] + "\n" + base[20][:230])
    out += [None, "", "   \n\t", "a", "one two three", "one two three", "ab " * 400, "x" * 1200, "é" * 300, "Ärger 東京 🎉 don't  stop\n\n", base[3] * 40]
    return list(enumerate(out))


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_span_hashes_agree_for_equal_words():
    data = np.frombuffer(b"ab cd ab  xx ab", np.uint8)
    offsets = np.array([0, 9, 15])
    starts, ends, text = kernel.words(data, offsets)
    hashes = kernel.span_hashes(kernel.prefix_hashes(data, kernel.byte_values(1)), starts, ends)
    assert text.tolist() == [0, 0, 0, 1, 1] and hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3


def test_slices_cover_all_rows():
    column = pa.array(["a" * 10, None, "", "é" * 5, "z" * 50]).slice(1)
    found = [(low, high, data.tobytes(), offsets.tolist()) for low, high, data, offsets in kernel.slices(column, 12)]
    assert [f[:2] for f in found] == [(0, 3), (3, 4)] and found[0][2] == "é".encode() * 5 and found[0][3] == [0, 0, 0, 10]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(f"{rnd.random():.6f}", f"{rnd.random():.6f}") for _ in range(30)]
    chain = [f"{rnd.random():.6f}" for _ in range(40)]
    edges += list(zip(chain, chain[1:])) + [(chain[0], chain[0]), (None, chain[1]), edges[0]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[c] for c in chain} == {min(chain)} and all(got[a] == got[b] == min(a, b) for a, b in edges[:30])
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- op1 ------------------------------------------------------------------------------------


def stripped(rows, length=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[p:p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = {}
    for d, b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                cover[p:p + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[d] = (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover) if not c))
    return out


def test_suffix_dedup_against_brute_force(spark, texts):
    rows = suffix_dedup.strip_repeats(documents(spark, texts)).select("own.doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n, bytes(r.kept)) for r in rows.collect()}
    assert got == stripped(texts)


def test_suffix_dedup_blocks_and_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_PIECES", 3)
    rows = [(None, t) if d % 9 == 0 else (d % 5, t) for d, t in texts]
    want = sorted((w[1], w[3]) for w in stripped([(n, t) for n, (_, t) in enumerate(rows)]).values())
    got = suffix_dedup.strip_repeats(documents(spark, rows)).select("n_removed", "kept").collect()
    assert sorted((r.n_removed, bytes(r.kept)) for r in got) == want


def test_family_merges_equal_sizes(spark):
    family = suffix_dedup.SuffixArrayFamily(spark)
    for n in range(3):
        batch = spark.createDataFrame([(n, 1), (99, 1)], "code long, n long")
        assert {r.code for found in family.scan(batch) for r in found.collect()} == ({99} if n else set())
        family.add(batch)
    assert [level is not None for level in family.levels] == [True, True]
    assert {(r.code, r.n) for r in family.levels[1].collect()} == {(0, 1), (1, 1), (99, 2)}


def test_dropping_repeats_keeps_columns(spark, texts):
    docs = documents(spark, texts)
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())


# --- op2 ------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices(["an", "the", "ing", "or", "st", "ed", "on", "re", "ou"], k=rnd.randint(2, 5)))
    items = [" ".join(word() for _ in range(n)) for n in (14, 25, 40, 70)]
    prose = [" ".join(word() for _ in range(300)) for _ in range(40)]
    reworded = items[2].split()
    for k in range(3, 30, 5):
        reworded[k] = "other"
    planted = {0: items[0], 1: items[1].upper(), 2: " ".join(reworded), 3: items[3]}
    rows = [(d, f"{p[:700]} {planted[d]} {p[700:]}" if d in planted else f"{p} {' '.join(items[2].split()[5:13])}") for d, p in enumerate(prose)]
    rows += [(100, None), (101, ""), (102, "...")]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = rows_of(decontaminate.leaks(documents(spark, rows), benchmark))
    assert {d: r.item_ids for d, r in got.items() if r.contaminated} == {d: [d] for d in range(4)} and len(got) == 43
    assert {r.doc_id for r in decontaminate.drop_leaks(documents(spark, rows), benchmark).collect()} == set(got) - set(range(4))


def test_items_without_id_contaminate(spark):
    words = [f"w{n % 97}x{n % 89}" for n in range(400)]
    long, short = " ".join(words[100:140]), " ".join(words[200:206])
    docs = documents(spark, [(1, " ".join(words[:150])), (2, " ".join(words[190:])), (3, " ".join(words[300:]))])
    benchmark = spark.createDataFrame([(None, long), (None, short), (7, short)], "item_id long, text string")
    got = rows_of(decontaminate.leaks(docs, benchmark))
    assert {d: (r.contaminated, r.item_ids) for d, r in got.items()} == {1: (True, []), 2: (True, [7]), 3: (False, [])}


def test_short_items_are_found(spark):
    """Items of 3 to 12 tokens in the middle of long texts, at every place relative to the windows."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices(["an", "the", "ing", "or", "st", "ed", "on", "re", "ou"], k=rnd.randint(2, 5)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 6, 7, 8, 9, 10, 12) for _ in range(8)]
    prose = [[word() for _ in range(300)] for _ in items]
    rows = [(d, " ".join([*p[:100 + d % 8], items[d].upper(), *p[100 + d % 8:]])) for d, p in enumerate(prose)]
    rows += [(1000 + d, " ".join([*p, *items[d].split()[:-1]])) for d, p in enumerate(prose[:16])]  # the last token is missing: too short, or no whole run
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = rows_of(decontaminate.leaks(documents(spark, rows), benchmark))
    assert all(d in got[d].item_ids and got[d].common_share == 1 for d in range(len(items)))
    assert not any(got[1000 + d].contaminated for d in range(8))


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.leaks(documents(spark, [(1, "a b c")]), none).collect())
    assert decontaminate.leaks(documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate._Checker(np.array(a)).common(b, len(a)) == table[-1][-1]


# --- op3, op10: held-out accuracy -----------------------------------------------------------


def test_quality_on_held_out_rows(spark, larger):
    rows = QUERIES["op3_quality_classifier"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").collect()
    assert held and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_quality_edges(spark, texts):
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(d, d % 2, 5) for d, _ in texts[:20]] + [(1, None, 5), (None, 1, 5)], "doc_id long, quality int, text long")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    flat = quality_classifier.score(docs, quality_classifier.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}


def test_attention_learns_the_one_bad_passage():
    rng = np.random.default_rng(1)
    x, bag, y = [], [], []
    for n in range(200):
        own = rng.normal(size=(6, quality_classifier.WIDTH)).astype(np.float32)
        y.append(n % 2)
        if n % 2:
            own[rng.integers(6), :4] += 6
        x.append(own)
        bag += [n] * 6
    model = quality_classifier.fit_bags(np.concatenate(x), np.array(bag), np.array(y, float))
    scores = model.scores(np.concatenate(x), np.array(bag), 200)
    assert ((scores > 0.5) == np.array(y, bool)).mean() > 0.95


def test_language_on_held_out_rows(spark, larger):
    rows = QUERIES["op10_language_id"](spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet"), "doc_id")
    held = rows.filter("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(n, f"the and {n} ing", "en") for n in range(8)] + [(20 + n, f"der und {n} ung", "de") for n in range(8)] + [(90, "abc", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = documents(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "東京"), (5, "the and ing"), (6, "und der ung")])
    got = rows_of(language_id.predict(asked, language_id.fit(table)))
    assert [got[n].lang_pred for n in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in ("en", "de")
    assert (got[5].lang_pred, got[6].lang_pred) == ("en", "de")
    assert {r.lang_pred for r in language_id.predict(asked, language_id.fit(table.filter("lang = 'en'"))).collect()} == {"und", "en"}
    assert {r.lang_pred for r in language_id.predict(asked, language_id.fit(table.limit(0))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than rows of the sample, and more than 216."""
    rows = [(n, f"text of {n}", f"l{n % 260:03}") for n in range(520)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=240)
    assert model.languages == [f"l{n:03}" for n in range(260)]


def test_codewords_differ():
    for n in (2, 3, 4, 9):
        code = language_id.codewords(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


# --- op4 ------------------------------------------------------------------------------------


def test_roles_are_recovered(spark, sf):
    rows = QUERIES["op4_chat_format"](spark, sf).collect()
    assert sum(r.role == r.true_role for r in rows) >= 0.95 * len(rows)


def test_long_transcripts_decode_as_one(spark):
    """However the chunks of a transcript are partitioned, the states are those of one Viterbi run."""
    rnd = random.Random(4)
    chunks = []
    for turn in range(300):
        mark = rnd.choice(["User: ", "Assistant: ", "### System\n", "", "", "[user] "])
        chunks.append((7, turn, mark + rnd.choice(["hello there?", "some words\nmore words", "", "fine\n\nand on"]) + rnd.choice(["", "\n"])))
    chunks += [(None, 1, "User: hi"), (8, 1, None), (8, 1, "Q: why?"), (8, 1, "Q: why?")]
    want, blank, lines = [], False, []
    for c in chunks[:300]:
        for scores, text, blank in chat_format.read_lines(c[2], blank):
            lines.append((c[1], scores))
    states = chat_format.decode([s for _, s in lines])
    for k, ((turn, _), state) in enumerate(zip(lines, states)):
        if k == 0 or lines[k - 1][0] != turn or state % 2 == 0:
            want.append((turn, chat_format.ROLES[state // 2], state % 2 == 0))
    df = spark.createDataFrame(chunks, "conv_id long, turn int, text string")
    got = chat_format.parse_transcripts(df).filter("conv_id = 7").orderBy("turn", "segment").collect()
    assert [(r.turn, r.role, r.begins) for r in got] == want
    assert chat_format.parse_transcripts(df.limit(0)).count() == 0
    assert chat_format.parse_transcripts(df).filter("conv_id is null or conv_id = 8").count() == 4


# --- op5 ------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def vocabulary():
    return byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="session")
def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    keys = list(vocabulary.ranks)
    assert sorted(vocabulary.table.slots(keys).tolist()) == list(range(len(keys)))


def test_encoding_agrees_with_the_library(spark, texts, vocabulary, reference_encoding):
    decoded = byte_bpe.decode(byte_bpe.encode(documents(spark, texts), vocabulary), vocabulary)
    got = rows_of(decoded)
    for d, t in texts:
        assert got[d].ids == reference_encoding.encode_ordinary(t or "") and bytes(got[d].decoded) == (t or "").encode()
    digest = rows_of(byte_bpe.digests(decoded))
    assert digest[0].ids_sha256 == hashlib.sha256(",".join(map(str, got[0].ids)).encode()).hexdigest()


def test_encoding_random_text(vocabulary, reference_encoding):
    rnd, encoder = random.Random(6), byte_bpe.Encoder(vocabulary)
    alphabet = "abcdefgh 's\n\t1290éßñ東🎉'  .,!" + "the"
    found = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(500)] + ["<|endoftext|> x"]
    assert encoder.encode(found) == [reference_encoding.encode_ordinary(t) for t in found]


def test_unknown_ids_decode_to_nothing(spark, vocabulary):
    df = spark.createDataFrame([(1, [64, None, 999999, -3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(df, vocabulary).orderBy("doc_id").collect()] == [reference(64, vocabulary), b"", b""]


def reference(rank, vocabulary):
    return next(token for token, n in vocabulary.ranks.items() if n == rank)


# --- op6 ------------------------------------------------------------------------------------


def test_scores_prefer_seen_order(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(w for _ in range(40) for w in rnd.choice([("red", "blue", "green"), ("one", "two", "three")]))
    rows = [(n, text()) for n in range(60)]
    docs = documents(spark, [*rows, (98, None), (99, " ")])
    model = lm_scoring.fit(docs)
    shuffled = rows[0][1].split()
    rnd.shuffle(shuffled)
    got = rows_of(lm_scoring.score(documents(spark, [rows[0], (1, " ".join(shuffled)), (2, None), (3, "")]), model))
    assert got[0].mean_log_probability > got[1].mean_log_probability
    assert got[2].n_words == got[3].n_words == 0 and got[2].mean_log_probability is None and got[2].log_likelihood == 0
    assert abs(got[0].log_likelihood / got[0].n_words - got[0].mean_log_probability) < 1e-9
    assert int(lm_scoring.word_counts(docs).sum()) == sum(len(t.split()) for _, t in rows)


def test_probabilities_sum_to_one():
    model = lm_scoring.WindowNetwork.start(np.random.default_rng(1).integers(0, 50, lm_scoring.BUCKETS))
    text = np.zeros(5, int)
    hidden = model.hidden(model.context(np.arange(5), text))
    logits = hidden @ model.out + model.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    total = (p / p.sum(1, keepdims=True)).sum(1)
    shares = np.bincount(model.classes, np.exp(model.share), minlength=lm_scoring.CLASSES)
    assert np.allclose(total, 1) and np.allclose(shares[shares > 0], 1, atol=1e-3)


def test_words_of_a_bucket_keep_their_own_counts(spark):
    """A rare word does not score as a frequent one that hashes alike, whether its count is broadcast or joined."""
    rows = [(n, " ".join(f"w{k}" for k in range(200) for _ in range(1 + 9 * (k % 2)))) for n in range(3)]
    counts = collections.Counter(w for _, t in rows for w in t.split())
    names = sorted(counts)
    asked = documents(spark, [*enumerate(names), (900, "never"), (None, "w0 w0"), (None, "w0 w0"), (901, None)])
    table = lm_scoring.word_table(documents(spark, rows))
    assert sorted(r.n for r in table.collect()) == sorted(counts.values())

    def scores(head, own):
        vocabulary = lm_scoring.Vocabulary.of(table, head, own)
        assert len(vocabulary.word) == (200 if head else 0) and vocabulary.counts.sum() == sum(counts.values())
        return lm_scoring.score(asked, lm_scoring.Model(lm_scoring.WindowNetwork.start(vocabulary.counts), vocabulary, table)).collect()

    def ordered(got):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_likelihood, 4)) for r in got)

    assert ordered(scores(0, 0)) == ordered(scores(1000, 0))
    got = scores(0, lm_scoring.BUCKETS - 2)  # all words share two buckets
    value = {r.doc_id: r.log_likelihood for r in got}
    word = lm_scoring.word_hashes(np.frombuffer("".join(names).encode(), np.uint8), np.cumsum([0, *map(len, names)]))[0]
    for side in (0, 1):
        members = [(counts[w], value[d]) for d, w in enumerate(names) if word[d] % 2 == side]
        assert {n for n, _ in members} == {3, 30}
        assert all(abs((v - members[0][1]) - np.log(n / members[0][0])) < 1e-6 for n, v in members)
    assert len(got) == 204 and value[900] < min(v for d, v in value.items() if d is not None and d < 200) and value[901] == 0


def test_words_of_one_class_are_told_apart_by_both_sides():
    """Of two equally frequent words of a class, the network learns which one stands between which neighbours."""
    counts = (1e6 / np.arange(1, lm_scoring.BUCKETS + 1)).astype(int)
    model = lm_scoring.WindowNetwork.start(counts)
    x, y = np.flatnonzero(model.classes == lm_scoring.OWN_CLASSES + 20)[:2]
    left, right = np.flatnonzero(model.classes == lm_scoring.OWN_CLASSES + 3)[:2]
    rng = np.random.default_rng(1)
    for _ in range(40):
        pick = rng.integers(0, 2, 1000)
        train = np.stack([np.where(pick, left, right), np.where(pick, x, y), np.where(pick, left, right)], 1).ravel()
        model.train(train, np.repeat(np.arange(1000), 3), 4.0)
    word = np.array([left, x, left, left, y, left, right, y, right, right, x, right])
    got = model.log_probability(word, np.repeat(np.arange(4), 3)).reshape(4, 3)
    assert got[0, 1] > got[1, 1] + 1 and got[2, 1] > got[3, 1] + 1
    assert got[0, 0] > got[1, 0] and got[2, 0] > got[3, 0]  # and the neighbours' own terms see the word
    every = np.arange(lm_scoring.BUCKETS)
    text = np.repeat(every, 3)
    lines = np.stack([np.full(len(every), left), every, np.full(len(every), right)], 1).ravel()
    assert abs(np.exp(model.log_probability(lines, text)[1::3].astype(float)).sum() - 1) < 1e-3


def test_logits_of_any_size_give_probabilities():
    """Exponentials that would overflow or vanish lose the largest logit first; the others keep their value."""
    rng = np.random.default_rng(2)
    h = np.ones((60, lm_scoring.HIDDEN + 1), np.float32)
    h[:, :-1] = rng.uniform(-1, 1, (60, lm_scoring.HIDDEN))
    at = rng.integers(0, 40, 60)
    for size, bias in ((0.1, 0), (0.1, -200), (0.1, 200), (30, 0)):
        weights = rng.normal(0, size, (40, lm_scoring.HIDDEN + 1)).astype(np.float32)
        weights[:, -1] += bias
        logits = h.astype(float) @ weights.T.astype(float)
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        with np.errstate(over="ignore"):
            got = lm_scoring._log_softmax(h, weights, at)
            moved = weights.copy()
            pull = lm_scoring._step(h, moved, at, 0.5)
        assert np.allclose(got, logits[np.arange(60), at] - np.log(np.exp(logits).sum(1)), rtol=1e-3, atol=1e-3)
        p[np.arange(60), at] -= 1
        assert np.allclose(pull, p @ weights[:, :-1], rtol=1e-2, atol=1e-2 * size)
        assert np.allclose(weights - moved, 0.5 * p.T @ h, atol=1e-3)


def test_a_step_moves_every_parameter_along_the_gradient():
    """Training against plain differentiation, one word at a time, in double precision."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 500, lm_scoring.BUCKETS)
    model = lm_scoring.WindowNetwork.start(counts)
    model.inner[:] = rng.normal(0, 0.1, model.inner.shape)
    word = rng.choice(np.argsort(-counts)[:600], 700)
    text = np.sort(rng.integers(0, 9, 700))
    embed, bias, out, out_bias, inner, inner_bias = (x.astype(float) for x in model._parameters())
    own, place, context = model.classes[word], model.place[word], model.context(model.inputs(word), text)
    members = np.bincount(own, minlength=lm_scoring.CLASSES)
    moved = [x.copy() for x in (embed, bias, out, out_bias, inner, inner_bias)]
    scores = np.empty(700)
    for i in range(700):
        h = np.tanh(bias + sum(embed[k, context[k, i]] for k in range(4)))
        p = np.exp(h @ out + out_bias)
        p /= p.sum()
        scores[i] = np.log(p[own[i]])
        p[own[i]] -= 1
        pull = out @ p
        moved[2] -= 2.0 / 700 * np.outer(h, p)
        moved[3] -= 2.0 / 700 * p
        a, b = model.bounds[own[i]], model.bounds[own[i] + 1]
        if b - a > 1:
            q = np.exp(inner[a:b] @ h + inner_bias[a:b])
            q /= q.sum()
            scores[i] += np.log(q[place[i] - a])
            q[place[i] - a] -= 1
            pull += q @ inner[a:b]
            rate = 2.0 * lm_scoring.INNER_RATE / max(members[own[i]], lm_scoring.INNER_WORDS)
            moved[4][a:b] -= rate * np.outer(q, h)
            moved[5][a:b] -= rate * q
        dh = pull * (1 - h * h)
        moved[1] -= 2.0 / 700 * dh
        for k in range(4):
            moved[0][k, context[k, i]] -= 2.0 / 700 * dh
    assert np.allclose(model.log_probability(word, text), scores, atol=1e-4)
    model.train(word, text, 2.0)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(model._parameters(), moved, strict=True))
    assert not np.allclose(moved[4], inner, atol=1e-4)


def test_a_step_over_several_groups_is_a_step_for_each():
    """Groups that stand side by side move their own outcomes only, also where the exponentials of one overflow or vanish."""
    rng = np.random.default_rng(7)
    bounds, counts = [0, 30, 32, 90], [25, 1, 60]
    groups = [(slice(sum(counts[:k]), sum(counts[:k + 1])), bounds[k], bounds[k + 1]) for k in range(3)]
    h = np.ones((sum(counts), lm_scoring.HIDDEN + 1), np.float32)
    h[:, :-1] = rng.uniform(-1, 1, (len(h), lm_scoring.HIDDEN))
    at = np.concatenate([rng.integers(a, b, n) for n, (_, a, b) in zip(counts, groups, strict=True)])
    rates = np.array([0.5, 0.25, 0.125])
    for bias in (0, -200, 200):
        weights = rng.normal(0, 0.3, (100, lm_scoring.HIDDEN + 1)).astype(np.float32)
        weights[30:32, -1] += bias
        for room in (None, np.empty(100, np.float32), np.full(10_000, np.nan, np.float32)):
            one_by_one, together = weights.copy(), weights.copy()
            with np.errstate(over="ignore", divide="ignore"):
                pulls = [lm_scoring._step(h[rows], one_by_one[a:b], at[rows] - a, rate) for (rows, a, b), rate in zip(groups, rates, strict=True)]
                pull = lm_scoring._step(h, together, at, np.repeat(rates, counts), room, groups)
            assert np.allclose(pull, np.concatenate(pulls), atol=1e-5) and np.allclose(together, one_by_one, atol=1e-5)
            assert (together[90:] == weights[90:]).all() and not np.allclose(together[:90], weights[:90], atol=1e-3)


def test_classes_of_a_step_are_trained_together(monkeypatch):
    """Small arrays of each class cost more calls than work: what is done row by row is done once for all of them."""
    rng, calls, step = np.random.default_rng(8), [], lm_scoring._step
    monkeypatch.setattr(lm_scoring, "_step", lambda *a, **k: calls.append(len(a[0])) or step(*a, **k))
    model = lm_scoring.WindowNetwork.start(rng.integers(1, 500, lm_scoring.BUCKETS))
    word = rng.integers(0, lm_scoring.BUCKETS, 2 * lm_scoring.STEP_WORDS + 10)
    model.train(word, np.zeros(len(word), int), 1.0)
    several = np.isin(model.classes[word], np.flatnonzero(np.diff(model.bounds) > 1))
    assert len(calls) == 6 and sum(calls) == len(word) + several.sum()


def test_buckets_are_those_of_a_look_up():
    rng = np.random.default_rng(10)
    word = np.unique(rng.integers(np.iinfo(np.int64).min, np.iinfo(np.int64).max, 3000))
    bucket = rng.integers(0, lm_scoring.BUCKETS, 2000)
    vocabulary = lm_scoring.Vocabulary(word[:2000], rng.integers(1, 90, 2000), bucket, np.full(lm_scoring.BUCKETS, 100), 4000)
    asked = rng.permutation(word)
    assert (vocabulary.buckets(asked) == vocabulary.look_up(asked)[0]).all() and (vocabulary.buckets(word[:2000]) == bucket).all()
    assert (vocabulary.buckets(word[2000:]) == vocabulary._shared(word[2000:], 4000)).all()


def test_hidden_values_are_hyperbolic_tangents():
    rng = np.random.default_rng(9)
    model = lm_scoring.WindowNetwork.start(np.full(lm_scoring.BUCKETS, 5))
    for size in (0.01, 1, 100):
        model.embed[:], model.bias[:] = rng.normal(0, size, model.embed.shape), rng.normal(0, size, model.bias.shape)
        context = rng.integers(0, lm_scoring.INPUTS + 1, (len(lm_scoring.OFFSETS), 300))
        with np.errstate(over="ignore"):
            got = model.hidden(context)
        assert np.allclose(got, np.tanh(model.bias.astype(float) + sum(model.embed[k, c].astype(float) for k, c in enumerate(context))), rtol=1e-4, atol=3e-6)


def test_counted_words_are_found_whatever_their_leading_bits():
    rng = np.random.default_rng(5)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    near = (rng.integers(-9, 9, 8) << 40)[:, None] + np.arange(30)  # many with the same leading bits
    word = np.unique(np.concatenate([near.ravel(), rng.integers(low, high, 500), [low, high, 0, -1]]))
    asked = np.concatenate([word, word[:-1] + 1, rng.integers(low, high, 500), [high - 1, low + 1]])
    n = rng.integers(1, 90, len(word))
    for counted in (word, word[:-1], word[:0]):
        counts = np.full(lm_scoring.BUCKETS, 100)
        bucket = np.arange(len(counted)) % 50 + 90
        vocabulary = lm_scoring.Vocabulary(counted, n[:len(counted)], bucket, counts, 100)
        at = {w: i for i, w in enumerate(counted.tolist())}
        got = vocabulary.look_up(asked)
        for w, b, share, open_ in zip(asked.tolist(), *got, strict=True):
            i = at.get(w)
            assert open_ == (i is None)
            assert b == (bucket[i] if i is not None else lm_scoring.Vocabulary._shared(w, 100))
            assert abs(share - (0 if b < 100 else np.log(1 if i is None else n[i]) - np.log(100.5))) < 1e-12


def test_words_hash_alike_wherever_they_stand():
    texts = ["", "One two", "x" * (2 * lm_scoring.HASHED_BYTES) + " two", " ", *(f"one two w{k}" for k in range(9000)), "two"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    word, text = lm_scoring.word_hashes(data, offsets)
    names = [(w.lower(), k) for k, t in enumerate(texts) for w in t.split()]
    assert text.tolist() == [k for _, k in names]
    seen = {}
    assert all(seen.setdefault(w, h) == h for (w, _), h in zip(names, word.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


# --- op7 ------------------------------------------------------------------------------------


def near_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_near_duplicates_against_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    rnd = random.Random(9)
    family = texts[20][1].split(" ")
    rows = list(texts)
    for n in range(40):  # near copies at all distances around the threshold
        words = list(family)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(1000)}"
        rows.append((1000 + n, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == near_groups(rows)


def test_near_duplicate_edges(spark, texts):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = [(None, texts[0][1]), (5, texts[0][1]), (5, texts[0][1]), (6, texts[0][1]), (5, "other words than those of before")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert sorted(r.doc_id or -1 for r in minhash.keep_first(documents(spark, rows)).collect()) == [-1, 5, 5]


def test_texts_that_share_an_id_are_decided_one_by_one(spark, texts):
    rows = [(1, texts[0][1]), (2, texts[0][1]), (2, "a text that stands only here and must stay"), (2, None), (3, texts[1][1]), (4, texts[1][1])]
    docs = documents(spark, rows)
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, texts[0][1]), (2, rows[2][1]), (2, ""), (3, texts[1][1])])


def test_bit_counts_estimate_similarity():
    rng = np.random.default_rng(3)
    common, errors = rng.integers(0, 1 << 63, 400).astype(np.uint64), []
    for k in (0, 100, 200, 300, 400):
        a = np.concatenate((common[:k], rng.integers(0, 1 << 63, 400 - k).astype(np.uint64)))
        b = np.concatenate((common[:k], rng.integers(0, 1 << 63, 400 - k).astype(np.uint64)))
        p = [minhash.packed(minhash.minima(np.sort(x), np.array([0, len(x)]))) for x in (a, b)]
        errors.append(abs(minhash.estimated(*p)[0, 0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert max(errors) < 0.2


# --- op8 ------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://Example.com/en/1?q", "https://www.example.com/en/", "https://a.b.net/es/x#t", "http://x.net/fr", "http://com", "http://org.com/", None, "nothing",
            "ftp://h?x://y/", "https://m.win-casino.org/de/1", "https://library.org/", "http://myexample.com/en/1", "a://b://c/d", "http://u.com\n/x"]
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(urls)], "page_id long, url string, host string")
    got = rows_of(url_filter.url_filter(pages, url_filter.labelled_table(spark)), "page_id")
    want = {0: ("example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 2: ("a.b.net", "/es/x", "net/es/", "block"),
            3: ("x.net", "/fr", None, None), 4: ("com", "", None, None), 5: ("org.com", "/", "com/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h", "", None, None),
            9: ("m.win-casino.org", "/de/1", None, "block"), 10: ("library.org", "/", None, "allow"), 11: ("myexample.com", "/en/1", "com/", "allow"), 12: ("b:", "//c/d", None, None),
            13: ("u.com\n", "/x", None, None)}
    for n, (host, path, rule, verdict) in want.items():
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule) and verdict in (None, got[n].verdict), (n, got[n])
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.url_filter(pages.limit(0), url_filter.labelled_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages.filter("page_id = 9"), url_filter.labelled_table(spark).limit(0)).collect()} == {"allow"}


def test_url_filter_is_native(spark, sf):
    plan = QUERIES["op8_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op9 ------------------------------------------------------------------------------------


def counted(text):
    words = WORD.findall(text or "")
    lines, dup = collections.Counter(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += lines[line] > 0
            lines[line] += 1
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_counts_against_brute_force(spark, texts):
    more = [(500, "a | b\n#x\n\na | b\n a | b\n"), (501, "a b c d e f g h a b c d e f g h a b"), (502, "\v\fw\r\nw\r\nw")]
    got = rows_of(quality_rules.quality_rules(documents(spark, texts + more)))
    for d, t in texts + more:
        r, want = got[d], counted(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_outliers_are_found_and_prose_is_kept(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    rows = quality_rules.quality_rules(docs).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) <= 0.05 * len(bad)


def test_distance_agrees_with_numpy(spark, sf):
    """The estimates of the aggregations are a fixed point of a concentration step done in numpy."""
    counts = quality_rules.text_counts(spark.read.parquet(f"{sf}/documents.parquet"))
    groups, fit = quality_rules.estimates(counts, min_group=10**6, steps=12)
    x = np.array([r[0] for r in counts.select(quality_rules._vector()).collect()])
    row = fit.first()
    center, inverse = np.array(row["_center"]), np.array(row["_inverse"]).reshape(x.shape[1], -1)
    for _ in range(3):
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        kept = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
        center, inverse = kept.mean(0), np.linalg.inv(np.cov(kept.T, bias=True) + np.diag(np.square(quality_rules.FLOORS)))
    assert np.allclose(center, row["_center"], atol=0.02)


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name


def test_pipeline_against_its_parts(spark, sf, reference_encoding):
    """run() agrees with brute-force versions of the near-duplicate, repeat and token stages on what the first stage kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = near_groups(rows)
    rows = [(d, t) for d, t in rows if first[d][2]]
    rows = [(d, v[3].decode("utf-8", "replace")) for d, v in stripped(rows).items()]
    leaked = {r.doc_id for r in decontaminate.leaks(documents(spark, rows), spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
    want = {d: reference_encoding.encode_ordinary(t) for d, t in rows if d not in leaked}
    got = rows_of(corpus_pipeline.run(spark, sf))
    assert {d: r.ids for d, r in got.items()} == want


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
