"""Suffix-array dedup of byte strings of ``LENGTH`` bytes.

Sampled suffixes. Of the suffixes that begin in a string of LENGTH bytes one is
chosen by content: the one whose first ``PREFIX`` bytes hash lowest. Equal
strings choose the same one, so two strings can only be equal where their
chosen suffixes begin alike. A piece is a run of consecutive strings with the
same chosen suffix; every string lies in exactly one piece.

The index family. Each batch of documents gets the array of its sampled
suffixes, in the order of the fingerprint of their prefix. It is merge-scanned
against the arrays of the existing levels for prefixes that occur in both; then
arrays of equal size merge into the next level, as in a binary counter. Every
array is one sorted table with a row per distinct prefix, so a prefix shared by
a third of the documents is one row.

Long matches. Pieces whose prefix occurs once hold no repeated string. Equal
pieces are repeated as a whole. Different pieces with the same prefix meet in
one task, where all their strings are sorted and equal neighbours are the
repeats; a prefix with many different pieces is compared block against block.
A Bloom filter of bounded size decides which pieces and documents need not be
shuffled; its false positives change nothing.

Defined cases: a null text has no bytes; texts shorter than LENGTH keep
everything; rows are told apart by (doc_id, text), so that repeated rows repeat
each other's strings and lose them, and a null or repeated doc_id is no fault;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.llm.kernel import byte_values, mix, owner, powers, prefix_hashes, slices, span_hashes
from querygrove.llm.scratch import remove, text_batches, written

LENGTH = 200
PREFIX = 64
BATCHES = 4
BLOCK_PIECES = 8192
BLOOM_BITS = 25

_VALUES = byte_values(1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The pieces of all texts of a slice: text, start in the text, number of strings, place of the chosen suffix, code, key."""
    n = len(data)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return dict.fromkeys(("text", "start", "strings", "at", "code", "key"), empty)
    sums = prefix_hashes(data, _VALUES)
    hashes = mix((sums[PREFIX:] - sums[:-PREFIX]) * powers(n + 1)[1][:n - PREFIX + 1])
    # Hash above, position below: the minimum names the leftmost lowest suffix.
    bits = np.uint64(n.bit_length())
    lowest = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, choices = 1, LENGTH - PREFIX + 1
    while 2 * width <= choices:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if choices > width:
        lowest = np.minimum(lowest[:width - choices], lowest[choices - width:])
    chosen = (lowest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), offsets[1:] - offsets[:-1])[:len(chosen)]
    inside = np.arange(len(chosen)) + LENGTH <= offsets[1:][text]
    new, last = inside.copy(), inside.copy()
    same = (chosen[1:] == chosen[:-1]) & inside[1:] & inside[:-1]
    new[1:] &= ~same
    last[:-1] &= ~same
    start, end = np.flatnonzero(new), np.flatnonzero(last)
    suffix = chosen[start]
    key = mix(span_hashes(sums, start, end + LENGTH) + (suffix - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"text": text[start], "start": start - offsets[:-1][text[start]], "strings": end - start + 1, "at": suffix - start,
            "code": hashes[suffix].view(np.int64), "key": key.view(np.int64)}


class SuffixArrayFamily:
    """Logarithmic family of sampled suffix arrays, each a sorted table (code, n) in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[DataFrame | None] = []

    def scan(self, batch: DataFrame) -> list[DataFrame]:
        """Codes that occur twice in the batch, or in the batch and an existing level."""
        return [batch.filter("n > 1").select("code"), *[batch.join(level, "code", "left_semi").select("code") for level in self.levels if level is not None]]

    def add(self, batch: DataFrame) -> None:
        """Takes in the array of a batch; two arrays of a level merge into one of the next."""
        for place, level in enumerate(self.levels):
            if level is None:
                self.levels[place] = batch
                return
            both = batch.unionByName(level).groupBy("code").agg(F.sum("n").alias("n")).sortWithinPartitions("code")
            merged = written(both, f"suffix-level{place + 1}")
            if place:  # level 0 holds the callers' tables
                remove(batch)
                remove(level)
            self.levels[place], batch = None, merged
        self.levels.append(batch)


def _row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = np.asarray(batch.column("batch")).astype(np.int32)
        for low, high, data, offsets in slices(batch.column("text")):
            found = pieces(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(part[low:high][found["text"]]), pa.array(found["code"])], names=["batch", "code"])


class Bloom:
    """Bits set by 64-bit hashes; built as an aggregation of at most 2**(bits - 6) rows."""

    def __init__(self, hashes: DataFrame, column: str, bits: int = BLOOM_BITS) -> None:
        h = F.col(column)
        place = F.explode(F.array(h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits)))
        words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
        got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set")).toArrow()
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64)
        self.words[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        out = np.ones(len(h), bool)
        for p in (h & np.uint64((1 << self.bits) - 1), h >> np.uint64(64 - self.bits)):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _candidates(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """All pieces whose code may occur more than once."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(bloom), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.asarray(batch.column("row"))
            for low, high, data, offsets in slices(batch.column("text")):
                found = pieces(data, offsets)
                near = shared.value.holds(found["code"])
                text = found["text"][near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low).take(pa.array(text)), pa.array(row[low:high][text]), pa.array(found["start"][near].astype(np.int32)),
                     pa.array(found["strings"][near].astype(np.int32)), pa.array(found["at"][near].astype(np.int32)), pa.array(found["code"][near]), pa.array(found["key"][near])],
                    names=["doc_id", "row", "start", "strings", "at", "code", "key"])

    return docs.mapInArrow(run, f"doc_id {kind}, row long, start int, strings int, at int, code long, key long")


def _only(docs: DataFrame, bloom: Bloom, hit: bool) -> DataFrame:
    """The documents that the filter may hold, or those that it does not."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = shared.value.holds(np.asarray(batch.column("row")))
            yield batch.filter(pa.array(near if hit else ~near))

    return docs.mapInArrow(run, docs.schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed pieces."""
    for batch in batches:
        listed = batch.column("pieces")
        lengths = np.asarray(pc.list_value_length(listed))
        flat = listed.flatten()
        values = {k: np.asarray(flat.field(k)) for k in ("start", "strings", "at", "code", "key", "other", "block")}
        first = np.concatenate(([0], np.cumsum(lengths)))
        for low, high, data, offsets in slices(batch.column("text")):
            part = slice(first[low], first[high])
            text = np.repeat(np.arange(high - low), lengths[low:high])
            begin = offsets[text] + values["start"][part]
            size = values["strings"][part] + LENGTH - 1
            raw = data.tobytes()
            blobs = [raw[a:a + b] for a, b in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low).take(pa.array(text)), batch.column("row").slice(low, high - low).take(pa.array(text)),
                 *[pa.array(values[k][part]) for k in ("start", "at", "code", "block", "other")], pa.array(blobs, pa.binary())],
                names=["doc_id", "row", "start", "at", "code", "block", "other", "blob"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of different pieces; rows of a (code, i, j) group come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        together = pa.Table.from_batches(held).combine_chunks()
        ids = [np.asarray(together.column(c)) for c in ("code", "i", "j")]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) if len(together) > 1 else np.zeros(0, int)
        if not len(change) or together.nbytes < 1 << 20:
            continue
        cut = int(change[-1]) + 1  # the last group may go on
        yield from _repeats_in(together.slice(0, cut))
        held = together.slice(cut).to_batches()
    if held:
        yield from _repeats_in(pa.Table.from_batches(held).combine_chunks())


def _repeats_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    code, i, j = (np.asarray(table.column(c)) for c in ("code", "i", "j"))
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(new)
    low = 0
    while low < len(group):
        # Whole groups of about 1024 pieces at a time.
        high = int(np.searchsorted(group, group[min(low + 1024, len(group)) - 1], "right"))
        part = table.slice(low, high - low)
        ((_, _, data, offsets),) = slices(part.column("blob"), 1 << 60, 1 << 60)
        strings = (offsets[1:] - offsets[:-1]) - LENGTH + 1
        owner_of = np.repeat(np.arange(len(part)), strings)
        within = np.arange(len(owner_of)) - np.repeat(np.concatenate(([0], np.cumsum(strings)[:-1])), strings)
        begin = offsets[:-1][owner_of] + within
        place = (np.asarray(part.column("at"))[owner_of] - within).astype(np.uint64)
        print_ = span_hashes(prefix_hashes(data, _VALUES), begin, begin + LENGTH)
        order_key = mix(print_ + group[low:high].astype(np.uint64)[owner_of] * np.uint64(0x9E3779B97F4A7C15) + place)
        order = np.argsort(order_key, kind="stable")
        same = order_key[order][1:] == order_key[order][:-1]
        repeated = np.zeros(len(order), bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        first, last = repeated.copy(), repeated.copy()
        run_on = repeated[1:] & repeated[:-1] & (owner_of[1:] == owner_of[:-1])
        first[1:] &= ~run_on
        last[:-1] &= ~run_on
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        of, begins = owner_of[a], np.asarray(part.column("start"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").combine_chunks().take(pa.array(of)), part.column("row").combine_chunks().take(pa.array(of)),
             pa.array((begins[of] + within[a]).astype(np.int32)), pa.array((begins[of] + within[b] + LENGTH).astype(np.int32))],
            names=["doc_id", "row", "low", "high"])
        low = high


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, row, low, high): byte spans that cover every repeated string; spans may overlap.

    ``docs`` has doc_id, text and row, which with doc_id names the text.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parted = docs.select(F.pmod("row", F.lit(batches)).cast("int").alias("batch"), "text")
    runs = parted.mapInArrow(_codes, "batch int, code long").groupBy("batch", "code").agg(F.count(F.lit(1)).alias("n"))
    runs = written(runs.sortWithinPartitions("batch", "code"), "suffix-batches", by="batch")
    family, matches = SuffixArrayFamily(spark), None
    for number in range(batches):
        batch = runs.filter(F.col("batch") == number).select("code", "n")
        for found in family.scan(batch):
            found = written(found, "suffix-matches")
            matches = found if matches is None else matches.union(found)
        if number + 1 < batches:  # nothing is scanned against the last merge
            family.add(batch)
    bloom = Bloom(matches, "code")
    near = written(_candidates(docs, bloom), "suffix-pieces")
    classes = near.groupBy("code", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "start", "strings", "at")).alias("one"))
    classes = written(classes, "suffix-classes")
    whole = near.join(classes.filter("n > 1").select("code", "key"), ["code", "key"]).select("doc_id", "row", F.col("start").alias("low"), (F.col("start") + F.col("strings") + F.lit(LENGTH - 1)).alias("high"))
    # Prefixes that go on differently: one piece of each kind is compared.
    kinds = classes.groupBy("code").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    mixed = classes.join(kinds, "code").withColumn("blocks", F.ceil(F.col("kinds") / BLOCK_PIECES))
    mixed = mixed.select("code", "key", "one.*", F.col("blocks").cast("int").alias("other"), F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
    mixed = written(mixed, "suffix-mixed")
    listed = mixed.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "strings", "at", "code", "key", "other", "block")).alias("pieces"))
    some = _only(docs, Bloom(mixed.select("row"), "row", 22), True)
    joined = some.join(listed.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    blobs = joined.select("doc_id", "row", "text", "pieces").mapInArrow(_cut, f"doc_id {kind}, row long, start int, at int, code long, block int, other int, blob binary")
    dealt = blobs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    dealt = dealt.select("doc_id", "row", "start", "at", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blob")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "code", "i", "j").sortWithinPartitions("code", "i", "j")
    part = dealt.mapInArrow(_repeats, f"doc_id {kind}, row long, low int, high int")
    return whole.union(part)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column("spans") if "spans" in batch.schema.names else None
        for low, high, data, offsets in slices(batch.column("text")):
            n, raw = high - low, data.tobytes()
            kept, removed, spans = [], np.zeros(n, np.int64), []
            for k in range(n):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                own = listed[low + k].as_py() if listed is not None else None
                if not own:
                    kept.append(raw[begin:end])
                    spans.append([])
                    continue
                merged: list[list[int]] = []
                for a, b in sorted((s["low"], s["high"]) for s in own):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, parts = begin, []
                for a, b in merged:
                    parts.append(raw[at:begin + a])
                    at = begin + b
                kept.append(b"".join([*parts, raw[at:end]]))
                removed[k] = sum(b - a for a, b in merged)
                spans.append([{"low": a, "high": b} for a, b in merged])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own").slice(low, n), pa.array(offsets[1:] - offsets[:-1]), pa.array(removed), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["own", "n_bytes", "n_removed", "spans", "kept"])


def strip_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """For every row of ``docs``: the row as struct ``own``, n_bytes, n_removed, the removed spans, and the remaining bytes ``kept``."""
    text_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", _row_key().alias("row"), F.struct(*[c for c in docs.columns if c != "text"]).alias("own"))
    spans = written(repeated_spans(keyed.select("doc_id", "text", "row"), batches), "suffix-spans")
    bloom = Bloom(spans.select("row"), "row", 22)
    lists = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    lists = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    some = _only(keyed, bloom, True).join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    own = keyed.schema["own"].dataType.simpleString()
    schema = f"own {own}, n_bytes long, n_removed long, spans array<struct<low:int,high:int>>, kept binary"
    clean = _only(keyed, bloom, False).select("own", "text").mapInArrow(_strip, schema)
    return some.select("own", "text", "spans").mapInArrow(_strip, schema).union(clean)


def drop_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the remaining bytes as text; n_chars, where present, is counted anew.

    Bytes that no longer form UTF-8 become U+FFFD, and a null text becomes empty.
    """
    rows = strip_repeats(docs, batches).withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))
    kinds = dict(docs.dtypes)

    def column(name: str) -> F.Column:
        if name == "text":
            return F.col("kept").alias(name)
        if name == "n_chars":
            return F.length("kept").cast(kinds[name]).alias(name)
        return F.col("own")[name].alias(name)

    return rows.select(*map(column, docs.columns))
