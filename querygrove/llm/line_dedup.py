"""Line dedup: range-partitioned line hashes, streamed once, and keep bitmaps instead of text.

Only DataFrame and SQL functions: no Python runs in tasks.

1. Every whole text is cut at ``\\n``. The key of a line is the line without
   blanks at both ends, A-Z lower-cased; keys of ``min_chars`` code points or more
   travel as 128 bits of hash with the document and the position, never as text.
2. The hashes are range partitioned by (hash, document) and sorted by document,
   largest first, and position. A range border may fall between two documents of
   one hash, so a line that a third of all documents share spreads over as many
   tasks as its rows fill; it never falls inside a document. Each task streams its
   range once: one row per (hash, document), the first of a hash being the
   document that keeps its lines. The ranges are written, since their borders
   come from a sample and a task run again must see the same ones.
3. A hash's runs, at most one a range, give its number of documents and its
   largest document. Only those of ``min_docs`` documents or more are joined
   back, by (range, hash).
4. What is to be dropped is packed into bitmaps: words of 64 lines, of which only
   those with a dropped line are stored, and documents that keep every line have
   no row at all.

Defined cases: a null or empty text is one empty line; rows without doc_id count
as no document and keep all lines; texts that share a doc_id are one document,
each with a bitmap of its own; repeated rows are answered alike; a line that is
repeated inside a document counts once for it and is dropped or kept with it; an
empty table gives an empty result; other columns stay as they are, whatever
their names. A text is held as one list of its lines, so that a task needs a
small multiple of the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.llm.scratch import fresh, remove, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the key rule ``[\x20\x09-\x0D]``.
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_BITS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; the general ``lower`` is the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key is long enough; ``docs`` has doc_id and text."""
    lines = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(_lowered(F.col("text")))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(_BLANKS)).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "text_hash", "pos")


def dropped_bits(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, and ``words``: (word, bits) of the lines to drop, by word; bit i of word w is line 64 w + i."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = line_hashes(docs, min_chars).repartitionByRange(n, "h1", "h2", F.desc("doc_id"))
    streamed = ranged.sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    # The ranges already hold whole (hash, document) groups: no further shuffle.
    held = streamed.groupBy("h1", "h2", "doc_id").agg(F.collect_set(F.struct("text_hash", "pos")).alias("places"))
    runs = written(held.withColumn("run", F.spark_partition_id()), "line-runs")
    parts = runs.groupBy("run", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    whole = Window.partitionBy("h1", "h2")
    common = parts.select("run", "h1", "h2", F.sum("n").over(whole).alias("docs"), F.max("last").over(whole).alias("last")).filter(F.col("docs") >= min_docs)
    gone = runs.join(common, ["run", "h1", "h2"]).filter("doc_id <> last").select("doc_id", F.inline("places"))
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = gone.groupBy("doc_id", "text_hash", F.expr(f"pos div {WORD_BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = words.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    bitmaps = written(packed, "line-bitmaps")
    remove(runs)
    return bitmaps


def dense(words: Column) -> Column:
    """The bitmap as one long per word up to the last stored one, so that a line's bit is found by its number."""
    filled = F.transform(words, lambda w, k: F.concat(
        F.array_repeat(F.lit(0).cast("long"), w["word"] - F.coalesce(F.get(words, k - 1)["word"], F.lit(-1)) - 1), F.array(w["bits"])))
    return F.flatten(filled)


def kept_lines(text: Column, bits: Column) -> Column:
    """The lines of ``text`` whose bit in the dense bitmap is not set, joined by ``\\n``."""
    def keeps(_: Column, i: Column) -> Column:
        word = F.coalesce(F.get(bits, F.floor(i / WORD_BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, i % WORD_BITS) == 0

    return F.array_join(F.filter(lines_of(text), keeps), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``own`` (each row of ``docs``), ``words`` (its bitmap; null: all lines stay), n_lines, n_dropped and ``kept``, the text that is left."""
    bitmaps = dropped_bits(docs.select("doc_id", "text"), min_chars, min_docs)
    own = fresh(docs, "own")
    rows = docs.select(F.struct(*docs.columns).alias(own), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    # Bitmaps grow with the documents: never a broadcast, so that a small table is planned like a large one.
    rows = rows.join(bitmaps.hint("merge"), ["doc_id", "text_hash"], "left")
    count = F.coalesce(F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0)).cast("long")
    rows = rows.select(F.col(own).alias("own"), "words", "text", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), count.alias("n_dropped"),
                       dense(F.col("words")).alias("_bits"))
    kept = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_lines(F.col("text"), F.col("_bits")))
    return rows.select("own", "words", "n_lines", "n_dropped", kept.alias("kept"))
