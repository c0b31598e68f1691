"""Documentation corpora: sections, an inverted index and keyword retrieval."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from querygrove.options import options
from querygrove.prims import once, ranked, spread_by

_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
_ENTRY = r"(?m)^[A-Za-z_][A-Za-z0-9_-]*:.*$"
_WORD = r"[a-z_][a-z0-9_]*"
_WORDS = re.compile(_WORD)
MARKDOWN = r"(?m)(?=^#{1,6}\s+.)"
MARKDOWN_TITLE = r"(?m)\A#{1,6}\s+(.+)$"
HTML = r"(?i)(?=<h[1-6][\s>])"
HTML_TITLE = r"(?is)\A<h[1-6][^>]*>(.*?)</h[1-6]>"


def doc_corpus(docs: DataFrame, bundled: DataFrame | None = None, max_size: int | None = None) -> DataFrame:
    """Markdown below ``docs`` or ``.querygrove/docs``, with the shipped documents."""
    limit = options()["max_file_size"] if max_size is None else max_size
    user = docs.filter(
        F.col("path").rlike(r"^(docs|\.querygrove/docs)/.*\.md$") & (F.octet_length("content") <= limit)
    ).select(F.concat(F.lit("user:"), "path").alias("source"), "content")
    return user if bundled is None else user.unionByName(bundled)


def frontmatter(docs: DataFrame) -> DataFrame:
    """Adds ``meta`` (entries of the leading block, keys lowered) and ``body``."""
    block = F.regexp_extract("content", _FRONT, 1)
    entries = F.transform(
        F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(0)),
        lambda e: F.struct(
            F.lower(F.regexp_extract(e, r"^([^:]*):", 1)).alias("key"),
            F.btrim(F.trim(F.regexp_extract(e, r"^[^:]*:\s*(.*)$", 1)), F.lit("'\"")).alias("value"),
        ),
    )
    return docs.withColumn("meta", entries).withColumn("body", F.regexp_replace("content", _FRONT, ""))


def keywords(meta: Column) -> Column:
    """Value of the last ``keywords`` entry."""
    found = F.filter(meta, lambda e: e["key"] == "keywords")
    return F.coalesce(F.try_element_at(F.transform(found, lambda e: e["value"]), F.lit(-1)), F.lit(""))


def split_sections(docs: DataFrame, pattern: str = MARKDOWN, title: str = MARKDOWN_TITLE) -> DataFrame:
    """One row per non-empty section; text before the first heading has an empty title."""
    parts = F.filter(F.transform(F.split("body", pattern), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    keep = [c for c in docs.columns if c not in ("content", "body", "meta")]
    extra = [keywords(F.col("meta")).alias("keywords")] if "meta" in docs.columns else []
    return docs.select(*keep, *extra, F.posexplode(parts).alias("sec_no", "text")).withColumn(
        "title", F.btrim(F.regexp_extract("text", title, 1), F.lit("\r")))


def page_sections(pages: DataFrame) -> DataFrame:
    """The same over HTML headings, with the tags taken out."""
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    found = split_sections(pages.withColumnRenamed("content", "body"), HTML, HTML_TITLE)
    return found.withColumn("title", plain(F.col("title"))).withColumn("text", plain(F.col("text")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def section_tokens(sections: DataFrame) -> DataFrame:
    """Inverted index: (token, source, sec_no, weight), one row per place a token counts for.

    Title words weigh 3, frontmatter keywords 2, words of the text 1. Sections
    are partitioned by their own key, which later sums by section reuse.
    """
    def weighted(text: Column, weight: int) -> Column:
        return F.transform(F.array_distinct(words(text)), lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight")))

    entries = F.concat(
        weighted(F.col("title"), 3), weighted(F.col("keywords"), 2), weighted(F.col("text"), 1))
    spread = once(spread_by(sections.select("source", "sec_no", "title", "keywords", "text"), "source", "sec_no"), _e=entries)
    return spread.select("source", "sec_no", "title", F.explode("_e").alias("e")).select("source", "sec_no", "title", "e.*")


def query_tokens(queries: DataFrame) -> DataFrame:
    """Tokens of each query with how often they occur in it."""
    return queries.select("query_id", F.explode(words(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(
        F.count(F.lit(1)).alias("times"))


def score_sections(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Score of every section that shares a token with a query, by joining the index with the queries' tokens.

    For query sets of any size; AQE splits frequent tokens. ``match_sections`` needs no shuffle
    while the queries fit its bound.
    """
    hits = index.join(query_tokens(queries), "token")
    return hits.groupBy("source", "sec_no", "query_id").agg(
        F.sum(F.col("weight") * F.col("times")).cast("double").alias("score"), F.first("title").alias("title"))


#: (query, token) pairs that are sent to every task at once.
MAX_QUERY_TOKENS = 200_000
#: Sections that are read at once; their scores with all queries and the (section, token, query) triples behind these, and bytes of a batch of results.
_SECTIONS, _SCORES, _TRIPLES, _BYTES = 512, 1 << 21, 1 << 20, 1 << 23
_FIELDS = (("title", 3), ("keywords", 2), ("text", 1))


class _Queries:
    """Tokens of the queries, and for each token the queries that have it, side by side in arrays."""

    def __init__(self, rows: list) -> None:
        self.ids = list(dict.fromkeys(r["query_id"] for r in rows))
        place = {q: i for i, q in enumerate(self.ids)}
        rows = sorted(rows, key=lambda r: r["token"])
        self.token: dict[str, int] = {}
        starts = []
        for at, row in enumerate(rows):
            if row["token"] not in self.token:
                self.token[row["token"]] = len(starts)
                starts.append(at)
        self.starts = np.array([*starts, len(rows)])
        self.query = np.array([place[r["query_id"]] for r in rows], np.int64)
        self.times = np.array([r["times"] for r in rows], np.int64)

    def found(self, sections: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of queries in the sections: the section's row, in order, the token and its weight."""
        rows, tokens, weights = [], [], []
        for name, weight in _FIELDS:
            for i, value in enumerate(sections.column(name).to_pylist()):
                here = [self.token[t] for t in set(_WORDS.findall((value or "").lower())) if t in self.token]
                rows += [i] * len(here)
                tokens += here
                weights += [weight] * len(here)
        order = np.argsort(np.array(rows, np.int64), kind="stable")
        return tuple(np.array(x, np.int64)[order] for x in (rows, tokens, weights))

    def scores(self, sections: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of the sections with every query, sums over the shared tokens only: a few sections at a time, with the place of the first.

        As many sections as have ``_TRIPLES`` triples; one alone has no more than three per token of the queries.
        """
        rows, tokens, weights = self.found(sections)
        n, many = len(self.ids), self.starts[tokens + 1] - self.starts[tokens]
        upto = np.concatenate([[0], np.cumsum(many)])
        ends = np.searchsorted(rows, np.arange(len(sections)), "right")
        low = begin = 0
        while low < len(sections):
            high = max(low + 1, int(np.searchsorted(upto[ends], upto[begin] + _TRIPLES, "right")))
            part = slice(begin, int(ends[high - 1]))
            sizes, token = many[part], tokens[part]
            place = np.repeat(self.starts[token] - (upto[part] - upto[begin]), sizes) + np.arange(sizes.sum())
            cell = np.repeat((rows[part] - low) * n, sizes) + self.query[place]
            total = np.bincount(cell, weights=np.repeat(weights[part], sizes) * self.times[place], minlength=(high - low) * n)
            yield low, total.reshape(high - low, n)
            low, begin = high, part.stop


def _matched(queries: _Queries, k: int | None, schema: pa.Schema):
    """Scores of sections inside a task: all, or the best ``k`` of each query. Only names of sections are copied per score, never their texts."""
    names = ["source", "sec_no", "title"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = min(_SECTIONS, max(1, _SCORES // max(len(queries.ids), 1)))
        for batch in batches:
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                for at, score in queries.scores(part):
                    yield part.slice(at, len(score)).select(names), score

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in parts(batches):
            longest = max(sum(len(str(v or "").encode()) for v in row.values()) for row in part.to_pylist())
            at, of = np.nonzero(score)
            rows = max(1, _BYTES // (longest + 64))
            for begin in range(0, len(at), rows):
                i, q = at[begin:begin + rows], of[begin:begin + rows]
                taken = part.take(pa.array(i))
                ids = pa.array([queries.ids[x] for x in q.tolist()], schema.field("query_id").type)
                yield pa.RecordBatch.from_arrays([ids, *taken.columns, pa.array(score[i, q])], names=schema.names)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in queries.ids]
        bound = np.zeros(len(top))  # a section below its query's k-th best score so far cannot come in
        for part, score in parts(batches):
            source, number, title = (part.column(c).to_pylist() for c in names)
            for q in np.flatnonzero((score >= np.maximum(bound, 1e-9)).any(0)).tolist():
                at = np.flatnonzero((score[:, q] > 0) & (score[:, q] >= bound[q]))
                if len(at) > k:
                    least = np.partition(score[at, q], len(at) - k)[len(at) - k]
                    at = at[score[at, q] >= least]
                entries = [(-score[i, q], source[i], title[i], number[i]) for i in at.tolist()]
                top[q] = heapq.nsmallest(k, top[q] + entries)
                if len(top[q]) == k:
                    bound[q] = -top[q][-1][0]
        rows = [(queries.ids[q], source, number, title, -score) for q, entries in enumerate(top) for score, source, title, number in entries]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return every if k is None else best


def match_sections(sections: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Scores of sections with queries: query_id, source, sec_no, title, score; with ``k`` the best of each task only.

    Sections (source, sec_no, title, keywords, text) are scored where they are read, against the
    tokens of all queries; nothing is shuffled, and with ``k`` only as many rows per
    query leave a task. Query sets of more than ``MAX_QUERY_TOKENS`` tokens are joined instead.
    """
    tokens = query_tokens(queries)
    rows = tokens.limit(MAX_QUERY_TOKENS + 1).collect()
    if len(rows) > MAX_QUERY_TOKENS:
        return score_sections(section_tokens(sections), queries).select("query_id", "source", "sec_no", "title", "score")
    fields = sections.select("source", "sec_no", "title", "keywords", "text")
    schema = StructType([queries.schema["query_id"], *[fields.schema[c] for c in ("source", "sec_no", "title")], StructField("score", DoubleType())])
    return fields.mapInArrow(_matched(_Queries(rows), k, to_arrow_schema(schema)), schema)


def top_sections(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Best ``k`` sections per query; limited per task before the shuffle."""
    k = options()["max_doc_sections"] if k is None else k
    return ranked(scores, ["query_id"], [F.desc("score"), F.col("source"), F.col("title"), F.col("sec_no")], k)


def bounded_text(sections: DataFrame, max_chars: int | None = None) -> DataFrame:
    limit = options()["max_doc_section_chars"] if max_chars is None else max_chars
    return sections.withColumn("truncated", F.length("text") > limit).withColumn("text", F.substring("text", 1, limit))
