"""Quality rules: exact text statistics and robust multivariate outliers.

Statistics of every whole text are counted in numpy over Arrow batches. The
transformed statistic vectors of a (lang, source) group then get a minimum
covariance determinant estimate: from coordinatewise medians, concentration
steps keep the ``support`` fraction of the group's rows with the smallest
Mahalanobis distance and fit mean and covariance to those. All steps are
aggregations over all rows, combined before they shuffle, so that a source with
a third of the rows costs no more than its share. Per group only one row of
estimates travels.

Groups of fewer than ``min_group`` rows are pooled per language, and what is
left of those is pooled once more. Null languages and sources are groups of
their own.

Defined cases: null and blank texts have zero counts and fail the base rules;
an empty table gives an empty result; repeated rows are judged each; other
columns of the input are not read.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from querygrove.llm.kernel import SPACE, byte_values, combine, counts_of, owner, prefix_hashes, slices, span_hashes, spans, words
from querygrove.llm.scratch import fresh, text_batches, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_punct", "n_stutter")
#: Transformed statistics, their smallest standard deviation (statistics that are zero in most texts
#: have no spread of their own; a boilerplate line that occurs twice is no outlier), and the words
#: that each ratio is shrunk by.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "punct", "stutter")
FLOORS = (0.12, 0.10, 0.30, 0.30, 0.06, 0.06, 0.08)
PRIOR_WORDS = 40.0
#: Groups whose estimates (57 numbers each) are broadcast, and shares of a group beyond that.
BROADCAST_GROUPS = 20_000
SALTS = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERED = np.zeros(256, bool)
_LOWERED[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT &= ~_SYMBOL
_VALUES = byte_values(9)
#: Continuation bytes of UTF-8 begin no code point.
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _marked(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of texts: is there an equal one in the text; is there an equal earlier one."""
    n = len(keys)
    repeated, later = np.zeros(n, bool), np.zeros(n, bool)
    order = np.lexsort((keys, owners))
    same = (keys[order][1:] == keys[order][:-1]) & (owners[order][1:] == owners[order][:-1])
    later[order[1:]] = same
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    return repeated, later


def slice_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text of a slice, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out
    starts, ends, text = words(data, offsets)
    out[:, 0] = counts_of(text, n)
    for k, mask in ((1, ~SPACE & _FIRST), (2, _SYMBOL), (6, _UPPER), (7, _LOWERED), (8, _PUNCT)):
        sums = np.concatenate(([0], np.cumsum(mask[data])))
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    sums = prefix_hashes(data, _VALUES)
    # Lines that hold a word: those in which some word starts.
    first, last = spans(data != 10, offsets)
    if len(first) and len(starts):
        holds = np.searchsorted(starts, last) > np.searchsorted(starts, first)
        first, last = first[holds], last[holds]
        line_text = owner(offsets, first)
        out[:, 5] = counts_of(line_text, n)
        out[:, 3] = counts_of(line_text[_marked(line_text, span_hashes(sums, first, last))[1]], n)
    hashes = span_hashes(sums, starts, ends)
    if len(starts) > 1:
        out[:, 9] = counts_of(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], n)
    windows = combine(hashes, 8)
    if len(windows):
        inside = text[:len(windows)] == text[7:]
        at = np.flatnonzero(inside)
        repeated = at[_marked(text[at], windows[at])[0]]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + 8, -1)
        out[:, 4] = counts_of(text[np.cumsum(cover)[:-1] > 0], n)
    return out


def _count_batches(text: str, others: list[str], row: str | None = None):
    """Counts of the column ``text``, or of that field of the struct ``row``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text) if row is None else pc.struct_field(batch.column(row), text)
            parts = [slice_counts(data, offsets) for _, _, data, offsets in slices(texts)]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            arrays = [batch.column(c) for c in others] + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, *[f"_{c}" for c in COUNTS]])

    return run


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``_name``, the COUNTS of each whole text."""
    text_batches(docs.sparkSession)
    keep = ["doc_id", "lang", "source"] if keep is None else keep
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    schema = StructType([source.schema[c] for c in keep] + [StructField(f"_{c}", LongType()) for c in COUNTS])
    return source.mapInArrow(_count_batches(text, keep), schema)


def _vector(p: str = "_") -> F.Column:
    """The statistic vector: ratios shrunk towards what prose has, so that a short text is not an outlier by chance."""
    n, prior = F.col(f"{p}n_words"), F.lit(PRIOR_WORDS)
    letters = F.col(f"{p}n_upper") + F.col(f"{p}n_lower")
    return F.array(
        F.log((F.col(f"{p}word_chars") + 5.5 * prior) / (n + prior)),
        F.sqrt(F.col(f"{p}n_symbols") / (n + prior)),
        F.sqrt(F.col(f"{p}n_dup_lines") / (F.col(f"{p}n_lines") + 4.0)),
        F.sqrt(F.col(f"{p}n_repeat_words") / (n + prior)),
        (F.col(f"{p}n_upper") + 0.03 * 5 * prior) / (letters + 5 * prior),
        F.log1p(F.col(f"{p}n_punct") / (n + prior)),
        F.sqrt(F.col(f"{p}n_stutter") / (n + prior)),
    )


def _base_failed(p: str = "_") -> F.Column:
    return (F.col(f"{p}n_words") < 20) | (100 * F.col(f"{p}n_repeat_words") > 30 * F.col(f"{p}n_words"))


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation."""
    z = statistics.NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance of one row of moments per group."""
    d = len(FEATURES)
    for frame in frames:
        centers, inverses, logdets = [], [], []
        for row in frame.itertuples(index=False):
            center = np.array([getattr(row, f"m{i}") for i in range(d)], float)
            cov = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    cov[i, j] = cov[j, i] = getattr(row, f"c{i}_{j}") - center[i] * center[j]
            cov += np.diag(np.square(FLOORS))
            centers.append(center.tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
            logdets.append(float(np.linalg.slogdet(cov)[1]))
        yield pd.DataFrame({"_g": frame["_g"], "_center": centers, "_inverse": inverses, "_logdet": logdets})


def _distance() -> F.Column:
    d = len(FEATURES)
    x = [F.col("_x")[i] - F.col("_center")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        row = F.lit(0.0)
        for j in range(d):
            row = row + x[j] * F.col("_inverse")[i * d + j]
        total = total + x[i] * row
    return total


def _group(lang: str, source: str) -> F.Column:
    return F.to_json(F.array(F.col(lang).cast("string"), F.col(source).cast("string")), {"ignoreNullFields": "false"})


def _by_group(rows: DataFrame, table: DataFrame, key: str, groups: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (at most ``groups`` rows, one per ``key``); no row stays without one.

    Up to ``BROADCAST_GROUPS`` groups the table is broadcast and the rows stay
    where they are. Beyond that rows and table are dealt by key in ``SALTS``
    shares, so that a group with a third of all rows spreads over as many tasks.
    """
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), key)
    share = fresh(rows, "_share")
    dealt = rows.withColumn(share, F.pmod(F.xxhash64("_x", F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    shares = table.withColumn(share, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(shares, [key, share]).drop(share)


def estimates(counts: DataFrame, support: float = 0.75, min_group: int = 60, steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """(groups, estimates) of counted rows.

    ``groups`` maps each (lang, source) key to the group it is judged in.
    ``estimates`` has, per group, centre, inverse covariance and the scale that
    makes the median squared distance the expected one.
    """
    d = len(FEATURES)
    rows = counts.select(_group("lang", "source").alias("_key"), F.to_json(F.array(F.col("lang").cast("string"))).alias("_lang"), _vector().alias("_x"))
    sizes = rows.groupBy("_key", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.filter(F.col("_n") < min_group).groupBy("_lang").agg(F.sum("_n").alias("_m"))
    sized = sizes.join(small, "_lang", "left")
    group = F.when(F.col("_n") >= min_group, F.col("_key")).when(F.col("_m") >= min_group, F.col("_lang")).otherwise(F.lit("rest"))
    groups = written(sized.select("_key", group.alias("_g")), "quality-groups")
    n = groups.count()
    rows = written(_by_group(rows.drop("_lang"), groups, "_key", n).drop("_key"), "quality-vectors")

    middle = rows.groupBy("_g").agg(*[F.percentile_approx(F.col("_x")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(d)])
    # The start: a diagonal covariance from quartiles.
    inverse = []
    for i in range(d):
        for j in range(d):
            sd = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
            inverse.append(1.0 / (sd * sd + FLOORS[i] ** 2) if i == j else F.lit(0.0))
    fit = middle.select("_g", F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("_center"), F.array(*inverse).alias("_inverse"))
    for _ in range(steps):
        judged = _by_group(rows, fit, "_g", n).select("_g", "_x", _distance().alias("_d"))
        cut = judged.groupBy("_g").agg(F.percentile_approx("_d", support, 2000).alias("_cut"))
        kept = _by_group(judged, cut, "_g", n).filter(F.col("_d") <= F.col("_cut"))
        moments = [F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)]
        moments += [F.avg(F.col("_x")[i] * F.col("_x")[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
        schema = "_g string, _center array<double>, _inverse array<double>, _logdet double"
        fit = written(kept.groupBy("_g").agg(*moments).mapInPandas(_inverted, schema), "quality-fit").drop("_logdet")
    judged = _by_group(rows, fit, "_g", n).select("_g", _distance().alias("_d"))
    scale = judged.groupBy("_g").agg((F.percentile_approx("_d", 0.5, 2000) / chi2_quantile(0.5, d)).alias("_scale"))
    # A group may be tighter than the floors; its scale never shrinks the distances' unit below them.
    scale = scale.withColumn("_scale", F.greatest(F.coalesce("_scale", F.lit(0.0)), F.lit(0.15)))
    return groups, written(fit.join(scale, "_g"), "quality-estimates")


def judged(counts: DataFrame, groups: DataFrame, fit: DataFrame, quantile: float = 0.99999) -> DataFrame:
    """``counts`` with ``_group``, ``_distance``, ``_base_failed`` and ``_kept``."""
    keyed = counts.withColumn("_key", _group("lang", "source")).withColumn("_x", _vector())
    rows = _by_group(keyed, groups.join(fit, "_g"), "_key", groups.count()).withColumn("_distance", F.sqrt(_distance() / F.col("_scale")))
    limit = chi2_quantile(quantile, len(FEATURES)) ** 0.5
    verdict = ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= limit, F.lit(True))
    return rows.withColumn("_base_failed", _base_failed()).withColumn("_kept", verdict).withColumnRenamed("_g", "_group")


def quality_rules(docs: DataFrame, quantile: float = 0.99999, min_group: int = 60) -> DataFrame:
    """Counts, group, distance and verdict for each row of ``docs`` (doc_id, lang, source, text)."""
    counts = written(text_counts(docs), "quality-counts")
    groups, fit = estimates(counts, min_group=min_group)
    rows = judged(counts, groups, fit, quantile)
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_group").alias("group"), F.col("_distance").alias("distance"),
                       F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, quantile: float = 0.99999, min_group: int = 60) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are counted twice, once for the estimates and once beside the row
    they decide on: that costs no shuffle of texts and needs no key.
    """
    groups, fit = estimates(written(text_counts(docs), "quality-counts"), min_group=min_group)
    # The row travels as one struct, so that none of its columns clashes with a count.
    source = docs.select(F.struct(*docs.columns).alias("_row"))
    schema = StructType([source.schema["_row"]] + [StructField(f"_{c}", LongType()) for c in COUNTS])
    own = source.mapInArrow(_count_batches("text", ["_row"], "_row"), schema).select("*", "_row.lang", "_row.source")
    return judged(own, groups, fit, quantile).filter("_kept").select("_row.*")
