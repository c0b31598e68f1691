"""Chat formatting: speakers of transcripts by a hidden Markov model, then canonical turns.

A transcript is a sequence of text chunks, in order of ``turn`` within
``conv_id``. The states are, for each role, "this line begins a turn" and "this
line goes on with it". A line shows a speaker marker or none, whether it is
blank or follows a blank line, and whether it is a short question; Viterbi
finds the likeliest states of all lines of a transcript.

A transcript may be of any length, with a third of all rows. Chunks are range
partitioned in order, so that a long transcript lies in several tasks. Each
task sums up its part of a transcript that reaches over a border as a matrix of
best scores from state to state; at most two such parts per partition come to
the driver, which finds the states at the borders; then all tasks decode their
parts in parallel. The result is the same as on one machine.

Defined cases: a null chunk counts as empty, and an empty chunk is one blank
line; chunks without conv_id form one transcript; chunks with equal turns are
ordered by their text, repeated ones next to each other; a transcript without
any marker begins with the user; an empty table gives an empty result; other
columns come along if named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove.llm.scratch import written

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2 + (1: goes on)
_NAMES = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "you": 1, "q": 1, "question": 1,
          "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2}
_MARKER = re.compile(
    r"^[ \t]*(?:#{1,4}[ \t]*|\*\*|<\|?|\[)?(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")(?:\*\*:|:\*\*|\|?>|\]:?|:|(?<=[a-z])[ \t]*$)[ \t]*", re.IGNORECASE)

_LOG = np.log
#: From state to state: a turn goes on with its role or gives way to another; roles alternate.
_NEXT = np.full((3, 3), 0.02)
_NEXT[0] = (0.02, 0.90, 0.08)
_NEXT[1] = (0.03, 0.07, 0.90)
_NEXT[2] = (0.03, 0.90, 0.07)
TRANSITION = np.full((STATES, STATES), -np.inf)
for _r in range(3):
    for _from in (2 * _r, 2 * _r + 1):
        TRANSITION[_from, 2 * _r + 1] = _LOG(0.6)
        for _t in range(3):
            TRANSITION[_from, 2 * _t] = _LOG(0.4 * _NEXT[_r, _t])
START = np.array([_LOG(0.15), -np.inf, _LOG(0.80), -np.inf, _LOG(0.05), -np.inf])


def line_scores(marker: int | None, blank: bool, after_blank: bool, text: str) -> np.ndarray:
    """Log-likelihood of what a line shows, by state."""
    out = np.empty(STATES)
    question = len(text) < 200 and text.rstrip().endswith("?")
    for role in range(3):
        begins = (0.85 if marker == role else 0.01) if marker is not None else 0.12
        goes_on = 0.01 if marker is not None else 0.97
        begins *= 0.01 if blank else (0.9 if after_blank else 0.25)
        goes_on *= 0.9 if blank else (0.08 if after_blank else 0.75)
        asks = (0.02, 0.25, 0.06)[role] if question else (0.98, 0.75, 0.94)[role]
        out[2 * role], out[2 * role + 1] = _LOG(begins * asks), _LOG(goes_on * asks)
    return out


def read_lines(chunk: str, after_blank: bool) -> list[tuple[np.ndarray, str, bool]]:
    """(scores, text without its marker, is it blank) of every line of a chunk."""
    found = []
    for line in chunk.split("\n"):
        match = _MARKER.match(line)
        marker = _NAMES[match.group(1).lower()] if match else None
        rest = line[match.end():] if match else line
        blank = marker is None and not line.strip()
        found.append((line_scores(marker, blank, after_blank, rest), rest, blank))
        after_blank = blank
    return found


def _through(matrix: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best scores from state to state, one line further."""
    return (matrix[:, :, None] + TRANSITION[None]).max(1) + scores


def decode(lines: list[np.ndarray], entry: int | None = None, leave: int | None = None) -> list[int]:
    """Likeliest states; ``entry`` is the state before the first line, ``leave`` the last line's state. Ties go to the lower state."""
    back, score = [], None
    for scores in lines:
        if score is None:
            score = (START if entry is None else TRANSITION[entry]) + scores
            continue
        step = score[:, None] + TRANSITION
        back.append(step.argmax(0))
        score = step.max(0) + scores
    state = int(score.argmax()) if leave is None else leave
    states = [state]
    for pointer in reversed(back):
        state = int(pointer[state])
        states.append(state)
    return states[::-1]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[tuple], bool]]:
    """(partition, transcript, its rows there, is it the first or last of the partition), for sorted rows."""
    current, rows, first = None, [], True
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        for row in zip(*columns, strict=True):
            if row[:2] != current:
                if rows:
                    yield *current, rows, first or row[0] != current[0]
                    first = row[0] != current[0]
                current, rows = row[:2], []
            rows.append(row)
    if rows:
        yield *current, rows, True


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's first and last transcript, what the driver needs to join them to those of its neighbours."""
    for part, key, rows, edge in _fragments(batches):
        if not edge:
            continue
        matrices, vector, blank = [None, None], None, False
        for row in rows:
            chunk = read_lines(row[3] or "", blank)
            other = read_lines((row[3] or "").split("\n", 1)[0], True)[0][0] if vector is None else None
            for scores, text, blank in chunk:  # noqa: B007  (the last one is read after the loop)
                if vector is None:
                    matrices, vector = [TRANSITION + scores, TRANSITION + other], START + scores
                else:
                    matrices, vector = [_through(m, scores) for m in matrices], (vector[:, None] + TRANSITION).max(0) + scores
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([repr(key)]), pa.array([matrices[0].ravel().tolist()]), pa.array([matrices[1].ravel().tolist()]), pa.array([vector.tolist()]), pa.array([blank])],
            names=["part", "key", "plain", "after_blank", "vector", "blank"])


def _borders(rows: list) -> dict[tuple[int, str], tuple[int | None, int, bool]]:
    """(partition, transcript): state before, state at the end, and does a blank line come before; for parts of transcripts that lie in several partitions."""
    out: dict[tuple[int, str], tuple[int | None, int, bool]] = {}
    chains: list[list] = []
    # rows are in order of partitions; a partition's first transcript may go on from the one before.
    for row in rows:
        if chains and chains[-1][-1]["key"] == row["key"] and chains[-1][-1]["part"] != row["part"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    for chain in chains:
        if len(chain) < 2:
            continue
        score, back = np.array(chain[0]["vector"]), []
        for before, row in zip(chain, chain[1:], strict=False):
            step = score[:, None] + np.array(row["after_blank" if before["blank"] else "plain"]).reshape(STATES, STATES)
            back.append(step.argmax(0))
            score = step.max(0)
        ends = [int(score.argmax())]
        for pointer in reversed(back):
            ends.append(int(pointer[ends[-1]]))
        ends.reverse()
        for k, row in enumerate(chain):
            out[row["part"], row["key"]] = (ends[k - 1] if k else None, ends[k], bool(k and chain[k - 1]["blank"]))
    return out


def render(role: str, text: str, begins: bool) -> str:
    """The canonical form of (the rest of) a turn."""
    return f"<|{role}|>\n{text}" if begins else text


def parse_transcripts(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Recovered turns of transcripts (conv_id, turn, text).

    One row per chunk and stretch of one turn in it: conv_id, turn, segment,
    role, begins (a new turn begins here), content, rendered, and ``keep``.
    """
    spark = chunks.sparkSession
    order = ["conv_id", "turn", "_hash", "_id"]
    rows = chunks.select("conv_id", "turn", "text", *keep).withColumn("_hash", F.xxhash64("text")).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "chat-chunks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "_part").sortWithinPartitions("_part", *order).select("_part", "conv_id", "turn", "text", *keep)
    schema = "part int, key string, plain array<double>, after_blank array<double>, vector array<double>, blank boolean"
    edges = sorted(dealt.mapInArrow(_summaries, schema).collect(), key=lambda r: r["part"])  # two a partition; a stable sort keeps first before last
    shared = spark.sparkContext.broadcast(_borders(edges))
    fields = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*dealt_names[1:3], "segment", "role", "begins", "content", "rendered", *keep]
        found: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        types = None
        for part, key, rows, _ in _fragments(_typed(batches, types_of := {})):
            if types is None:
                types = [types_of["conv_id"], types_of["turn"], pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), *[types_of[c] for c in keep]]
            entry, leave, blank = shared.value.get((part, repr(key)), (None, None, False))
            lines, of = [], []
            for at, row in enumerate(rows):
                for scores, text, blank in read_lines(row[3] or "", blank):  # noqa: B007
                    lines.append((scores, text))
                    of.append(at)
            states = decode([scores for scores, _ in lines], entry, leave)
            segment, held = 0, None
            for k, (state, (_, text)) in enumerate(zip(states, lines, strict=True)):
                fresh_row = k == 0 or of[k] != of[k - 1]
                if held is not None and (fresh_row or state % 2 == 0):
                    found.append(_segment(rows[held[0]], held))
                    held = None
                if held is None:
                    segment = 0 if fresh_row else segment + 1
                    held = (of[k], segment, ROLES[state // 2], state % 2 == 0, [])
                held[4].append(text)
            if held is not None:
                found.append(_segment(rows[held[0]], held))
            if len(found) > 2000:
                yield emit()
                found.clear()
        if types is not None:
            yield emit()

    dealt_names = dealt.columns
    out = f"conv_id {fields['conv_id']}, turn {fields['turn']}, segment int, role string, begins boolean, content string, rendered string"
    return dealt.mapInArrow(run, ", ".join([out, *[f"`{c}` {fields[c]}" for c in keep]]))


def _typed(batches: Iterator[pa.RecordBatch], types: dict) -> Iterator[pa.RecordBatch]:
    """Notes the Arrow types of the columns while batches pass."""
    for batch in batches:
        types.update({f.name: f.type for f in batch.schema})
        yield batch


def _segment(row: tuple, held: tuple) -> tuple:
    _, segment, role, begins, texts = held
    content = "\n".join(texts).strip("\n")
    return (*row[1:3], segment, role, begins, content, render(role, content, begins), *row[4:])


def as_transcripts(turns: DataFrame, lost_every: int = 7) -> DataFrame:
    """Chunks of raw transcripts from (conv_id, turn, role, text) turns.

    Each conversation is written in one of six marker styles, chosen by hash;
    one turn in ``lost_every``, chosen by hash, has lost its marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    role = F.coalesce("role", F.lit("user"))
    capital = F.initcap(role)
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("System")

    def marked(form: Column, sep: str) -> Column:
        return F.concat(form, F.lit(sep))

    marker = (
        F.when(style == 0, marked(F.concat(capital, F.lit(":")), " ")).when(style == 1, marked(F.concat(F.lit("### "), capital), "\n"))
        .when(style == 2, marked(F.concat(F.lit("<|"), role, F.lit("|>")), "\n")).when(style == 3, marked(F.concat(human, F.lit(":")), " "))
        .when(style == 4, marked(F.concat(F.lit("["), F.upper(role), F.lit("]")), " ")).otherwise(marked(F.concat(short, F.lit(":")), " ")))
    lost = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(lost_every)) == 0) & (F.col("turn") > 0)
    text = F.concat(F.when(lost, F.lit("")).otherwise(marker), F.coalesce("text", F.lit("")), F.lit("\n"))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("said"), text.alias("text"))
