"""Chat formatting by token-level assembly.

Roles and texts are escaped and encoded as separate segments; reserved ids are spliced between them; the loss mask is a
prefix sum over +1 and -1 at the segments' edges. Turns are formatted where they lie; only then do a conversation's turns
meet, in order, as a stream: a conversation may be longer than memory.

Template: `### ROLE: TEXT</turn>\n`. In contents a backslash precedes each backslash and control string, which is undone
on reading. Defined results: null roles and texts are empty; turns of one number go by role, then text; a null conv_id is
a conversation like any other; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import lists, read_ranks, vocabulary
from .common import map_arrow, texts_of

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Reserved ids follow the vocabulary's own 50,256 and its free 50,256th.
RESERVED = ((50257, OPEN.encode()), (50258, COLON.encode()), (50259, CLOSE.encode()))
CONTROL = re.compile(r"\\|###|</turn>|: ")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, turn, role, text, ids array<int>, loss array<int>: each turn's tokens and mask."""
    raw = turns.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, RESERVED)
        roles, texts = texts_of(batch.column(2)), texts_of(batch.column(3))
        n = len(roles)
        ids, sizes = v.encode([escape(x) for pair in zip(roles, texts) for x in pair])
        sizes = sizes.reshape(n, 2)
        counts = sizes.sum(1) + 3
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        # the spliced ids' places; the encoded segments fill the rest in order
        colon, close = begin + 1 + sizes[:, 0], begin + counts - 1
        free = np.ones(len(out), bool)
        for at, (i, _) in zip((begin, colon, close), RESERVED):
            out[at], free[at] = i, False
        out[free] = ids
        step = np.zeros(len(out) + 1, np.int32)
        learned = np.array([r == LEARNED_ROLE for r in roles], np.int32)
        np.add.at(step, colon + 1, learned)
        np.subtract.at(step, close, learned)
        yield pa.RecordBatch.from_arrays([*batch.columns, lists(out, counts), lists(np.cumsum(step)[:-1], counts)], [*batch.schema.names, "ids", "loss"])

    kinds = {c: src.schema[c].dataType.simpleString() for c in src.columns}
    return map_arrow(src, run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", ids array<int>, loss array<int>", 1_000_000)


def assembled(turns: DataFrame, ranks_path: str) -> DataFrame:
    """Turns in order within their conversation, each in one partition: conv_id, turn, ids, loss, and start, the place of
    its first token in the conversation."""
    rows = formatted(turns, ranks_path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "ids", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in batches:
            starts = []
            for c, n in zip(batch.column(0).to_pylist(), np.diff(np.asarray(batch.column(2).offsets)).tolist()):
                if c != last:
                    last, at = c, 0
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], ["conv_id", "turn", "ids", "loss", "start"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, loss array<int>, start bigint")


def read_back(rows: DataFrame, ranks_path: str) -> DataFrame:
    """What the assembled ids and masks say of each conversation; digests grow turn by turn."""
    raw = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = rows.select("conv_id", "ids", "loss")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, RESERVED)
        opens, colon, close = (i for i, _ in RESERVED)
        last: object = run
        state: list = []
        kind = None

        def done(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*[[c, n, a.hexdigest(), k, b.hexdigest(), f, t] for c, n, a, k, b, f, t in rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            kind, finished = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                c = batch.column(0)[i].as_py()
                ids, loss = (np.asarray(batch.column(k)[i].values) for k in (1, 2))
                if last is run or c != last:
                    if state:
                        finished.append(state)
                    last, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                at, end = int(np.flatnonzero(ids == colon)[0]), len(ids) - 1
                if ids[0] != opens or ids[end] != close:
                    raise ValueError("a turn's reserved ids are missing")
                role, text = (unescape(v.decode(x).decode("utf-8")) for x in (ids[1:at], ids[at + 1 : end]))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                learned = unescape(v.decode(ids[loss == 1]).decode("utf-8"))
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(v.decode(ids).decode("utf-8"))
                state[6] += len(ids)
            if finished:
                yield done(finished)
        if state:
            yield done([state])

    return src.mapInArrow(run, f"conv_id {src.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def conversations(turns: DataFrame, ranks_path: str) -> DataFrame:
    """Formats all conversations and one more, number -7, whose two turns hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    every = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(assembled(every, ranks_path), ranks_path)


ORACLE_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(regexp_replace(role, '\\|###|</turn>|: ', '\\\0', 'g')) + length(regexp_replace(text, '\\|###|</turn>|: ', '\\\0', 'g')) as inside from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(14 + inside) as bigint) as formatted_chars
from e group by conv_id"""
