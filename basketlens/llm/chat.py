"""Chat formatting by assembling tokens.

Role and text of every turn are encoded on their own and spliced between reserved ids that
mark the turn's start, the start of its text and its end, so no text can produce a mark.  The
same holds for the rendered string: control strings within a text are escaped, reversibly, by
a backslash after their first character.  The loss mask holds from where the text of a role to
be learned starts to its end mark; :func:`read_back` finds the turns and the text under the
mask from ids and mask alone.

A conversation of any length comes as blocks of whole turns, about ``BLOCK`` tokens each, with
the place of their first token.  Turns are sorted over all tasks by range, so that one task has
a stretch of a long conversation; the stretches' lengths are summed up to their places.
Digests stream the blocks of a conversation in order: one task, but one block in memory.

Defined results: turns come in order of their number (null first), ties by role, then text;
repeated rows are repeated turns.  A null text or role is empty.  Rows with a null conv_id
form one conversation.  An empty table gives no conversation.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import Vocabulary, shipped

#: Marks in the order of their ids, which follow the vocabulary's.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
LEARNED = ("assistant",)
#: Tokens after which a block ends with its turn, turns encoded at once, and characters of a
#: text that the ranges are found by.
BLOCK, AT_ONCE, PREFIX = 4_096, 256, 200
#: A control string after its first character, with the backslashes that escape it.
_REST = r"(?=\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>)"
PLAIN = re.compile(r"([<\[])(\\*)" + _REST)
ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)


def escape(text: str) -> str:
    return PLAIN.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def assemble(
    vocabulary: Vocabulary, turns: list[tuple[str, str]], learned=LEARNED
) -> list[tuple[list[int], list[bool]]]:
    """Ids and loss mask of each turn."""
    turn, start, end = range(len(vocabulary.tokens), len(vocabulary.tokens) + 3)
    encoded = vocabulary.encode_all([escape(s) for pair in turns for s in pair])
    out = []
    for at, (role, _) in enumerate(turns):
        head, text = [turn, *encoded[2 * at], start], [*encoded[2 * at + 1], end]
        out.append((head + text, [False] * len(head) + [role in learned] * len(text)))
    return out


def render(vocabulary: Vocabulary, ids: list[int]) -> str:
    size = len(vocabulary.tokens)
    data = [MARKS[i - size].encode() if i >= size else vocabulary.tokens[i] for i in ids]
    return b"".join(data).decode("utf-8", "surrogatepass")


def read_back(
    vocabulary: Vocabulary, ids: list[int], mask: list[bool]
) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text), and the texts under the mask."""
    turn, start, end = range(len(vocabulary.tokens), len(vocabulary.tokens) + 3)
    turns, under, open_at, role = [], [], 0, ""
    for at, i in enumerate(ids):
        if i == turn:
            open_at = at + 1
        elif i in (start, end):
            text = unescape(render(vocabulary, ids[open_at:at]))
            if i == start:
                role, open_at = text, at + 1
            else:
                turns.append((role, text))
                if mask[at]:
                    kept = [x for x, m in zip(ids[open_at:at], mask[open_at:at]) if m]
                    under.append(unescape(render(vocabulary, kept)))
    return turns, under


def format_conversations(
    rows: DataFrame, path: str, pattern: str, learned: tuple[str, ...] = LEARNED
) -> DataFrame:
    """Blocks of the conversations: conv_id, start (place of the first token in the
    conversation), text (rendered), ids, loss_mask."""
    sent = shipped(rows.sparkSession, path, pattern)
    names = ["conv_id", "part", "start", "size", "text", "ids", "loss_mask"]

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_id, place = TaskContext.get().partitionId(), None, 0
        ids: list[int] = []
        mask: list[bool] = []

        def block(kind: pa.DataType) -> pa.RecordBatch:
            values = [[open_id], [part], [place], [len(ids)], [render(sent.value, ids)], [ids], [mask]]
            kinds = [kind, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                turns = [(r or "", t or "") for r, t in zip(*[some.column(c).to_pylist() for c in ("role", "text")])]
                found = assemble(sent.value, turns, learned)
                for conv_id, (more, under) in zip(some.column("conv_id").to_pylist(), found):
                    if ids and (conv_id != open_id or len(ids) >= BLOCK):
                        yield block(kind)
                        place = place + len(ids) if conv_id == open_id else 0
                        ids, mask = [], []
                    open_id = conv_id
                    ids += more
                    mask += under
        if ids:
            yield block(kind)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("conv_id", "turn", "role", "text").repartitionByRange(
        parts, "conv_id", "turn", "role", F.substring("text", 1, PREFIX)
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = cut_lineage(
        ranged.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
            assembled,
            f"conv_id {kind}, part int, start long, size int, text string, ids array<int>, loss_mask array<boolean>",
        )
    )
    # a task has at most two conversations in common with others: its first and its last
    stretches = blocks.groupBy("conv_id", "part").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = stretches.withColumn("before", F.sum("size").over(before)).where("before IS NOT NULL")
    later = later.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), "before")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part"))
    placed = F.col("start") + F.coalesce("before", F.lit(0))
    return blocks.join(F.broadcast(later), same, "left").select(
        "conv_id", placed.alias("start"), "text", "ids", "loss_mask"
    )


def digests(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation, from ids and mask: turns and text under the mask as digests."""
    sent = shipped(formatted.sparkSession, path, pattern)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None  # conv_id, turns, their hash, characters, their hash, all characters

        def ended(states: list[list]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [[i, n, told.hexdigest(), chars, loss.hexdigest(), size] for i, n, told, chars, loss, size in states]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            done = []
            kind = batch.schema.field("conv_id").type
            for conv_id, ids, mask in zip(*[batch.column(c) for c in ("conv_id", "ids", "loss_mask")]):
                conv_id, ids, mask = conv_id.as_py(), ids.as_py(), mask.as_py()
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(state)
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, under = read_back(sent.value, ids, mask)
                state[1] += len(turns)
                for role, text in turns:
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for text in under:
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(render(sent.value, ids))
            if done:
                yield ended(done)
        if state is not None:
            yield ended([state])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = formatted.select("conv_id", "start", "ids", "loss_mask").repartition(parts, "conv_id")
    return streamed.sortWithinPartitions("conv_id", "start").mapInArrow(
        digest,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
