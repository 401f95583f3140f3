"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and the sorted
spans of its assistant turns are intersected with the sorted token spans by
binary search: a token is under the loss as far as it lies in such a span.

Template: ``### role: text</turn>`` and a newline per turn. Inside texts and roles
a backslash becomes two, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\e``; in
roles also ``:`` becomes ``\\c``. So no control string can come from a text,
and :func:`parse` gives all turns back.

Turns are ordered by ``turn`` (nulls first), ties by role and text. Null roles and
texts count as empty; rows with a null id make one conversation. Other columns
are not read. One conversation is one row of the result and must fit in memory
once; rows reach a task sorted, one conversation after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import map_arrow, partitions

HEAD, MID, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_CODES = {"\\\\": "\\", "\\h": "###", "\\e": "</turn>", "\\c": ":"}
_ESCAPED = re.compile(r"\\[\\hec]")


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")
    return text.replace(":", "\\c") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the (start, end) spans of its loss texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, True)}{MID}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(HEAD) :].partition(MID)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token, the part of it in a loss span (start = end: none). Both lists are
    sorted; the spans that can meet a token are found by binary search."""
    starts, ends = offsets[:, 0], offsets[:, 1]
    if not len(spans) or not len(offsets):
        return starts, starts.copy()
    first = np.searchsorted(spans[:, 1], starts, "right")  # the first span that ends after the token starts
    within = np.minimum(first, len(spans) - 1)
    a = np.maximum(starts, spans[within, 0])
    z = np.minimum(ends, spans[within, 1])
    hit = (first < len(spans)) & (a < z)
    return np.where(hit, a, starts), np.where(hit, z, starts)


def cover(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of the tokens' parts (bytes of one character share its span)."""
    out: list[tuple[int, int]] = []
    hit = ends > starts
    for a, z in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, loss_start and
    loss_end (per token, the characters of it under the loss)."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        kinds: list[pa.DataType] = []

        def flush(ids: list, convs: list) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], []]
            for conv in convs:
                formatted, spans = render(conv)
                enc = tok.encode(formatted, add_special_tokens=False)
                a, z = mask(np.array(enc.offsets, np.int64).reshape(-1, 2), spans)
                for c, v in zip(columns, (formatted, enc.ids, a.astype(np.int32), z.astype(np.int32)), strict=True):
                    c.append(v)
            arrays = [pa.array(ids, kinds[0]), pa.array(columns[0], pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "formatted", "input_ids", "loss_start", "loss_end"])

        ids: list = []
        convs: list[list[tuple[str, str]]] = []
        held = 0
        for b in batches:
            kinds[:] = [b.column(0).type]
            for conv, who, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not ids or ids[-1] != conv:
                    if held > 1 << 20:
                        yield flush(ids, convs)
                        ids, convs, held = [], [], 0
                    ids.append(conv)
                    convs.append([])
                convs[-1].append((who, said))
                held += len(said) + 16
        if ids:
            yield flush(ids, convs)

    return map_arrow(rows, run, f"conv_id {kind}, formatted string, input_ids array<int>, loss_start array<int>, loss_end array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Loss texts come from the mask alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            out: list[tuple] = []
            for text, starts, ends in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                turns = parse(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[a:z]) for a, z in cover(starts.values.to_numpy(), ends.values.to_numpy()))
                out.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c)) for c in zip(*out, strict=True))], names=["a", "b", "c", "d", "e", "f"])

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_arrow(formatted.select("conv_id", "formatted", "loss_start", "loss_end"), run, schema)
