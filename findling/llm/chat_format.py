"""Rendering conversations for training, with a parser that reads them back.

Every turn becomes ``opening text closing`` by its role. The parser knows only
the rendered text: it takes the opening it finds, reads to the first closing
that no backslash disarms, and drops the backslashes that disarm something. A
turn is rendered as it is, parsed, compared with the source, and escaped at the
next level until both are identical: first the control strings in it, then
every character that can begin one.

Each piece parses by itself and to its end, so a conversation is the pieces in
order, and pieces are made without a shuffle. Reading back walks through sorted
rows and keeps running digests only, so a conversation may be of any length.

Defined results: a null text or role is empty. Turns with one number stand in
order of role and rendered text, escapes and all; a null turn stands first, and a null conversation is
one of its own. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Opening and closing of the known roles; any other role is named in its opening.
MARKS = {
    "system": ("[SYS]", "[/SYS]"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("[ROLE=", "]", "[/ROLE]")
CONTROL = re.compile(r"\\|\[/?(?:SYS|INST|ROLE)|</?s>")
FIRSTS = re.compile(r"[\\\[\]<]")
LEARNED_ROLE = "assistant"

_DISARMED = re.compile(r"\\([\\\[\]<])")
_ENDS = {
    closing: re.compile(r"\\[\\\[\]<]|" + re.escape(closing))
    for closing in [*(m[1] for m in MARKS.values()), *OTHER[1:]]
}


class NotParsed(ValueError):
    """The text is no rendered conversation."""


def escaped(text: str, level: int) -> str:
    if level == 0:
        return text
    pattern = CONTROL if level == 1 else FIRSTS
    return pattern.sub(lambda m: ESCAPE + m.group(0), text)


def render(role: str, text: str, level: int = 0) -> str:
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = OTHER[0] + escaped(role, 2) + OTHER[1], OTHER[2]
    return opening + escaped(text, level) + closing


def _until(text: str, start: int, closing: str) -> tuple[str, int]:
    for found in _ENDS[closing].finditer(text, start):
        if found.group(0) == closing:
            return _DISARMED.sub(r"\1", text[start : found.start()]), found.end()
    raise NotParsed(f"no {closing} after {start}")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of rendered text; raises ``NotParsed`` where the grammar ends."""
    turns, at = [], 0
    while at < len(text):
        for role, (opening, closing) in MARKS.items():
            if text.startswith(opening, at):
                body, at = _until(text, at + len(opening), closing)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise NotParsed(f"no opening at {at}")
            role, at = _until(text, at + len(OTHER[0]), OTHER[1])
            body, at = _until(text, at, OTHER[2])
        turns.append((role, body))
    return turns


def round_trip(role: str, text: str) -> str:
    """The turn rendered with the least escaping that reads back as it was."""
    for level in (0, 1, 2):
        piece = render(role, text, level)
        try:
            if parse(piece) == [(role, text)]:
                return piece
        except NotParsed:
            pass
    raise AssertionError("full escaping always reads back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, piece`` for every row; joined in order, the pieces of a
    conversation are its rendered text."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pieces = [round_trip(r, t) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()),
                 pa.array(pieces, pa.string())],
                ["conv_id", "turn", "role", "piece"],
            )

    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.col("role").cast("string"), F.col("text").cast("string"),
    )
    return rows.mapInArrow(rendered, "conv_id bigint, turn bigint, role string, piece string")


class _ReadBack:
    """Running figures of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text in parse(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == LEARNED_ROLE:
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def read_back(pieces: DataFrame) -> DataFrame:
    """What a parser recovers from the rendered conversations, one row for each."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            ids, texts = batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()
            for conv_id, piece in zip(ids, texts):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _ReadBack(conv_id)
                current.add(piece)
            yield _rows(done)
        if current is not None:
            yield _rows([current.row()])

    order = ["conv_id", "turn", "role", "piece"]
    return (
        pieces.repartition("conv_id")
        .sortWithinPartitions(*order)
        .mapInArrow(
            digests,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
            "loss_sha256 string, formatted_chars bigint",
        )
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_DIGEST)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _DIGEST)], schema=_DIGEST
    )


def conversation_texts(pieces: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the pieces joined, for conversations that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "piece")))
    return pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("formatted")
    )
