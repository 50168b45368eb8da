"""Encoding and decoding with a SentencePiece vocabulary of the merge type.

A text is normalised, cut into characters, and neighbouring symbols are merged:
an agenda holds every adjacent pair whose joined text is in the vocabulary, the
best score first, the leftmost of equals first; a merge takes its pair off and
puts the two new neighbouring pairs on, until the agenda is empty. What is left
and not in the vocabulary is spelled by byte pieces, or is unknown.

Merges never cross a place where no piece of the vocabulary could stand, so a
text falls into runs that are merged each for itself, and a run that was seen
before is looked up. Tasks read Arrow batches and hold a bounded piece of one
at a time; the vocabulary's file travels as a broadcast of its bytes.

Defined results: a null text is empty and has no ids; null ids decode to an
empty text. Bytes that are no UTF-8 count as U+FFFD each. Texts of any length are
encoded whole; a run without any place to cut at costs its task about 150 bytes a
character. Other columns of any name come along; the names of the columns made
are parameters, and one that is taken raises ``ValueError``.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from findling.llm.common import flat_texts, pieces

SPACE = "▁"  # stands for a blank inside pieces
BATCH_BYTES = 4 << 20  # of text that a task encodes at once
CACHE_RUNS = 1 << 18  # runs whose ids a task remembers
PROBED_AT_ONCE = 512
CACHE_CHARACTERS = 48  # a longer run is not remembered
NEVER = (1 << 31) - 1  # the rank of a pair that is no piece
NEVER32 = np.int32(NEVER)
RUNS_AT_ONCE = 1 << 14
PLACE_BITS = 40  # of an entry of the agenda; the rank of its score stands above

#: Fixed values of the file format: kinds of pieces, and field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, WHITESPACE_AS_SUFFIX, UNKNOWN_SURFACE, MERGE_TYPE = 3, 35, 24, 44, 2
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("findling.each_byte", _each_byte)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary(dict):
    """The pieces of a model file; as a dictionary it gives the ids of a run of characters."""

    def __init__(self, model: bytes):
        super().__init__()
        self.model = model
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == PIECES:
                fields = dict(_fields(value))
                self.names.append(fields[1].decode())
                scores.append(struct.unpack("<f", fields.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(fields.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_TYPE, 1) != MERGE_TYPE:
            raise ValueError("the vocabulary is not of the merge type")
        if trainer.get(WHITESPACE_AS_SUFFIX, 0):
            raise ValueError("pieces that end in blanks are not supported")
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        surface = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        self.dummy_prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(normalizer.get(REMOVE_EXTRA, 1))
        plain = not normalizer.get(CHARACTER_MAP) and not self.remove_extra
        self.own_rules = plain and bool(normalizer.get(ESCAPE, 1))

        self.ids = {name: i for i, name in enumerate(self.names)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        whole = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)]
        places = {s: n for n, s in enumerate(sorted({scores[i] for i in whole}, reverse=True))}
        self.rank = {self.names[i]: places[scores[i]] for i in whole}
        self.unused = {self.names[i] for i in whole if self.kinds[i] == UNUSED}

        #: Neighbouring characters inside any piece; between two others no merge reaches.
        self.inner = {n[i : i + 2] for n in self.rank for i in range(len(n) - 1)}
        words = all(p[0] == SPACE or p[1] != SPACE for p in self.inner)
        joins = "".join(sorted({c for p in self.inner for c in p} - {SPACE}))
        pattern = f"{SPACE}*[{re.escape(joins)}]+|{SPACE}+|." if words and joins else ".+"
        self.runs = re.compile(pattern, re.DOTALL).findall
        fixed = sorted((self.names[i] for i in whole if self.kinds[i] == USER_DEFINED), key=len)
        self.fixed = re.compile("(" + "|".join(map(re.escape, fixed[::-1])) + ")") if fixed else None

        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.surface = [n.replace(SPACE, " ").encode() for n in self.names]
        for i, kind in enumerate(self.kinds):
            if kind == CONTROL:
                self.surface[i] = b""
            elif kind == BYTE:
                self.surface[i] = bytes([int(self.names[i][3:-1], 16)])
            elif kind == UNKNOWN:
                self.surface[i] = surface
        self._library = None
        self.wrong: set[str] = set()  # runs that the library merges otherwise
        self._table()

    def _table(self) -> None:
        """What many runs are merged by: the symbol of each character, and sorted pairs of
        symbols with the rank and the symbol of what they join to."""
        names = list(self.rank)
        place = {name: i for i, name in enumerate(names)}
        self.width = len(names)
        pairs = sorted(
            (place[n[:i]] * self.width + place[n[i:]], self.rank[n], place[n])
            for n in names
            for i in range(1, len(n))
            if n[:i] in place and n[i:] in place
        )
        keys, ranks, joined = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pair_keys = np.append(keys, 1 << 62)
        self.pair_rank = np.append(ranks, NEVER).astype(np.int32)
        self.pair_joined = np.append(joined, 0).astype(np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for name, i in place.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = i
        self.symbol_ids = np.array([self.ids[name] for name in names], np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what pairs of symbols join to; a negative symbol joins to nothing."""
        key = left.astype(np.int64) * self.width + right
        spot = np.searchsorted(self.pair_keys, key)
        never = (self.pair_keys[spot] != key) | (left < 0) | (right < 0)
        return np.where(never, NEVER32, self.pair_rank[spot]), self.pair_joined[spot]

    @property
    def library(self) -> SentencePieceProcessor:
        if self._library is None:
            self._library = SentencePieceProcessor(model_proto=self.model)
        return self._library

    def normalised(self, text: str) -> str:
        """The text with blanks escaped; character maps are applied by the library's table."""
        if not self.own_rules:
            return self.library.normalize(text)
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.dummy_prefix else text

    def runs_of(self, text: str) -> list[str]:
        """The runs of a whole text, which no merge goes beyond."""
        text = self.normalised(text)
        if self.fixed is None:
            return self.runs(text)
        parts = self.fixed.split(text)  # every other part is a fixed symbol
        return [run for i, part in enumerate(parts) for run in ([part] if i % 2 else self.runs(part))]

    def ids_of(self, runs: list[str]) -> bytes:
        """The ids of runs end to end, four bytes each."""
        out = b"".join(map(self.__getitem__, runs))
        if self.byte_fallback:
            return out
        ids = np.frombuffer(out, np.int32)  # neighbouring unknowns are one
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~np.append(False, again)[: len(ids)]].tobytes()

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return np.frombuffer(self.ids_of(self.runs_of(text)), np.int32).tolist()

    def learn(self, texts: list[list[str]], check: bool = False) -> None:
        """Merge all runs of ``texts`` that are not known, many at a time.

        With ``check`` the library encodes each of them too; a run begins with the blank
        that the library puts before a text, so it is given the run without it.
        """
        new = set().union(*texts) - self.keys()
        if len(self) + len(new) > CACHE_RUNS:
            self.clear()
            new = set().union(*texts)
        short = [r for r in new if len(r) <= CACHE_CHARACTERS]
        if not self.unused and self.fixed is None:
            short.sort(key=len)
            for first in range(0, len(short), RUNS_AT_ONCE):
                self._merge_many(short[first : first + RUNS_AT_ONCE])
        if check and self.own_rules and self.dummy_prefix:
            probe = [r for r in new if r[0] == SPACE and r != SPACE]
            for first in range(0, len(probe), PROBED_AT_ONCE):
                some = probe[first : first + PROBED_AT_ONCE]
                if not self._library_agrees(some):
                    self.wrong.update(r for r in some if not self._library_agrees([r]))

    def _library_agrees(self, runs: list[str]) -> bool:
        text = "".join(runs)[1:].replace(SPACE, " ")
        theirs = self.library.encode(text, num_threads=1)
        return array("i", theirs).tobytes() == b"".join(map(self.__getitem__, runs))

    def _merge_many(self, runs: list[str]) -> None:
        """The ids of runs of about one length: a row of symbols each, and beside it the
        agenda of its adjacent pairs, of which the best is taken in all rows at once."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        width = int(sizes[-1])
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        symbols = np.full((len(runs), width + 1), -1, np.int32)  # a column to shift in from
        symbols[np.arange(width + 1) < sizes[:, None]] = self.symbol_of[codes]
        known = np.nonzero((symbols >= 0).sum(axis=1) == sizes)[0]  # others are spelled one by one
        symbols, sizes, open_ = symbols[known], sizes[known], np.arange(len(known))
        merged = symbols.copy()
        agenda, joined = self._look_up(symbols[:, :-1], symbols[:, 1:])
        while len(open_):
            each = np.arange(len(open_))
            at = agenda.argmin(axis=1)
            going = agenda[each, at] < NEVER
            if not going.all():
                merged[open_[~going], : symbols.shape[1]] = symbols[~going]
                open_, at = open_[going], at[going]
                symbols, agenda, joined = symbols[going], agenda[going], joined[going]
                each = each[: len(open_)]
                if not len(open_):
                    break
            sizes[open_] -= 1
            whole = joined[each, at]
            place = np.arange(symbols.shape[1] - 1)
            symbols = np.where(place > at[:, None], symbols[:, 1:], symbols[:, :-1])
            symbols[each, at] = whole
            if symbols.shape[1] < 2:
                merged[open_, :1] = symbols
                break
            moved = place[:-1] >= at[:, None]
            agenda = np.where(moved, agenda[:, 1:], agenda[:, :-1])
            joined = np.where(moved, joined[:, 1:], joined[:, :-1])
            ahead, behind = np.nonzero(at < agenda.shape[1])[0], np.nonzero(at > 0)[0]
            left = np.concatenate([whole[ahead], symbols[behind, at[behind] - 1]])
            right = np.concatenate([symbols[ahead, at[ahead] + 1], whole[behind]])
            pair = np.concatenate([ahead, behind]), np.concatenate([at[ahead], at[behind] - 1])
            agenda[pair], joined[pair] = self._look_up(left, right)
        flat = self.symbol_ids[merged[np.arange(width + 1) < sizes[:, None]]].tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        self.update((runs[i], flat[a:b]) for i, a, b in zip(known.tolist(), [0, *ends], ends))

    def __missing__(self, run: str) -> bytes:
        if self.fixed is not None and self.fixed.fullmatch(run):
            return array("i", [self.ids[run]]).tobytes()
        if len(run) <= CACHE_CHARACTERS:
            symbols = self.merge(run) if self.unused else self.merge_short(run)
            if len(self) >= CACHE_RUNS:
                self.clear()
            self[run] = out = array("i", self._ids_of(symbols)).tobytes()
            return out
        edges = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.inner]
        parts = (run[a:b] for a, b in zip([0, *edges], [*edges, len(run)]))
        return b"".join(array("i", self._ids_of(self.merge(part))).tobytes() for part in parts)

    def _ids_of(self, symbols: list[str]) -> list[int]:
        out = list(map(self.ids.get, symbols))
        if None in out:
            if not self.byte_fallback:
                return [self.unknown if i is None else i for i in out]
            spelled = lambda symbol: [self.bytes[byte] for byte in symbol.encode()]
            out = [j for i, s in zip(out, symbols) for j in ((i,) if i is not None else spelled(s))]
        return out

    def merge_short(self, run: str) -> list[str]:
        """The same as ``merge`` for a short run: its agenda is a list by place, whose least
        rank is looked for at every step."""
        symbols, rank = list(run), self.rank.get
        agenda = [rank(run[i : i + 2], NEVER) for i in range(len(run) - 1)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(joined + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + joined, NEVER)
        return symbols

    def merge(self, run: str) -> list[str]:
        """The symbols of a run after all merges, from the agenda of adjacent pairs."""
        symbols, n = list(run), len(run)
        rank, unused, place_bits = self.rank.get, self.unused, PLACE_BITS
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        agenda = []  # rank of the score, then place of the left symbol
        for left in range(n - 1):
            if (place := rank(run[left : left + 2])) is not None:
                agenda.append(place << place_bits | left)
                if run[left : left + 2] in unused:
                    halves[run[left : left + 2]] = run[left], run[left + 1]
        heapify(agenda)
        while agenda:
            key = heappop(agenda)
            left = key & (1 << place_bits) - 1
            right = after[left]
            if right >= n or not symbols[left]:
                continue  # taken up by another merge
            joined = symbols[left] + symbols[right]
            if rank(joined) != key >> place_bits:
                continue  # the pair is no longer the one that was put on
            symbols[left], symbols[right] = joined, ""
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
            for a, b in ((left, beyond), (before[left], left)):
                if a >= 0 and b < n and (place := rank(symbols[a] + symbols[b])) is not None:
                    heappush(agenda, place << place_bits | a)
                    if symbols[a] + symbols[b] in unused:
                        halves[symbols[a] + symbols[b]] = symbols[a], symbols[b]
        symbols = [s for s in symbols if s]
        while any(s in halves for s in symbols):  # unused pieces fall apart again
            symbols = list(chain.from_iterable(halves.get(s, (s,)) for s in symbols))
        return symbols

    def decode(self, ids) -> str:
        """The text of a row of ids."""
        out = list(map(self.surface.__getitem__, ids))
        if self.dummy_prefix or self.remove_extra:
            for place, i in enumerate(ids):  # the blank put before the text goes again
                if self.kinds[i] == CONTROL:
                    continue
                if self.kinds[i] not in (BYTE, UNKNOWN) and out[place].startswith(b" "):
                    out[place] = out[place][1:]
                    if self.remove_extra and not out[place]:
                        continue
                break
        if self.controls.isdisjoint(ids):
            return b"".join(out).decode("utf-8", "findling.each_byte")
        edges = [i for i, x in enumerate(ids) if x in self.controls]  # no character spans one
        parts = (b"".join(out[a:b]) for a, b in zip([0, *edges], [*edges, len(out)]))
        return "".join(part.decode("utf-8", "findling.each_byte") for part in parts)


def read_vocabulary(path: str) -> bytes:
    """The bytes of a model file of the driver's machine."""
    with open(path, "rb") as file:
        model = file.read()
    Vocabulary(model)  # a file of another kind raises here
    return model


def _with(df: DataFrame, *made: tuple[str, T.DataType]) -> T.StructType:
    taken = {c.lower() for c in df.columns} & {name.lower() for name, _ in made}
    if taken:
        raise ValueError(f"columns of these names exist already: {sorted(taken)}")
    return T.StructType([*df.schema, *(T.StructField(name, kind) for name, kind in made)])


def encode(
    docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", agrees: str | None = None
) -> DataFrame:
    """``docs`` with the ids of ``text`` in place of the text itself.

    With ``agrees`` a boolean column of that name says whether the library gives the
    same ids to all runs of the text; it is asked batch by batch about the new ones.
    """
    kept = docs.drop(text).columns
    rest = docs.select(*kept)
    made = [(ids, T.ArrayType(T.IntegerType())), *([(agrees, T.BooleanType())] if agrees else [])]
    schema = _with(rest, *made)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value)
        for batch in batches:
            flat, offsets = flat_texts(batch.column(batch.schema.get_field_index(text)))
            for first, last in pieces(offsets, BATCH_BYTES):
                texts = []
                for row in range(first, last):
                    body = flat[offsets[row] : offsets[row + 1]].tobytes()
                    texts.append(vocabulary.runs_of(body.decode("utf-8", "findling.each_byte")))
                vocabulary.learn(texts, bool(agrees))
                out = list(map(vocabulary.ids_of, texts))
                ends = np.cumsum([0, *map(len, out)]) // 4
                columns = [batch.column(i).slice(first, last - first) for i in order]
                values = pa.array(np.frombuffer(b"".join(out), np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                if agrees:
                    same = [vocabulary.wrong.isdisjoint(runs) for runs in texts]
                    columns.append(pa.array(same if vocabulary.wrong else [True] * len(texts), pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    chosen = docs.select(text, *kept)
    order = range(1, len(kept) + 1)
    return chosen.mapInArrow(encoded, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its column of ids."""
    schema = _with(df, (text, T.StringType()))
    held = df.sparkSession.sparkContext.broadcast(model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset :][: len(lists) + 1]
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for first, last in pieces(ends, BATCH_BYTES // 4):
                texts = [
                    vocabulary.decode(values[offsets[r] : offsets[r] + sizes[r]].tolist())
                    for r in range(first, last)
                ]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], schema.names
                )

    return df.mapInArrow(decoded, schema)


def report(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, library_agrees`` of every document."""
    coded = encode(docs.select("doc_id", "text"), model, agrees="library_agrees")
    return decode(coded, model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "library_agrees",
    )
