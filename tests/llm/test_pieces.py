"""SentencePiece encoding and decoding against the library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from findling.llm import sentence_pieces as sp

DOC = "doc_id bigint, text string, length int"
MODEL = sp.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = "abeinrt \n▁é中文🙂\x00.0 1 theÀ한\t"


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(MODEL)


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(LETTERS, k=rnd.randrange(60))) for _ in range(n)]


LONG = ["a" * 9001, "the" * 4000, " " * 3001, "中" * 2000, "ab\n" * 3000, "x▁▁y " * 50, "<s></s><unk><0x41>", "", " "]


def test_ids_are_the_librarys(vocabulary):
    for text in texts(1, 3000) + LONG:
        assert vocabulary.encode(text) == vocabulary.library.encode(text), text[:50]


def test_runs_merged_together_are_those_merged_alone(vocabulary):
    rows = [vocabulary.runs_of(t) for t in texts(2, 2000) + LONG]
    vocabulary.clear()
    vocabulary.learn(rows, check=True)
    assert not vocabulary.wrong
    for runs in rows:
        assert vocabulary.ids_of(runs) == b"".join(
            struct.pack(f"<{len(ids)}i", *ids) for r in runs for ids in [vocabulary._ids_of(vocabulary.merge(r))]
        )


def test_decoding_is_the_librarys(vocabulary):
    rnd = random.Random(3)
    some = [1, 2, 0, 259, 300, 5, 13, 200, 231, 185, 178, 240, 162, 133, 28705, 29000, 400]
    for _ in range(4000):
        ids = rnd.choices(some, k=rnd.randrange(9))
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids), ids


def test_report(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts(4, 60) + LONG)] + [(900, None, 0), (900, "a", 0), (None, "b c", 0)]
    df = spark.createDataFrame(rows, DOC).repartition(4)
    library = SentencePieceProcessor(model_proto=MODEL)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(map(repr, map(tuple, sp.report(df, MODEL).collect()))) == sorted(map(repr, want))
    assert sp.report(df.limit(0), MODEL).count() == 0


def test_other_columns_come_along(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, None)], "ids bigint, text string, agrees int")
    with pytest.raises(ValueError, match="ids"):
        sp.encode(df, MODEL)
    coded = sp.encode(df, MODEL, ids="pieces")
    back = {r.ids: (r.agrees, r.decoded) for r in sp.decode(coded, MODEL, "pieces").collect()}
    assert back == {1: (5, "a b"), 2: (None, "")}
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sp.decode(nulls, MODEL).collect()] == ["", ""]


def message(*fields):
    """A serialised message of numbered fields."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def small_model(pieces, byte_fallback, dummy):
    rows = [(b"<unk>", 0.0, sp.UNKNOWN), (b"<s>", 0.0, sp.CONTROL), (b"</s>", 0.0, sp.CONTROL), *pieces]
    body = [(1, message((1, name), (2, score), (3, kind))) for name, score, kind in rows]
    trainer = message((sp.MODEL_TYPE, sp.MERGE_TYPE), (sp.BYTE_FALLBACK, byte_fallback))
    return message(*body, (2, trainer), (3, message((1, b"identity"), (3, dummy), (4, 0), (5, 1))))


def test_unused_and_fixed_pieces_ties_and_unknowns():
    plain = [("▁", -9.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("▁a", -2.0)]
    rows = [(n.encode(), s, sp.NORMAL) for n, s in plain]
    rows += [("abab".encode(), -2.5, sp.UNUSED), ("ca".encode(), -1.5, sp.UNUSED), (b"[X]", 0.0, sp.USER_DEFINED)]
    for dummy in (0, 1):
        model = small_model(rows, 0, dummy)
        library, own = SentencePieceProcessor(model_proto=model), sp.Vocabulary(model)
        rnd = random.Random(dummy)
        for _ in range(3000):
            text = "".join(rnd.choices(["a", "b", "c", "d", " ", "[X]", "é"], k=rnd.randrange(12)))
            assert own.encode(text) == library.encode(text), text
            assert own.decode(own.encode(text)) == library.decode(library.encode(text)), text


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError, match="merge"):
        sp.Vocabulary(message((1, message((1, b"<unk>"), (2, 0.0), (3, 2)))))
