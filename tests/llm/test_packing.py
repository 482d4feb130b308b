import random
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from siftline.llm.packing import Packing, best_fit, encoder, pack, pieces, sequences  # noqa: E402
from siftline.llm.packing import expected_pieces  # noqa: E402

SCHEMA = "doc_id long, text string"
PATH = public.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a  b \n c\t", "é  ü x", "it's THEY'LL 12345 !!??", "\x1c\x85 x", "🙂🙂 ok", "end   ",
    "<|endoftext|> in a text <|endoftext|>", "a\r\n\r\nb", "x" * 500, "日本語 テスト", "́", "٣٤ ⅷ²",
]


def test_ids_are_those_of_the_tokenizers_library():
    own = Tokenizer.from_file(PATH)
    encode = encoder(open(PATH, encoding="utf-8").read())
    rnd = random.Random(1)
    letters = "ab eE  \n\t'sé12!?<|> ß.🙂"
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(400)]
    for text in texts:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids, text


def check(cut, packed, params):
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= params.tokens and len(parts) <= params.pieces
        assert sum(n * n for _, n in parts) <= params.attention
    assert len(packed) == len(cut)
    return len(by_sequence)


@pytest.mark.parametrize("params", [Packing(tokens=16, group_pieces=30), Packing(tokens=16, pieces=3, rule="dot", weights=(1, 1, 1)), Packing(tokens=16, attention=150, weights=(1, 0.5, 1))])
def test_round_trip_and_capacities(spark, params):
    rnd = random.Random(2)
    texts = ODD + [" ".join(rnd.choice(["a", "of", "the", "zebra", "é"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "repeated"), (3, "repeated")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", sequence_id string").repartition(3)
    cut = pieces(frame, PATH, params)
    packed = pack(cut, params)
    out = packed.collect()
    check(cut.collect(), out, params)
    own = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, ids.tolist()))
    for doc, text in enumerate(texts):
        if doc == 3:
            continue
        parts = sorted(by_doc[doc])
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        ids = [i for _, _, part in parts for i in part]
        assert ids == own.encode(text or "", add_special_tokens=False).ids + [2]
        assert [s for _, s, _ in parts] == [sum(len(x) for _, _, x in parts[:k]) for k in range(len(parts))]
        assert all(len(x) == params.longest for _, _, x in parts[1:])
        assert len(parts) == -(-len(ids) // params.longest)
    assert len(by_doc[3]) == 2 + len([1 for d, t in rows if d == 3]) - 2
    total = {r.sequence_id: (bytes(r.ids), list(r.lengths)) for r in sequences(packed).collect()}
    assert sum(len(x) // 4 for x, _ in total.values()) == sum(r.length for r in out)


def test_near_the_lower_bound():
    rnd = np.random.default_rng(0)
    lengths = np.sort(rnd.integers(1, 1024, 20_000))[::-1]
    place, offset = best_fit(lengths, Packing())
    assert place.max() + 1 <= 1.01 * lengths.sum() / 1024
    small = np.sort(rnd.integers(1, 17, 300))[::-1]
    place, _ = best_fit(small, Packing(tokens=16, pieces=3, attention=256, weights=(1, 1, 0)))
    assert np.bincount(place, small).max() <= 16 and np.bincount(place).max() <= 3


def test_empty_table(spark):
    cut = pieces(spark.createDataFrame([], SCHEMA), PATH)
    assert pack(cut).collect() == []


def test_pieces_of_one_document_go_to_several_groups(spark):
    rows = spark.range(3000).selectExpr("7L AS doc_id", "int(id) AS piece", "id * 16 AS start", "16L AS length", "id AS ids_crc32")
    packed = pack(rows, Packing(tokens=16, group_pieces=500)).collect()
    assert len({r.sequence_id for r in packed}) == 3000 and len({r.sequence_id >> 32 for r in packed}) == 6


def test_expected_pieces_grow_with_the_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 40_960)], "doc_id long, text string")
    assert expected_pieces(docs) == 2 + 11 and expected_pieces(docs.limit(0)) == 0
