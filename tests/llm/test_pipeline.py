import random
import zlib

import pytest
from test_decontaminate import brute as hits
from test_minhash import brute as components
from test_paragraphs import brute as passages

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from siftline.llm.paragraphs import Paragraphs  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"aa": ["ban", "tor", "mil", "su", "dek"], "bb": ["kel", "öst", "rif", "ga", "pun"]}


def word(rnd, lang):
    return "".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(2, 4)))


def documents(seed):
    rnd = random.Random(seed)
    texts = [(" ".join(word(rnd, lang) for _ in range(rnd.randint(30, 120))), lang) for lang in ("aa", "bb") for _ in range(25)]
    passage = " ".join(word(rnd, "aa") for _ in range(70))
    item = " ".join(word(rnd, "bb") for _ in range(15))
    texts += [(f"{t[:40]} {passage} {t[40:]}", lang) for t, lang in texts[:3]]
    texts += [(f"{texts[30][0][:200]} {item} {word(rnd, 'bb')}", "bb"), (item, "bb")]
    texts += [texts[4], texts[4], (texts[5][0] + " " + word(rnd, "aa"), "aa"), (None, "aa"), ("", None), ("12 34", "aa"), (texts[6][0].upper(), None)]
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    rnd.shuffle(rows)
    return rows, [(0, item), (1, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items = documents(1)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def by_id(rows):
    return {r[0]: tuple(r) for r in rows}


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.stage(step(spark, docs, folder), name)
        assert docs.columns == columns and dict(docs.dtypes) == dict(spark.createDataFrame([], SCHEMA).dtypes)
        after = by_id(docs.collect())
        texts = [(r[0], r[1]) for r in before]
        if name == "language_id":
            assert set(after) == {i for i, t in texts if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, _, kept) in components(texts, 5).items() if kept}
        elif name == "repeated_passages":
            want = by_id(before)
            gone = passages(texts, Paragraphs())
            assert gone and {i for i in after if after[i] != want[i]} == {r[0] for r in gone}
            for i, r in after.items():
                words = (want[i][1] or "").split()
                left = [w for n, w in enumerate(words) if not any(d == i and a <= n < a + size for d, a, size, *_ in gone)]
                assert (r[1] or "").split() == left and r[4] == len(r[1])
        else:
            want = {d: n for d, _, n, _ in hits(texts, [(0, documents(1)[1][0][1])])}
            assert {i for i in after if after[i] != by_id(before)[i]} == {i for i, n in want.items() if n}
            assert not any(n for _, _, n, _ in hits([(i, r[1]) for i, r in after.items()], [(0, documents(1)[1][0][1])]))
        if name in ("language_id", "near_duplicates"):
            assert all(after[i] == by_id(before)[i] for i in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_packed(docs.collect(), packed)


def check_packed(docs, packed):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(pieces) == {r.doc_id for r in docs}
    for r in docs:
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [2]
        for _, start, length, crc in pieces[r.doc_id]:
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])) == crc
        assert sum(p[2] for p in pieces[r.doc_id]) == len(ids)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r.doc_id for r in packed.collect()}
    assert ids and ids < {r[0] for r in documents(1)[0]}


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "doc_id long, text string, lang string, score string, kept int, __text string, class int"
    rows = [(1, "ab cd", None, "x", 1, "y", 2), (1, "ab cd", None, "x", 1, "y", 2), (None, "ef", None, None, None, None, None), (2, None, None, "", 0, "", 0)]
    for content in (rows, []):
        docs = spark.createDataFrame(content, extra)
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
            assert docs.columns == spark.createDataFrame([], extra).columns
        assert docs.count() == (3 if content else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
