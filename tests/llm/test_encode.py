import pytest

from tilewright.llm import encode

ODD = [
    None, "", " ", "\n\n \t", "Hello  world", " lead and trail ", "a b  c", "don't we'll I'M", "<|endoftext|> is text", "x\x1fy z\x1f w",
    "tab\tnew\nline\r\n end", "naïve café 本要旨", "👩‍⚖️ ½ № ﬁ", "é ─ ​﻿", "1,234.56 (7)", "a   b", "\x1c \x1d", "word " * 3000, "é" * 5000, "end　",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")


def whole(text):
    t = encode._load(f"{encode.TOKENIZER_DIR}/{encode.BYTE_BPE_50K}")
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_on_whole_texts(texts):
    got = {r.doc_id: r.ids for r in encode.encode(texts, ["doc_id"]).collect()}
    assert got == {i: whole(t) for i, t in enumerate(ODD)}
    assert got[0] == got[1] == []


def test_corpus_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in encode.encode(docs, ["doc_id", "text"]).collect():
        assert r.ids == whole(r.text)


def test_cache_bound_changes_nothing(texts, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encode, "CACHE_PIECES", 3)
    path = f"{encode.TOKENIZER_DIR}/{encode.BYTE_BPE_50K}"
    for part in (ODD, ODD[:5], ODD[5:]):
        flat, offsets = encode.encode_array(pa.array(part, pa.string()), path)
        assert [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(part))] == [whole(t) for t in part]


def test_counts_and_round_trip(texts):
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(texts, ["doc_id"]).collect()}
    assert counts == {i: len(whole(t)) for i, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(texts, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_offsets(texts):
    for r in encode.encode_with_offsets(texts, ["doc_id", "text"]).collect():
        assert r.ids == whole(r.text)
        assert all(0 <= s <= e <= len(r.text or "") for s, e in zip(r.starts, r.ends))
        if r.ids:
            assert r.ends[-1] == len(r.text)


def test_split_characters_and_null_ids(spark):
    ids = whole("本")
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in encode.decode(df, ["doc_id"]).collect()}
    assert got[1] == "本" and "�" in got[2] and got[3] is None and got[4] == ""


def test_another_tokenizer_is_encoded_whole(spark):
    df = spark.createDataFrame([(1, "Hello  World"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode.encode(df, ["doc_id"], tokenizer="word_bpe_49k.json").collect()}
    t = encode._load(f"{encode.TOKENIZER_DIR}/word_bpe_49k.json")
    assert got == {1: t.encode("Hello  World", add_special_tokens=False).ids, 2: []}


def test_empty_table(texts):
    assert encode.encode(texts.limit(0), ["doc_id"]).count() == 0


def test_negative_ids_are_an_error(spark):
    from pyspark.errors import PythonException

    from tilewright.llm.encode import decode

    with pytest.raises(PythonException):
        decode(spark.createDataFrame([(1, [-1])], "doc_id long, ids array<int>"), ["doc_id"]).collect()
