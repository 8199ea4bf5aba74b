import random

import public_tokenizers
import pytest

from gridloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tool():
    return bpe.codec(PATH)


def library(tool, text):
    return tool.library.encode(text, add_special_tokens=False).ids


ALPHABETS = ["abcdeé'st ", "a'slltvre ", "!?'s.a1 \n\t", "ab12", "  \n\xa0\x85 a", "éèüß€漢字😀ab ", "\x1c\x1f\x85 a'", "aaaab"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_memo_equals_library(tool, alphabet):
    rnd = random.Random(alphabet)
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert tool.encode(text).tolist() == library(tool, text), repr(text)


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("size", [3, 7, 20])
def test_tree_concatenation_is_exact(tool, alphabet, size):
    rnd = random.Random(f"{alphabet}{size}")
    for _ in range(150):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200)))
        found = bpe.leaves(text, tool.specials, size)
        assert "".join(t for t, _ in found) == text
        ids = bpe.concatenate([tool.encode(t) for t, _ in found], [c for _, c in found], tool, window=4)
        assert ids == library(tool, text), repr(text)


def test_every_latin_character(tool):
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f" {c} {c}", f"{c}{c}1'{c}s", f"  {c}"):
            assert tool.encode(text).tolist() == library(tool, text), repr(text)


def test_special_strings_are_never_cut(tool):
    text = "ab" * 30 + "<|endoftext|>" * 9 + "cd" * 30 + " <|endoftext|> x" * 5
    for size in (2, 5, 11):
        found = bpe.leaves(text, tool.specials, size)
        ids = bpe.concatenate([tool.encode(t) for t, _ in found], [c for _, c in found], tool, window=4)
        assert ids == library(tool, text)


def test_documents(spark, tool):
    texts = ["", None, "Hello  world\n", "x" * 70000, "word " * 20000, "é'" * 40000, "same", "same", "漢字" * 20000]
    docs = spark.createDataFrame([(i, t, "e", "f", "g", "h") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string, `a.b c` string, _row string")
    coded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert coded.columns == ["doc_id", "a.b c", "_row", "ids", "decoded"]
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert all(r["a.b c"] == "g" and r["_row"] == "h" for r in rows.values())
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library(tool, t or "")
        assert rows[i]["decoded"] == (t or "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(docs, PATH).collect() == []


def test_decode_of_broken_characters(tool):
    ids = library(tool, "漢字😀")[:-1]
    assert tool.decode(ids) == tool.library.decode(ids, skip_special_tokens=False)
