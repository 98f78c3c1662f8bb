import random

import pytest
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.ChunkCodec(PATH), Tokenizer.from_file(PATH)


def agree(both, text):
    codec, library = both
    ids = codec.encode(text.encode())
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:80]
    assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False) == text


PIECES = ["a", "Word", " the", "'s", "'ll", " 12", "3.14", "  ", "\n", "\n\n ", "\t", "é", "日本語", "🚀", "\x1c", "\x85", " ", "　", "​", "<|endoftext|>", "<|", "!?", " ...", "_", "it's,", "a" * 40]


def test_edges(both):
    for text in ["", " ", "   ", "\n", "a", " a ", "<|endoftext|>", "x <|endoftext|>  y", "x" * 9000, " " * 9000, "a b" * 4000, "é" * 5000, "ab\x1ccd " * 500]:
        agree(both, text)


def test_long_mixed_texts(both):
    rng = random.Random(5)
    for n in (10, 100, 1000, 5000):
        for _ in range(12):
            agree(both, "".join(rng.choice(PIECES) for _ in range(n)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=300).map("".join))
def test_any_text(text):
    codec = bpe.codec_of(PATH)
    assert codec.decode(codec.encode(text.encode())).decode() == text
    assert codec.encode(text.encode()) == codec.tokenizer.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(both):
    codec = bpe.ChunkCodec(PATH)
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(4000))
    first = codec.encode(text.encode())
    once = codec.encoded_chunks
    assert codec.encode(text.encode()) == first
    assert codec.encoded_chunks == once > 5


def test_documents(spark):
    rows = [(1, "Hello  world\n"), (2, None), (None, ""), (1, "Hello  world\n"), (3, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as ids_sha256")
    got = bpe.encode_documents(docs, PATH, texts=True).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert {r.decoded_sha256 for r in got if r.doc_id == 2} == {sha("")}
    assert [r.ids for r in got if r.doc_id == 3] == [[50256]]
    assert bpe.encode_documents(docs.limit(0), PATH).collect() == []


def test_memory_keeps_what_is_in_use():
    rng = random.Random(5)
    words = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(600)).encode()
    shared, others = words(), [words() for _ in range(12)]
    codec = bpe.ChunkCodec(PATH, chunk_memory=40)
    want = bpe.ChunkCodec(PATH).encode(shared)
    codec.encode(shared)
    for other in others:
        codec.encode(other)
        before = codec.encoded_chunks
        assert codec.encode(shared) == want and codec.encoded_chunks == before  # met again, not encoded again
        assert len(codec.chunks) <= 40
    assert codec.encoded_chunks > 40
