import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import weft.llm.tokens as tokens  # noqa: E402
from weft.llm.tokens import Decoder, Encoder, Merges, PieceTransducer, decode_corpus, encode_corpus, read_ranks  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
MERGES = Merges(RANKS)


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["Hello world", "don't we'll 'S it's", "  two  blanks \n\n\tx ", "naïve café — “quoted”…", "東の斜面 👩‍🔧👍🏽", "<|endoftext|> as text", "1234567 89", "\x00\x07\x1c\x85\xa0​", "a" * 700, " " * 300 + "x", "\r\n\r\n", "=" * 400 + "-" * 300, "é" * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_public_tokenizer(public, text):
    assert Encoder(MERGES).encode(text) == public(text)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_slices_change_nothing(public, text, size):
    e, out = Encoder(MERGES), []
    for i in range(0, len(text), size):
        out += e.feed(text[i : i + size])
    assert out + e.finish() == public(text)


def test_random_texts(public):
    rnd, e = random.Random(1), Encoder(MERGES)
    letters = "  \n\tabcdeABCstlr'0123.,-—éñ東🙂́_{}<|>"
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 3, 30, 200])))
        assert e.encode(text) == public(text)


def test_long_runs_in_small_slices(public, monkeypatch):
    monkeypatch.setattr(tokens, "_SLICE", 64)
    for text in ("a" * 3000, " " * 2000 + "x", "ab" * 1500 + "'ll" + "c" * 300, "=-" * 900 + " " + "z" * 500 + "  q", "12345" * 300, "\n" * 999):
        assert Encoder(MERGES).encode(text) == public(text)


def test_memory_stays_bounded():
    t, most = PieceTransducer(MERGES), 0
    for _ in range(300):
        list(t.feed(b"abcd" * 64))
        most = max(most, len(t.window))
    assert most < 20 * MERGES.lookahead


def test_decoding_piece_by_piece():
    text = "東の 👩‍🔧 naïve"
    ids, d = Encoder(MERGES).encode(text), Decoder(RANKS)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == text


def test_corpus(spark, public):
    rows = [(1, "Hello", "clash"), (2, "", None), (3, None, None), (3, None, None), (4, "x" * 600_000 + " y", None), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, PATH).collect()), key=str)
    assert got == sorted(((a, public(b) if b else []) for a, b, _ in rows), key=str)
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df, PATH), PATH).collect()}
    assert back == {1: "Hello", 2: "", 3: "", 4: rows[4][1], None: "a"}


def test_empty_corpus(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
