"""Ids by pieces equal ids of whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordersight.llm import bpe
from ordersight.llm.bpe import PieceEncoder

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's 's x", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b",
       "é à ü", "naïve café x", "　 a", "a\u0085 b", "1 23 456,7", "😀 😀x 😀", "word " * 50, "$$$ ||| a|b", "\t\t x\r\n y"]


@pytest.fixture(scope="module")
def both():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return PieceEncoder(path), tokenizers.Tokenizer.from_file(path)


def check(both, texts):
    ids, sizes = both[0].encode(texts)
    want = [both[1].encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(map(int, x)) for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_odd_texts(both):
    check(both, ODD)
    check(both, ODD[::-1])  # all pieces are known now


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1'.,|\n\t é \u0085 <>😀", max_size=30), min_size=1, max_size=6))
def test_any_text(both, texts):
    check(both, texts)


def test_full_stores(both, monkeypatch):
    """Stores that forget after nearly every batch, and words with a line break that stand twice in a text."""
    monkeypatch.setattr(bpe, "CACHED_PIECES", 40)
    small = (PieceEncoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")), both[1])
    rng = np.random.default_rng(2)
    for _ in range(12):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["a!\nB", "x\n y", "one", "two,", "z.\n\nQ"], 30), rng.integers(0, 12, 30))]
        check(small, ["say a!\nB and a!\nB again a!\nB end", " ".join(words), " ".join(words[::-1]), *ODD[:6]])
    assert len(small[0].spaced.sizes) <= 60 and len(small[0].other.sizes) <= 40


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aSstremvld'1., \n\t\réÀ<|>", max_size=40), min_size=1, max_size=6))
def test_plain_texts(both, texts):
    check(both, texts)


def test_cuts_of_many_texts(both, monkeypatch):
    """Texts that are cut apart from each other, among texts that are not plain."""
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 20)
    rng = np.random.default_rng(3)
    words = ["it's", " 'tis", "we'LL", "'re", "été", "a\n\n b", "x  ", "12", "--", "😀", "", "\n"]
    check(both, [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(300)])


def test_known_words_with_other_marks(both):
    """A word that was met goes to the tokenizer no second time for the marks and line breaks around it."""
    encoder = PieceEncoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    sent, tokenizer = [], encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(w for t in texts for w in t.split())
            return tokenizer.encode_batch_fast(texts, **kw)
    encoder.tokenizer = Counted()
    check((encoder, both[1]), ["Say hello there, hello", "Say, say\nSay. there\nhello! hello,"])
    assert sent.count("hello") <= 2 and sum("hello" in w for w in sent) == sent.count("hello")
