"""The inner loops of packing: the tokenizer's kept pieces, and an index that gets narrower."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracewell.llm import encoding, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "one", "one two  three", "two\n three\n", "a᠎ b", " x y", "x  y one", " lead one", "one two", "<|endoftext|> one", "der.\nEin é \U0001f600 \x1c z", "late two ", "12 34's"]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_pieces_are_the_librarys(most):
    """Whatever is kept; words that end in white space are never, so they need no mark for later texts."""
    pieces, plain = encoding.Pieces(PATH, lambda ids, starts: [tuple(ids[a:b]) for a, b in zip(starts, starts[1:])], most), encoding.load(PATH)
    for texts in (TEXTS, TEXTS[::-1], [], ["one"] * 3):
        found = [[i for value in values for i in value] for values, _ in pieces.of(texts)]
        assert found == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(pieces.kept) <= most and None not in pieces.kept.values()


def test_ids_and_counts():
    encoding._PIECES.clear()
    plain = [e.ids for e in encoding.load(PATH).encode_batch(TEXTS, add_special_tokens=False)]
    for code, kind in (("H", "<u2"), ("I", "<u4")):
        assert [np.frombuffer(b"".join(v), kind).tolist() for v, _ in encoding.ids(PATH, code).of(TEXTS)] == plain
    assert [sum(v) for v, _ in encoding.counts(PATH).of(TEXTS)] == [len(x) for x in plain]
    encoding._PIECES.clear()


def odd_texts(n=1500):
    """Runs of characters that the pre-tokenizer treats in different ways, some in words that repeat."""
    rng = random.Random(8)
    some = [*"ab \n.,;!-'<|_ \t\r\x1c7", " ", " ", "\n", "\n\n", "  ", "'s", "'ll ", "Wort ", "wörd. ", ".\nĖta, ", "é", "×", "÷ ", "\xa0", "\x85 ", "\u1680", "\u2009 ", "\u3000", "\u180e ", "ж ", "з7", "語 ", "\u0301", "²", "\U0001f600 ", "<|endoftext|>", "\x00"]
    return TEXTS + ["".join(rng.choices(some, k=rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize(("file", "most"), [("byte_bpe_50k.json", 0), ("byte_bpe_50k.json", 40), ("byte_bpe_50k.json", 10**6), ("word_bpe_49k.json", 10**6)])
def test_columns_are_the_librarys(file, most):
    """Ids of whole columns, with pieces cut into pre-tokens where that is known to be the same, whatever is kept."""
    path = public_tokenizers.path(file)
    own, plain, texts = encoding.Ids(path, "H", most), encoding.load(path), odd_texts()
    expected = [[*e.ids, 1] for e in plain.encode_batch(texts, add_special_tokens=False)]
    column = pa.array([None, *texts, None], pa.string())
    for first, size in ((1, len(texts)), (1, 9), (5, 700), (300, 0), (14, 100)):
        ids, stops = own.joined(column.slice(first, size), 1)
        assert [x.tolist() for x in np.split(ids, stops)[:-1]] == expected[first - 1 : first - 1 + size] and len(stops) == size
    assert own.joined(pa.array([None, ""], pa.large_string()), 7)[0].tolist() == [7, 7]
    assert len(own.places) <= most and not own.places.new


def test_words_share_what_is_kept():
    """A word before a mark or a line is the word; only what is new goes to the library, and once."""
    own = encoding.Ids(PATH, "H")
    own.joined(pa.array(["Thanor one", "The one."]), 1)
    assert set(own.places) == {"Thanor", " one", "The", "."}
    own.joined(pa.array(["The one one. one.\nThe one", "Thanor."]), 1)
    assert set(own.places) == {"Thanor", " one", "The", ".", "\n"}


def test_parts_of_a_batch():
    """Slices of bounded bytes hold every row, in order; a long text has one for itself or ends one."""
    texts = ["x" * 50, None, "", "y" * 500, "z", "é" * 40, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    for size in (1, 60, 10**6):
        found = list(packing.parts(batch, size))
        assert [x for p in found for x in p.column(1).to_pylist()] == texts
        assert all(sum(len((x or "").encode()) for x in p.column(1).to_pylist()[:-1]) < size for p in found)
    assert len(found) == 1 and not list(packing.parts(batch.slice(0, 0)))


def index(rng):
    terms = [rng.integers(0, 300, rng.integers(1, 90)) for _ in range(200)]
    seen = np.bincount(np.concatenate([np.unique(t) for t in terms]), minlength=300)
    return terms, lambda: packing.Index(terms, seen, 200, 45.0)


def test_narrow_index():
    rng = np.random.default_rng(4)
    terms, make = index(rng)
    whole, narrow = make(), make()
    keep = np.ones(200, bool)
    for _ in range(4):
        keep &= rng.random(200) < 0.5
        narrow.narrow(keep)
        for seed in range(200):
            assert (narrow.scores(seed) == np.where(keep, whole.scores(seed), 0)).all()
    assert len(narrow.doc) < len(whole.doc) / 4


def test_same_windows_with_a_narrow_index(monkeypatch):
    """Postings of used documents are dropped on the way, and the sequences are those of the whole index."""
    terms, make = index(np.random.default_rng(6))
    lengths, same = np.array([len(t) for t in terms]), np.arange(200) // 2
    own = make()
    found = packing.order_and_cut(lengths, own, same, window=64)
    assert len(own.doc) < len(make().doc)
    monkeypatch.setattr(packing.Index, "narrow", lambda self, docs: None)
    assert found == packing.order_and_cut(lengths, make(), same, window=64)
