from tracewell.llm import encoding, shingles, worker


def test_caches_of_other_operators_go_with_the_turn():
    shingles.grams([b"one", b"two"])
    worker.turn("shingles")
    assert b"one" in shingles.WORDS
    worker.turn("shingles")
    assert b"one" in shingles.WORDS
    encoding._PIECES["path", "n"] = object()
    worker.turn("encoding")
    assert not shingles.WORDS and encoding._PIECES
    before = shingles.grams([b"one", b"two"]).tolist()
    worker.turn("dedup")
    assert not encoding._PIECES and not shingles.WORDS
    assert shingles.grams([b"one", b"two"]).tolist() == before
