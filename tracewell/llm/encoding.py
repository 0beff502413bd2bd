"""Encoding texts with a public tokenizer file, word by word where that is proven to be the same.

A cut between a character that is not white space and an ASCII white-space character is *stable*
for a byte-level tokenizer: none of its pre-tokens spans such a place and none looks back, so the
ids on both sides do not depend on each other. A text cut at all its stable places can therefore
be encoded piece by piece, and the ids of frequent pieces kept.

Where the pre-tokens are those of the plain byte-level rule, a piece of nothing but known letters, ASCII digits,
ASCII marks and single line feeds is cut further, into its pre-tokens: the rule looks at nothing else there, and the
model never sees two pre-tokens together. So "word", "word." and "line.\\nword" share what is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .worker import keeps

#: Places where a text may be cut. White space here is what any Unicode version calls so.
STABLE = re.compile("(?<=[^\\s\u180e])(?=[ \\t-\\r])")
_BLANK = frozenset(re.findall("[\\s\\u180e]", "".join(map(chr, range(0x10000)))))  # none lies beyond
#: The same beyond ASCII, as the number that a character's bytes in UTF-8 make, by how many they are.
_WIDE = {n: [int.from_bytes(c.encode()) for c in _BLANK if len(c.encode()) == n] for n in (2, 3)}
#: Kinds of bytes. Those from OTHER on are in no piece that is cut into pre-tokens.
SPACE, LINE, LETTER, DIGIT, MARK, OTHER, BLANK = range(7)


def _kind(byte: int) -> int:
    """Bytes that follow in a character count as letters; the first tells whether it is one."""
    c = chr(byte)
    if byte >= 0x80:  # U+00C0 to U+027F and U+0400 to U+047F are letters, but for two signs of arithmetic
        return LETTER if byte < 0xC0 or 0xC3 <= byte <= 0xC9 or byte in (0xD0, 0xD1) else OTHER
    if c.isspace():
        return {" ": SPACE, "\n": LINE}.get(c, BLANK)
    if c.isalnum():
        return LETTER if c.isalpha() else DIGIT
    return MARK if c.isprintable() and c not in "'<" else OTHER  # contractions, and the special string


_KINDS = bytes(map(_kind, range(256)))


def load(path: str):
    """The library's own tokenizer for a file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Kept(dict):
    """Values by word; words asked for in vain are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> None:
        self.new.append(word)


class Pieces:
    """Values of pieces of texts (their token counts, or their ids), kept for up to ``most`` pieces.

    Pieces are a text's words with the space before them; a word that ends in white space has no
    value and sends its text down the slower path, which cuts at every stable place.
    ``values`` makes a list of values from ids and the places where pieces begin, and the last ends.
    """

    def __init__(self, path: str, values, most: int = 1_200_000):
        self.tokenizer, self.values, self.most = load(path), values, most
        self.kept = Kept()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # how byte-level files write a space

    def encode(self, texts: list[str]) -> list:
        if not texts:
            return []
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.values(x, (0, len(x)))[0] for x in found]

    def spaced(self, words: list[str], run: int = 1000) -> list:
        """Values of words with a space before each. Many are encoded as one text, whose cuts are all stable; as
        no word holds a space, exactly the tokens that begin with one begin a word."""
        out: list = []
        runs = [words[i : i + run] for i in range(0, len(words), run)]
        for at in range(0, len(runs), 16):
            part = runs[at : at + 16]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in part], add_special_tokens=False)
            for r, e in zip(part, found, strict=True):
                ids = e.ids
                starts = np.flatnonzero(self.opens[np.array(ids, np.intp)]).tolist()
                if len(starts) != len(r) or starts[0]:
                    out += self.encode([" " + w for w in r])
                else:
                    starts.append(len(ids))
                    out += self.values(ids, starts)
        return out

    def of(self, texts: list[str]) -> list[tuple[list, list[str]]]:
        """For each text the values of its pieces in order, and its words."""
        words = [t.split(" ") for t in texts]
        get, new = self.kept.__getitem__, self.kept.new
        drafts, stops = [], [0]
        for w in words:
            drafts.append(list(map(get, w[1:])))
            stops.append(len(new))
        asked = new[:]
        new.clear()
        fresh = dict.fromkeys(asked)
        todo = [w for w in fresh if w and w[-1] not in _BLANK]
        blank = len(todo) < len(fresh)
        found = dict(zip(todo, self.spaced(todo), strict=True))
        fresh.update(found)
        if len(self.kept) + len(found) <= self.most:  # words that end in white space are asked for again
            self.kept.update(found)
        out = []
        for k, (text, w, values, first) in enumerate(zip(texts, words, drafts, self.encode([w[0] for w in words]), strict=True)):
            missed = [fresh[x] for x in asked[stops[k] : stops[k + 1]]]
            if (blank and None in missed) or (len(w) > 1 and (not w[0] or w[0][-1] in _BLANK)):
                # a last word may end as it likes, but that is rare enough to share the slow path
                values = self.encode(STABLE.split(text))
            else:
                if missed:
                    rest = iter(missed)
                    values = [next(rest) if v is None else v for v in values]
                values.insert(0, first)
            out.append((values, w))
        return out


def cuts(data: np.ndarray, starts: np.ndarray, inner: bool) -> np.ndarray:
    """Where texts may be cut, as numbers of bytes: at their ``starts``, before a space at a stable place and, with
    ``inner``, between the pre-tokens of pieces that hold only what is known. ``data`` begins with a text."""
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    space = np.flatnonzero(kind == SPACE)
    before = kind[space - 1]
    stable = (before != SPACE) & (before != LINE) & (before != BLANK)
    wide = np.flatnonzero(data[space - 1] >= 0x80)
    at = space[wide]
    two = data[at - 2].astype(np.int64) << 8 | data[at - 1]
    stable[wide] = ~(np.isin(two, _WIDE[2]) | np.isin(data[at - 3].astype(np.int64) << 16 | two, _WIDE[3]))
    cut = np.zeros(len(data), bool)
    cut[space[stable]] = True
    cut[starts] = True
    if inner:
        hard = kind >= OTHER
        hard[space] |= ~cut[space]
        line = np.flatnonzero(kind == LINE)
        hard[line] |= kind[line - 1] <= LINE
        sign = np.flatnonzero(data[:-1] == 0xC3)
        hard[sign] |= (data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)
        pieces = np.flatnonzero(cut)
        easy = np.ones(len(pieces), bool)
        easy[np.searchsorted(pieces, np.flatnonzero(hard), "right") - 1] = False
        turns = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != SPACE) & (kind[:-1] != SPACE)) + 1
        cut[turns[easy[np.searchsorted(pieces, turns, "right") - 1]]] = True
    return np.flatnonzero(cut)


class Ids(Pieces):
    """Pieces' ids, and the ids of whole columns of texts, whose different pieces alone are looked at one by one.

    What is kept for columns is one array of ids and the place of each piece in it.
    """

    def __init__(self, path: str, code: str, most: int = 700_000):
        size = array(code).itemsize

        def values(ids: list[int], starts: Sequence[int]) -> list[bytes]:
            whole = array(code, ids).tobytes()
            return [whole[size * a : size * b] for a, b in zip(starts, starts[1:])]

        super().__init__(path, values, most)
        added, rule = self.tokenizer.get_added_tokens_decoder().values(), str(self.tokenizer.pre_tokenizer)
        #: Whether columns are cut at all; if not, nothing is kept for them.
        self.plain = self.tokenizer.normalizer is None and rule.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in rule
        self.plain &= not any(" " in t.content or t.lstrip or t.rstrip for t in added)
        #: Whether pieces are: a special string has a byte of no known kind.
        self.inner = self.plain and all(max(t.content.encode().translate(_KINDS), default=0) >= OTHER for t in added)
        self.places = Kept()
        self.flat, self.begins = np.zeros(1 << 16, f"<u{size}"), np.ones(1 << 12, np.int64)  # place 0 is the end's
        self.begins[0] = 0

    def _write(self, pieces: list[str]) -> None:
        """Ids of pieces behind those that are kept."""
        spaced = [p[0] == " " and p[-1] not in _BLANK and p.rfind(" ") == 0 for p in pieces]
        one = iter(self.spaced([p[1:] for p, s in zip(pieces, spaced, strict=True) if s]))
        two = iter(self.encode([p for p, s in zip(pieces, spaced, strict=True) if not s]))
        found = [next(one if s else two) for s in spaced]
        own = np.frombuffer(b"".join(found), self.flat.dtype)
        first = len(self.places) + 1
        begin, stop = int(self.begins[first]), first + len(pieces)
        if begin + len(own) > len(self.flat):
            self.flat = np.concatenate([self.flat[:begin], np.empty(begin + 2 * len(own), self.flat.dtype)])
        if stop >= len(self.begins):
            self.begins = np.concatenate([self.begins[: first + 1], np.empty(first + 2 * len(pieces), np.int64)])
        self.flat[begin : begin + len(own)] = own
        self.begins[first + 1 : stop + 1] = begin + np.cumsum([len(x) for x in found]) // self.flat.itemsize

    def joined(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, each with the id ``end`` behind it, and where texts end. Nulls are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return self.flat[:0], np.empty(0, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = offsets[:-1][np.diff(offsets) > 0]
        at = cuts(data, starts, self.inner) if self.plain and len(data) else starts
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        asked = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        places = list(map(self.places.__getitem__, asked))
        new, self.places.new = self.places.new, []
        first = len(self.places) + 1
        if new:
            self._write(new)
            rest = iter(range(first, first + len(new)))
            places = [next(rest) if p is None else p for p in places]
        self.flat[0] = end
        places = np.array([*places, 0], np.int64)
        ends = np.searchsorted(at, offsets[1:])  # how many pieces lie before
        codes = np.insert(pieces.indices.to_numpy(), ends, len(asked))
        begins = self.begins[places]
        sizes = (self.begins[places + 1] - begins)[codes]
        stops = np.cumsum(sizes)
        out = self.flat[np.repeat(begins[codes] - stops + sizes, sizes) + np.arange(stops[-1])]
        room = self.most - first + 1 if self.plain else 0
        self.places.update(zip(new[:room], range(first, first + len(new))))
        return out, stops[ends + np.arange(len(ends))]


_PIECES: dict[tuple, Pieces] = {}
keeps("encoding", _PIECES.clear)


def counts(path: str) -> Pieces:
    """Kept by worker process: a piece's number of tokens."""
    if (path, "n") not in _PIECES:
        _PIECES[path, "n"] = Pieces(path, lambda ids, starts: np.diff(starts).tolist())
    return _PIECES[path, "n"]


def ids(path: str, code: str = "I") -> Ids:
    """Kept by worker process: a piece's ids as little-endian unsigned numbers of 32 bits, or of 16 with the code H.

    Fewer than of counts, since each takes more.
    """
    if (path, code) not in _PIECES:
        _PIECES[path, code] = Ids(path, code)
    return _PIECES[path, code]
