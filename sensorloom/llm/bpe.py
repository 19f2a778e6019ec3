"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Every prefix of a byte string has exactly one encoding, and a token sequence is an
encoding exactly if each adjacent pair of tokens encodes to itself. So one token per
prefix (its last one) describes the encodings of all prefixes, and the next prefix is
solved from at most `lookahead` earlier ones, where `lookahead` is the length of the
longest token of the merge list. A token is emitted as soon as the encodings of all
prefixes that a later token can still start from agree on it. State held at any time:
the prefixes of that window, whatever the length of the text.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import regex

# The published pre-tokenisation pattern of the byte-level vocabularies.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Characters of a text that are parted at a time.
WINDOW = 1 << 16

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_SHORT_ENDS = np.frombuffer("stmd".encode("utf-32-le"), np.uint32)
_LONG_ENDS = {(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's own library sees it."""
    out = np.full(0x110000, _OTHER, np.uint8)
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    text = codes.tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[codes[m.start() : m.end()]] = kind
    return out


def piece_starts(text: str) -> np.ndarray:
    """Where the pieces of PIECE_PATTERN start in a text, and the text's end, found from character classes.

    Runs of one class are pieces. The last white space before a run is a piece of its own
    or, if it is a blank, the run's first character; white space before it is one piece. An
    apostrophe that starts a piece takes the letters of a contraction with it.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _classes()[codes]
    n = len(codes)
    start = np.ones(n + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:n])
    space = kinds == _SPACE
    ends = np.flatnonzero(space[:-1] & ~space[1:])  # last white space of each run that something follows
    start[ends] = True
    start[ends[codes[ends] == 32] + 1] = False
    for i in np.flatnonzero((codes == 39) & start[:n]):
        if i + 1 < n and codes[i + 1] in _SHORT_ENDS:
            start[i + 1], start[i + 2] = False, True
        elif i + 2 < n and (codes[i + 1], codes[i + 2]) in _LONG_ENDS:
            start[i + 1], start[i + 3] = False, True
    return np.flatnonzero(start)


def pieces(text: str, window: int = WINDOW) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Pieces of a text, window by window: (starts, pieces).

    Where a window ends, pieces that end at least two characters before it are settled, since
    the pattern looks one character ahead; the next window starts behind them. A window
    without a settled piece is doubled.
    """
    at, size = 0, window
    while at < len(text):
        stop = min(len(text), at + size)
        part = text if stop - at == len(text) else text[at:stop]
        cuts = piece_starts(part)
        if stop < len(text):
            cuts = cuts[cuts <= len(part) - 2]
            if len(cuts) < 2:
                size *= 2
                continue
        bounds = cuts.tolist()
        yield cuts[:-1] + at, [part[i:j] for i, j in zip(bounds, bounds[1:])]
        at, size = at + bounds[-1], window


class _Known(dict):
    """Packed ids of pieces met so far; others are solved on first use."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, piece: str) -> bytes:
        return self.solve(piece)


class MergeList:
    """Ranks of a byte-level BPE vocabulary with the tables the transducer needs."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 200_000, pair_cache_size: int = 1_000_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.tokens[r] = b
        #: Bytes of each token.
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        #: Bytes that may follow before the end of a token is settled.
        self.lookahead = max(map(len, ranks))
        #: Every end of a token, with its rank where it is a token itself, else -1.
        self._tails = {b[i:]: -1 for b in ranks for i in range(1, len(b))} | ranks
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pair_cache_size = pair_cache_size
        self._parts: dict[int, tuple[int, ...]] = {}
        self._cache: dict[str, bytes] = _Known(self.encode_piece)
        self._cache_size = cache_size

    @classmethod
    def from_bytes(cls, content: bytes, **kw) -> MergeList:
        rows = (line.split() for line in content.splitlines() if line.strip())
        return cls({base64.b64decode(a): int(b) for a, b in rows}, **kw)

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Encoding of a few bytes by repeatedly applying the lowest-ranked merge; `below`: only merges ranked lower."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, ...]:
        """The two tokens that a token is merged from; itself for one byte, and all of them for one that no merges reach."""
        got = self._parts.get(token)
        if got is None:
            data = self.tokens[token]
            got = self._parts[token] = (token,) if len(data) == 1 else tuple(self.merge(data, token))
        return got

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` may stand after `left` (-1: at the start) in an encoding.

        Each token must be reached by merges. Then the merges of both are undone, latest first;
        a merge over the border that ranks before the one just undone would have come first.
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self._pair_cache_size:
                self._pairs.clear()
            known = self._pairs[key] = len(self.parts(right)) <= 2 and (left < 0 or self._stay_apart(left, right))
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        get, tokens, parts = self.ranks.get, self.tokens, self.parts
        limit = len(tokens)
        while True:
            x = get(tokens[a] + tokens[b])
            if x is not None and x < limit:
                return False
            if len(tokens[a]) == len(tokens[b]) == 1:
                return True
            if len(tokens[b]) == 1 or (len(tokens[a]) > 1 and a > b):
                limit, a = a, parts(a)[-1]
            else:
                limit, b = b + 1, parts(b)[0]  # of equal merges the left one comes first

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as 32-bit numbers and remembered for short ones (the memory is bounded)."""
        ids = self._cache.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None and self.follows(-1, whole):
                ids = array("i", (whole,)).tobytes()
            else:
                t = Transducer(self)
                ids = array("i", t.feed(data)).tobytes() + array("i", t.finish()).tobytes()
            if len(data) <= self.lookahead:
                if len(self._cache) >= self._cache_size:
                    self._cache.clear()
                self._cache[piece] = ids
        return ids

    def encode_stream(self, text: str) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(starts, packed ids) of the pieces of a text, window by window."""
        find = self._cache.__getitem__
        for starts, found in pieces(text):
            yield starts, list(map(find, found))

    def encode(self, text: str | None) -> array:
        """All ids of a text; empty for an empty or null text."""
        out = array("i")
        for _, ids in self.encode_stream(text or ""):
            out.frombytes(b"".join(ids))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids; a character split over tokens is held until it is whole."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            part = state.decode(self.tokens[i])
            if part:
                yield part
        part = state.decode(b"", final=True)
        if part:
            yield part


class Transducer:
    """Consumes bytes, emits token ids once no later byte can change them."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self._bytes = bytearray()  # bytes after the last settled position
        self._last = [-1]  # last token of the encoding of each open prefix
        self._from = [0]  # where that token starts, counted from the settled position
        self.widest = 0  # largest number of open prefixes so far

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 2 * self.m.lookahead
        for at in range(0, len(data), step):
            self._extend(data[at : at + step])
            out += self._settle()
        return out

    def finish(self) -> list[int]:
        out = self._path(0, len(self._bytes))
        self._bytes.clear()
        self._last, self._from = [-1], [0]
        return out

    def _extend(self, data: bytes) -> None:
        last, start = self._last, self._from
        tails, pairs, follows, longest = self.m._tails, self.m._pairs, self.m.follows, self.m.lookahead
        done = len(self._bytes)
        self._bytes += data
        buf = bytes(self._bytes)
        for i in range(done + 1, len(buf) + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                r = tails.get(buf[j:i])
                if r is None:
                    raise ValueError("the vocabulary cannot spell these bytes")
                if r >= 0:
                    before = last[j]
                    ok = pairs.get((before, r))
                    if ok or (ok is None and follows(before, r)):
                        last.append(r)
                        start.append(j)
                        break
            else:
                raise ValueError("the vocabulary cannot spell these bytes")
        self.widest = max(self.widest, len(buf))

    def _settle(self) -> list[int]:
        n = len(self._bytes)
        open_ = set(range(max(0, n - self.m.lookahead + 1), n + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.discard(top)
            open_.add(self._from[top])
        (p,) = open_
        if not p:
            return []
        out = self._path(0, p)
        del self._bytes[:p]
        self._last = [self._last[p], *self._last[p + 1 :]]
        self._from = [0, *(max(0, s - p) for s in self._from[p + 1 :])]
        return out

    def _path(self, lo: int, hi: int) -> list[int]:
        out = []
        while hi > lo:
            out.append(self._last[hi])
            hi = self._from[hi]
        return out[::-1]
