"""Cutting oversized texts at natural boundaries, with overlap (problem 8)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.bpe import DEFAULT_VOCABULARY, MergeList, piece_starts
from sensorloom.llm.tokenize import merges_of, share_vocabulary

LEVELS = ("paragraph", "line", "sentence", "word")
_SENTENCE_ENDS = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[」』”]*")
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])  # the last entry stands for all later ones
_ENDS_CLAUSE = "，、；："
_EDGE = 256  # characters looked at to find back to the text's own pieces


@dataclass(frozen=True)
class Piece:
    start: int  # characters
    end: int
    tokens: int
    cut: str  # kind of the boundary at its end; "end" for the last piece


def _boundaries(text: str) -> list[np.ndarray]:
    """For each level, and each position of the text and its end, whether a boundary is there.

    A line ends behind its line break, a paragraph behind the last of several line breaks with
    nothing but white space between them, a word where white space starts or ends or a clause
    has ended.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    space = _IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)]
    feed, back = codes == 10, codes == 13
    line, paragraph, sentence, word = (np.zeros(n + 1, bool) for _ in range(4))
    line[1:] = feed | back
    line[1:n] &= ~(back[:-1] & feed[1:])  # a pair is one break
    breaks = np.flatnonzero(line)
    if len(breaks) > 1:
        black = np.concatenate([[0], np.cumsum(~space)])
        joined = black[breaks[1:]] == black[breaks[:-1]]  # nothing but white space since the break before
        paragraph[breaks[1:][joined & ~np.append(joined[1:], False)]] = True
    for m in _SENTENCE_ENDS.finditer(text):
        sentence[m.end()] = True
    word[1:n] = space[1:] != space[:-1]
    if not text.isascii():
        for c in _ENDS_CLAUSE:
            word[1:] |= codes == ord(c)
    return [paragraph, line, sentence, word]


class _Offsets:
    """Prefix sums of token lengths, and the token positions that are natural boundaries."""

    def __init__(self, text: str, merges: MergeList):
        self.text, self.merges = text, merges
        starts, packed = [], []
        for at, ids in merges.encode_stream(text):
            starts.append(at)
            packed += ids
        ids = np.frombuffer(b"".join(packed), np.int32)
        self.n = len(ids)
        #: Where the text's own pieces start, its end, and the tokens before each.
        self.starts = np.concatenate([*starts, [len(text)]])
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4, out=self.before[1:])
        if self.n:
            byte = np.zeros(self.n + 1, np.int64)
            np.cumsum(merges.lengths[ids], out=byte[1:])
            data = np.frombuffer(text.encode(), np.uint8)
            head = (data & 0xC0) != 0x80  # first bytes of characters
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum(head, out=chars[1:])
            self.char = chars[byte]
            self.whole = np.append(head[byte[:-1]], True)  # token boundaries that do not split a character

    def find_boundaries(self) -> None:
        self.hard = np.flatnonzero(self.whole)
        at = self.char[self.hard]
        levels = _boundaries(self.text)
        self.levels = [self.hard[level[at]] for level in levels]
        self.any = self.hard[np.logical_or.reduce(levels)[at]]

    def count(self, lo: int, hi: int) -> int:
        """Tokens of text[lo:hi] by itself: the text's own counts, and the edges encoded again.

        From a piece's start on, the same pieces follow whatever stands before, and they stay the
        same up to two characters before the end.
        """
        starts, before, encode = self.starts, self.before, self.merges.encode
        first, head = int(np.searchsorted(starts, lo)), 0
        if starts[first] != lo:
            size = _EDGE
            while True:
                stop = min(hi, lo + size)
                ends = piece_starts(self.text[lo:stop])[1:] + lo
                ends = ends[ends <= stop - 2]
                meet = ends[starts[np.searchsorted(starts, ends)] == ends]
                if len(meet):
                    first = int(np.searchsorted(starts, meet[0]))
                    head = len(encode(self.text[lo : int(meet[0])]))
                    break
                if stop == hi:
                    return len(encode(self.text[lo:hi]))
                size *= 2
        last = int(np.searchsorted(starts, hi - 2, "right")) - 1
        if last < first:
            return head + len(encode(self.text[int(starts[first]) : hi]))
        return head + int(before[last] - before[first]) + len(encode(self.text[int(starts[last]) : hi]))


def cut(text: str, merges: MergeList, limit: int = 1024, overlap: int = 64) -> list[Piece]:
    """Pieces of at most `limit` tokens each; the whole text as one piece if it is not longer.

    From each start, the last boundary under the limit is found by binary search: of the best
    level that has one in the second half of the allowed tokens, else of any level in the
    first half, behind the piece before; where there is none at all, the text is cut at the
    last token that ends with a whole character. The next piece starts at the first natural
    boundary (else token) at most `overlap` tokens back. A piece's own encoding may differ
    from its share of the text's at the edges, so these are counted again and it is cut
    shorter if need be.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    o = _Offsets(text, merges)
    if o.n <= limit:
        return [Piece(0, len(text), o.n, "end")]
    o.find_boundaries()
    pieces: list[Piece] = []
    start, done, room = 0, 0, limit
    while True:
        if o.n - start <= room:
            end, kind = o.n, "end"
        else:
            end, kind = -1, "hard"
            for level, where in zip(LEVELS, o.levels):
                k = bisect_right(where, start + room) - 1
                if k >= 0 and where[k] > max(done, start + room // 2):
                    end, kind = int(where[k]), level
                    break
            if end < 0:
                k = bisect_right(o.any, start + room) - 1
                if k >= 0 and o.any[k] > max(done, start):
                    end = int(o.any[k])
                    kind = next(level for level, where in zip(LEVELS, o.levels) if _holds(where, end))
            if end < 0:
                end = int(o.hard[bisect_right(o.hard, start + room) - 1])
        lo, hi = int(o.char[start]), int(o.char[end])
        own = o.count(lo, hi)
        if own > limit:
            room = min(room, end - start) - (own - limit)
            continue
        pieces.append(Piece(lo, hi, own, kind))
        if end == o.n:
            return pieces
        back = end
        if overlap:
            k = bisect_left(o.any, end - overlap)
            back = int(o.any[k]) if k < len(o.any) and o.any[k] < end else int(o.hard[bisect_left(o.hard, end - overlap)])
            if back <= start:
                back = end
        start, done, room = back, end, limit


def _holds(where: np.ndarray, at: int) -> bool:
    k = bisect_left(where, at)
    return k < len(where) and where[k] == at


def split_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, overlap: int = 64,
    vocabulary: str = DEFAULT_VOCABULARY, with_text: bool = True,
) -> DataFrame:
    """Rows (id, piece, start, end, n_tokens, cut[, piece_text]) of every text above the limit.

    start and end count characters; piece counts from 0. Texts within the limit, empty
    and null ones give no rows; a null id stays null; repeated rows are cut each; an
    empty table gives none; further columns are dropped. A text of at most `limit`
    bytes has at most `limit` tokens, so Spark skips it before Python sees it. No shuffle.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary)
    fields = [(id_col, df.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("n_tokens", T.IntegerType()), ("cut", T.StringType())]
    fields += [("piece_text", T.StringType())] * with_text
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(shared)
        for b in batches:
            for i, cell in enumerate(b.column(1)):
                text = cell.as_py()
                pieces = cut(text, m, limit, overlap)
                if len(pieces) < 2:
                    continue
                rows = [(k, p.start, p.end, p.tokens, p.cut, text[p.start : p.end]) for k, p in enumerate(pieces)]
                ids = b.column(0).take(pa.array([i] * len(rows)))
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([ids, *cols][: len(fields)], names=[n for n, _ in fields])

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col), text.alias(text_col)).where(F.octet_length(text_col) > limit).mapInArrow(run, out)
