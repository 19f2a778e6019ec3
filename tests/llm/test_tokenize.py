import random

import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm.bpe import DEFAULT_VOCABULARY, PIECE_PATTERN, MergeList, Transducer
from sensorloom.llm.bpe import pieces as split_pieces
from sensorloom.llm.split import _Offsets, cut, split_corpus
from sensorloom.llm.tokenize import decode_corpus, encode_corpus, roundtrip_report

tiktoken = pytest.importorskip("tiktoken")
PATTERN = regex.compile(PIECE_PATTERN)


@pytest.fixture(scope="module")
def merges():
    return MergeList.from_bytes(open(DEFAULT_VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def reference(merges):
    return tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    m = _shared()
    assert list(m[0].encode(text)) == m[1].encode_ordinary(text)
    assert "".join(m[0].decode(m[0].encode(text))) == text


_CACHE = []


def _shared():
    if not _CACHE:
        m = MergeList.from_bytes(open(DEFAULT_VOCABULARY, "rb").read())
        _CACHE.extend([m, tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=m.ranks, special_tokens={})])
    return _CACHE


@pytest.mark.parametrize("text", ["a" * 9000, "0123456789" * 900, "=-" * 3000, " " * 3000, "漢字🙂" * 900, "<|endoftext|>" * 50, "\r\n\t " * 500, "ab" * 70_000])
def test_long_and_odd_texts(merges, reference, text):
    assert list(merges.encode(text)) == reference.encode_ordinary(text)


def test_state_stays_bounded(merges, reference):
    for unit in ("x", "ab", "9f3e", "é"):
        data = (unit * 20_000).encode()[:40_000]
        t = Transducer(merges)
        out = []
        for at in range(0, len(data), 97):  # whatever the sizes it is fed in
            out += t.feed(data[at : at + 97])
        out += t.finish()
        assert b"".join(merges.tokens[i] for i in out) == data
        assert t.widest <= 4 * merges.lookahead


def test_small_caches_give_the_same(merges):
    small = MergeList(merges.ranks, cache_size=3, pair_cache_size=5)
    rnd = random.Random(0)
    for _ in range(20):
        s = "".join(rnd.choice("abc 12\n-é") for _ in range(200))
        assert small.encode(s) == merges.encode(s)


def test_corpus(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "id is null", "x"), (1, "Hello world", "x"), (5, "\x00​" + "é" * 3000, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a column with the result's name
    got = encode_corpus(d)
    assert got.columns == ["doc_id", "ids"] and got.count() == 6
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[2] == [] and by[3] == [] and by[1] == [15496, 995] and by[None]
    back = {r.doc_id: r.text for r in decode_corpus(got).collect()}
    assert back[5] == rows[5][1] and back[2] == back[3] == ""
    report = roundtrip_report(d)
    assert all(r.same for r in report.collect())
    assert encode_corpus(d.where("false")).count() == 0


def _check(text, pieces, merges, limit, overlap):
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert len(merges.encode(text[p.start : p.end])) == p.tokens <= limit
    rebuilt, at = "", 0
    for p in pieces:
        assert p.start <= at
        rebuilt += text[at : p.end]
        at = p.end
    assert rebuilt == text
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end < b.end
        assert len(merges.encode(text[b.start : a.end])) <= overlap + 2


@pytest.mark.parametrize("unit", ["word ", "Ein Satz. ", "line\n", "para one.\n\nmore ", "x", "漢字。", "🙂", "9f3e", "  \n ", "a,b;"])
def test_pieces(merges, unit):
    for limit, overlap in ((32, 8), (64, 0), (128, 20)):
        text = unit * (4 * limit)
        _check(text, cut(text, merges, limit, overlap), merges, limit, overlap)


def test_natural_boundaries_first(merges):
    text = "one two three. " * 5 + "\n\n" + "four five six. " * 5
    pieces = cut(text, merges, 32, 4)
    assert pieces[0].cut == "paragraph" or pieces[0].cut == "sentence"
    assert cut("short", merges, 32, 4)[0].cut == "end"
    with pytest.raises(ValueError):
        cut("x", merges, 32, 16)


def test_a_boundary_in_the_first_half_comes_before_a_hard_cut(merges):
    text = "One paragraph here.\n\nAnd a second one.\n\n" + "x7" * 400
    pieces = cut(text, merges, 128, 8)
    assert pieces[0].cut == "paragraph" and text[: pieces[0].end].endswith("one.\n\n")
    assert all(p.cut == "hard" for p in pieces[1:-1]) and len(pieces) > 2
    _check(text, pieces, merges, 128, 8)


def test_pieces_of_odd_texts(merges, reference):
    rnd = random.Random(2)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\r\n", "\t", "é", "漢", "1", "²", "-", "_", "\x1c", "\x85", "Ⅷ", "a", "word", "end. ", "。", "🙂"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        for window in (3, 1 << 16):  # whatever the window
            assert [p for _, ps in split_pieces(text, window) for p in ps] == [m.group() for m in PATTERN.finditer(text)]
        o = _Offsets(text, merges)
        i, j = sorted((rnd.randrange(len(text) + 1), rnd.randrange(len(text) + 1)))
        assert o.count(i, j) == len(reference.encode_ordinary(text[i:j]))


def test_pairs_by_merges(merges):
    rnd = random.Random(3)
    n = len(merges.tokens)
    for top in (600, 5000, n):
        for _ in range(4000):
            a, b = rnd.randrange(top), rnd.randrange(top)
            assert merges.follows(a, b) == (merges.merge(merges.tokens[a] + merges.tokens[b]) == [a, b])


def test_all_documents_are_cut_within_the_limit(merges, reference):
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        pieces = cut(text or "", merges)
        n = len(reference.encode_ordinary(text or ""))
        assert (len(pieces) > 1) == (n > 1024)
        if len(pieces) > 1:
            _check(text, pieces, merges, 1024, 64)
            assert all(p.tokens == len(reference.encode_ordinary(text[p.start : p.end])) for p in pieces)


def test_split_corpus(spark):
    rows = [(1, "word " * 2000, 1), (2, "short", 1), (3, None, 1), (4, "", 1), (5, "é" * 3000, 1), (1, "word " * 2000, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    got = split_corpus(d)
    n = {k: got.where(f"doc_id = {k}").count() for k in range(1, 6)}
    assert n[1] >= 4 and n[1] % 2 == 0 and n[2] == n[3] == n[4] == 0 and n[5] >= 2
    assert got.where("n_tokens > 1024").count() == 0
    assert split_corpus(d.where("false")).count() == 0
