import math
import random

import pyarrow.parquet as pq

from sensorloom.llm.leakage import ItemIndex, LeakRule, covered_share, folded_words, leak_report, leaked_items, passages, tile

ITEM = "Twenty bricks wobble beside a leather saddle; a brass telescope that wobbles in thin fog also borders the stone lion; whenever a birch canoe sags, a trolley mirrors some benches. Where would the older walker unit find the granite millstone?"
OTHER = "A crooked flagpole that rocks during repairs also faces the pewter jug: does the marble basin still lean on a timber barn?"
WORDS = ITEM.split()


def leaks(text, items=((1, ITEM), (2, OTHER))):
    return {h[0] for h in ItemIndex(list(items)).leaks(text)}


def test_whole_and_half():
    assert leaks("before " + ITEM + " after") == {1}
    half = " ".join(WORDS[: len(WORDS) // 2 + 1])
    assert leaks("before " + half + " and then nothing of it") == {1}
    assert leaks("before " + " ".join(WORDS[: len(WORDS) // 4])) == set()


def test_disguises():
    for t in (
        ITEM.upper(), ITEM.replace(" ", "\n> "), ITEM.replace(" ", " ​"), ITEM.replace("brass", "**br**ass").replace("saddle", "<b>saddle</b>"),
        ITEM.replace("\n", "\\n").replace(" ", "\\n", 5), ITEM.replace("telescope", "tele-\n  scope"), ITEM.replace("a", "\\u0061"), ITEM.replace("Where", "&Wh&#101;re"),
        ITEM.replace("leather", "lether").replace("canoe", "caone").replace("benches", "really benches").replace("older", "nearby"), "".join(chr(0xFEE0 + ord(c)) if "!" <= c <= "~" else c for c in ITEM),
    ):
        assert leaks("x y z " + t + " end") == {1}, t[:80]


def test_other_orders_are_no_leaks():
    rnd = random.Random(0)
    for _ in range(10):
        w = WORDS[:]
        rnd.shuffle(w)
        assert leaks(" ".join(w)) == set()
    parts = [" ".join(WORDS[i : i + 10]) for i in range(0, len(WORDS), 10)]
    apart = " filler text goes here and on and on for a while so that no stretch joins them at all "
    assert leaks(apart.join(parts[::-1])) == set()
    assert leaks(" ".join(parts[::-1])) == set()


def test_coverage_finds_reordered_passages():
    reordered = "and so " + " ".join([" ".join(WORDS[i : i + 10]) for i in range(0, len(WORDS), 10)][::-1]) + " it goes"
    any_order = ItemIndex([(1, ITEM), (2, OTHER)], LeakRule(ordered=False))
    ((key, span, _, coverage),) = any_order.leaks(reordered)
    assert key == 1 and span < 0.5 and coverage > 0.9
    assert any_order.leaks(" ".join(WORDS[: len(WORDS) // 3])) == []
    assert covered_share([(0, 0, 5), (5, 100, 5), (12, 104, 4)], 20) == 9 / 20


def _misspelt(word, rnd):
    if len(word) < 4:
        return word
    i = rnd.randrange(len(word) - 1)
    return rnd.choice([word[:i] + word[i + 1 :], word[:i] + rnd.choice("bcdfg") + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])


def test_recall_under_misspellings():
    """Passages of every evaluation item with a share of their words misspelt, amid other text."""
    rnd = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/eval_items.parquet").to_pylist()]
    other = " ".join(t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t).split()
    index = ItemIndex(items)
    for misspelt, share, least in ((0.2, 0.55, 0.99), (0.2, 1.0, 0.99), (0.4, 0.55, 0.97), (0.4, 0.7, 0.97), (0.4, 1.0, 0.99)):
        hits = 0
        for key, text in items:
            words = text.split()
            n = math.ceil(len(words) * share)
            at, f = rnd.randrange(len(words) - n + 1), rnd.randrange(len(other) - 80)
            passage = [_misspelt(w, rnd) if rnd.random() < misspelt else w for w in words[at : at + n]]
            hits += key in {h[0] for h in index.leaks(" ".join(other[f : f + 40] + passage + other[f + 40 : f + 80]))}
        assert hits >= least * len(items), (misspelt, share, hits)


def test_seeds_cost_no_row():
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/eval_items.parquet").to_pylist()]
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    gated, open_ = ItemIndex(items), ItemIndex(items, LeakRule(seed_share=0.0))
    assert [{h[0] for h in gated.leaks(t)} for t in docs] == [{h[0] for h in open_.leaks(t)} for t in docs]


def test_both_items_and_repeats():
    assert leaks((OTHER + " filler ") * 40 + ITEM) == {1, 2}


def test_tiles_cover_no_word_twice():
    rnd = random.Random(1)
    for _ in range(50):
        a = [rnd.randrange(6) for _ in range(30)]
        b = [rnd.choice([-1, *range(6)]) for _ in range(40)]
        t = tile(a, b)
        for i, j, n in t:
            assert a[i : i + n] == b[j : j + n]
        assert len({i + k for i, _, n in t for k in range(n)}) == sum(n for *_, n in t) == len({j + k for _, j, n in t for k in range(n)})
        rest_a = set(a) - {a[i + k] for i, _, n in t for k in range(n)}
        assert not rest_a & set(b)  # what both have is tiled down to single words
    assert max(m for *_, m in passages(tile(list(range(20)), list(range(20))))) == 20


def test_folding():
    assert folded_words("Straße­ ń <p>A&amp;B</p> \\u00e9t\\u00e9") == ["strasse", "n", "a", "b", "ete"]
    assert folded_words(None) == folded_words(" \n") == []


def test_operator(spark):
    docs = [(1, "intro " + ITEM, "d"), (1, "intro " + ITEM, "d"), (2, None, "d"), (3, "", "d"), (None, ITEM, "d"), (5, OTHER + " " + ITEM, "d"), (6, "nothing " * 3000, "d")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "e"), (1, ITEM, "e"), (2, OTHER, "e"), (3, None, "e"), (4, "", "e"), (None, ITEM, "e")], "item_id bigint, text string, doc_id string")
    for block in (1 << 20, 100):  # in one block, and in several
        got = leaked_items(d.select("doc_id", "text", "item_id"), items, block_bytes=block)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (5, 1), (5, 2)]
    assert {(r.item_id, r.documents) for r in leak_report(got).collect()} == {(1, 2), (2, 1)}
    assert leaked_items(d.where("false"), items).count() == 0
    assert leaked_items(d, items.where("false")).count() == 0
