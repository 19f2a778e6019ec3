"""Evaluation texts leaking into training text (problem 7), by greedy string tiling.

Both sides are read as sequences of folded words; words one edit apart are alike. Pairs of
neighbouring words that a document shares with an item are the seeds. Around seeds the
document's words are tiled with the item's: running Karp-Rabin finds the longest matches
not yet marked, longest first, down to single words. Tiles that keep the item's order in
one stretch form a passage, and an item has leaked if the passage spans at least half of
its words. The share of the item under tiles in any order is its coverage, by which
reordered passages can be found as well.
"""

from __future__ import annotations

import html
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class LeakRule:
    """When an item counts as leaked.

    A passage that spans min_span of the item must match in min_density of its words; from a
    span of 70 % on less is needed, down to whole_density where it spans the whole item. In a
    run of n matching words all n - 1 pairs are seeds and each other word breaks two of them,
    so an accepted passage keeps about span * (2 * density - 1) of the item's pairs, 0.32 at
    least; added words break one each. seed_share is below that.
    """

    min_span: float = 0.5  # share of the item's words between the passage's ends
    min_density: float = 0.82
    whole_density: float = 0.7
    seed_share: float = 0.2  # share of the item's word pairs that a stretch of the document must hold to be tiled
    max_doc_gap: int = 12  # words of the document between two tiles (added words, line prefixes)
    max_item_gap: int = 5  # words of the item between two tiles (changed words)
    ordered: bool = True  # only passages in the item's order; else coverage counts too
    min_coverage: float = 0.8  # share of the item under tiles, in any order, within a stretch twice its length

_ESCAPED = regex.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf]|\\x([0-9a-fA-F]{2})")
_INLINE_TAG = regex.compile(r"</?(?:b|i|u|em|strong|span|a|code|mark|sub|sup|font|small|s|tt)(?:\s[^<>]{0,200})?>", regex.I)
_TAG = regex.compile(r"</?[a-zA-Z!][^<>]{0,200}>")
_DROPPED = regex.compile(r"[\p{Cf}\p{Mn}\p{Cc}--[\t\n\r]]|[*_`~\\]", regex.V1)
_HYPHENATED = regex.compile(r"(?<=\p{L})[-‐‑][^\S\n]*\r?\n[^\p{L}\p{N}\n]*(?=\p{Ll})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _unescape(m: regex.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else "\n"


def folded_words(text: str | None) -> list[str]:
    """Words without case, marks, markup, escapes, invisible characters and hyphenation at line ends."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    text = unicodedata.normalize("NFKD", text).encode("utf-8", "replace").decode()
    text = _DROPPED.sub("", text)
    text = _HYPHENATED.sub("", text).casefold()
    return _WORD.findall(text)


def _deletions(word: str) -> Iterator[str]:
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


class ItemIndex:
    """Items' words as numbers, their word pairs, and the words one edit away from theirs."""

    def __init__(self, items: list[tuple[object, str | None]], rule: LeakRule | None = None):
        self.rule = rule or LeakRule()
        self.items = []
        number: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for key, text in items:
            words = [number.setdefault(w, len(number)) for w in folded_words(text)]
            if not words:
                continue
            k = len(self.items)
            pairs = set(zip(words, words[1:]))
            self.items.append((key, words, max(1, len(pairs))))
            for p in pairs:
                self.pairs[p].append(k)
        self.single = defaultdict(list)  # items of one word have no pair
        for k, (_, words, _n) in enumerate(self.items):
            if len(words) == 1:
                self.single[words[0]].append(k)
        self.number = number
        self._near: dict[str, set[int]] = defaultdict(set)
        for w, n in number.items():
            if len(w) >= 4:
                self._near[w].add(n)
                for d in _deletions(w):
                    self._near[d].add(n)
        self._known: dict[str, frozenset[int]] = {}

    def alike(self, word: str) -> frozenset[int]:
        """Numbers of the items' words that are the word, or one inserted, dropped, changed or swapped letter from it."""
        got = self._known.get(word)
        if got is None:
            own = self.number.get(word)
            near: set[int] = set()
            if len(word) >= 4:
                near |= self._near.get(word, set())
                for d in _deletions(word):
                    near |= self._near.get(d, set())
            if own is not None:
                near.add(own)
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[word] = frozenset(near)
        return got

    def leaks(self, text: str | None) -> list[tuple[object, float, float, float]]:
        """(item key, span, density, coverage) of the items that a text leaks."""
        words = folded_words(text)
        known, alike, pairs, single, rule = self._known, self.alike, self.pairs, self.single, self.rule
        seeds: dict[int, list[int]] = defaultdict(list)
        before: frozenset[int] | tuple = ()
        for at, w in enumerate(words):
            now = known.get(w)
            if now is None:
                now = alike(w)
            for n in now:
                for m in before:
                    for k in pairs.get((m, n), ()):
                        seeds[k].append(at - 1)
                if single:
                    for k in single.get(n, ()):
                        seeds[k].append(at)
            before = now
        out = []
        for k, at in seeds.items():
            key, item, n_pairs = self.items[k]
            need = max(min(3, n_pairs), rule.seed_share * n_pairs)
            if len(at) < need:
                continue
            best, coverage = (0.0, 0.0), 0.0
            n = len(item)
            for lo, hi in self._stretches(at, n, need):
                begin, end = max(0, lo - n), min(len(words), hi + n + 1)
                for a in range(begin, max(begin + 1, end - 4 * n), 4 * n):  # windows that overlap by four items' length
                    got, covered = self._passage(item, words[a : min(end, a + 8 * n)])
                    best, coverage = max(best, got), max(coverage, covered)
                    if best[0] >= 1:
                        break
            if best[0] >= rule.min_span or (not rule.ordered and coverage >= rule.min_coverage):
                out.append((key, *best, coverage))
        return out

    def _stretches(self, at: list[int], n: int, need: float) -> Iterator[tuple[int, int]]:
        """First and last seed of each run of seeds not further apart than the item is long, with enough of them."""
        start = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] - at[i - 1] > max(n, 2 * self.rule.max_doc_gap):
                if i - start >= need:
                    yield at[start], at[i - 1]
                start = i

    def _passage(self, item: list[int], words: list[str]) -> tuple[tuple[float, float], float]:
        """((span, density) of the best passage, coverage in any order)."""
        mine, rule = set(item), self.rule
        doc = []
        for w in words:
            own = self.number.get(w, -1)
            if own not in mine:
                near = self.alike(w) & mine
                own = min(near) if near else -1
            doc.append(own)
        best = (0.0, 0.0)
        left = Counter(item)
        shared = 0
        for n in doc:
            if left.get(n, 0):
                left[n] -= 1
                shared += 1
        if shared < rule.whole_density * (rule.min_span * len(item) - 1):  # too few words for any passage that counts
            return best, shared / len(item)
        tiles = tile(item, doc)
        for first, last, matched in passages(tiles, rule.max_item_gap, rule.max_doc_gap):
            span, density = min(1.0, (last - first + 1) / len(item)), matched / (last - first)  # a changed word at an end is not seen
            if density >= rule.min_density - (rule.min_density - rule.whole_density) * max(0.0, (span - 0.7) / 0.3):
                best = max(best, (span, density))
        return best, covered_share(tiles, len(item))


def covered_share(tiles: list[tuple[int, int, int]], n: int) -> float:
    """Largest share of an item of n words under tiles that lie within 2n words of the document."""
    by_place = sorted((j, k) for _, j, k in tiles)
    best = total = lo = 0
    for j, k in by_place:
        total += k
        while by_place[lo][0] < j + k - 2 * n:
            total -= by_place[lo][1]
            lo += 1
        best = max(best, total)
    return min(1.0, best / n)


def tile(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the longest non-overlapping matches, longest first.

    Karp-Rabin hashes of all unmarked windows of the current length find where a match at
    least as long starts; the length halves when no longer ones are left.
    """
    base, mod = 1_000_003, (1 << 61) - 1
    free_a, free_b = [True] * len(a), [x >= 0 for x in b]
    tiles: list[tuple[int, int, int]] = []

    def windows(seq: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        top = pow(base, s - 1, mod)
        h, run = 0, 0
        for i, x in enumerate(seq):
            if not free[i]:
                h = run = 0
                continue
            if run == s:
                h = (h - (seq[i - s] + 1) * top) % mod
                run -= 1
            h = (h * base + x + 1) % mod
            run += 1
            if run == s:
                yield h, i - s + 1

    s = 16
    while s:
        where = defaultdict(list)
        for h, i in windows(a, free_a, s):
            where[h].append(i)
        found: list[tuple[int, int, int]] = []
        if where:
            for h, j in windows(b, free_b, s):
                for i in where.get(h, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n >= s:
                        found.append((n, i, j))
        longest = max((f[0] for f in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        for n, i, j in sorted(found, key=lambda f: (-f[0], f[2], f[1])):
            while n >= s:  # what an earlier tile has left of it
                if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                    tiles.append((i, j, n))
                    free_a[i : i + n] = [False] * n
                    free_b[j : j + n] = [False] * n
                    break
                n -= 1
        s //= 2
    return tiles


def passages(tiles: list[tuple[int, int, int]], max_item_gap: int = LeakRule.max_item_gap, max_doc_gap: int = LeakRule.max_doc_gap) -> Iterator[tuple[int, int, int]]:
    """(first, end, matched words) in the item of the best chain of tiles, in order and in one stretch, up to each tile."""
    tiles = sorted(tiles, key=lambda t: (t[1], t[0]))
    best: list[tuple[float, int, int]] = []  # score, first item word, matched words
    for q, (i, j, k) in enumerate(tiles):
        mine = (float(k), i, k)
        for p in range(q):
            pi, pj, pk = tiles[p]
            gap_a, gap_b = i - pi - pk, j - pj - pk
            if 0 <= gap_a <= max_item_gap and 0 <= gap_b <= max_doc_gap:
                score, first, matched = best[p]
                value = score + k - 0.5 * gap_a - 0.05 * gap_b
                if value > mine[0]:
                    mine = (value, first, matched + k)
        best.append(mine)
        yield mine[1], i + k, mine[2]


_INDEXES: dict[str, ItemIndex] = {}


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, rule: LeakRule | None = None,
) -> DataFrame:
    """(doc_id, item_id, span, density, coverage) of every item that a document leaks.

    span is the share of the item's words that the best passage covers, density the share of
    the passage's words that match, coverage the share of the item under tiles in any order;
    `rule` says when it counts (LeakRule). Null, empty and wordless documents and items leak
    nothing; rows with a null id take no part; repeated rows count once; empty tables give
    an empty result; further columns are dropped. The items are the stated query set: their
    bytes are summed first, and they are held against all documents in blocks of at most
    about block_bytes, each sent to all executors. Documents stay where they are; only hits
    are shuffled.
    """
    spark = docs.sparkSession
    q = items.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).alias("k"), F.col(item_text).cast("string").alias("t")).distinct()
    total = q.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    d = docs.where(F.col(doc_id).isNotNull() & (F.length(doc_text) > 0)).select(F.col(doc_id), F.col(doc_text).cast("string"))
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("span", T.DoubleType()), T.StructField("density", T.DoubleType()), T.StructField("coverage", T.DoubleType())])
    if blocks > 1:
        q = q.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    result = None
    for n in range(blocks):
        rows = [(r.k, r.t) for r in (q if blocks == 1 else q.where(F.col("block") == n)).toLocalIterator()]
        hits = d.mapInArrow(_scan(spark.sparkContext.broadcast(rows), out.names, rule), out)
        result = hits if result is None else result.unionByName(hits)
    return result.groupBy(doc_id, item_id).agg(F.max(F.struct("span", "density", "coverage")).alias("best")).select(doc_id, item_id, "best.span", "best.density", "best.coverage")


def _scan(shared, names, rule):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _INDEXES.get(key)
        if index is None:
            _INDEXES.clear()
            index = _INDEXES[key] = ItemIndex(shared.value, rule)
        for b in batches:
            at, found = [], []
            for i, cell in enumerate(b.column(1)):
                for hit in index.leaks(cell.as_py()):
                    at.append(i)
                    found.append(hit)
            if at:
                cols = [list(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cols[0]), *[pa.array(c, type=pa.float64()) for c in cols[1:]]], names=names)

    return run


def leak_report(leaks: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Per leaked item: documents that carry it, how many carry it whole, and the widest span."""
    return leaks.groupBy(item_id).agg(F.count("*").alias("documents"), F.count_if(F.col("span") >= 0.999).alias("whole"), F.max("span").alias("widest"))
