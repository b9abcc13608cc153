"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed: seeds found in a document name the items
and the diagonals to look at, and each such passage is aligned with the item
word by word, insertions, deletions and changes allowed.  A first pass counts in
how many documents each n-gram stands.  Passages with a seed that is rare, or
the rarest of a few consecutive ones, are aligned at once; those with common
seeds alone only where they hold words enough of the item to reach the
threshold at all, so that no copy is lost by how common its words are.
A long item's excerpt counts by its own length, not as a share of the item.

Items are handled in blocks of bounded size; a block travels with the tasks.
Nothing of a document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, lean, text_of
from keyloom.llm.words import rolled, words

NGRAM = 3
#: An n-gram is rare in so many documents at most, or this share of all.
RARE, RARE_SHARE = 20, 1e-4
#: And one at least in every so many consecutive n-grams of an item counts as rare.
SPAN = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score from which a passage counts as a copy of the item.
THRESHOLD = 0.45
#: A passage with the score of so many unbroken words counts too, whatever the item's length.
EXCERPT = 13
#: Characters of test items in a block; more items take more blocks.
BLOCK_CHARS = 16_000_000
BATCH_CHARS = 4_000_000
#: Cells of one round of alignment.
CELLS = 1_000_000
#: Pairs of a place in a text and one in an item that are handled at once; a document's own pairs stay together.
PAIRS = 2_000_000
TABLE = 1 << 20


@dataclass
class Items:
    """A block of items: ids, and their word hashes one after the other."""

    ids: list
    words: np.ndarray
    edges: np.ndarray

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram its hash, its item and its position in the item."""
        runs = rolled(self.words, NGRAM)
        at = np.arange(len(runs))
        item = np.searchsorted(self.edges, at, side="right") - 1
        inside = at + NGRAM <= self.edges[item + 1] if len(at) else np.zeros(0, bool)
        return runs[inside], item[inside], (at - self.edges[item])[inside]


class Finder:
    """Which of given hashes stand where: a bit table first, then a search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.table = np.zeros(TABLE, dtype=bool)
        self.table[(self.sorted & np.uint64(TABLE - 1)).astype(np.int64)] = True

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``runs`` and numbers in ``sorted``."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(runs & np.uint64(TABLE - 1)).astype(np.int64)])
        nr = np.minimum(np.searchsorted(self.sorted, runs[at]), len(self.sorted) - 1)
        hit = self.sorted[nr] == runs[at]
        return at[hit], nr[hit]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row offset, word hashes and edges of groups of texts of about BATCH_CHARS bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else []
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_CHARS, side="right")))
        h, edges, _ = words(column.slice(a, z - a))
        yield a, h, edges
        a = z


def _runs(h: np.ndarray, edges: np.ndarray, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, document, number of the n-gram) of the n-grams found, none across two documents."""
    at, nr = finder.find(rolled(h, NGRAM))
    doc = np.searchsorted(edges, at, side="right") - 1
    inside = at + NGRAM <= edges[doc + 1] if len(at) else np.zeros(0, bool)
    return at[inside], doc[inside], nr[inside]


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each window with its item, as a share of the item's best possible score."""
    out = np.zeros(len(windows))
    order = np.argsort([len(w) * len(i) for w, i in zip(windows, items, strict=True)], kind="stable")
    a = 0
    while a < len(order):
        z = a + 1
        wide = len(windows[order[a]])
        while z < len(order) and max(wide, len(windows[order[z]])) * (z + 1 - a) <= CELLS:
            wide = max(wide, len(windows[order[z]]))
            z += 1
        here = order[a:z]
        n = max(len(items[i]) for i in here)
        # 0 and 1 stand for "past the end" and match nothing
        w, t = np.zeros((len(here), wide), np.uint64), np.ones((len(here), n), np.uint64)
        for r, i in enumerate(here):
            w[r, : len(windows[i])] = windows[i] | np.uint64(2)
            t[r, : len(items[i])] = items[i] | np.uint64(2)
        row, best = np.zeros((len(here), wide + 1), np.int32), np.zeros(len(here), np.int32)
        slide = -GAP * np.arange(wide + 1, dtype=np.int32)
        for j in range(n):
            same = w == t[:, j : j + 1]
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slide, axis=1) - slide  # gaps in the item, any length
            best = np.maximum(best, row.max(axis=1))
        out[here] = best / (MATCH * np.array([max(1, len(items[i])) for i in here]))
        a = z
    return out


class Matcher:
    """Finds copies of items in texts; ``rare`` are the n-grams (hash, item, position) whose passages are aligned at once."""

    def __init__(self, items: Items, rare: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        grams, item, pos = items.grams()
        self.items, self.finder = items, Finder(grams)
        order = np.argsort(grams, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.rare = np.isin(items.edges[self.item] + self.pos, items.edges[rare[1]] + rare[2])
        self.first = np.searchsorted(grams[order], self.finder.sorted)
        self.count = np.diff(np.append(self.first, len(grams)))

    def matches(self, h: np.ndarray, edges: np.ndarray, threshold: float = 0.0, excerpt: int = EXCERPT) -> list[tuple[int, int, float, int]]:
        """(document, item, score, seeds found): the best passage of each document and item, of the threshold or as long as an excerpt."""
        at, doc, nr = _runs(h, edges, self.finder)
        least = np.minimum(threshold, excerpt / np.maximum(1, np.diff(self.items.edges))) - 1e-9  # score that counts, by item
        total, a, out = np.cumsum(self.count[nr]), 0, []
        while a < len(at):
            z = int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right"))
            if z < len(at):  # whole documents
                z = int(np.searchsorted(doc, doc[z]))
                z = z if z > a else int(np.searchsorted(doc, doc[a], side="right"))
            out += self._matches(h, edges, at[a:z], doc[a:z], nr[a:z], least)
            a = z
        return out

    def _matches(self, h: np.ndarray, edges: np.ndarray, at: np.ndarray, doc: np.ndarray, nr: np.ndarray, least: np.ndarray) -> list[tuple[int, int, float, int]]:
        n = self.count[nr]
        src = np.repeat(np.arange(len(nr)), n)
        which = self.first[nr][src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        d, it, diag = doc[src], self.item[which], at[src] - self.pos[which]
        order = np.lexsort((diag, it, d))
        d, it, diag, rare = d[order], it[order], diag[order], self.rare[which][order]
        windows, items, who, i = [], [], [], 0
        sizes = np.diff(self.items.edges)
        seeds: dict[tuple[int, int], int] = {}
        while i < len(d):
            size, z = int(sizes[it[i]]), i + 1
            while z < len(d) and d[z] == d[i] and it[z] == it[i] and diag[z] <= diag[i] + size:
                z += 1
            pad = size // 4 + 4
            a, b = max(int(edges[d[i]]), int(diag[i]) - pad), min(int(edges[d[i] + 1]), int(diag[z - 1]) + size + pad)
            window, item, key = h[a:b], self.items.words[self.items.edges[it[i]] : self.items.edges[it[i] + 1]], (int(d[i]), int(it[i]))
            seeds[key] = seeds.get(key, 0) + z - i
            # no alignment matches more words than stand in the passage
            if rare[i:z].any() or np.isin(item, window).sum() >= least[it[i]] * size:
                windows.append(window)
                items.append(item)
                who.append(key)
            i = z
        best: dict[tuple[int, int], float] = {}
        for key, s in zip(who, align(windows, items).tolist(), strict=True):
            best[key] = max(best.get(key, 0.0), s)
        return [(x, y, s, seeds[x, y]) for (x, y), s in best.items() if s >= least[y]]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).alias("i"), text_of(text_col).alias("t"))
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(chars) // BLOCK_CHARS))
    for b in range(n):
        part = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b)).collect()  # a block of bounded size
        part.sort(key=lambda r: (r.i is None, r.i, r.t))
        h, edges, _ = words(pa.array([r.t for r in part], pa.string()))
        yield Items([r.i for r in part], h, edges)


def _seeds(docs: DataFrame, items: Items, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and position of the rare seeds; document counts are over all documents."""
    grams, item, pos = items.grams()
    finder = Finder(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen, rows = np.zeros(len(finder.sorted), np.int64), 0
        for b in batches:
            rows += len(b)
            for _, h, edges in _texts(b.column(0)):
                _, doc, nr = _runs(h, edges, finder)
                each = np.unique(doc.astype(np.int64) * len(seen) + nr)
                seen += np.bincount(each % max(1, len(seen)), minlength=len(seen))
        found = np.flatnonzero(seen)
        # the number of documents goes as an n-gram of its own
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int64()), pa.array([rows, *seen[found]], pa.int64())], ["gram", "n"])

    df, total = np.zeros(len(finder.sorted), np.int64), 0
    if len(df):
        counted = docs.select(text_of(text_col).alias("t")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        for g, n in counted.collect():  # the n-grams of a block
            if g < 0:
                total = n
            else:
                df[g] = n
    mine = df[np.searchsorted(finder.sorted, grams)] if len(grams) else np.zeros(0, np.int64)
    keep = mine <= max(RARE, RARE_SHARE * total)
    bounds = np.searchsorted(item, np.arange(len(items.ids) + 1))
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for i in range(a, max(a + 1, z - SPAN + 1)) if z > a else ():
            part = mine[i : min(i + SPAN, z)]
            keep[i + int(part.argmin())] = True
    return grams[keep], item[keep], pos[keep]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", excerpt: int = EXCERPT) -> DataFrame:
    """doc_id, item_id, score (0..1), seeds: documents with a passage that copies an item, edits allowed.

    ``score`` is the share of the best score of the whole item; a passage counts
    from ``threshold`` on, and one that copies a part of a long item from the
    score of ``excerpt`` unbroken words on, whatever share that is.
    Words are compared in lower case without punctuation.  Null or empty texts
    have no passages; items of fewer than three words, null ones too, are not
    searched.  Null ids are given as they are.  Repeated rows and items each
    give their rows.  Either table may be empty.  Other columns are not read.
    """
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        m = Matcher(items, _seeds(docs, items, text_col))

        def scan(batches: Iterator[pa.RecordBatch], m: Matcher = m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lean()
                ids = b.column(0).to_pylist()
                for a, h, edges in _texts(b.column(1)):
                    hits = [(ids[a + d], m.items.ids[i], s, c) for d, i, s, c in m.matches(h, edges, threshold, excerpt)]
                    if hits:
                        cols = list(zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "seeds"])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(scan, "doc_id long, item_id long, score double, seeds long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", excerpt: int = EXCERPT) -> DataFrame:
    """The rows of ``docs`` without a passage that copies an item or an excerpt of one, with all their columns."""
    for items in _blocks(benchmark, item_col, item_text_col):
        m = Matcher(items, _seeds(docs, items, text_col))
        t = fresh(docs, "_text")

        def clean(batches: Iterator[pa.RecordBatch], m: Matcher = m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lean()
                keep = np.ones(len(b), bool)
                for a, h, edges in _texts(b.column(len(b.schema) - 1)):
                    keep[[a + d for d, _, _, _ in m.matches(h, edges, threshold, excerpt)]] = False
                yield b.select(range(len(b.schema) - 1)).filter(pa.array(keep))

        docs = docs.withColumn(t, text_of(text_col)).mapInArrow(clean, docs.schema)
    return docs
