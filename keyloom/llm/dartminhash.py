"""Near-duplicate detection with DartMinHash signatures.

Every element (a five-word shingle) owns a fixed random set of darts in the
plane weight x rank, drawn from hashes of the element, cell by unit cell.  A
document takes the darts that lie below its weight for the element and below
a rank that gives about k ln k + 2k darts in all; each dart belongs to one of
k coordinates, and the earliest dart of a coordinate is its minimum.  So a
signature costs the larger of the number of elements and of darts, instead of
elements times coordinates.  Bands of coordinates are the join keys.

Texts alike in their words are first made one.  In each band bucket texts are
compared with one leader, exactly, by their shingle sets.  Bucket mates that
then are of different components still have to be told apart, without pairing
them all.  Let E(x) be the edits of x, its shingles that the leader T lacks and
those of T that x lacks.  Similarity 0.8 of x and y means that x and y differ in
(|x| + |y|) / 9 shingles at most, hence share (|E(x)| + |E(y)| - (|x| + |y|) / 9) / 2
of their edits; and where x is not like T, |E(x)| > (|x| + |T|) / 9, so that this is
about half of E(y).  Edits are ordered, the rarest of the leader's group first,
and two texts meet only at an edit among the first of both (a prefix filter),
from which on enough edits are left to share.  Most edits of a copy are its own
and meet nobody, so a large group of copies costs about as many comparisons as
it has members and links; and no link between bucket mates is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, fresh, lean, materialize
from keyloom.llm.graph import components
from keyloom.llm.words import STEP, mix, shingle_sets, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Texts are taken in groups of about so many characters.
BATCH_CHARS = 500_000
#: A pair whose signatures agree in a smaller share of coordinates is not compared exactly; 6 deviations below the threshold.
SKETCH_LEAST = 0.58
CELLS = 200_000
EMPTY = np.uint64(2**64 - 1)
FRACTION = 30
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def _throw(out: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
    """Throw the darts with rank in [lo, hi) of each (document, element, weight) and keep the earliest in ``out``."""
    first = np.floor(lo).astype(np.int64)
    cols = np.ceil(hi).astype(np.int64) - first
    cells = cols * np.ceil(weight).astype(np.int64)
    src = np.repeat(np.arange(len(element)), cells)
    nth = np.arange(len(src)) - np.repeat(np.cumsum(cells) - cells, cells)
    row, col = nth // cols[src], first[src] + nth % cols[src]
    cell = mix(element[src] + STEP * (col.astype(np.uint64) * np.uint64(65537) + row.astype(np.uint64) + np.uint64(1)))
    darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
    again = np.repeat(np.arange(len(src)), darts)
    order = np.arange(len(again)) - np.repeat(np.cumsum(darts) - darts, darts)
    a = mix(cell[again] ^ (STEP * (order.astype(np.uint64) + np.uint64(7))))
    b = mix(a + STEP)
    rank = col[again] + (a >> np.uint64(64 - FRACTION)).astype(np.float64) / 2.0**FRACTION
    at = src[again]
    keep = (rank >= lo[at]) & (rank < hi[at])
    if (weight != 1).any():
        keep &= row[again] + (b >> np.uint64(40)).astype(np.float64) / 2.0**24 < weight[at]
    coordinate = (b & np.uint64(0xFFFFFF)) % np.uint64(k)
    value = (col[again].astype(np.uint64) << np.uint64(50)) | ((a >> np.uint64(64 - FRACTION)) << np.uint64(20)) | ((a ^ b) & np.uint64(0xFFFFF))
    np.minimum.at(out, (doc[at[keep]] * k + coordinate[keep].astype(np.int64)), value[keep])


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int, by_count: bool = False) -> np.ndarray:
    """k minima for each weighted set (documents x k); those of an empty set are EMPTY.

    Weights are 1, or with ``by_count`` the number of times a shingle stands in the text.
    """
    n = np.array([len(s) for s, _ in sets], dtype=np.int64)
    out = np.full(len(sets) * k, EMPTY, dtype=np.uint64)
    if not n.sum():
        return out.reshape(-1, k)
    doc = np.repeat(np.arange(len(sets)), n)
    element = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([c for _, c in sets]).astype(np.float64) if by_count else np.ones(len(element))
    total = np.maximum(np.bincount(doc, weights=weight, minlength=len(sets)), 1)
    lo, hi = np.zeros(len(sets)), (k * math.log(k) + 2 * k) / total
    live = np.ones(len(element), dtype=bool)
    while live.any():
        at = np.flatnonzero(live)
        cells = np.cumsum(np.ceil(hi[doc[at]] + 1) * np.ceil(weight[at]))
        for part in np.split(at, np.unique(np.searchsorted(cells, np.arange(CELLS, cells[-1], CELLS)))):
            d = doc[part]  # a long text or many short ones: so many cells at once
            _throw(out, d, element[part], weight[part], lo[d], hi[d], k)
        short = (out.reshape(-1, k) == EMPTY).any(axis=1) & (n > 0)
        lo, hi = hi, hi * 2  # the rest of the coordinates get later darts
        live = short[doc]
    return out.reshape(-1, k)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, (len(sig), bands)).copy()
    for r in range(rows):
        h = mix(h * STEP + sig[:, r : bands * rows : rows])
    return h.view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in groups of about BATCH_CHARS bytes of text (column 1)."""
    for b in batches:
        size = np.cumsum(np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: len(b) + 1])) if len(b) else []
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH_CHARS, side="right")))
            yield b.slice(a, z - a)
            a = z


def _keys(h: np.ndarray, edges: np.ndarray) -> list[bytes]:
    import xxhash

    raw = memoryview(np.ascontiguousarray(h)).cast("B") if len(h) else b""
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _sets_of(texts: pa.Array, by_count: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    h, edges, _ = words(texts)
    sets = shingle_sets(h, edges, SHINGLE)
    return h, edges, sets if by_count else [(s, np.ones(len(s), np.int64)) for s, _ in sets]


def _sign(batches: Iterator[pa.RecordBatch], by_count: bool) -> Iterator[pa.RecordBatch]:
    lean()
    for b in _batches(batches):
        h, edges, sets = _sets_of(b.column(1), by_count)
        keys = band_keys(signatures(sets, BANDS * ROWS, by_count))
        some = np.diff(edges) > 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_keys(h, edges), pa.binary()), pa.array([x if s else None for x, s in zip(keys, some, strict=True)], pa.list_(pa.int64())), b.column(2)], ["doc_id", "key", "bands", "text_hash"])
    lean()


def _collect_sets(batches: Iterator[pa.RecordBatch], by_count: bool) -> Iterator[pa.RecordBatch]:
    lean()
    for b in _batches(batches):
        h, edges, sets = _sets_of(b.column(1), by_count)
        low = (signatures(sets, BANDS * ROWS, by_count) & np.uint64(0xFFFF)).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array(_keys(h, edges), pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([_plain(*s).tobytes() for s in sets], pa.binary())], ["key", "sketch", "shingles"])
    lean()


def _plain(element: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one of the same similarities: an element of weight c is c elements."""
    if not len(count) or count.max() == 1:
        return element.astype("<u8")
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    again = np.repeat(element, count)
    return np.sort(np.where(nth > 0, mix(again + STEP * nth.astype(np.uint64)), again)).astype("<u8")


def _alike(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            least = threshold * max(len(p), len(q))
            ok = len(p) > 0 and min(len(p), len(q)) >= least
            if ok:
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                ok = both >= threshold * (len(p) + len(q) - both) - 1e-9
            keep.append(ok)
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def text_hash(col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")))


def _verify(pairs: DataFrame, sets: DataFrame, prefilter: bool) -> DataFrame:
    """Of pairs (a, b) of keys those whose shingle sets reach the threshold."""
    if prefilter:
        sk = sets.select("key", "sketch")
        k = BANDS * ROWS
        near = pairs.join(sk.withColumnsRenamed({"key": "a", "sketch": "x"}), "a").join(sk.withColumnsRenamed({"key": "b", "sketch": "y"}), "b")

        def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, k) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= SKETCH_LEAST))

        pairs = near.select("a", "b", "x", "y").mapInArrow(agree, "a binary, b binary")
    s = sets.select("key", "shingles")
    full = pairs.join(s.withColumnsRenamed({"key": "a", "shingles": "x"}), "a").join(s.withColumnsRenamed({"key": "b", "shingles": "y"}), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_alike, "a binary, b binary")


#: |x ^ y| <= NEAR * (|x| + |y|) is the same as similarity THRESHOLD.
NEAR = (1 - THRESHOLD) / (1 + THRESHOLD)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_count: bool = False) -> DataFrame:
    """doc_id, class_id, class_rows, keep: one row per document.

    Documents are of one class if a chain of links joins them: texts alike in
    their words, or whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; with ``by_count`` shingles weigh as often as they stand in
    a text, and similarity is the weighted one (sum of minima over sum of
    maxima).  ``class_id`` is the least doc_id of the class; ``keep``
    marks the row that stays.  Null and empty texts, and texts without a word,
    are one class.  Texts of fewer than five words are one shingle.  Long texts
    are read whole, in groups of bounded size.  Null ids take part; a class of
    null ids has a null class_id.  Rows alike in id and text are one document
    and are marked alike.  Empty table: no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("text_hash"))
    signed = materialize(rows.mapInArrow(lambda it: _sign(it, by_count), "doc_id long, key binary, bands array<bigint>, text_hash long"), "signed")
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = materialize(signed.groupBy("key").agg(F.min(ordered).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.filter(F.col("bands").isNotNull()).select("key", F.explode("bands").alias("band"))
    # written first: a join of two plain shuffles is one that a hot bucket can be split in
    buckets = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = materialize(banded.join(buckets, "band"), "members")
    drop_table(buckets)
    # the leader of a bucket is its member with most bucket mates over all bands: of a group of copies, the least edited
    known = members.groupBy("key").agg(F.sum("size").alias("known"))
    leaders = materialize(members.join(known, "key").groupBy("band").agg(F.max(F.struct("known", "key")).alias("l")).select("band", F.col("l.key").alias("leader")), "leaders")
    sets = _sets(rows, nodes, members, by_count)
    stars = materialize(members.join(leaders, "band").filter("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    drop_table(members)
    drop_table(leaders)
    links = materialize(_verify(stars, sets, True), "links")
    comp = components(links)
    pairs = _others(stars, comp, sets)
    if pairs is not None:
        more = materialize(_verify(pairs, sets, True), "links")
        if not more.isEmpty():
            stars_now = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
            comp = components(stars_now.unionByName(more))
        drop_table(pairs)
        drop_table(more)
    named = materialize(_in(nodes.select("key", "first", "n"), comp, "key", "c"), "classed")
    for t in (stars, links, sets, comp, nodes):
        drop_table(t)
    by_class = named.groupBy("c").agg(F.sum("n").alias("class_rows"), F.min("first").alias("stays"))
    by_key = named.select("key", "c").join(by_class, "c").select("key", "class_rows", "stays")
    stays = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.text_hash") == F.col("text_hash"))
    return signed.select("doc_id", "text_hash", "key").join(by_key, "key").select(
        "doc_id", F.col("stays.doc_id").alias("class_id"), "class_rows", stays.alias("keep"), "text_hash")


def _in(keys: DataFrame, comp: DataFrame, name: str, out: str) -> DataFrame:
    """``keys`` with the component of column ``name``; that of a text without a link is the text."""
    c = comp.select(F.col("node").alias(name), F.col("component").alias("_c"))
    return keys.join(c, name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")


def _others(stars: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of different components under one leader that may reach the threshold; None where there is no such leader.

    ``stars`` are texts a and their leaders b.  All that may be like one
    another are found, as the module says.
    """
    held = materialize(_in(_in(stars, comp, "a", "c"), comp, "b", "cb"), "held")
    open_ = held.groupBy("b").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("b")
    s = sets.select("key", "shingles")
    both = held.join(open_, "b").join(s.withColumnsRenamed({"key": "a", "shingles": "x"}), "a").join(s.withColumnsRenamed({"key": "b", "shingles": "y"}), "b")
    edited = materialize(both.select(F.xxhash64("a", "b").alias("id"), "a", "c", (F.col("c") != F.col("cb")).alias("out"), "b", "x", "y").mapInArrow(
        _edits, "id long, a binary, c binary, out boolean, size long, led long, edits binary"), "edited")
    drop_table(held)
    if edited.isEmpty():
        return None
    rows = edited.select("id", "edits").mapInArrow(_explode, "id long, edit long")
    often = materialize(rows.groupBy("edit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    shared = rows.join(often, "edit").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "edit"))).alias("shared"))
    e = F.call_function("div", F.octet_length("edits"), F.lit(8))
    df = edited.withColumn("e", e).drop("edits").join(shared, "id")
    # the least number of edits to share: with any text, and with a text that is not like the leader
    any_ = F.greatest(F.ceil(F.col("e") - F.col("size") * (1 / THRESHOLD - 1) - 1e-6), F.lit(1))
    far = F.greatest(F.floor((F.col("e") + (F.col("led") - F.col("size")) * NEAR) / 2 + 1e-6) + 1, F.lit(1))
    alone = F.col("e") - F.size("shared")  # edits that nobody else made stand first
    df = df.withColumn("short", F.col("e") - far + 1).withColumn("upto", F.when(F.col("out"), F.greatest(F.col("e") - any_ + 1, "short")).otherwise(F.col("short")))
    first = df.filter(alone < F.col("upto")).select("a", "c", "out", "size", "e", "short", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), (F.col("upto") - alone).cast("int"))).alias("i", "s"))
    first = materialize(first.select(F.col("s.edit").alias("edit"), "a", "c", "out", "size", "e", "short", (F.col("alone") + F.col("i") + 1).alias("at")), "first")

    x = first.filter("out").select("edit", *(F.col(k).alias(f"{k}1") for k in ("a", "c", "size", "e", "short", "at")))
    y = first.filter("at <= short").select("edit", "out", *(F.col(k).alias(f"{k}2") for k in ("a", "c", "size", "e", "at")))
    left = 1 + F.least(F.col("e1") - F.col("at1"), F.col("e2") - F.col("at2"))  # edits that may be shared from here on
    enough = left + 1e-6 >= (F.col("e1") + F.col("e2") - (F.col("size1") + F.col("size2")) * NEAR) / 2
    found = x.join(y, "edit").filter((F.col("c1") != F.col("c2")) & enough & (~F.col("out") | (F.col("at1") <= F.col("short1")) & (F.col("a1") < F.col("a2"))))
    pairs = materialize(found.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")).distinct(), "pairs")
    for t in (edited, often, first):
        drop_table(t)
    return pairs


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, a, c, out, b, x, y to id, a, c, out, sizes of x and y, edits: hashes of the leader and the shingles that one of x and y has."""
    lean()
    for b in batches:
        size, led, out = [], [], []
        for key, x, y in zip(b.column(4), b.column(5), b.column(6), strict=True):
            p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            of = np.frombuffer(key.as_buffer()[:8], "<u8")
            size.append(len(p))
            led.append(len(q))
            out.append(mix(np.setxor1d(p, q, assume_unique=True) ^ mix(of * STEP)).astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(size, pa.int64()), pa.array(led, pa.int64()), pa.array(out, pa.binary())], ["id", "a", "c", "out", "size", "led", "edits"])
    lean()


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_count: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all their columns.

    Rows alike in id and text count as one document, of which one row stays.
    """
    classes = materialize(near_classes(docs, id_col, text_col, by_count), "near")
    gone = classes.filter("NOT keep").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    h = fresh(docs, "_text_hash")
    hashed = docs.withColumn(h, text_hash(text_col))
    kept = hashed.join(gone, hashed[id_col].cast("long").eqNullSafe(gone["_i"]) & (hashed[h] == gone["_h"]), "left_anti")
    repeats = classes.filter("keep").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeats.isEmpty():
        once = kept.groupBy(F.col(id_col).alias("_i"), F.col(h).alias("_k")).agg(F.first(F.struct(*kept.columns)).alias("_r"))
        kept = once.select("_r.*")
    return kept.drop(h)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(1)]
        ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
        flat = np.concatenate([*found, np.zeros(0, "<i8")])
        for a in range(0, len(flat), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 200_000]), pa.array(flat[a : a + 200_000])], ["id", "edit"])


def _sets(rows: DataFrame, nodes: DataFrame, members: DataFrame, by_count: bool) -> DataFrame:
    """key, sketch, shingles of the texts that have bucket mates."""
    wanted = materialize(nodes.select("key", F.col("first.doc_id").alias("first")).join(members.select("key").distinct(), "key"), "wanted")
    with_id = rows.filter("doc_id IS NOT NULL").join(wanted.select(F.col("first").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    found = with_id.unionByName(rows.filter("doc_id IS NULL")).mapInArrow(lambda it: _collect_sets(it, by_count), "key binary, sketch binary, shingles binary")
    found = found.join(wanted.select("key"), "key", "left_semi")
    out = materialize(found.dropDuplicates(["key"]), "sets")
    drop_table(wanted)
    return out
