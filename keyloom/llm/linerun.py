"""Line dedup: repeated runs of lines from a suffix array over line ids, by distributed prefix doubling.

A document is a sequence of line ids.  Rows are (document, position); the rank
of a row at level h is its place in the order of all runs of 2^h lines, so rows
of one rank start with the same 2^h lines and are neighbours in the suffix
array.  A round pairs the rank at a position with that 2^h lines on, sorts the
distinct pairs over the cluster and numbers them: these are the ranks of level
h + 1.  Rows whose run stands nowhere else are dropped, as nothing longer from
there can be repeated either, so rounds soon are small.

Suffixes have a common prefix of m lines just where the two (overlapping) ranks
of 2^h lines that cover m lines agree: they are one interval of the suffix
array with longest common prefixes of m or more.  Intervals are taken at the
least depth at which a run is long enough in words, from each line forward and
from each line backward; the places of an interval after its first are later
copies, and what such copies cover, merged, are the maximal repeated runs that
go.

A line id is a 128-bit hash of the line (two of 64 bits whose seeds differ
before the text is read).  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, fresh, materialize, text_of
from keyloom.llm.spans import RUN

#: Words of a run that counts.
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """array<struct<t, nr>>: the lines that are not blank, without outer blanks, and their numbers among all lines."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "").alias("t"), i.alias("nr")))
    return F.filter(every, lambda x: x["t"] != "")


def running(values: Column) -> Column:
    """Running sums of an array, from 0 on (one more than values); runs of RUN keep long arrays near linear."""
    empty = F.array().cast("array<bigint>")

    def one(s: Column, x: Column) -> Column:
        return F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out"))

    def run(s: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(s["all"], at, F.lit(RUN)), F.struct(s["sum"].alias("sum"), empty.alias("out")), one)
        return F.struct(inner["sum"].alias("sum"), F.concat(s["out"], F.array(inner["out"])).alias("out"), s["all"].alias("all"))

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array(F.array(F.lit(0).cast("bigint"))).alias("out"), values.alias("all"))
    return F.when(F.size(values) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(RUN)), start, run, lambda s: F.flatten(s["out"])))


DOC = ("none", "doc", "th")


def _steps(min_words: int) -> int:
    return max(1, (min_words - 1).bit_length())


def _sequences(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """none, doc, th (which document), n_lines, lines array<struct<a, b, ahead, back>>; no lines where a document is too short.

    a, b: the line's id; ahead: lines of the least run of enough words that starts here; back: of that which ends here, unless
    its first line has the same run ahead; null where there is none.
    """
    text = text_of(text_col)
    df = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("th"), _lines(text).alias("_l"))
    df = df.select(*DOC, F.size("_l").alias("n_lines"), F.transform("_l", lambda x: F.size(F.split(x["t"], r"\s+")).cast("bigint")).alias("_w"),
                   F.transform("_l", lambda x: F.xxhash64(F.lit(1), x["t"])).alias("_a"), F.transform("_l", lambda x: F.xxhash64(F.lit(2), x["t"])).alias("_b"))
    df = df.withColumn("_c", running(F.col("_w")))
    steps = F.array(*(F.lit(2**h) for h in range(_steps(min_words), -1, -1)))
    n, c = F.col("n_lines"), F.col("_c")
    # from line i the fewest lines with enough words: the last reach that is short of them, by halving steps, and one more
    end = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(
        steps, i, lambda j, p: F.when((j + p <= n) & (F.get(c, j + p) - F.get(c, i) < min_words), j + p).otherwise(j)) + 1)
    start = F.transform(F.sequence(F.lit(1), n), lambda e: F.aggregate(
        steps, e, lambda j, p: F.when((j - p >= 0) & (F.get(c, e) - F.get(c, j - p) < min_words), j - p).otherwise(j)) - 1)
    df = df.withColumn("_long", F.element_at("_c", -1) >= min_words).withColumn("_e", F.when(F.col("_long"), end)).withColumn("_s", F.when(F.col("_long"), start))
    ahead = F.transform("_e", lambda e, i: F.when(e <= n, e - i))
    back = F.transform("_s", lambda s, k: F.when((s >= 0) & (F.get(F.col("_e"), s) != k + 1), k + 1 - s))
    lines = F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b"), ahead.alias("ahead"), back.alias("back"))
    return df.select(*DOC, "n_lines", F.when(F.col("_long"), lines).alias("lines"))


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows of ``keys`` (distinct), numbered in their order over the cluster as ``rank``; numbers have gaps."""
    ordered = keys.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def _level(rows: DataFrame, by: list[str], h: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``by`` stands elsewhere too, with its rank; and the table of ranks."""
    ranks = _ranked(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), by, f"ranks{h}")
    return rows.join(ranks, by).drop(*by), ranks


def intervals(lines: DataFrame) -> DataFrame | None:
    """Least runs of enough words that stand elsewhere too: none, doc, th, i, m, r, q; those with the same m, r, q are one interval.

    ``lines``: none, doc, th, pos, a, b, ahead, back, a row per line of each document.  None if no run is repeated.
    """
    found, ranks = _level(lines, ["a", "b"], 0)
    of = Window.partitionBy(*DOC)
    found = found.withColumn("seg", F.col("pos") - F.row_number().over(of.orderBy("pos")))
    seg = Window.partitionBy(*DOC, "seg")
    found = found.withColumn("ahead", F.when(F.col("pos") + F.col("ahead") - 1 <= F.max("pos").over(seg), F.col("ahead")))
    found = found.withColumn("back", F.when(F.col("pos") - F.col("back") + 1 >= F.min("pos").over(seg), F.col("back")))
    # the most lines that a run in this stretch of repeated lines needs; a stretch with too few words goes
    found = found.withColumn("need", F.greatest(F.max("ahead").over(seg), F.max("back").over(seg))).filter("need IS NOT NULL")
    level = materialize(found.select(*DOC, "pos", "ahead", "back", "need", "rank"), "level0")
    drop_table(ranks)
    most = level.agg(F.max("need")).first()[0]
    if most is None:
        return None
    levels = [level]
    while 2 ** len(levels) <= most:
        step = 2 ** (len(levels) - 1)
        order = of.orderBy("pos")
        # where rows between are missing, the run of twice the length cannot be repeated
        pairs = levels[-1].filter(F.col("need") >= 2 * step).select(*DOC, "pos", "need", F.col("rank").alias("r"), F.lead("rank", step).over(order).alias("q"), F.lead("pos", step).over(order).alias("at"))
        pairs = materialize(pairs.filter(F.col("at") == F.col("pos") + step).drop("at"), "pairs")
        found, ranks = _level(pairs, ["r", "q"], len(levels))
        levels.append(materialize(found.select(*DOC, "pos", "need", "rank"), f"level{len(levels)}"))
        drop_table(pairs)
        drop_table(ranks)
    run = F.explode(F.array(F.struct(F.col("pos").alias("i"), F.col("ahead").alias("m")), F.struct((F.col("pos") - F.col("back") + 1).alias("i"), F.col("back").alias("m"))))
    runs = level.select(*DOC, run.alias("w")).select(*DOC, "w.i", "w.m").filter("m IS NOT NULL")
    runs = runs.withColumn("h", sum((F.when(F.col("m") >= 2**h, 1).otherwise(0) for h in range(1, len(levels))), F.lit(0)))
    names = None
    for h, t in enumerate(levels):
        t = t.select(*DOC, "pos", F.lit(h).alias("h"), "rank")
        names = t if names is None else names.unionByName(t)
    first = names.withColumnsRenamed({"pos": "i", "rank": "r"})
    runs = runs.join(first, [*DOC, "i", "h"]).withColumn("pos", F.col("i") + F.col("m") - F.pow(F.lit(2), F.col("h")).cast("int"))
    runs = runs.join(names.withColumnsRenamed({"rank": "q"}), [*DOC, "pos", "h"])
    out = materialize(runs.select(*DOC, "i", "m", "r", "q"), "intervals")
    for t in levels:
        drop_table(t)
    return out


def _merged(wins: Column) -> Column:
    """Windows (i, m), sorted, as disjoint runs array<struct<start, lines>>."""
    none = F.array().cast("array<struct<start:int,lines:int>>")

    def step(s: Column, x: Column) -> Column:
        end = x["i"] + x["m"]
        apart = x["i"] > s["e"]
        out = F.when(apart & (s["e"] > s["s"]), F.concat(s["out"], F.array(F.struct(s["s"].alias("start"), (s["e"] - s["s"]).alias("lines"))))).otherwise(s["out"])
        return F.struct(F.when(apart, x["i"]).otherwise(s["s"]).alias("s"), F.when(apart, end).otherwise(F.greatest(s["e"], end)).alias("e"), out.alias("out"))

    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out"))
    return F.aggregate(wins, start, step, lambda s: F.when(s["e"] > s["s"], F.concat(s["out"], F.array(F.struct(s["s"].alias("start"), (s["e"] - s["s"]).alias("lines"))))).otherwise(s["out"]))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted, runs, text_hash: one row per document.

    ``runs`` lists the maximal runs to delete, as start:lines, comma-joined;
    starts count the lines that are not blank, from 0.  A run goes if its lines
    hold ``min_words`` words and stand, in this order, at an earlier place too:
    in a document of smaller id, or earlier in this one.  Lines are compared
    without outer blanks; blank lines count for nothing and stay.

    Null text: no lines.  Null ids stand after all others; documents of one id by
    a hash of their texts.  Rows alike in id and text are one document and are
    treated alike.  Long texts are read whole.  Empty table: no rows.  Other
    columns are not read.
    """
    seen = materialize(_sequences(docs, min_words, id_col, text_col), "sequences")
    long_ = seen.filter("lines IS NOT NULL").select(*DOC, "lines")
    if not long_.groupBy(*DOC).count().filter("count > 1").isEmpty():
        long_ = long_.dropDuplicates(list(DOC))
    found = intervals(long_.select(*DOC, F.posexplode("lines").alias("pos", "l")).select(*DOC, "pos", "l.a", "l.b", "l.ahead", "l.back"))
    none = F.array().cast("array<struct<start:int,lines:int>>")
    if found is None:
        out = seen.select(*DOC, "n_lines", none.alias("runs"))
    else:
        place = F.struct(*DOC, "i")
        first = materialize(found.groupBy("m", "r", "q").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("m", "r", "q", "first"), "first")
        later = found.join(first, ["m", "r", "q"]).filter(place != F.col("first"))
        gone = later.groupBy(*DOC).agg(_merged(F.array_sort(F.collect_set(F.struct("i", "m")))).alias("runs"))
        out = seen.select(*DOC, "n_lines").join(gone, list(DOC), "left").withColumn("runs", F.coalesce("runs", none))
    runs = F.col("runs")
    return out.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.aggregate(runs, F.lit(0), lambda s, x: s + x["lines"]).cast("long").alias("n_deleted"),
                      F.array_join(F.transform(runs, lambda x: F.concat_ws(":", x["start"].cast("string"), x["lines"].cast("string"))), ",").alias("runs"), F.col("th").alias("text_hash"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the texts; all columns and rows stay, null texts stay null."""
    found = materialize(repeated_runs(docs, min_words, id_col, text_col), "runs").filter("n_deleted > 0")
    found = found.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.transform(F.split("runs", ","), lambda r: F.struct(
        F.split(r, ":")[0].cast("int").alias("s"), (F.split(r, ":")[0].cast("int") + F.split(r, ":")[1].cast("int")).alias("e"))).alias("_r")).distinct()
    h, every, nr, cuts = (fresh(docs, x) for x in ("_text_hash", "_every", "_nr", "_cuts"))
    hashed = docs.withColumn(h, F.xxhash64(text_of(text_col)))
    joined = hashed.join(found, hashed[id_col].cast("long").eqNullSafe(found["_i"]) & (hashed[h] == found["_h"]), "left")
    some = F.col("_r").isNotNull()
    joined = joined.withColumn(every, F.when(some, F.split(F.col(text_col), "\n"))).withColumn(nr, F.when(some, F.transform(_lines(F.col(text_col)), lambda x: x["nr"])))
    # each cut in numbers of all lines; blank lines in it stay
    joined = joined.withColumn(cuts, F.transform("_r", lambda r: F.struct(F.get(F.col(nr), r["s"]).alias("s"), (F.get(F.col(nr), r["e"] - 1) + 1).alias("e"))))
    lines, cut = F.col(every), F.col(cuts)
    after = F.transform(cut, lambda x, k: F.concat(F.filter(F.slice(lines, x["s"] + 1, x["e"] - x["s"]), lambda t: F.regexp_replace(t, r"^[ \t\r]+", "") == ""),
                                                   F.slice(lines, x["e"] + 1, F.coalesce(F.get(cut, k + 1)["s"], F.size(lines)) - x["e"])))
    kept = F.array_join(F.concat(F.slice(lines, F.lit(1), F.get(cut, F.lit(0))["s"]), F.flatten(after)), "\n")
    return joined.select(*(F.when(F.col("_r").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS t,
                  unnest(range(0, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')))) AS i FROM documents),
w AS (SELECT *, len(string_split_regex(t, '\\s+')) AS n, sum(len(string_split_regex(t, '\\s+'))) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM l),
f AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= {MIN_WORDS} GROUP BY 1, 2),
g AS (SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= {MIN_WORDS} GROUP BY 1, 3),
p AS (SELECT * FROM f UNION SELECT * FROM g),
s AS (SELECT p.doc_id, p.i, p.j, string_agg(w.t, chr(10) ORDER BY w.i) AS t FROM p JOIN w ON w.doc_id = p.doc_id AND w.i BETWEEN p.i AND p.j GROUP BY 1, 2, 3),
r AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS nr FROM s),
d AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r WHERE nr > 1),
q AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM d),
u AS (SELECT doc_id, min(i) AS a, count(*) AS n FROM q GROUP BY doc_id, k),
x AS (SELECT doc_id, sum(n)::BIGINT AS n_deleted, string_agg(a || ':' || n, ',' ORDER BY a) AS runs FROM u GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(runs, '') AS runs
FROM documents LEFT JOIN y ON y.doc_id = documents.doc_id LEFT JOIN x ON x.doc_id = documents.doc_id
"""
