"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

What the fixed patterns find are seeds.  Identifier-like runs of tokens (they
hold a digit or an @) are instances; the words around them are lexical
patterns.  Over the bipartite graph of patterns and instances scores pass back
and forth a few times: a pattern's confidence in a kind is the score of its
instances against that and what tells against the kind (instances of another
kind, or of a form that the kind cannot have); an instance of which nothing is
known yet counts neither way.  An instance's score is one minus the product of
its confident patterns' doubts.  Instances next to a pattern of high
confidence, of the kind's form and outside the seeds' spans, are found as well.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, materialize, text_of
from keyloom.llm.spans import apart, joined, spans, tagged, when_has

# The kinds in their order, and their patterns (possessive where that changes no match, so that
# matching never backtracks far).
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of tokens that may be identifiers.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(+]?[0-9]\S*+)*+"

ROUNDS = 3
#: A pattern speaks with this confidence and with so many different seeds at least.
CONFIDENCE, SUPPORT = 0.8, 3
#: Known instances among all of a pattern, at least: what little is known of a crowd does not speak for it.
SHARE = 0.25
#: Letters and digits of a new identifier, at least and at most.
LEAST, MOST = 5, 64


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def add(s: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind."""
    def octets(s: Column) -> Column:
        return F.forall(F.split(s["match"], r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.right(x, F.lit(9)).try_cast("int"), F.lit(999)) <= 255))

    def digits(s: Column) -> Column:
        return F.regexp_replace(s["match"], "[^0-9]", "")

    def card(s: Column) -> Column:
        d = digits(s)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))

    return {
        "email": when_has(F.contains(text, F.lit("@")), spans(text, EMAIL)),
        "ip": when_has(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans(text, IP), octets)),
        "card": when_has(text.rlike(CARD), F.filter(spans(text, CARD), card)),
        "phone": when_has(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda s: F.length(digits(s)).between(10, 15))),
    }


def _word(words: Column, i: int) -> Column:
    """The i-th word (from the end, if negative), in lower case, its letters only; "^" where there is none."""
    w = F.regexp_replace(F.lower(F.try_element_at(words, F.lit(i))), r"[^\p{L}]", "")
    return F.coalesce(w, F.lit("^"))


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, patterns>> of the identifier-like runs and the words around them."""
    found = spans(text, CANDIDATE)
    pieces = F.split(text, CANDIDATE, -1)

    def around(s: Column, i: Column) -> Column:
        left = F.filter(F.split(F.right(F.get(pieces, i), F.lit(80)), r"\s+"), lambda w: w.rlike(r"\p{L}"))
        right = F.filter(F.split(F.left(F.get(pieces, i + 1), F.lit(80)), r"\s+"), lambda w: w.rlike(r"\p{L}"))
        a, b, c, d = _word(left, -2), _word(left, -1), _word(right, 1), _word(right, 2)
        head = F.regexp_extract(s["match"], r"^[^\p{L}\p{N}+@(]*+", 0)
        tail = F.regexp_extract(s["match"], r"(?<![^\p{L}\p{N})])[^\p{L}\p{N})]*+$", 0)
        value = F.lower(F.regexp_replace(s["match"], r"[^\p{L}\p{N}@]", ""))
        # a pattern names the word next to the instance, and the other one where there is one
        pats = F.array(F.when(b != "^", F.concat_ws(" ", F.lit("L"), a, b)), F.when((b != "^") & (c != "^"), F.concat_ws(" ", F.lit("B"), b, c)), F.when(c != "^", F.concat_ws(" ", F.lit("R"), c, d)))
        return F.struct((s["start"] + F.length(head)).alias("start"), (s["end"] - F.length(tail)).alias("end"), value.alias("value"), F.array_compact(pats).alias("patterns"))

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(found, around), lambda s: s["start"] < s["end"]))


def _meets(kind: str) -> Column:
    """Whether a span of the kind meets the candidate ``c``."""
    return F.exists("base", lambda s: (s["kind"] == kind) & (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))


def _fits(kind: str, value: Column) -> Column:
    """Whether an instance has a form that unseen identifiers of the kind may have: a name of letters foremost, or a number without any."""
    digits, letters = F.regexp_count(value, F.lit("[0-9]")), F.regexp_count(value, F.lit(r"\p{L}"))
    form = (letters > 0) & (letters >= digits) if kind == "email" else (digits >= LEAST) & (letters == 0) & ~F.contains(value, F.lit("@"))
    return F.length(value).between(LEAST, MOST) & form


def _against(kind: str) -> Column:
    """What tells against an instance being of the kind: its form, or its score in another kind."""
    others = F.greatest(*(F.col(k) for k in KINDS if k != kind))
    return (1 - F.col(kind)) * F.when(_fits(kind, F.col("value")), others).otherwise(1.0)


def find_pii(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, share: float = SHARE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found: one row per document.

    Counts and the digest are of the fixed patterns' spans; ``spans`` also has
    the ``n_found`` spans that contexts add (of the same kinds).  Null text: as
    empty.  Null ids and repeated rows: rows like any other.  Long texts are read
    whole.  Empty table: no rows.  Other columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    base = rows.select("doc_id", "_h", F.struct(*(v.alias(k) for k, v in base_spans(F.col("_t")).items())).alias("_s"), candidates(F.col("_t")).alias("cands"))
    kinds = {k: F.col(f"_s.{k}") for k in KINDS}
    seen = materialize(base.select("doc_id", "_h", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in kinds.items()), tagged(kinds).alias("base"), "cands"), "pii")

    places = seen.filter(F.size("cands") > 0).select("doc_id", "_h", "base", F.explode("cands").alias("c"))
    inside = {k: _meets(k) for k in KINDS}
    places = places.select("doc_id", "_h", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("value"), F.col("c.patterns").alias("patterns"),
                           *(v.cast("int").alias(k) for k, v in inside.items()), apart(F.col("c.start"), F.col("c.end"), F.col("base")).alias("free"))
    edges = places.select("value", F.explode("patterns").alias("pattern"), *KINDS).groupBy("pattern", "value").agg(*(F.max(k).alias(k) for k in KINDS))
    # patterns that ever speak have seeds enough, or get them from instances of other patterns that do
    edges = materialize(edges, "edges")
    scores = edges.groupBy("value").agg(*(F.max(k).cast("double").alias(k) for k in KINDS))
    strong = None
    for _ in range(rounds):
        means = edges.select("pattern", "value").join(scores, "value").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), *(F.round(F.sum(k), 6).alias(k) for k in KINDS), *(F.round(F.sum(_against(k)), 6).alias(f"not_{k}") for k in KINDS))
        sure = {k: F.col(k) / (F.col(k) + F.col(f"not_{k}")) for k in KINDS}
        speaks = {k: (F.col(k) >= support) & (sure[k] >= confidence) & (F.col(k) >= share * F.col("n")) for k in KINDS}
        strong = materialize(means.filter(reduce(Column.__or__, speaks.values())).select("pattern", *(F.when(speaks[k], sure[k]).otherwise(0.0).alias(k) for k in KINDS)), "strong")
        doubt = edges.select("pattern", "value", *(F.col(k).alias(f"_{k}") for k in KINDS)).join(strong, "pattern", "left").groupBy("value").agg(
            *(F.greatest(F.max(f"_{k}").cast("double"), F.round(1 - F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 - F.coalesce(k, F.lit(0.0)))))), 6)).alias(k) for k in KINDS))
        old, scores = scores, materialize(doubt, "scores")
        drop_table(old)
    best = reduce(lambda a, k: F.when(F.col(f"s.{k}") == F.greatest(*(F.col(f"s.{x}") for x in KINDS)), F.lit(k)).otherwise(a), reversed(KINDS), F.lit(None).cast("string"))
    new = places.filter("free").filter(F.length("value").between(LEAST, MOST)).select("doc_id", "_h", "start", "end", "value", F.explode("patterns").alias("pattern")).join(strong.select("pattern", F.struct(*KINDS).alias("s")), "pattern")
    fits = reduce(lambda a, k: F.when(F.col("kind") == k, _fits(k, F.col("value"))).otherwise(a), KINDS, F.lit(False))
    new = new.select("doc_id", "_h", "start", "end", "value", best.alias("kind")).filter(fits).distinct()
    nr = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    # a span named by several patterns of different kinds takes the first kind
    new = new.groupBy("doc_id", "_h", "start", "end").agg(F.min(F.struct(nr.alias("nr"), "kind")).alias("k"))
    extra = new.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", F.col("k.nr").alias("nr"), "end", F.col("k.kind").alias("kind"))).alias("more"))
    extra = extra.select(F.col("doc_id").alias("_i"), F.col("_h").alias("_g"), "more")
    out = seen.join(extra, seen["doc_id"].eqNullSafe(extra["_i"]) & (seen["_h"] == extra["_g"]), "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
                      F.when(F.col("more").isNull(), F.lit(0)).otherwise(F.size("more")).cast("long").alias("n_found"))
