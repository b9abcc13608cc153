"""Secret scan with corpus-wide ownership frequency.

Fixed patterns find assignments, access keys and long hex strings; opaque
tokens (long, of mixed letters and digits) are candidates besides.  Every
candidate's value is hashed, and over the whole corpus the distinct
repositories and owners that hold the hash are counted.  A value of many
owners, or in very many repositories, is a widely copied example; one of a
single owner in few repositories is live-looking.
Opaque tokens of one owner are added to the spans.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, text_of
from keyloom.llm.spans import apart, joined, located, spans, tagged, when_has

# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
#: Kind of the spans that ownership adds, and their pattern.
OPAQUE_KIND = "opaque"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: A value of so many owners at least is an example; of at most so many it is live-looking.
EXAMPLE_OWNERS, LIVE_OWNERS = 3, 1
#: A value in so many repositories is an example even under one owner.
EXAMPLE_REPOS = 100


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; an assignment's ``match`` is its value."""
    whole = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    put = F.zip_with(located(whole, F.split(text, ASSIGN, -1)), value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("match")))
    return {
        "assign": when_has(text.rlike(r"(?i)passw|secret|token|api_?key"), F.filter(put, lambda s: F.length(s["match"]) >= 6)),
        "access": when_has(F.contains(text, F.lit("AKIA")), F.filter(spans(text, ACCESS), lambda s: F.length(s["match"]) >= 20)),
        "hex": when_has(text.rlike(HEX), spans(text, HEX)),
    }


def opaque_spans(text: Column, tags: Column) -> Column:
    """Long tokens with a digit, a capital and a small letter, outside the given spans."""
    mixed = spans(text, OPAQUE)
    return when_has(text.rlike(OPAQUE), F.filter(mixed, lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]") & apart(s["start"], s["end"], tags)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
                 live_owners: int = LIVE_OWNERS, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repos: one row per document.

    The owner of a document is its source; its repository, unless a column is
    named, the document itself.  Counts and the digest are of the fixed
    patterns' spans; ``spans`` also has opaque tokens that look live.  A value is
    an example if ``example_owners`` or ``example_repos`` hold it, and looks live
    if at most ``live_owners`` do and it is no example; ``n_live`` and
    ``n_example`` count the document's different values of each sort.
    ``most_owners`` and ``most_repos`` are the most that hold one of its values
    (0 without any); a repository counts once, whoever owns it.

    Null text: as empty.  A null owner or id is an owner or repository of its own.
    Repeated rows count once for ownership.  Long texts are read whole.  Empty
    table: no rows.  Other columns are not read.
    """
    text = text_of(text_col)
    repo = F.col(repo_col or id_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"), F.xxhash64(text).alias("_h"),
                       F.coalesce(F.concat(F.lit("s"), F.col(owner_col).cast("string")), F.lit("n")).alias("_owner"), F.coalesce(F.concat(F.lit("s"), repo), F.lit("n")).alias("_repo"))
    kinds = {k: F.col(f"_s.{k}") for k in KINDS}
    found = rows.withColumn("_s", F.struct(*(v.alias(k) for k, v in base_spans(F.col("_t")).items()))).withColumn("base", tagged(kinds))
    values = F.array_distinct(F.transform(F.concat(*kinds.values(), F.col("opaque")), lambda s: F.sha2(s["match"].cast("binary"), 256)))
    found = found.withColumn("opaque", opaque_spans(F.col("_t"), F.col("base"))).select(
        "doc_id", "_h", "_owner", "_repo", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in kinds.items()), "base",
        F.transform("opaque", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["match"].cast("binary"), 256).alias("value"))).alias("opaque"), values.alias("values"))
    seen = materialize(found, "secrets")

    held = seen.filter(F.size("values") > 0).select("doc_id", "_h", "_owner", "_repo", F.explode("values").alias("value"))
    # distinct by steps, each combined before its shuffle: (value, holder), then value
    def holders(col: str, out: str) -> DataFrame:
        return held.groupBy("value", col).agg(F.lit(1).alias("one")).groupBy("value").agg(F.count(F.lit(1)).alias(out))

    owned = materialize(holders("_owner", "owners").join(holders("_repo", "repos"), "value"), "owned")
    judged = held.select("doc_id", "_h", "value").distinct().join(owned, "value")
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    live = (F.col("owners") <= live_owners) & ~example
    by_doc = judged.groupBy("doc_id", "_h").agg(
        F.sum(live.cast("long")).alias("n_live"), F.sum(example.cast("long")).alias("n_example"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"), F.collect_set(F.when(live, F.col("value"))).alias("live"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_i", "_h": "_g"})
    out = seen.join(by_doc, seen["doc_id"].eqNullSafe(by_doc["_i"]) & (seen["_h"] == by_doc["_g"]), "left")
    more = F.transform(F.filter("opaque", lambda s: F.array_contains(F.coalesce("live", F.array().cast("array<string>")), s["value"])),
                       lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("nr"), s["end"].alias("end"), F.lit(OPAQUE_KIND).alias("kind")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      joined(F.array_sort(F.concat("base", more))).alias("spans"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repos")))
