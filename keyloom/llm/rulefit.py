"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are Spark columns.  On a bounded sample of labelled
rows small boosted trees are grown; each path from a root is a rule, a
conjunction of thresholds on statistics; a lasso logistic regression keeps a
few of the rules and weighs them; the result is compiled into one Spark column
expression, so scoring is a projection of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, text_of

#: Labelled rows that training takes at most (those of the least hashes of their ids).
MAX_TRAIN = 12_000
TREES, DEPTH, CUTS, SHRINK = 30, 3, 24, 0.3
SEED = 5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, none null; of an empty text all are 0 but for the shares of distinct items."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    pieces = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: F.trim(w) != "")
    words = F.greatest(F.size(pieces), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("double")
    stops = F.length(F.regexp_replace(text, r"[^.,;:?]+", "")).cast("double")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("double")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("double")
    digits = F.length(F.regexp_replace(text, r"[^0-9]+", "")).cast("double")
    return {
        "n_words": words, "n_lines": n_lines, "words_per_line": words / n_lines, "word_length": letters / words,
        "letter_share": letters / n, "upper_share": upper / F.greatest(letters, F.lit(1.0)), "digit_share": digits / n,
        "mark_share": marks / n, "odd_mark_share": (marks - stops) / n, "stops_per_word": stops / words,
        "distinct_words": F.size(F.array_distinct(pieces)) / words, "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "short_words": F.size(F.filter(pieces, lambda w: F.length(w) <= 3)) / words,
        "ended_lines": F.size(F.filter(lines, lambda w: w.rlike(r"[.!?]\s*$"))) / n_lines,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        cond = F.lit(True)
        for name, above, cut in self.terms:
            cond = cond & (F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut))
        return F.when(cond, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The score in 0..1, over columns named as the statistics."""
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + r.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], cols: np.ndarray, depth: int, path: tuple, out: list) -> list[tuple[np.ndarray, float]]:
    """Grow one tree on gradients; paths go to ``out``, leaves (rows, value) come back."""
    leaf = [(rows, float(-g[rows].sum() / (h[rows].sum() + 1.0)))]
    if depth == 0 or len(rows) < 20:
        return leaf
    whole, top = g[rows].sum() ** 2 / (h[rows].sum() + 1), (1e-6, 0, 0.0)
    for c in cols:
        v = x[rows, c]
        at = np.searchsorted(cuts[c], v, side="left")
        gs = np.cumsum(np.bincount(at, weights=g[rows], minlength=len(cuts[c]) + 1))
        hs = np.cumsum(np.bincount(at, weights=h[rows], minlength=len(cuts[c]) + 1))
        ns = np.cumsum(np.bincount(at, minlength=len(cuts[c]) + 1))
        if len(cuts[c]) == 0:
            continue
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
        gain[(ns[:-1] < 8) | (ns[-1] - ns[:-1] < 8)] = -1
        i = int(gain.argmax())
        if gain[i] > top[0]:
            top = (float(gain[i]), int(c), float(cuts[c][i]))
    if top[0] <= 1e-6:
        return leaf
    _, c, cut = top
    leaves = []
    for above in (False, True):
        sub = rows[(x[rows, c] > cut) == above]
        here = (*path, (c, above, cut))
        out.append(here)
        leaves += _grow(x, g, h, sub, cuts, cols, depth - 1, here, out)
    return leaves


def _tidy(path: tuple) -> tuple:
    """One threshold for each statistic and side: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for c, above, cut in path:
        old = best.get((c, above))
        best[c, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple(sorted((c, above, cut) for (c, above), cut in best.items()))


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, w: np.ndarray, b: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    v = np.ones(r.shape[1]) / max(1, r.shape[1]) ** 0.5
    for _ in range(12):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (0.25 * (np.linalg.norm(r @ v) ** 2 + n) / n * 1.05 + 1e-9)
    wz, bz, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ wz + bz, -40, 40))) - y
        nw = wz - step * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * strength, 0)
        nb = bz - step * e.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wz, bz = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def train(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = SEED) -> RuleModel:
    """Fit the ensemble; with no rows or one class only, a constant score."""
    p = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
    bias = float(np.log(p / (1 - p)))
    if len(y) < 40 or y.min() == y.max():
        return RuleModel(bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.02, 0.98, CUTS))) for c in range(x.shape[1])]
    cuts = [q[q < x[:, c].max()] for c, q in enumerate(cuts)]
    f, paths = np.full(len(y), bias), []
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), size=max(40, len(y) // 2), replace=False) if len(y) > 80 else np.arange(len(y)))
        cols = np.sort(rng.choice(x.shape[1], size=max(2, x.shape[1] * 2 // 3), replace=False))
        start = len(paths)
        _grow(x, prob - y, prob * (1 - prob), rows, cuts, cols, DEPTH, (), paths)
        # leaves are applied to all rows, not only those sampled
        seen = {p for p in paths[start:]}
        for path in [p for p in paths[start:] if not any(len(q) > len(p) and q[: len(p)] == p for q in seen)]:
            m = np.ones(len(y), dtype=bool)
            for c, above, cut in path:
                m &= (x[:, c] > cut) == above
            s = rows[m[rows]]
            f[m] += SHRINK * float(-(prob[s] - y[s]).sum() / ((prob[s] * (1 - prob[s])).sum() + 1.0))
    rules = sorted({_tidy(p) for p in paths})
    r = np.ones((len(y), len(rules)), dtype=np.float32)
    for j, path in enumerate(rules):
        for c, above, cut in path:
            r[:, j] *= (x[:, c] > cut) == above
    mean, sd = r.mean(axis=0), r.std(axis=0) + 1e-6
    z = ((r - mean) / sd).astype(np.float64)
    held = rng.random(len(y)) < 0.2
    w, b, losses = np.zeros(len(rules)), bias, []
    for strength in (0.03, 0.015, 0.008, 0.004, 0.002, 0.001):  # warm starts down the path
        w, b = _lasso(z[~held], y[~held], strength, w, b, 120)
        q = np.clip(1 / (1 + np.exp(-(z[held] @ w + b))), 1e-6, 1 - 1e-6)
        losses.append((float(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean()) if held.any() else 0.0, strength))
    # the strongest penalty that loses next to nothing against the best: fewest rules
    enough = min(x for x, _ in losses) * 1.05 + 0.005
    w, b = _lasso(z, y, next(s for x, s in losses if x <= enough), np.zeros(len(rules)), bias, 400)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    named = [Rule(tuple((names[c], above, float(cut)) for c, above, cut in rules[j]), float(w[j] / sd[j])) for j in keep]
    return RuleModel(float(b - (w[keep] * mean[keep] / sd[keep]).sum()), named)


def may_train(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 3, is not 1.  A null id: none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most ``max_rows`` labelled ids.

    Null labels and ids are left out; of a repeated label the least counts, of
    the texts of a repeated id that of the least statistics.
    """
    picked = labels.filter(may_train(F.col(id_col)) & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label).cast("double").alias("_y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(picked), "_id")  # max_rows at most
    stats = statistics(F.col("_t"))
    names = list(stats)
    rows = found.select("_id", "_y", *(v.alias(k) for k, v in stats.items())).groupBy("_id").agg(F.min(F.struct("_y", *names)).alias("_r"))
    got = rows.select("_id", "_r.*").toPandas().sort_values("_id", kind="stable")  # max_rows at most
    return train(got[names].to_numpy(float), (got["_y"].to_numpy(float) > 0).astype(float), names)


def scored(docs: DataFrame, model: RuleModel, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score (0..1) in a column ``out``; other columns as they are."""
    stats = statistics(text_of(text_col))
    tmp = fresh(docs, "_stats")
    wide = docs.withColumn(tmp, F.struct(*(v.alias(k) for k, v in stats.items())))
    names = {k: fresh(docs, f"_stat_{k}") for k in stats}
    wide = wide.select(*docs.columns, *(F.col(f"{tmp}.{k}").alias(v) for k, v in names.items()))
    renamed = RuleModel(model.bias, [Rule(tuple((names[n], a, c) for n, a, c in r.terms), r.weight) for r in model.rules])
    return wide.withColumn(out, renamed.score()).drop(*names.values())


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored like any other (their statistics are 0);
    long texts are scored whole.  A null id has held_out false.  Repeated rows
    are scored alike; rows of one id each by its text.  Without usable labels
    every score is the same.  An empty table gives no rows.  Other columns are
    not read.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **kw)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(plain, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    s = fresh(docs, "_score")
    return scored(docs, fit_quality(docs, labels, **kw), s).filter(F.col(s) >= 0.5).drop(s)
