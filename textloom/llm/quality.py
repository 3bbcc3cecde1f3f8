"""Quality scores by a sparse ensemble of rules over text statistics.

Statistics of whole texts are Spark columns. On a bounded sample of labelled rows the
driver grows a few shallow trees on bootstraps, reads each path off as a conjunction of
thresholds, weighs the conjunctions by logistic regression with an L1 penalty (proximal gradient) and keeps
those of non-zero weight. The rules compile into one Spark expression: scoring is a
projection, with neither Python nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: A rule: its weight and its tests (statistic, at most?, threshold).
Rule = tuple[float, tuple[tuple[str, bool, float], ...]]


def statistics(text: Column) -> dict[str, Column]:
    """Of a text that isn't null."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, " ")
    lines = F.split(text, "\n")

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / n

    return {
        "chars": F.length(text).cast("double"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "symbols": share("#$%&*@^~<>{}[]\\/_=+`"),
        "bars": share("|•·"),
        "cries": share("!?"),
        "stops": share(".,;:"),
        "word_chars": n / F.size(words),
        "new_words": F.size(F.array_distinct(words)) / F.size(words),
        "lines": F.size(lines).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            each = [values[s] <= t if under else values[s] > t for s, under, t in tests]
            total = total + F.when(reduce(lambda a, b: a & b, each), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, levels: list[np.ndarray], rng: np.random.Generator) -> list[tuple[tuple[int, bool, float], ...]]:
    """All paths from the root, inner ones too, of a tree that splits by Gini."""
    paths = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best = (0.0, 0, 0.0)
        p = y[rows].mean()
        whole = len(rows) * p * (1 - p)
        for f in rng.choice(x.shape[1], max(2, (x.shape[1] + 1) // 2), replace=False).tolist():
            # counts by threshold: a row falls under every threshold from its place on
            at = np.searchsorted(levels[f], x[rows, f], "left")
            n = np.cumsum(np.bincount(at, minlength=len(levels[f]) + 1))[:-1]
            ones = np.cumsum(np.bincount(at, y[rows], len(levels[f]) + 1))[:-1]
            rest, rest_ones = len(rows) - n, y[rows].sum() - ones
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = whole - np.where(n > 0, ones * (n - ones) / n, 0) - np.where(rest > 0, rest_ones * (rest - rest_ones) / rest, 0)
            gain[(n < least) | (rest < least)] = 0
            if len(gain) and gain.max() > best[0] + 1e-12:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float(levels[f][k]))
        if best[0] <= 1e-9:
            return
        under = x[rows, best[1]] <= best[2]
        split(rows[under], (*path, (best[1], True, best[2])))
        split(rows[~under], (*path, (best[1], False, best[2])))

    split(rng.integers(0, len(y), len(y)), ())
    return paths


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty on the weights (FISTA)."""
    n, m = z.shape
    mean = y.mean()
    bias = float(np.log(mean / (1 - mean)))
    w = v = np.zeros(m)
    b = vb = bias
    # largest curvature, by power iteration on [z, 1]
    u = np.ones(m + 1)
    for _ in range(30):
        r = z @ u[:-1] + u[-1]
        u = np.append(z.T @ r, r.sum())
        u /= np.linalg.norm(u)
    r = z @ u[:-1] + u[-1]
    size = 4 * n / max(float(r @ r), 1e-9) * 0.9
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(z @ v + vb, -40, 40))) - y
        new = v - size * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = vb - size * g.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b)


def fit_arrays(names: list[str], x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, penalty: float = 2e-4, seed: int = 5) -> Model:
    """With no rows or one class only: no rules, the bias from (ones + 1) / (rows + 2)."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if len(y) < 2 or y.min() == y.max():
        return Model((), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    levels = [np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 160))) for f in range(x.shape[1])]
    paths = list(dict.fromkeys(tuple(sorted(p)) for _ in range(trees) for p in grow(x, y, depth, max(2, len(y) // 500), levels, rng)))
    masks = [np.logical_and.reduce([x[:, f] <= t if under else x[:, f] > t for f, under, t in p]) for p in paths]
    once = {m.tobytes(): i for i, m in reversed(list(enumerate(masks)))}
    picked = sorted(once.values())
    z = np.stack([masks[i] for i in picked], 1).astype(np.float64) if picked else np.zeros((len(y), 0))
    w, bias = lasso(z, y, penalty, 400)
    rules = [(float(c), tuple((names[f], under, t) for f, under, t in paths[i])) for c, i in zip(w, picked) if abs(c) > 1e-6]
    return Model(tuple(rules), bias)


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> Model:
    """Learns labels.quality of the rows whose crc32(doc_id as text) mod 3 isn't 1, of at most
    `most_rows` labelled documents, those of the docs given whose doc_id hashes lowest. Rows with a null in doc_id
    or quality don't count; a null text counts as empty. Of the rows that share a doc_id, the one whose text hashes lowest
    counts; a doc_id with both labels counts once with each."""
    own = pick(labels, doc_id="doc_id", quality="quality").selectExpr("cast(doc_id as long) label_id", "cast(quality as double) quality")
    own = own.where(F.col("label_id").isNotNull() & F.col("quality").isin(0.0, 1.0) & ~held_out("label_id")).distinct()
    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    there = own.join(docs.select("doc_id"), own["label_id"] == docs["doc_id"], "left_semi")
    drawn = there.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(most_rows)
    values = statistics(F.col("text"))
    # at most most_rows pairs of numbers are broadcast
    found = docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["label_id"]).select("quality", "doc_id", F.xxhash64("text").alias("h"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("s"))
    seen = found.groupBy("doc_id", "quality").agg(F.min_by("s", "h").alias("s")).orderBy("doc_id", "quality").select("quality", "s.*").toPandas()
    return fit_arrays(list(values), seen[list(values)].to_numpy(float), seen["quality"].to_numpy(float))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: a projection.

    A null or empty text has the statistics of no characters and a score like any other. A null doc_id
    stays and isn't held out; repeated rows are scored each; no rows give none; other columns play no part.
    """
    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    values = statistics(F.col("text"))
    used = {s for _, tests in model.rules for s, _, _ in tests}
    known = docs.select("doc_id", *[values[s].alias(f"__{s}") for s in values if s in used])
    out = known.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score({s: F.col(f"__{s}") for s in used}).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score is at least that. The statistics are bound to a
    lambda's variable, so that the filter has each of them once and not once for each rule."""
    values = statistics(F.coalesce(F.col("text"), F.lit("")))
    bound = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    score = F.transform(bound, lambda s: model.score({n: s[n] for n in values}))
    return docs.where(F.element_at(score, 1) >= least)
