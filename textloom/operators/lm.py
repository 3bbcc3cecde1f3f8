"""Language-model data and sampling: windows, splits, top-k chances, and a small network for inference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(rows: DataFrame, length: int) -> DataFrame:
    """rows with an array `ids` -> start (from 1), x and y, so many ids each, in place of ids: all windows, y moved on by one.
    A window is cut where it is used, so that counting windows cuts none."""
    starts = F.when(F.size("ids") > length, F.sequence(F.lit(1), F.size("ids") - length)).otherwise(F.array().cast("array<int>"))
    spread = rows.select("*", F.explode(starts).alias("start"))
    return spread.withColumns({"x": F.slice("ids", F.col("start"), length), "y": F.slice("ids", F.col("start") + 1, length)}).drop("ids")


def is_training(pos: Column, n: Column, share: float = 0.9) -> Column:
    """Whether the id at a position (from 0) of n is of the training part."""
    return pos < F.floor(n * share)


def top_k_chances(logits: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """(id, token, logit) -> chance of the k highest logits of each id; what ties with the k-th stays."""
    own = Window.partitionBy("id")
    rows = logits.withColumn("logit", F.col("logit") / temperature).withColumn("rank", F.rank().over(own.orderBy(F.desc("logit")))).where(F.col("rank") <= k)
    weight = F.exp(F.col("logit") - F.max("logit").over(own))
    return rows.withColumn("w", weight).select("id", "token", (F.col("w") / F.sum("w").over(own)).alias("chance"))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def gelu(u: np.ndarray) -> np.ndarray:
    """u times the normal distribution's share below it, which is within 1e-7 of the true one (a rational approximation of the
    error function, Abramowitz and Stegun 7.1.26)."""
    x = np.abs(u) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return u * 0.5 * (1 + np.sign(u) * (1 - tail))


def generated(prompts: DataFrame, model: Transformer, count: int, *, temperature: float = 1.0, k: int | None = None, seed: int = 0) -> DataFrame:
    """(id, ids) -> (id, ids): so many ids sampled after each prompt, which is not empty; a row's draws follow from the seed and its id."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [model.generate(p, count, temperature=temperature, k=k, seed=[seed, abs(i)]) for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    return prompts.selectExpr("cast(id as long) id", "cast(ids as array<int>) ids").mapInArrow(work, "id long, ids array<int>")


def experiments(temperatures: DataFrame, tops: DataFrame) -> DataFrame:
    """(temperature) and (top_k) tables -> every pair of them, a few rows each."""
    return temperatures.crossJoin(F.broadcast(tops))


def as_markdown(rows: list[tuple], header: list[str]) -> str:
    """A table of a few rows in Markdown."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(header), "|" + "-|" * len(header), *map(line, rows)]) + "\n"


class Transformer:
    """Inference of a pre-norm transformer in numpy: weights by name, learned positions, tied output. A layer may have a
    bias, named as its weights with .b after it."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int, causal: bool = True):
        self.w, self.heads, self.causal = weights, heads, causal
        self.layers = sum(name.endswith(".qkv") for name in weights)

    @classmethod
    def random(cls, vocabulary: int, length: int, width: int, heads: int, layers: int, seed: int = 0, causal: bool = True) -> Transformer:
        rng = np.random.default_rng(seed)

        def some(*shape):
            return rng.normal(0, 0.02, shape)

        w = {"tokens": some(vocabulary, width), "places": some(length, width), "out": np.ones(width)}
        for i in range(layers):
            w |= {f"{i}.qkv": some(width, 3 * width), f"{i}.proj": some(width, width), f"{i}.up": some(width, 4 * width), f"{i}.down": some(4 * width, width), f"{i}.one": np.ones(width), f"{i}.two": np.ones(width)}
        return cls(w, heads, causal)

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * self.w[name] + self.w.get(f"{name}.b", 0.0)

    def _layer(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[name] + self.w.get(f"{name}.b", 0.0)

    def attention(self, x: np.ndarray, layer: int) -> np.ndarray:
        n, d = x.shape
        q, k, v = (m.reshape(n, self.heads, -1).transpose(1, 0, 2) for m in np.split(self._layer(x, f"{layer}.qkv"), 3, 1))
        score = q @ k.transpose(0, 2, 1) / np.sqrt(d / self.heads)
        if self.causal:
            score = np.where(np.tril(np.ones((n, n), bool)), score, -np.inf)
        p = np.exp(score - score.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        return self._layer((p @ v).transpose(1, 0, 2).reshape(n, d), f"{layer}.proj")

    def logits(self, ids: list[int]) -> np.ndarray:
        return self.hidden(ids) @ self.w["tokens"].T

    def loss(self, ids: list[int]) -> float:
        """Mean cross-entropy of each id given those before it."""
        z = self.logits(ids[:-1])
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), ids[1:]]))

    def hidden(self, ids: list[int]) -> np.ndarray:
        x = self.w["tokens"][ids] + self.w["places"][: len(ids)]
        for i in range(self.layers):
            x = x + self.attention(self._norm(x, f"{i}.one"), i)
            h = self._layer(self._norm(x, f"{i}.two"), f"{i}.up")
            x = x + self._layer(gelu(h), f"{i}.down")
        return self._norm(x, "out")

    def generate(self, prompt: list[int], count: int, *, temperature: float = 1.0, k: int | None = None, seed: int = 0) -> list[int]:
        """Sampled ids after the prompt, of whose ids the last that fit are seen."""
        rng, length = np.random.default_rng(seed), len(self.w["places"])
        seen, out = list(prompt), []
        for _ in range(count):
            z = self.logits(seen[-length:])[-1] / temperature
            if k is not None:
                z = np.where(z < np.sort(z)[-min(k, len(z))], -np.inf, z)
            p = np.exp(z - z.max())
            out.append(int(rng.choice(len(p), p=p / p.sum())))
            seen.append(out[-1])
        return out
