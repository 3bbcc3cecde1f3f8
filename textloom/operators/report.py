"""The annotation report: its tables by Spark, its page on the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annotation as A
from . import lotes

#: Labels in the order in which they are shown, and edges of kappa's classes (fixed values).
LABELS, EDGES = ["o", "pi", "pc", "li", "lc"], [0.2, 0.4, 0.6, 0.8]
#: How many of the worst and best sentences and of the best covered files are shown (fixed values).
WORST, BEST, COVERED = 6, 5, 15


def tables(pairs: DataFrame, coverage: DataFrame | None = None, report: DataFrame | None = None) -> dict[str, DataFrame]:
    """(lote, sentence, pos, a, b) -> the report's tables, each of a few rows: totals; agreement by lote and over all, each sentence weighing the
    same; classes of kappa; the worst and best sentences; labels of either side and merged, with their shares of all and of those
    beside o; entities by kind; the confusion; and the files with most entities."""
    merged = A.merged(pairs.withColumn("sentence", F.concat_ws("/", "lote", "sentence")))
    per = A.kappa(pairs.select("lote", "sentence", "a", "b"), ["lote", "sentence"])
    sides = merged.select(F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("merged")), F.array("a", "b", "label"))).alias("side", "label"))
    labels = sides.groupBy("side").pivot("label", LABELS).agg(F.count(F.lit(1))).fillna(0)
    total, own = sum((F.col(x) for x in LABELS), F.lit(0)), sum((F.col(x) for x in LABELS[1:]), F.lit(0))
    k = F.coalesce("kappa", F.lit(0.0))
    low = [None, *EDGES]
    classes = [F.count_if((F.lit(True) if a is None else k >= a) & (F.lit(True) if b is None else k < b)).alias(f"{a or 0:.1f}-{b or 1:.1f}") for a, b in zip(low, [*EDGES, None])]
    out = {
        "totals": per.agg(F.count("*").alias("sentences"), F.sum("n").alias("units"), F.avg("kappa").alias("kappa"), F.avg("agreement").alias("agreement"), F.sum(F.round(F.col("n") * (1 - F.col("agreement")))).cast("long").alias("disagreements")),
        "agreement": report if report is not None else per.rollup("lote").agg(F.count("*").alias("sentences"), F.avg("kappa").alias("kappa"), F.avg("agreement").alias("agreement")).orderBy(F.col("lote").asc_nulls_last()),
        "kappa": per.agg(*classes),
        "worst": per.orderBy(k, "lote", "sentence").limit(WORST),
        "best": per.orderBy(k.desc(), "lote", "sentence").limit(BEST),
        "labels": labels.select("side", *LABELS, F.round(100 * own / total, 2).alias("entity_pct")).orderBy("side"),
        "shares": labels.select("side", *[F.round(100 * F.try_divide(F.col(x), own), 2).alias(x) for x in LABELS[1:]]).orderBy("side"),
        "entities": lotes.entity_counts(merged).orderBy("type"),
        "confusion": pairs.groupBy("a").pivot("b", LABELS).agg(F.count(F.lit(1))).fillna(0).orderBy("a"),
    }
    if coverage is not None:
        out["coverage"] = coverage.orderBy(F.desc("entity_pct"), "file").limit(COVERED)
    return out


def of_files(spark: SparkSession, annotations: str, assignments: list[str]) -> dict[str, DataFrame]:
    """The tables of annotators' files: the parts _p1, _p2, ... in the order of their assignments."""
    from ..sources import files

    records, lots, pairs = files.annotations(spark, annotations), {}, None
    for part, path in enumerate(assignments, 1):
        sentences, own = files.assignments(spark, path)
        rows = lotes.annotations(records.where(F.col("part") == part).select("file", "pos", "clave", "valor"), sentences, own)
        states = lotes.pairs(rows, own)
        both = lotes.side_by_side(rows, states)
        lots[f"parte{part}"] = states, lotes.details(both)
        each = both.select(F.lit(f"parte{part}").alias("lote"), "sentence", "pos", "a", "b")
        pairs = each if pairs is None else pairs.unionByName(each)
    name = F.concat_ws("/", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1))
    return tables(pairs, lotes.coverage(records.withColumn("file", name)), lotes.report(lots).orderBy(F.col("lote").asc_nulls_last()))


def _cell(v) -> str:
    return html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))


def _bars(names: list[str], values: list[float]) -> str:
    most = max([*values, 1e-9])
    rows = "".join(f'<text x="0" y="{18 * i + 13}">{_cell(n)}</text><rect x="110" y="{18 * i + 2}" width="{300 * max(0.0, v) / most:.1f}" height="13"/><text x="{115 + 300 * max(0.0, v) / most:.1f}" y="{18 * i + 13}">{_cell(v)}</text>' for i, (n, v) in enumerate(zip(names, values)))
    return f'<svg width="520" height="{18 * len(names) + 4}" font-size="12" fill="#456">{rows}</svg>'


def page(found: dict[str, DataFrame], title: str = "Anotación") -> str:
    """The tables, which have a few rows each, as a page: figures, bars, a heat map and rankings."""
    parts = [f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><style>td,th{{padding:2px 8px;text-align:right}}.kpi{{display:inline-block;margin:8px;padding:8px 16px;border:1px solid #ccc}}.kpi b{{display:block;font-size:22px}}</style><h1>{html.escape(title)}</h1>"]
    for name, df in found.items():
        rows, columns = df.collect(), df.columns
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if name == "totals":
            parts += [f"<div class=kpi><b>{_cell(v)}</b>{html.escape(c)}</div>" for c, v in rows[0].asDict().items()]
            continue
        if name == "kappa":
            parts.append(_bars(columns, [float(v) for v in rows[0]]))
            continue
        shade = max([v for r in rows for v in r[1:]] or [1]) if name == "confusion" else 0
        style = lambda v: f' style="background:rgba(60,110,170,{min(1.0, (v / shade) ** 0.35):.2f})"' if shade and isinstance(v, int) else ""
        body = "".join("<tr>" + "".join(f"<td{style(v)}>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>{body}</table>")
        if name in ("entities", "coverage", "labels"):
            value = {"entities": "n", "coverage": "entity_pct", "labels": "entity_pct"}[name]
            parts.append(_bars([str(r[0]) for r in rows], [float(r[value]) for r in rows]))
    return "".join(parts)
