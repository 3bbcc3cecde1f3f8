"""Vectors in numbered blocks, met by queries.

Rows and queries carry the number of a block. Each block is one partition's, sorted so that its rows come first and
its queries stream past them: a block's rows are sent once, however many queries it gets, a task holds one
block at a time, and each query leaves at most k rows there. The merge keeps a query's k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Partitions at most; beyond it, several blocks share one, one after the other.
MOST_PARTITIONS = 20_000
MET = "block int, asks boolean, mark int, id long, embedding array<double>"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: vec_id and embedding not
    null, no null, NaN or infinite component, at least one component."""
    rows = pick(vectors, vec_id="vec_id", embedding="embedding").selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def matrices(batch, at: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of an Arrow batch whose vectors, in column `at`, have one length: first, end, vectors."""
    col = batch.column(at)
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield a, b, flat[offsets[a] : offsets[b]].reshape(b - a, -1)


def met(rows: DataFrame, queries: DataFrame, count: int, index: Callable, ask: Callable, schema: str) -> DataFrame:
    """rows and queries: (block int from 0 below count, mark int, id long, embedding), one vector length in a block.

    index(ids, marks, vectors) makes what is kept of a block's rows; ask(index, ids, marks, vectors) yields Arrow
    batches for some of its queries.
    """

    def work(batches: Iterator) -> Iterator:
        at, held, made = None, [], None
        for batch in batches:
            block, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            mark, ids = (batch.column(k).to_numpy() for k in (2, 3))
            edges = set((np.flatnonzero((np.diff(block) != 0) | (asks[1:] != asks[:-1])) + 1).tolist())
            for first, end, x in matrices(batch, 4):
                cuts = [first, *sorted(e for e in edges if first < e < end), end]
                for a, b in zip(cuts, cuts[1:]):
                    own = (ids[a:b], mark[a:b], x[a - first : b - first])
                    if block[a] != at:
                        at, held, made = block[a], [], None
                    if not asks[a]:
                        held.append(tuple(v.copy() for v in own))
                        continue
                    if made is None and held:
                        made = index(*(np.concatenate(v) for v in zip(*held)))
                        held = []
                    if made is not None:
                        yield from ask(made, *own)

    sides = [df.select("block", F.lit(asks).alias("asks"), F.col("mark").cast("int").alias("mark"), "id", "embedding") for df, asks in ((rows, False), (queries, True))]
    dealt = sides[0].union(sides[1]).repartitionById(max(1, min(count, MOST_PARTITIONS)), F.col("block")).sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(work, schema)


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k of each query_id in `order`, ranked from 1."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), *[c for c in found.columns if c != "query_id"])


def spread(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with a block number, dealt evenly by a running count within each task so that repeated rows don't gather;
    (dim, first, blocks) of each vector length; and how many blocks there are. `size`: rows in a block, about."""
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim")
    table, total = [], 0
    for r in dims.toLocalIterator():  # a row for each vector length
        table.append((r["dim"], total, -(-r["n"] // size)))
        total += table[-1][2]
    place = rows.sparkSession.createDataFrame(table, "dim int, first int, blocks int")
    turn = F.monotonically_increasing_id()  # partition << 33 | row
    numbered = rows.withColumn("turn", turn.bitwiseAND((1 << 33) - 1) + F.xxhash64(F.shiftright(turn, 33)).bitwiseAND(0xFFFFF)).withColumn("dim", F.size("embedding"))
    blocked = numbered.join(place, "dim").withColumn("block", (F.col("first") + F.pmod("turn", F.col("blocks"))).cast("int"))
    return blocked.select("block", F.lit(0).alias("mark"), F.col("vec_id").alias("id"), "embedding"), place, total
