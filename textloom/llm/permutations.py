"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the distinct vectors. A vector stands for the order of its nearest pivots.

1. Every row is posted in the lists of its first `posts` pivots. A list is one block or, where it is long, several, and
   short lists share a block; a list's rows are dealt to its blocks in turn, so that many like vectors don't gather in one.
2. A query goes to the lists of its first pivots (a share `probe` of all) and to no others. A row that stands in
   several of these counts in the first alone.
3. A block keeps pivot inverted files: for each pivot the rows that have it among their `near` nearest, and at what
   place. A query walks the files of its own nearest pivots and sums up how far apart the places are (footrule
   distance; a pivot missing on one side counts as place `near`).
4. Rows whose footrule is at most that of the query's nearest share `rerank` of the pivots themselves, which are a
   sample of all rows, are reranked by the inner product on the original vectors. This bound is one for
   all blocks, so neither cores nor partitions change a result.
5. Queries that so found fewer than k rows, as in tables of few rows, are held against all rows of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .vectors import best, clean, matrices, met, spread

SCHEMA = "query_id long, vec_id long, score double"


def order(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Each row's `near` nearest pivots, nearest first."""
    near = min(near, len(pivots))
    score = -(x @ pivots.T)
    if near < len(pivots) // 4:
        some = np.argpartition(score, near - 1, axis=1)[:, :near]
        some.sort(axis=1)  # equal scores go by the pivot's number
        return np.take_along_axis(some, np.argsort(np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(score, axis=1, kind="stable")[:, :near]


class Files:
    """Pivot inverted files of some rows."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows_n, self.near = orders.shape
        by = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.places = (by // self.near).astype(np.int32), (by % self.near).astype(np.int32)
        self.starts = np.searchsorted(orders.ravel()[by], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Of every row to the query's order, less what all rows share."""
        a, b = self.starts[query], self.starts[query + 1]
        n = b - a
        ends = np.cumsum(n)
        at = np.repeat(a - ends + n, n) + np.arange(ends[-1])
        own, place = self.places[at], np.repeat(np.arange(len(query), dtype=np.int32), n)
        return np.bincount(self.rows[at], np.abs(own - place) + own + place - 2 * self.near, self.rows_n)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors get equal scores."""
    return (vectors * query).sum(1)


def top(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k nearest, ties to the smaller id."""
    if len(ids) > k:
        rough = vectors @ query
        keep = rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())
        ids, vectors = ids[keep], vectors[keep]
    score = exact(vectors, query)
    at = np.lexsort((ids, -score))[:k]
    return ids[at], score[at]


def _batch(out: list[tuple[int, np.ndarray, np.ndarray]]):
    import pyarrow as pa

    ids, scores = (np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in (1, 2))
    names = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.float64))], names=["query_id", "vec_id", "score"])


def drawn_pivots(rows: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Of each vector length, the `pivots` distinct vectors whose hashes are lowest."""
    found: dict[int, np.ndarray] = {}
    hashed = rows.select(F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h"), "embedding")
    for (dim,) in hashed.select("dim").distinct().orderBy("dim").toLocalIterator():
        own = hashed.where(F.col("dim") == dim)
        lowest = own.select("h").distinct().orderBy("h").limit(pivots)
        one = own.join(F.broadcast(lowest), "h").groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy("h")  # at most `pivots` rows
        found[dim] = np.array([r[0] for r in one.select("embedding").collect()])
    return found


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, pivots: int = 1024, near: int = 64, posts: int = 2, probe: float = 0.375, rerank: float = 0.15, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row (vec_id divisible by `every`) its k
    nearest found by inner product, all if fewer.

    Pivots: the `pivots` distinct vectors of each length whose hashes are lowest. Rows with a
    null vec_id, a null, empty or zero vector or one with null or non-finite components take no
    part; vectors are held against those of their own length. Ties go to the smaller vec_id; rows that repeat
    rank each, repeated query rows once for each distinct vector. No rows give none; other columns play no part.
    """
    rows = clean(vectors).where(F.exists("embedding", lambda x: x != 0))
    spark = rows.sparkSession
    queries = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "embedding"]), "asked")
    drawn = drawn_pivots(rows, pivots)
    first, total = {}, 0
    for dim, p in drawn.items():  # a list for each pivot of each length
        first[dim], total = total, total + len(p)
    sent = spark.sparkContext.broadcast((drawn, first))

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivots_, starts = sent.value
        turn = 0
        for batch in batches:
            for a, b, x in matrices(batch, 1):
                own, dim = order(x, pivots_[x.shape[1]], posts), x.shape[1]
                part = batch.slice(a, b - a)
                for m in range(own.shape[1]):
                    lists, turns = own[:, m] + starts[dim], np.arange(turn, turn + b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(np.full(b - a, m, np.int32)), pa.array(turns), part.column(0), part.column(1)], names=["list", "mark", "turn", "id", "embedding"])
                turn += b - a

    posted = stored(rows.select("vec_id", "embedding").mapInArrow(post, "list int, mark int, turn long, id long, embedding array<double>"), "posted")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).toLocalIterator()}  # a row for each list
    place, filled, number = np.zeros((total, 2), np.int32), 0, 0  # a list's first block and how many it has
    for dim, p in drawn.items():
        for i in range(first[dim], first[dim] + len(p)):
            n = sizes.get(i, 0)
            if filled and filled + n > block:
                number, filled = number + 1, 0
            if n > block:
                place[i], number = (number, -(-n // block)), number - (-n // block)
            else:
                place[i], filled = (number, 1), filled + n
        number, filled = number + (filled > 0), 0  # lists of one length share no block with another's
    table = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(place)], "list int, first int, blocks int")
    blocks = posted.join(table, "list").select((F.col("first") + F.pmod("turn", F.col("blocks"))).cast("int").alias("block"), "mark", "id", "embedding")
    routes = spark.sparkContext.broadcast(place)

    def probes(n: int) -> int:
        return int(np.ceil(probe * n))

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivots_, starts = sent.value
        for batch in batches:
            for a, b, x in matrices(batch, 1):
                p = pivots_[x.shape[1]]
                lists = order(x, p, probes(len(p))) + starts[x.shape[1]]
                goes = [np.unique(np.concatenate([np.arange(f, f + n) for f, n in np.unique(routes.value[own], axis=0).tolist()])) for own in lists]
                at = pa.array(np.repeat(np.arange(a, b), [len(g) for g in goes]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(goes).astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["block", "mark", "id", "embedding"])

    asked = queries.select("vec_id", "embedding").mapInArrow(route, "block int, mark int, id long, embedding array<double>")
    sample: dict[int, Files] = {}  # the files of the pivots themselves, in a worker

    def index(ids, marks, x):
        p = sent.value[0][x.shape[1]]
        orders = order(x, p, near)
        if x.shape[1] not in sample:
            sample[x.shape[1]] = Files(order(p, p, near), len(p))
        return ids, marks, x, orders, Files(orders, len(p))

    def ask(made, ids, _, x):
        row_ids, marks, vectors_, orders, files = made
        p = sent.value[0][x.shape[1]]
        n, out = probes(len(p)), []
        full = order(x, p, max(near, n))
        for q_id, q, own in zip(ids.tolist(), x, full):
            probed = np.zeros(len(p), bool)
            probed[own[:n]] = True
            here = probed[orders[:, :posts]]  # of a row's posts, those whose lists are probed; the first counts
            counts = here[np.arange(len(marks)), marks] & ~(here & (np.arange(here.shape[1]) < marks[:, None])).any(1)
            bound = np.partition(sample[x.shape[1]].footrule(own[:near]), most := max(0, int(np.ceil(rerank * len(p))) - 1))[most]
            at = np.flatnonzero(counts & (files.footrule(own[:near]) <= bound) & (row_ids != q_id))
            out.append((q_id, *top(row_ids[at], vectors_[at], q, k)))
        yield _batch(out)

    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by = [F.col("score").desc(), F.col("vec_id")]
    found = stored(best(met(blocks, asked, max(1, number), index, ask, SCHEMA), k, by), "found")
    discard(posted)

    # queries left with fewer than k
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = stored(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "embedding"), "few")
    discard(queries)
    if few.isEmpty():
        discard(few)
        return found
    whole, where, count = spread(rows, block)
    rest = few.join(where, F.size("embedding") == F.col("dim")).select(F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"), F.lit(0).alias("mark"), F.col("vec_id").alias("id"), "embedding")

    def ask_all(made, ids, _, x):
        row_ids, vectors_ = made
        yield _batch([(q_id, *top(row_ids[own := row_ids != q_id], vectors_[own], q, k)) for q_id, q in zip(ids.tolist(), x)])

    more = best(met(whole, rest, count, lambda ids, _, x: (ids, x), ask_all, SCHEMA), k, by)
    return found.join(few, found["query_id"] == few["vec_id"], "left_anti").unionByName(more)
