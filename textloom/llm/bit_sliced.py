"""Exact top-k by a bit-sliced index over quantised vectors.

A component x becomes floor(scale * x). A block of rows keeps, for each attribute, the
bits of its values above the attribute's least as bitmaps over the rows, one slice for each bit.

A query's score is a sum of its components times the attributes. With a component in
signed digits (no two neighbours set), each digit adds the attribute's slices, shifted, or takes
them away (adds their complement and a constant). All bitmaps of one weight are reduced
by full adders, three to a sum and a carry, until each weight has one: the
score's slices. From the most significant slice downward, rows are kept while at least k
remain above; what is left ties at the boundary.

The `coarse` lowest bits of the attributes are left out of the sums, so a score lies in a
known interval; every row whose interval reaches the k-th row's is resolved by its exact integer
product, ties to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, clean, met, spread

SCHEMA = "query_id long, vec_id long, score long"


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold each such integer exactly. A product beyond the doubles is an error."""
    with np.errstate(over="ignore"):
        out = np.floor(x * float(scale))
    if not np.isfinite(out).all():
        raise OverflowError("a quantised component is beyond the range of a double")
    return out


def signed_digits(v: int) -> list[tuple[int, int]]:
    """(bit, sign) whose sum is v, no two neighbouring bits."""
    out, bit = [], 0
    while v:
        if v & 1:
            d = 2 - (v & 3)
            out.append((bit, d))
            v -= d
        v >>= 1
        bit += 1
    return out


def added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight -> one bitmap for each weight from 0, their sum."""
    words = next(iter(columns.values()))[0].shape[-1]
    top, w, out = max(columns), 0, []
    carried: list[np.ndarray] = []
    while w <= top or carried:
        stack = [np.stack(columns[w])] if columns.get(w) else []
        stack += carried
        now = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        carried = []
        while len(now) > 1:
            m = len(now) // 3
            if m:
                a, b, c = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                now = np.concatenate([x ^ c, now[3 * m :]])
            else:
                a, b = now[:1], now[1:]
                carried.append(a & b)
                now = a ^ b
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        w += 1
    return out


def highest(slices: list[np.ndarray], k: int, rows: int) -> np.ndarray:
    """The k-th largest sum's prefix: a mask of the rows with sums at least the k-th largest."""
    def count(b):
        return int(np.bitwise_count(b).sum())

    sure, maybe = np.zeros_like(slices[0]), _ones(rows, len(slices[0]))
    need = min(k, rows)
    for s in reversed(slices):
        one = maybe & s
        n = count(one)
        if n >= need:
            maybe = one
        else:
            sure |= one
            need -= n
            maybe &= ~s
    return sure | maybe


def _ones(rows: int, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[:rows] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _values(slices: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for w, s in enumerate(slices):
        out += (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
    return out


class Index:
    """The slices of a block of quantised rows."""

    def __init__(self, values: np.ndarray, coarse: int):
        self.values, self.rows = values, len(values)
        words = -(-self.rows // 64)
        self.low, self.words = values.min(0), words
        above = (values - self.low).astype(np.uint64)
        bits = max(1, int(above.max()).bit_length())
        self.coarse = min(coarse, bits - 1)
        self.slices = []  # by attribute: array (bits, words) of the bits kept
        for d in range(values.shape[1]):
            planes = (above[:, d] >> np.arange(self.coarse, bits, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
            padded = np.zeros((len(planes), words * 64), np.uint8)
            padded[:, : self.rows] = planes
            self.slices.append(np.packbits(padded, axis=1, bitorder="little").view(np.uint64))
        self.lost = (1 << self.coarse) - 1

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(q * (kept part >> coarse)) plus a constant that makes it positive."""
        columns: dict[int, list[np.ndarray]] = {}
        shift = 0
        for q, planes in zip(query.tolist(), self.slices):
            for bit, sign in signed_digits(q):
                for p, plane in enumerate(planes):
                    columns.setdefault(bit + p, []).append(plane if sign > 0 else ~plane)
                    shift += (1 << (bit + p)) if sign < 0 else 0
        self.shift = shift
        return added(columns) if columns else [np.zeros(self.words, np.uint64)]

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k with the highest products, in order."""
        slices = self.sums(query)
        bits = highest(slices, k, self.rows)
        picked = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.rows])
        # the k-th row's sum, less what the bits left out may make of any row
        slack = -(-self.lost * int(np.abs(query).sum()) >> self.coarse) + 1 if self.coarse else 0
        if not slack or len(picked) >= self.rows:
            return picked
        kth = int(_values(slices, picked).min())
        return np.flatnonzero(np.unpackbits(self.at_least(slices, max(0, kth - slack)).view(np.uint8), bitorder="little")[: self.rows])

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Mask of the rows whose sum is at least the bound, from the highest slice down."""
        if bound >> len(slices):
            return np.zeros(self.words, np.uint64)
        more, same = np.zeros(self.words, np.uint64), _ones(self.rows, self.words)
        for w in range(len(slices) - 1, -1, -1):
            if bound >> w & 1:
                same = same & slices[w]
            else:
                more |= same & slices[w]
                same = same & ~slices[w]
        return more | same


def _exact(values: np.ndarray, query: np.ndarray) -> list[int]:
    """Products by integers of any size; one that no long holds is an error."""
    q = [int(x) for x in query.tolist()]
    out = [sum(a * int(b) for a, b in zip(q, row)) for row in values.tolist()]
    if any(not -(1 << 63) <= v < 1 << 63 for v in out):
        raise OverflowError("a score is beyond the range of a long")
    return out


class Block:
    """A block's ids, the bit-sliced index of its rows, and apart from it those with components beyond +-limit."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int, coarse: int):
        values = quantised(vectors, scale)
        self.limit = 1 << (62 - values.shape[1].bit_length()) // 2  # so that sums of products stay within 62 bits
        wide = (np.abs(values) > self.limit).any(1)
        self.ids, self.wide_ids, self.wide = ids[~wide], ids[wide], values[wide]
        self.index = Index(values[~wide].astype(np.int64), coarse) if len(self.ids) else None

    def find(self, q_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k highest, best first, without the query's own id."""
        found: list[tuple[int, int]] = []
        if self.index and (np.abs(query) > self.limit).any():
            keep = self.ids != q_id
            found += zip(_exact(self.index.values[keep], query), self.ids[keep].tolist())
        elif self.index:
            q = query.astype(np.int64)
            at = self.index.candidates(q, k + int((self.ids == q_id).sum()))
            at = at[self.ids[at] != q_id]
            score = self.index.values[at] @ q
            top = np.lexsort((self.ids[at], -score))[:k]
            found += zip(score[top].tolist(), self.ids[at[top]].tolist())
        if len(self.wide):
            keep = self.wide_ids != q_id
            found += zip(_exact(self.wide[keep], query), self.wide_ids[keep].tolist())
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, coarse: int = 4, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products for each query row
    (vec_id divisible by `every`), all if fewer.

    Rows with a null vec_id, a null or empty vector or one with null or non-finite components take no part; vectors
    are held against those of their own length. Equal scores rank by vec_id. A vec_id that repeats as a
    candidate ranks once for each row; repeated query rows are one query for each distinct vector,
    ranked together. Components of any finite size are exact: large ones are multiplied as integers of any
    size, and a score that a long can't hold is an error. No rows give none; other columns play no part.
    """
    rows = clean(vectors)
    blocks, place, count = spread(rows, block)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "embedding"])
    # every row is a candidate, so every query goes to every block of its length
    asked = queries.join(place, F.size("embedding") == F.col("dim")).select(F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"), F.lit(0).alias("mark"), F.col("vec_id").alias("id"), "embedding")

    def index(ids, _, x):
        return Block(ids, x, scale, coarse)

    def ask(made, ids, _, x):
        import pyarrow as pa

        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for q_id, q in zip(ids.tolist(), quantised(x, scale)):
            got = made.find(q_id, q, k)
            out["query_id"] += [q_id] * len(got)
            out["vec_id"] += [v for _, v in got]
            out["score"] += [s for s, _ in got]
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return best(met(blocks, asked, count, index, ask, SCHEMA), k, [F.col("score").desc(), F.col("vec_id")])
