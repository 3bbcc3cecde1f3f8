"""Byte-pair encoding over characters, as string replacement.

A token is one character: those of the texts stand for themselves, merged ones are private-use characters.
Replacing a pair's two characters by the new one, from left to right, is then Spark's replace(). Over whole tables
the same is done on arrays of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = 0xF0000
#: The id that ends a text in a block, and a block's size in characters.
_END, BLOCK = 0xFFFF, 1 << 18
#: Share of neighbouring tokens that a round of merges may bring to the driver, as distinct runs with their numbers.
ROUND = 0.35
#: The most distinct runs that the driver takes; where there are more, the round has a smaller share.
RUNS = 200_000


@dataclass(frozen=True)
class Bpe:
    chars: tuple[str, ...]
    merges: tuple[tuple[str, str, str], ...]  # first, second, new

    @property
    def vocabulary(self) -> list[str]:
        text = {c: c for c in self.chars}
        for a, b, n in self.merges:
            text[n] = text[a] + text[b]
        return list(text.values())

    def encode(self, x: Column) -> Column:
        """A text's tokens as one string; a character that training hasn't seen is the first of the vocabulary."""
        known = "".join(f"\\x{{{ord(c):x}}}" for c in self.chars)
        out = F.regexp_replace(x, f"(?s)[^{known}]", F.regexp_replace(F.lit(self.chars[0]), r"([\\$])", r"\\$1"))
        for a, b, n in self.merges:
            out = F.replace(out, F.lit(a + b), F.lit(n))
        return out

    def ids(self, tokens: Column) -> Column:
        place = {t: i for i, t in enumerate([*self.chars, *[m[2] for m in self.merges]])}
        look = F.create_map(*[F.lit(v) for kv in place.items() for v in kv])
        return F.transform(F.filter(F.split(tokens, ""), lambda t: t != ""), lambda t: F.element_at(look, t))

    def decode(self, tokens: Column) -> Column:
        out = tokens
        for a, b, n in reversed(self.merges):
            out = F.replace(out, F.lit(n), F.lit(a + b))
        return out


def analysis(spark: SparkSession, tok: Bpe, text: str) -> dict:
    """A text's ids and pieces, their numbers, characters by token (null without tokens), and the pieces in a row."""
    row = spark.range(1).select(tok.ids(tok.encode(F.lit(text))).alias("ids")).first()
    pieces = [tok.vocabulary[i] for i in row["ids"]]
    return {"ids": row["ids"], "pieces": pieces, "n_chars": len(text), "n_tokens": len(pieces), "ratio": len(text) / len(pieces) if pieces else None, "segmentation": " | ".join(pieces)}


def pair_counts(rows: DataFrame) -> DataFrame:
    """(id, tokens) -> a, b, n, first: neighbouring tokens with their number and first place, counted on the map side."""
    chars = F.filter(F.split("tokens", ""), lambda t: t != "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1_000_000_000), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    spread = rows.select("id", F.posexplode(pairs).alias("pos", "p")).where("p.b is not null")
    return spread.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))


def _merged(x: np.ndarray, a: int, b: int, new: int, *, keep: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray | None]:
    """Ids with each (a, b) from left to right as one; keep: also which of the old ids have gone on."""
    at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
    if a == b and len(at):  # of a run's overlapping pairs every second one
        begins = np.r_[True, np.diff(at) != 1]
        at = at[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
    if not len(at):
        return (x, None) if keep else x
    stays = np.ones(len(x), bool)
    stays[at + 1] = False
    x = x.copy()
    x[at] = new
    return (x[stays], stays) if keep else x[stays]


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _over_blocks(f: Callable[[list, np.ndarray], Iterator[dict]], schema: str) -> Callable:
    arrow = _arrow(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                for out in f(ids, np.frombuffer(pa.decompress(data, size, "zstd"), np.uint16)):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return run


def _packed(ids: list, x: np.ndarray) -> dict:
    import pyarrow as pa

    return {"ids": [ids], "size": [2 * len(x)], "data": [pa.compress(x.tobytes(), "zstd", asbytes=True)]}


_PACKED = "ids array<long>, size int, data binary"


def _blocks(rows: DataFrame, chars: tuple[str, ...]) -> DataFrame:
    """(id, text) -> blocks of texts as ids of their characters."""

    arrow = _arrow(_PACKED)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(0x110000, np.uint16)
        table[[ord(c) for c in chars]] = np.arange(len(chars))
        ids, parts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = table[np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)]
                ids.append(i)
                parts += [x, np.array([_END], np.uint16)]
                size += len(x)
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pydict(_packed(ids, np.concatenate(parts)), schema=arrow)
                    ids, parts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict(_packed(ids, np.concatenate(parts)), schema=arrow)

    return rows.selectExpr("cast(id as long) id", "text").mapInArrow(read, _PACKED)


def _counted(blocks: DataFrame, v: int) -> np.ndarray:
    """Numbers of neighbouring ids, at a * v + b."""

    def count(ids: list, x: np.ndarray) -> Iterator[dict]:
        inside = (x[:-1] != _END) & (x[1:] != _END)
        n = np.bincount((x[:-1].astype(np.int64) * v + x[1:])[inside], minlength=1)
        yield {"p": (p := np.flatnonzero(n)), "n": n[p]}

    out = np.zeros(v * v, np.int64)
    for r in blocks.mapInArrow(_over_blocks(count, "p long, n long"), "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["p"]] = r["n"]
    return out


def _runs(blocks: DataFrame, linked: np.ndarray, v: int) -> DataFrame:
    """run, n, id, pos: the longest runs whose neighbours are all linked, with their number and first place."""
    schema = "run binary, n long, id long, pos long"

    def cut(ids: list, x: np.ndarray) -> Iterator[dict]:
        ends = np.flatnonzero(x == _END)
        link = np.zeros(len(x) + 1, bool)
        inside = np.flatnonzero((x[:-1] != _END) & (x[1:] != _END))
        link[1 + inside] = linked[x[inside].astype(np.int64) * v + x[inside + 1]]
        # link[i]: x[i - 1] and x[i] are linked
        start, stop = np.flatnonzero(~link[:-1] & link[1:]), np.flatnonzero(link[:-1] & ~link[1:]) + 1
        size = stop - start
        out = {"run": [], "n": [], "id": [], "pos": []}
        for k in np.unique(size):
            s = start[size == k]
            rows = np.ascontiguousarray(x[s[:, None] + np.arange(k)])
            _, first, n = np.unique(rows.view(np.dtype((np.void, 2 * int(k)))).ravel() if k > 4 else _words(rows), return_index=True, return_counts=True)
            out["run"] += [rows[i].tobytes() for i in first]
            out["n"] += n.tolist()
            # a block's texts needn't be in order of their ids: the least (id, pos) of each run
            text = np.searchsorted(ends, s)
            at = s - np.r_[0, ends[:-1] + 1][text]
            if any(a > b for a, b in zip(ids, ids[1:])):
                key = rows.view(np.dtype((np.void, 2 * int(k)))).ravel() if k > 4 else _words(rows)
                order = np.lexsort((at, np.array(ids)[text]))
                _, place = np.unique(key[order], return_index=True)
                first = order[place]
            out["id"] += [ids[t] for t in text[first]]
            out["pos"] += at[first].tolist()
        yield out

    rows = blocks.mapInArrow(_over_blocks(cut, schema), schema)
    return rows.groupBy("run").agg(F.sum("n").alias("n"), F.min(F.struct("id", "pos")).alias("first")).select("run", "n", "first.id", "first.pos")


def _taken(rows: DataFrame, most: float) -> list[tuple] | None:
    """All rows, or None if there are more than so many."""
    out = []
    for r in rows.toLocalIterator():
        if len(out) >= most:
            return None
        out.append(tuple(r))
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of up to four ids as one number each."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = out << np.uint64(16) | rows[:, k].astype(np.uint64)
    return out


def _round(runs: list[tuple], least: int, v: int, known: int, size: int) -> list[tuple[int, int]]:
    """The merges that have at least so many places, in order, by the runs alone."""
    x = np.frombuffer(b"".join(bytes(r[0]) + b"\xff\xff" for r in runs), np.uint16)
    lengths = np.array([len(r[0]) // 2 + 1 for r in runs])
    n = np.repeat(np.array([r[1] for r in runs], np.float64), lengths)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    id_ = np.repeat(np.array([r[2] for r in runs], np.int64), lengths)
    pos = np.repeat(np.array([r[3] for r in runs], np.int64), lengths) + np.arange(len(x)) - begin
    merges: list[tuple[int, int]] = []
    while known < size and len(x) > 1:
        inside = np.flatnonzero((x[:-1] != _END) & (x[1:] != _END))
        pairs = x[inside].astype(np.int64) * v + x[inside + 1]
        counts = np.bincount(pairs, n[inside], minlength=1)
        most = counts.max()
        if most < least:
            break
        tied = np.flatnonzero(counts == most)
        at = inside[np.isin(pairs, tied)] if len(tied) > 1 else inside[pairs == tied[0]][:1]
        at = at[np.lexsort((pos[at], id_[at]))[0]]
        a, b = int(x[at]), int(x[at + 1])
        merges.append((a, b))
        x, stays = _merged(x, a, b, known, keep=True)
        n, id_, pos = n[stays], id_[stays], pos[stays]
        known += 1
    return merges


def train(rows: DataFrame, size: int) -> Bpe:
    """(id, text) -> merges of the most frequent pair, the first seen on ties, until the vocabulary has `size` tokens.

    Merges are found in rounds. A pair never has more places than the neighbours that it is made of had at the round's start, so
    the merges of at least `least` places only need the runs of neighbours with as many: their distinct ones reach the driver.
    """

    def letters(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0):
                found |= set(text.as_py() or "")
        yield pa.RecordBatch.from_pydict({"c": sorted(found)}, schema=pa.schema([("c", pa.string())]))

    chars = tuple(sorted(r[0] for r in rows.select("text").mapInArrow(letters, "c string").distinct().toLocalIterator()))
    if len(chars) >= size:
        return Bpe(chars, ())
    if size > _END:
        raise ValueError(f"a vocabulary of {size}: at most {_END}")
    merges: list[tuple[int, int]] = []
    blocks, found = _blocks(rows, chars), []
    while len(chars) + len(merges) < size:
        start = len(chars) + len(merges) - len(found)

        def move(ids: list, x: np.ndarray, found=tuple(found), start=start) -> Iterator[dict]:
            for k, (a, b) in enumerate(found):
                x = _merged(x, a, b, start + k)
            yield _packed(ids, x)

        blocks = (blocks.mapInArrow(_over_blocks(move, _PACKED), _PACKED) if found else blocks).checkpoint()
        counts = _counted(blocks, size)
        if not counts.any():
            break
        ranked = np.sort(counts[counts > 0])[::-1]
        runs, share = None, ROUND
        while runs is None:
            least = int(ranked[max(0, int(np.searchsorted(np.cumsum(ranked), share * ranked.sum(), "right")) - 1)])
            # the most frequent pairs alone are runs of one pair or of one token, whatever the input
            runs = _taken(_runs(blocks, counts >= least, size), RUNS if least < ranked[0] else float("inf"))
            share /= 2
        found = _round(runs, least, size, len(chars) + len(merges), size)
        merges += found
    tokens = [*chars, *[chr(_OWN + k) for k in range(len(merges))]]
    return Bpe(chars, tuple((tokens[a], tokens[b], tokens[len(chars) + k]) for k, (a, b) in enumerate(merges)))


def encoded(rows: DataFrame, bpe: Bpe) -> DataFrame:
    """(id, text) -> (id, text, tokens, back): the tokens that encode() gives, and the text of them that decode() gives."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, tokens string, back string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = [*bpe.chars, *[m[2] for m in bpe.merges]]
        place, words = {t: i for i, t in enumerate(tokens)}, bpe.vocabulary
        merges = [(place[a], place[b], place[n]) for a, b, n in bpe.merges]
        codes, table = np.array([ord(t) for t in tokens], np.uint32), np.zeros(0x110000, np.uint16)
        table[codes[: len(bpe.chars)]] = np.arange(len(bpe.chars))
        for batch in batches:
            ids, texts, out, back = batch.column(0), batch.column(1), [], []
            at = 0
            while at < len(texts):  # texts side by side, up to a block's size
                group, size = [], 0
                while at < len(texts) and size < BLOCK:
                    group.append(texts[at].as_py())
                    size += len(group[-1] or "")
                    at += 1
                x = np.concatenate([p for t in group for p in (table[np.frombuffer((t or "").encode("utf-32-le"), np.uint32)], np.array([_END], np.uint16))])
                for m in merges:
                    x = _merged(x, *m)
                ends = np.flatnonzero(x == _END)
                for t, i, j in zip(group, np.r_[0, ends[:-1] + 1], ends):
                    own = x[i:j]
                    out.append(None if t is None else codes[own].tobytes().decode("utf-32-le"))
                    back.append(None if t is None else "".join(map(words.__getitem__, own.tolist())))
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(out, pa.string()), pa.array(back, pa.string())], names=["id", "text", "tokens", "back"])

    return rows.select("id", "text").mapInArrow(run, schema)
