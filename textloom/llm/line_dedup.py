"""Removal of lines that many documents repeat.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased.
Keys of at least `least_chars` code points in at least `least_docs` documents
lose their lines everywhere but in the largest doc_id that holds them.

1. Each task marks its documents' key hashes in two Bloom filters, once-seen and
   twice-seen (two positions for each hash). It hands on the positions set, as compressed
   gaps by slice of the filter, and each slice is merged apart:
   twice = twice of either side, or once of both.
2. Only lines whose hash is in the twice-seen filter are suspects. They alone shuffle,
   with their text, and are counted exactly, pre-aggregated on the map side, so that a
   line in a third of all documents is a few rows for each task. A doc_id in several rows counts once: the suspects of
   such ids, which are few or none, are made distinct first.
3. Of the confirmed keys the `most_sent` commonest reach the documents as a broadcast, the others, none of which is
   common then, through joins.

The filters have 16 bits for each line, `most_bits` at most: the broadcast has that
bound, and beyond it the filter lets more lines through to the exact count, with the same result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, pick, sliced, spare, stored

#: Stripped from a line's ends for its key (fixed value).
BLANKS = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bits of a slice of the filter.
SLICE = 1 << 23


def key(line: str) -> str:
    line = line.strip(BLANKS)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def _keys(texts, least: int) -> tuple[np.ndarray, np.ndarray, object, object]:
    """Of an Arrow column of texts without nulls, the keys of at least so many code points: whose row and which line (counted over all
    rows) each is of, the keys, and the lines by row as lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines = cut.flatten()
    at = np.flatnonzero(pc.binary_length(lines).to_numpy() >= least)  # no key has more code points than its line has bytes
    keys = pc.ascii_lower(pc.ascii_trim(lines.take(pa.array(at)), characters=BLANKS))
    long = pc.greater_equal(pc.utf8_length(keys), least)
    at, keys = at[long.to_numpy(zero_copy_only=False)], keys.filter(long)
    ends = np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)
    return np.searchsorted(ends, at, "right"), at, keys, cut


def _hashes(keys) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys.to_pylist()), np.uint64, len(keys))


def _once(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first of each pair of row and hash."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    return np.sort(order[np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))]) if len(order) else order


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each hash, as rows."""
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)], 1).astype(np.int64)


def _mark(bits: int, least: int):
    """Documents -> (slice, once, twice) of a task, as compressed gaps."""

    def packed(at: np.ndarray) -> bytes:
        return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare()
        seen, again = [], []

        def fold(parts: list[np.ndarray], twice: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            # each array holds a position once for each key that has it
            at, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return at, np.union1d(at[n > 1], np.concatenate(twice) if twice else np.zeros(0, np.int64))

        held = 0
        for batch in sliced(batches, 0):
            rows, _, keys, _ = _keys(batch.column(0), least)
            h = _hashes(keys)
            seen.append(_positions(h[_once(rows, h)], bits).ravel())
            held += len(seen[-1])
            if held > 4_000_000:
                once, twice = fold(seen, again)
                seen, again, held = [once], [twice], 0
        once, twice = fold(seen, again)
        for s in np.unique(once // SLICE).tolist():
            a, b = (x[np.searchsorted(x, s * SLICE) : np.searchsorted(x, (s + 1) * SLICE)] - s * SLICE for x in (once, twice))
            yield pa.RecordBatch.from_pydict({"slice": [s], "once": [packed(a)], "twice": [packed(b)]}, schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return work


def _merge(batches: Iterator) -> Iterator:
    """Rows of _mark in order of slice -> (slice, the twice-seen bitmap)."""
    import pyarrow as pa

    def out(s, twice):
        return pa.RecordBatch.from_pydict({"slice": [s], "bitmap": [zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("bitmap", pa.binary())]))

    at, once, twice = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != at:
                if at is not None:
                    yield out(at, twice)
                at, once, twice = row["slice"], np.zeros(SLICE, bool), np.zeros(SLICE, bool)
            a, b = (np.cumsum(np.frombuffer(zlib.decompress(row[c]), "<u4")) for c in ("once", "twice"))
            twice[b] = True
            twice[a[once[a]]] = True
            once[a] = True
    if at is not None:
        yield out(at, twice)


def twice_seen(docs: DataFrame, least: int, most_bits: int) -> tuple[bytes, int]:
    """The twice-seen filter over the column text, and its size in bits."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = max(SLICE, min(most_bits, 1 << max(0, 16 * int(lines) - 1).bit_length()))
    slices = bits // SLICE
    parts = docs.select("text").mapInArrow(_mark(bits, least), "slice int, once binary, twice binary")
    merged = parts.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, bitmap binary")
    whole = bytearray(bits // 8)
    for s, b in merged.toLocalIterator():
        whole[s * SLICE // 8 : (s + 1) * SLICE // 8] = zlib.decompress(b)
    return bytes(whole), bits


def _suspects(sent, bits: int, least: int):
    """(doc_id, own, text) -> (doc_id, own, key) of the lines that the filter has."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare()
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in sliced(batches, 2):
            rows, _, keys, _ = _keys(batch.column(2), least)
            h = _hashes(keys)
            p = _positions(h, bits)
            hit = np.flatnonzero((bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(1))
            hit = hit[_once(rows[hit], h[hit])]
            of = pa.array(rows[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), keys.take(pa.array(hit)).cast(pa.string())], names=["doc_id", "own", "key"])

    return work


def _array(values: list[str]):
    import pyarrow as pa

    return pa.array(values, pa.string())


def _digest(k: str) -> bytes:
    return hashlib.blake2b(k.encode(), digest_size=16).digest()


def _cleaned(batches: Iterator, least: int, loses, carried: int) -> Iterator:
    """loses: which keys' lines go, from the batch, the keys' rows and the keys. The `carried` columns after
    doc_id and text come last. Only the texts that lose lines are put together anew."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in sliced(batches, 1):
        texts = batch.column(1)
        rows, at, keys, cut = _keys(texts, least)
        gone = loses(batch, rows, keys)
        rows, at = rows[gone], at[gone]
        sizes = cut.value_lengths().to_numpy().astype(np.int64)
        begin, lost = np.cumsum(sizes) - sizes, {}
        for r, i in zip(rows.tolist(), (at - begin[rows]).tolist()):
            lost.setdefault(r, set()).add(i)
        changed = np.zeros(len(texts), bool)
        changed[list(lost)] = True
        left = ["\n".join(x for i, x in enumerate(cut[r].as_py()) if i not in lost[r]) for r in sorted(lost)]
        kept = pc.replace_with_mask(texts, pa.array(changed), pa.array(left, texts.type)) if lost else texts
        arrays = [batch.column(0), pa.array(sizes), pa.array(np.bincount(rows, minlength=len(texts)).astype(np.int64)), kept.cast(pa.string())]
        more = range(2, 2 + carried)
        yield pa.RecordBatch.from_arrays(arrays + [batch.column(k) for k in more], names=["doc_id", "n_lines", "n_dropped", "kept", *[batch.schema.names[k] for k in more]])


def dedup_lines(docs: DataFrame, *, carry: tuple[str, ...] = (), least_chars: int = 40, least_docs: int = 5, most_bits: int = 1 << 31, most_sent: int = 1_000_000) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the text left) for each row, then the columns in `carry`.

    A null or empty text is one empty line. Rows that repeat a doc_id count as one document, and those of the doc_id
    that keeps a key all keep it. A row without a doc_id counts as none and keeps no repeated key; it
    stays, with doc_id null. No rows give none. Other columns play no part.
    A text that loses all lines becomes empty.
    """
    spark = docs.sparkSession
    names = [f"carried_{i}" for i in range(len(carry))]
    docs = pick(docs, doc_id="doc_id", text="text", **dict(zip(names, carry))).selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text", *names)
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc_id", "n_lines", "n_dropped")], T.StructField("kept", T.StringType()), *docs.select(names).schema.fields])
    bitmap, bits = twice_seen(docs, least_chars, most_bits)
    sent = spark.sparkContext.broadcast(bitmap)
    # a text's hash tells rows of one doc_id, or of none, apart, so that what a row loses is no more than its own lines
    owned = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    every = owned.mapInArrow(_suspects(sent, bits, least_chars), "doc_id long, own long, key string")
    suspects = every.where("doc_id is not null").select("doc_id", "key")
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("id")), "again")
    counted = [F.count("*").alias("n"), F.max("doc_id").alias("keeper")]
    if again.isEmpty():
        found = suspects.groupBy("key").agg(*counted)
    else:
        marked = suspects.join(again, F.col("doc_id") == F.col("id"), "left")
        each = marked.where("id is null").groupBy("key").agg(*counted)
        once = marked.where("id is not null").select("key", "doc_id").distinct().groupBy("key").agg(*counted)
        found = each.union(once).groupBy("key").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    found = stored(found.where(F.col("n") >= least_docs), "lines")
    discard(again)
    many = found.count() > most_sent
    top = found.orderBy(F.desc("n"), "key").limit(most_sent) if many else found
    # a digest, a number and a hash for each key: at most most_sent times 32 bytes
    sent_keys = [(r["key"], r["keeper"]) for r in top.select("key", "keeper").toLocalIterator()]
    small = spark.sparkContext.broadcast(({_digest(k): d for k, d in sent_keys}, np.unique(_hashes(_array([k for k, _ in sent_keys])))))
    if many:
        rest = found.join(top.select("key"), "key", "left_anti").select("key", "keeper")
        held = every.join(rest, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        lost = held.groupBy(F.col("doc_id").alias("at"), "own").agg(F.collect_set("key").alias("lost"))
        hashed = docs.withColumn("hash", F.xxhash64("text"))
        docs = hashed.join(lost, hashed["doc_id"].eqNullSafe(lost["at"]) & (F.col("hash") == F.col("own")), "left").select("doc_id", "text", *names, "lost")
    else:
        discard(found)

    def clean(batches: Iterator) -> Iterator:
        spare()
        keeper, hashes = small.value

        def loses(batch, rows: np.ndarray, keys) -> np.ndarray:
            h = _hashes(keys)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            out = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            ids = batch.column(0)
            for i in np.flatnonzero(out).tolist():
                d = keeper.get(_digest(keys[i].as_py()))
                out[i] = d is not None and d != ids[int(rows[i])].as_py()
            if many:
                own = batch.column(batch.num_columns - 1)
                for r in np.unique(rows).tolist():
                    if held := set(own[r].as_py() or ()):
                        for i in np.flatnonzero(rows == r).tolist():
                            out[i] = out[i] or keys[i].as_py() in held
            return np.flatnonzero(out)

        yield from _cleaned(batches, least_chars, loses, len(carry))

    return docs.mapInArrow(clean, schema).toDF("doc_id", "n_lines", "n_dropped", "kept", *carry)
