"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

A document's set holds its distinct shingles of `words` words (A-Z lower-cased, words
are runs of anything but [\\x20\\x09-\\x0D]; a shorter text is one shingle), as 64-bit hashes. Documents
whose sets have 100 * intersection >= percent * union are linked; a component is what links reach.

1. One pass over the texts gives each document its set's size and fingerprint, its MinHash
   samples folded into `bands` band keys, and its odd sketch: each sample flips one bit, so that the
   XOR of two sketches has a bit set for about each sample that differs.
2. Documents of equal sets are a class, found by a pre-aggregated grouping; from here on
   only one of each class plays, so copies never meet in pairs.
3. Star round: each band bucket's smallest id is its leader; the others are candidates with
   it. A bucket of any size gives one row for each member. Candidates whose sketches rule
   the similarity out go; the rest are confirmed on full sets.
4. Rest round, over the buckets that still hold several components. In those of at most SMALL members, the members
   of all but the commonest component meet the others in a join, with the sketch test inside. Larger ones are narrowed first: a
   shingle that only one of their documents has can be in no intersection, so a document's other shingles bound its
   similarity to all it shares a large bucket with; those that the bound keeps under the threshold leave the large
   buckets, again and again, as the fewer left have fewer shingles in common. Those that stay get a sketch of eight times the
   samples and meet in blocks of bounded size, where numpy makes both tests. What is already linked makes no pairs, and no pair is
   left untried that shares a bucket and may be similar enough.
5. Drawn rounds, before large buckets' members meet: while more than twice as many pairs are left there as members shared a
   bucket, large buckets draw another leader, and between two components the likeliest candidate is confirmed. Large groups whose
   members lie about the threshold grow together here, at a row for each member. `most_rounds` at most, and no further
   one once a round leaves more than half of the pairs.
6. Components by least label over the confirmed links, with pointer jumping; each step
   is written to the shared folder.

Pairs are confirmed where the second one's set lies; an id in very many pairs, such as the leader of a large group, has its set
sent in as many copies as its pairs fill parts of PART.

With five samples in a band and 44 bands, a pair of similarity 0.75 shares no bucket once in
150,000. A sketch test lets a pair through unless its sketches differ in more bits than all but MISS
of the pairs just at the threshold do (by the exact tail, at most one pair in 3,400,000 is missed).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, pick, sliced, spare, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split, but not between words here (fixed values).
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Longs of an odd sketch, and how many times its samples and longs the rest round's has.
LONGS, FINE = 16, 8
#: Pairs of one id, or members of a bucket, that a task takes at a time.
PART = 2000
#: Members of a bucket that meet as they are.
SMALL = 16
#: The most of the pairs just at the threshold that the sketch test may miss: what lies beyond 5 deviations.
MISS = 2.867e-7


class Hashes(dict):
    """64-bit hashes of words; starts anew when it holds too many."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, known: Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    got = WORD.findall(low) if _ODD.search(low) else low.split()
    if not got:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, got), np.uint64, len(got))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out ^ h[k : len(h) - n + 1 + k]) + np.uint64(k + 1)
    return np.unique(out)


class Signer:
    def __init__(self, bands: int, rows: int, longs: int = LONGS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, 64 * longs
        self.mul = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.place = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each permutation."""
        low = (hashes >> np.uint64(20)).astype(np.uint32)
        best = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 512):  # so that a step stays in the cache
            x = low[i : i + 512] * self.mul[:, None] + self.add[:, None]
            x ^= x >> np.uint32(15)
            np.minimum(best, x.min(1), out=best)
        return best

    def keys(self, samples: np.ndarray) -> np.ndarray:
        x = np.arange(1, self.bands + 1, dtype=np.uint64)
        for part in samples.reshape(self.bands, self.rows).T:
            x = _mixed(x ^ part.astype(np.uint64)) + np.uint64(11)
        return x.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        at = _mixed(samples.astype(np.uint64) ^ self.place) % np.uint64(self.bits)
        odd = np.bincount(at.astype(np.int64), minlength=self.bits).astype(np.uint8) & 1
        return np.packbits(odd, bitorder="little").view(np.int64)


def _signed(bands: int, rows: int, words: int):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        spare()
        signer, known = Signer(bands, rows), Hashes()
        half = (1 << 64) - 1
        for batch in sliced(batches, 1):
            n, a, b, keys, sketch = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words, known)
                n.append(len(s))
                f = xxh3_128_intdigest(s.tobytes())
                a.append((f >> 64) - (1 << 63))
                b.append((f & half) - (1 << 63))
                m = signer.samples(s) if len(s) else None
                keys.append(signer.keys(m) if len(s) else None)
                sketch.append(signer.sketch(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp_a", "fp_b", "keys", "sketch"])

    return work


def _sets(words: int):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare()
        known = Hashes()
        for batch in sliced(batches, 1):
            found = [shingles(t, words, known).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return work


def _fine(bands: int, rows: int):
    """(id, shingles) -> (id, fine): the sketch of more samples."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = Signer(bands * FINE, rows, LONGS * FINE, seed=8)
        for batch in batches:
            col = batch.column(1)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
            found = [signer.sketch(signer.samples(flat[b - n : b])) for b, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fine"])

    return work


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the least node that links reach."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("node").alias("up"), F.col("component").alias("over"))
        new = stored(step.join(up, step["component"] == up["up"]).select("node", F.least("component", "over").alias("component"), "was"), "labels")
        discard(label)
        if new.where("component <> was").isEmpty():
            discard(both)
            out = new.select("node", "component")
            out._stored_at = new._stored_at
            return out
        label = new.select("node", "component")
        label._stored_at = new._stored_at


def _apart(longs: int = LONGS, a: str = "sa", b: str = "sb"):
    """Column: the bits in which two sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(longs)), F.lit(0))


def _tail(percent: int, samples: int, bits: int = 64 * LONGS) -> np.ndarray:
    """At i: the chance that sketches of two sets just at the threshold differ in more than i bits.

    Samples that differ are binomial; each flips a bit on either side, and flips in one place undo each other.
    """
    differ = 1 - percent / 100
    count = np.arange(bits + 1)
    odd = np.zeros(bits + 1)  # the chance of so many bits that differ
    odd[0] = 1.0
    out = np.zeros(bits + 1)
    chance = samples * math.log1p(-differ)
    for k in range(samples + 1):
        out += math.exp(chance) * odd
        if k < samples:
            chance += math.log((samples - k) / (k + 1) * differ / (1 - differ))
        for _ in range(2):
            odd = np.r_[0.0, (odd * (1 - count / bits))[:-1]] + np.r_[(odd * count / bits)[1:], 0.0]
    return np.r_[np.cumsum(out[::-1])[::-1][1:], 0.0]


@lru_cache(8)
def _bound(percent: int, samples: int, bits: int = 64 * LONGS) -> int:
    return int(np.argmax(_tail(percent, samples, bits) <= MISS))


def _likely(percent: int, samples: int):
    """Column: whether sketches sa, sb may belong to similar enough sets."""
    return _apart() <= F.lit(_bound(percent, samples))


def _sizes_fit(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def with_sets(pairs: DataFrame, key: str, sets: DataFrame, name: str, part: int) -> DataFrame:
    """pairs with the column `name`: the shingles of the id in `key`. The pairs of an id in more than `part` of them
    are dealt to several tasks, and its set with them."""
    hot = stored(pairs.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > part).select("id", F.ceil(F.col("n") / part).cast("int").alias("parts")), "hot")
    own = sets.select("id", F.col("shingles").alias(name))
    if hot.isEmpty():
        return pairs.join(own, pairs[key] == own["id"]).drop("id")
    # at most a row for each `part` pairs
    left = pairs.join(hot, pairs[key] == hot["id"], "left").drop("id").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = own.join(hot, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, (F.col(key) == F.col("id")) & (left["salt"] == right["salt"])).drop("id", "salt")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 75, bands: int = 44, rows: int = 5, most_rounds: int = 3, most_sent: int = 2_000_000, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Texts that are null, empty or without words have no set and no links. Rows that repeat a
    doc_id count as that one document: their links are its links. A row whose doc_id is null is
    linked with nothing and kept, its component null. No rows give none; other columns play no part.
    """
    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    signed = stored(docs.mapInArrow(_signed(bands, rows, words), "doc_id long, n_shingles long, fp_a long, fp_b long, keys array<long>, sketch array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")

    # classes of equal sets; the smallest id stands for each
    one = F.min(F.struct("doc_id", "n_shingles", "keys", "sketch")).alias("h")
    alone = stored(full.groupBy("fp_a", "fp_b").agg(one).select("fp_a", "fp_b", F.col("h.doc_id").alias("id"), "h.n_shingles", "h.keys", "h.sketch"), "heads")
    copies = full.select("doc_id", "fp_a", "fp_b").join(alone.select("id", "fp_a", "fp_b"), ["fp_a", "fp_b"]).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    # n: the size of the set; an id that heads several classes has a row for each
    within = Window.partitionBy("bucket")
    buckets = alone.select("id", F.explode("keys").alias("bucket"), F.col("n_shingles").alias("n"))
    led = buckets.select("bucket", "id", "n", F.min("id").over(within).alias("leader"), F.max("id").over(within).alias("last"))
    shared = stored(led.where("leader < last").drop("last"), "shared")
    # a doc_id that repeats with other texts heads several classes, each with its own set
    sketches = alone.select("id", "sketch", "n_shingles")
    used = [alone, shared]

    def with_sketches(pairs: DataFrame, *more: str, distance: bool = False) -> DataFrame:
        left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        fits = _sizes_fit(percent) & _likely(percent, bands * rows)
        return pairs.join(left, "a").join(right, "b").where(fits).select("a", "b", *more, *([_apart().alias("distance")] if distance else []))

    def few(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
        """The rows of df that have one of these ids."""
        needed = stored(ids.select(F.col("id").alias("needed")).distinct(), "needed")
        used.append(needed)
        sent = needed.count() <= most_sent  # ids only, so the rows needn't move
        return df.join(F.broadcast(needed) if sent else needed, df[key] == needed["needed"], "left_semi")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        """(id, shingles) of the documents with these ids."""
        texts = few(docs, ids, "doc_id")
        return stored(texts.mapInArrow(_sets(words), "id long, shingles array<long>"), f"sets-{name}")

    def confirmed(pairs: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = stored(pairs, f"pairs-{name}")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        own = few(sets, ids) if sets else sets_of(ids, name)
        both = with_sets(with_sets(pairs, "b", own, "xb", part), "a", own, "xa", part)
        common = F.size(F.array_intersect("xa", "xb"))
        near = common * 100 >= (F.size("xa") + F.size("xb") - common) * percent
        out = stored(both.where(near).select("a", "b").distinct(), f"linked-{name}")
        discard(pairs, *([] if sets else [own]))
        used.append(out)
        return out

    star = stored(shared.where("id > leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = confirmed(with_sketches(star), "star")
    tried, members = star, shared.count()
    used.append(star)

    def unsettled(held: DataFrame) -> DataFrame:
        """(bucket, id, n, component, c: the bucket's members) of the buckets in `held` that have several components."""
        grouped = components(links)
        placed = stored(held.join(grouped, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
        mixed = stored(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where("low < high").select("bucket", "c"), "mixed")
        out = stored(placed.join(mixed, "bucket"), "rest")
        discard(grouped, placed, mixed)
        used.append(out)
        return out

    rest = unsettled(shared)
    small, large, sets = rest.where(F.col("c") <= SMALL), rest.where(F.col("c") > SMALL), None
    across = stored(_across_small(small, few(alone, small), percent, bands, rows), "across-small")
    used.append(across)
    if not large.isEmpty():
        # one reading of the texts for the large buckets and for the pairs of the small ones
        sets = sets_of(large.select("id").union(across.select("a")).union(across.select("b")), "rest")
        used.append(sets)
        large = _possible(large.drop("c"), sets, percent, used)
        n, before = 0, None
        while n < most_rounds and (pairs := _open(large)) > 2 * members and (before is None or 2 * pairs <= before):
            n, before = n + 1, pairs
            # every bucket draws another leader; of the candidates between two components, the likeliest is tried
            draw = F.struct(F.xxhash64("bucket", "id", F.lit(n)).alias("h"), "id", "component")
            drawn = stored(large.groupBy("bucket").agg(F.min(draw).alias("l")).select("bucket", F.col("l.id").alias("leader"), F.col("l.component").alias("leads")), "drawn")
            apart = large.join(drawn, "bucket").where("component <> leads").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"), F.least("component", "leads").alias("ca"), F.greatest("component", "leads").alias("cb")).distinct()
            likely = with_sketches(apart, "ca", "cb", distance=True).join(tried, ["a", "b"], "left_anti")
            best = stored(likely.groupBy("ca", "cb").agg(F.min(F.struct("distance", "a", "b")).alias("p")).select("p.a", "p.b"), "likeliest")
            new = confirmed(best, "drawn", sets)
            discard(drawn)
            used.append(best)
            tried = tried.union(best)
            if new.isEmpty():
                break
            links = links.union(new)
            large = unsettled(large.select("bucket", "id", "n")).drop("c")
        across = across.union(_across_large(large, few(alone, large), few(sets, large), percent, bands, rows, part)).distinct()
    links = links.union(confirmed(across.join(tried, ["a", "b"], "left_anti"), "rest", sets))

    final = components(links.union(copies))
    discard(*used)
    out = signed.join(final, signed["doc_id"] == final["node"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    out._reads = (signed, final)  # to be discarded by whoever has used up the result
    return out


def _possible(rest: DataFrame, sets: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """The rows (bucket, id, component, n, the least size of an id's sets) whose shingles that others of the rows have too don't rule out a link."""
    before = None
    while True:
        ids = rest.select("id").distinct()
        n = ids.count()
        if not n or (before is not None and n > 0.9 * before):
            return rest
        before = n
        own = sets.join(ids, "id", "left_semi")
        # an id in several rows has its largest count; a shingle that only rows of one id have is its own
        held = own.select("id", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
        lone = held.groupBy("id").agg(F.count("*").alias("lone"))
        size = sets.select("id", F.size("shingles").alias("size")).join(ids, "id", "left_semi").groupBy("id").agg(F.max("size").alias("most"), F.count("*").alias("k"))
        least = rest.groupBy("bucket").agg(F.min("n").alias("low"))
        near = rest.join(least, "bucket").groupBy("id").agg(F.min("low").alias("low"))
        s = F.when(F.col("k") == 1, F.col("most") - F.coalesce("lone", F.lit(0))).otherwise(F.col("most"))
        bound = size.join(lone, "id", "left").join(near, "id").select("id", "low", "most", s.alias("s"))
        stay = bound.where(F.col("s") * 100 >= (F.col("most") + F.greatest("low", "s") - F.col("s")) * percent).select("id")
        # buckets left with one component make no pairs, so they may stay
        rest = stored(rest.join(stay, "id", "left_semi"), "possible")
        used.append(rest)


def _open(rest: DataFrame) -> int:
    """The pairs in buckets that are of two components."""
    own = rest.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    return own.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s")).agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0


def _sides(rest: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with what is known of each id, and whether it is outside its bucket's commonest component (minor): only pairs with such a one are across."""
    count = rest.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    most = count.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("members"))
    return rest.select("bucket", "id", "component").join(most, "bucket").withColumn("minor", F.col("component") != F.col("major")).drop("major").join(known, "id")


def _across_small(rest: DataFrame, heads: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """(a, b): pairs that share a bucket, across components, that the sketches let through."""
    full = _sides(rest, heads.select("id", "sketch", "n_shingles"))
    a, b = (full.select("bucket", *[F.col(c).alias(f"{n}{x}") for c, n in (("id", "i"), ("component", "c"), ("sketch", "s"), ("n_shingles", "n"), ("minor", "m"))]) for x in "ab")
    meet = F.col("ma") & (F.col("ca") != F.col("cb")) & (~F.col("mb") | (F.col("ia") < F.col("ib")))
    return a.join(b, "bucket").where(meet & _sizes_fit(percent) & _likely(percent, bands * rows)).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def _across_large(rest: DataFrame, heads: DataFrame, sets: DataFrame, percent: int, bands: int, rows: int, part: int) -> DataFrame:
    """The same for buckets of any size, by a finer sketch too. A bucket's members are dealt to parts, and every two parts meet in a group;
    a pair is given by the first bucket that it shares alone."""
    fine = sets.mapInArrow(_fine(bands, rows), "id long, fine array<long>")
    full = _sides(rest, heads.select("id", "sketch", "n_shingles", "keys").join(fine, "id"))
    full = full.withColumn("parts", F.ceil(F.col("members") / part).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    full = full.select("bucket", "x", "y", "own", "id", "component", "minor", "n_shingles", "sketch", "fine", "keys")
    bounds = _bound(percent, bands * rows), _bound(percent, bands * rows * FINE, 64 * LONGS * FINE)
    return full.groupBy("bucket", "x", "y").applyInArrow(_met(percent, *bounds), "a long, b long").distinct()


def _met(percent: int, most: int, most_fine: int):
    def work(table):
        import pyarrow as pa

        col = lambda c: table.column(c).combine_chunks()
        own, ids, component, minor, n = (col(c).to_numpy(zero_copy_only=False) for c in ("own", "id", "component", "minor", "n_shingles"))
        sketch, fine, keys = (col(c).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in ("sketch", "fine", "keys"))
        bucket, x, y = (table.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        one, other = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = []
        for i in one.tolist():
            # of the two rows of a pair within a part, the later one
            j = other if x != y else other[other > i]
            j = j[(minor[i] | minor[j]) & (component[j] != component[i]) & (ids[j] != ids[i])]
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent]
            j = j[np.bitwise_count((sketch[j] ^ sketch[i]).view(np.uint64)).sum(1, dtype=np.int64) <= most]
            j = j[np.bitwise_count((fine[j] ^ fine[i]).view(np.uint64)).sum(1, dtype=np.int64) <= most_fine]
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(1)] == bucket] if len(j) else j
            found.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])]))
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work
