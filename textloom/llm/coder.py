"""Adaptive context-mixing range coder for token ids, in blocks.

A block's ids are dealt to lanes, runs of neighbours that are coded side by side, one id of each lane at
a step, against one model that all lanes share and that learns after each step:

- order 2 and order 1: for the last two ids (hashed) and for the last id, the id that followed and how sure
  that is, a state that rises with each hit and falls with each miss;
- order 0: counts of ids.

The likelier of the two predicted ids is tried first, then the other, if it is another. The chance of each is mixed in the
logistic domain from the hit rates of the three orders' states (order 0's is how frequent the id is), with
weights that follow the gradient. States are few, so a chance is mixed for each set of states and not for each id. An id
that neither order predicts is coded by the order-0 counts. All of it narrows one 48-bit range for
each lane (carries are added when the block ends). All arithmetic is on integers, so a block reads
the same on any machine.

The operator codes in Spark's JVM, with TokenCoder.java, which makes the same blocks bit for bit; this form needs no Spark.

A block starts from nothing and holds whole documents. A crc32 covers its header, table and digits, another its ids.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"TLC2"
#: crc32 of all that follows; then ids, lanes, vocabulary, documents, crc32 of ids, bytes of the documents' table.
HEAD = struct.Struct("<4sIIIIIII")
LANES = 16384
_SLOTS = 1 << 18
_BITS = 20  # the order-0 counts are scaled to a total of 1 << _BITS
_BOTTOM, _U = np.uint64(1 << 32), np.uint64
_MAX = 7  # the highest state
_DOWN = np.array([0, *(s - (s >> 1) for s in range(1, _MAX + 1))], np.int32)  # what a miss takes from a state
_EDGES = np.array([2, 8, 32, 128, 512, 2048, 8192])  # of order 0's states, in frequency


def _squash(x: int) -> int:
    return min(4096 - 32, max(32, round(4096 / (1 + math.exp(-x / 256)))))


_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4096 - p - 0.5))) for p in range(4096)], np.int64)
_SQUASH = np.array([_squash(x) for x in range(-2047, 2048)], np.int64)


class Mixer:
    """Chances, of 4096, by set of states: parts hold each set's state in each of the orders."""

    def __init__(self, *parts: np.ndarray):
        self.parts = parts
        self.rates = [np.full(int(p.max()) + 1, 8192, np.int64) for p in parts]  # of 65536
        self.weights = np.full(len(parts), 1 << 15, np.int64)
        self.seen, self.hits = np.zeros(len(parts[0]), np.int64), np.zeros(len(parts[0]), np.int64)
        self.mix()

    def mix(self) -> None:
        self.x = np.stack([_STRETCH[r[p] >> 4] for r, p in zip(self.rates, self.parts)])
        mixed = (self.weights[:, None] * self.x).sum(0) >> 16
        self.chance = _SQUASH[np.clip(mixed, -2047, 2047) + 2047]

    def count(self, sets: np.ndarray, hit: np.ndarray) -> None:
        self.seen += np.bincount(sets, minlength=len(self.seen))
        self.hits += np.bincount(sets[hit], minlength=len(self.seen))

    def learn(self) -> None:
        """From the sets counted since the last time."""
        total = int(self.seen.sum())
        if not total:
            return
        for r, p in zip(self.rates, self.parts):
            n, k = (np.bincount(p, x, len(r)).astype(np.int64) for x in (self.seen, self.hits))  # sums far below 2 ** 53 are exact
            r += (k * 65535 // np.maximum(n, 1) - r) * np.minimum(n, 64) // 128
        miss = (self.hits << 12) - self.seen * self.chance
        self.weights = np.clip(self.weights + (self.x @ miss) // (total << 3), -(1 << 18), 1 << 18)
        self.seen[:], self.hits[:] = 0, 0
        self.mix()


class Model:
    """What both sides know before a step."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary, self.steps = vocabulary, 0
        self.counts = np.ones(vocabulary, np.int64)
        self.one, self.two = np.zeros(vocabulary, np.int32), np.zeros(_SLOTS, np.int32)  # id << 3 | state
        self.last, self.slot = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
        k = np.arange(64 * 2 * 8)
        s1, s2, same, zero = k >> 7, k >> 4 & 7, k >> 3 & 1, k & 7
        self.first = Mixer(zero, s1 * 2 + same, s2 * 2 + same)
        k = np.arange(64 * 8)
        self.second = Mixer(k & 7, k >> 6, k >> 3 & 7)
        self.new: list[np.ndarray] = []
        self._tally()
        self._prefer()

    def _tally(self) -> None:
        if self.new:
            self.counts += np.bincount(np.concatenate(self.new), minlength=self.vocabulary) * 16
            self.new.clear()
        upto = np.cumsum(self.counts)
        room = (1 << _BITS) - self.vocabulary
        self.cum = np.concatenate([[0], np.arange(1, self.vocabulary + 1) + upto * room // upto[-1]])
        self.zero = np.searchsorted(_EDGES, np.diff(self.cum), "right").astype(np.int32)
        self.ids = None  # by place below the total, for the decoder

    def _prefer(self) -> None:
        """Whether order 2's id goes first, by the states of both orders."""
        one, two = self.first.rates[1].reshape(8, 2).max(1), self.first.rates[2].reshape(8, 2).max(1)
        self.prefers = (two[None, :] >= one[:, None]).ravel()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's id to try first and its chance."""
        self.v1, self.v2 = self.one[self.last], self.two[self.slot]
        g1, g2 = self.v1 >> 3, self.v2 >> 3
        self.states = ((self.v1 & 7) << 3) | (self.v2 & 7)
        other = self.prefers[self.states]
        self.a, self.b, self.same = np.where(other, g2, g1), np.where(other, g1, g2), g1 == g2
        self.set = (((self.states << 1) | self.same) << 3) | self.zero[self.a]
        return self.a, self.first.chance[self.set]

    def again(self, missed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lanes whose first id was wrong: those with another, that id and its chance."""
        who = missed[~self.same[missed]]
        b = self.b[who]
        self.set2 = (self.states[who] << 3) | self.zero[b]
        return who, b, self.second.chance[self.set2]

    def learn(self, ids: np.ndarray, hit: np.ndarray, hit2: np.ndarray) -> None:
        """From each lane's id and whether the ids tried were right."""
        self.first.count(self.set, hit)
        self.second.count(self.set2, hit2)
        fresh = (ids << 3) | 1
        for table, at, v in ((self.one, self.last, self.v1), (self.two, self.slot, self.v2)):
            s = v & 7
            table[at] = np.where(v >> 3 == ids, v + (s < _MAX), np.where(s > 0, v - _DOWN[s], fresh))
        self.slot = (self.last.astype(np.int64) * 40503 + ids.astype(np.int64) * 2654435 + 977) & (_SLOTS - 1)
        self.last = ids
        self.new.append(ids)
        self.steps += 1
        if self.steps < 32 or self.steps % 4 == 0:
            self.first.learn()
            self.second.learn()
            self._prefer()
        if self.steps in (1, 2, 4, 8, 16) or self.steps % 32 == 0:
            self._tally()

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at places below the order-0 total."""
        if self.ids is None:
            kind = np.uint16 if self.vocabulary <= 1 << 16 else np.int32
            self.ids = np.repeat(np.arange(self.vocabulary, dtype=kind), np.diff(self.cum))
        return self.ids[places].astype(np.int32)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 256))


def encode(ids: np.ndarray, vocabulary: int, lanes: int) -> bytes:
    """The lanes' digits. ids: at least one, each below vocabulary. The last lane is filled up with its last id."""
    if vocabulary > 1 << (_BITS - 1):
        raise ValueError(f"a vocabulary of more than {1 << (_BITS - 1)} ids")
    steps = -(-len(ids) // lanes)
    grid = np.full(lanes * steps, ids[-1], np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    digits, at = np.zeros((steps + 64, lanes), np.uint32), np.zeros(lanes, np.int64)

    def put(who: np.ndarray) -> None:
        nonlocal digits
        row, v = at[who], low[who]
        if row.max() + 4 >= len(digits):
            digits = np.concatenate([digits, np.zeros_like(digits)])
        digits[row, who] = v >> _U(32)
        at[who] = row + 1
        low[who] = (v & (_BOTTOM - _U(1))) << _U(16)

    def settle(who: np.ndarray) -> None:
        while len(who):
            put(who)
            w = width[who] << _U(16)
            width[who] = w
            who = who[w < _BOTTOM]

    for now in grid:
        guess, chance = model.predict()
        hit = guess == now
        right = (width >> _U(12)) * chance.astype(_U)
        low += right * ~hit
        width = np.where(hit, right, width - right)
        missed = np.flatnonzero(~hit)
        who, guess2, chance2 = model.again(missed)
        hit2 = guess2 == now[who]
        w = width[who]
        right = (w >> _U(12)) * chance2.astype(_U)
        low[who] += right * ~hit2
        width[who] = np.where(hit2, right, w - right)
        left = np.ones(len(now), bool)
        left[who[hit2]] = False
        missed = missed[left[missed]]
        settle(missed[width[missed] < _BOTTOM])
        s = now[missed]
        r, a = width[missed] >> _U(_BITS), model.cum[s]
        low[missed] += r * a.astype(_U)
        width[missed] = r * (model.cum[s + 1] - a).astype(_U)
        settle(np.flatnonzero(width < _BOTTOM))
        model.learn(now, hit, hit2)
    everyone = np.arange(lanes)
    low += _U(0xFFFF)
    low &= ~_U(0xFFFF)
    put(everyone)
    put(everyone)
    top = int(at.max())
    carry = np.zeros(lanes, np.uint32)
    for i in range(top - 1, -1, -1):
        carry += digits[i]
        digits[i] = carry & 0xFFFF
        carry >>= 16
    used = np.arange(top)[None] < at[:, None]
    return at.astype("<u4").tobytes() + digits[:top].T[used].astype("<u2").tobytes()


def decode(data: bytes, n: int, vocabulary: int, lanes: int) -> np.ndarray:
    steps = -(-n // lanes)
    at = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    flat = np.concatenate([np.frombuffer(data, "<u2", offset=4 * lanes).astype(_U), np.zeros(8, _U)])
    place = np.concatenate([[0], np.cumsum(at)])[:-1]
    ends = place + at
    code, width = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)

    def more(who: np.ndarray) -> None:
        p = place[who]
        got = np.where(p < ends[who], flat[np.minimum(p, len(flat) - 1)], _U(0))
        place[who] = p + 1
        code[who] = (code[who] << _U(16)) | got

    def settle(who: np.ndarray) -> None:
        while len(who):
            more(who)
            w = width[who] << _U(16)
            width[who] = w
            who = who[w < _BOTTOM]

    for _ in range(3):
        more(np.arange(lanes))
    model = Model(vocabulary, lanes)
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        guess, chance = model.predict()
        right = (width >> _U(12)) * chance.astype(_U)
        hit = code < right
        code -= right * ~hit
        width = np.where(hit, right, width - right)
        now = guess.astype(np.int32)
        missed = np.flatnonzero(~hit)
        who, guess2, chance2 = model.again(missed)
        w, c = width[who], code[who]
        right = (w >> _U(12)) * chance2.astype(_U)
        hit2 = c < right
        code[who] = c - right * ~hit2
        width[who] = np.where(hit2, right, w - right)
        now[who] = guess2  # those that are wrong are set anew below
        left = np.ones(lanes, bool)
        left[who[hit2]] = False
        missed = missed[left[missed]]
        settle(missed[width[missed] < _BOTTOM])
        r, c = width[missed] >> _U(_BITS), code[missed]
        # below 2 ** 20 and of numbers below 2 ** 53, the quotient of floats has the right floor
        s = model.at(np.minimum((c.astype(np.float64) / r.astype(np.float64)).astype(np.int64), (1 << _BITS) - 1))
        a = model.cum[s]
        code[missed] = c - r * a.astype(_U)
        width[missed] = r * (model.cum[s + 1] - a).astype(_U)
        now[missed] = s
        settle(np.flatnonzero(width < _BOTTOM))
        grid[t] = now
        model.learn(now, hit, hit2)  # an id that was tried is always coded as a hit
    return grid.T.reshape(-1)[:n].astype("<u4")


def table(doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A block's table of documents: which have a doc_id, these, and their numbers of ids."""
    known = np.array([d is not None for d in doc_ids], "u1")
    return zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes())


def write_block(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    """A block of documents: their ids end to end, and how many each has."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id outside the vocabulary")
    lanes, documents = _lanes(len(ids)), table(doc_ids, sizes)
    body = documents + (encode(ids, vocabulary, lanes) if len(ids) else b"")
    fields = (len(ids), lanes, vocabulary, len(doc_ids), zlib.crc32(ids), len(documents))
    whole = zlib.crc32(body, zlib.crc32(HEAD.pack(MAGIC, 0, *fields)))
    return HEAD.pack(MAGIC, whole, *fields) + body


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token ids and sizes. Raises ValueError if the block is no block, or if any of it or its ids don't have its checksums."""
    if len(block) < HEAD.size:
        raise ValueError("a block is cut off")
    magic, whole, *fields = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    if zlib.crc32(memoryview(block)[HEAD.size :], zlib.crc32(HEAD.pack(MAGIC, 0, *fields))) != whole:
        raise ValueError("a block's checksum is wrong")
    n, lanes, vocabulary, docs, crc, size = fields
    documents = zlib.decompress(block[HEAD.size : HEAD.size + size])
    known = np.frombuffer(documents, "u1", docs)
    names = np.frombuffer(documents, "<i8", docs, docs)
    sizes = np.frombuffer(documents, "<u4", docs, 9 * docs).astype(np.int64)
    ids = decode(block[HEAD.size + size :], n, vocabulary, lanes) if n else np.zeros(0, "<u4")
    if zlib.crc32(ids) != crc or int(sizes.sum()) != n:
        raise ValueError("a block's ids don't have its checksum")
    return [int(d) if k else None for d, k in zip(names, known)], ids, sizes
