"""SentencePiece encoding and decoding by weighted transducers.

Three transducers are compiled from the model's file and composed with each input:

- the normaliser: the model's character map by longest match, then spaces as its normalizer_spec has them (extra ones removed
  or not, one put in front or not, ▁ in their place);
- the lexicon: a trie from characters to pieces, whose final states carry a piece's weight, and byte fallback: a
  character that no piece starts with takes the path of its bytes;
- for a BPE model an acceptor over pairs of neighbouring pieces.

The composition with an input is an acyclic graph whose states are a position and the acceptor's state; the
tropical-semiring shortest path through it is the encoding.

Unigram models: weights are negated log-probabilities and there is no acceptor; the shortest path is the best segmentation.

BPE models: scores are merge ranks, and no sum of them makes the library's result, which joins the best pair
first, the leftmost on ties. The acceptor does: it lets piece b follow piece a if joining from the characters of a + b
ends in just a, b. A text's encoding is the one path through accepted pairs: no join ever crosses a bound that
is left at the end, so what happens between two such bounds happens in the same order as in the pieces there by
themselves, and every pair of neighbours is accepted; and in any path of accepted pairs, the first join to cross a bound would be the
best one within the two pieces there as well, so that they by themselves would be joined too. Whether a pair is accepted
is worked out when it is first met, and kept.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from ctypes import c_float
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import pick
from .tokens import Known, gathered, runs

SPACE = "▁"
#: Pairs whose acceptance a worker keeps.
PAIRS = 2_000_000


# the model's file


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer: number and value."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _message(proto: bytes, number: int) -> dict:
    """A message's fields; one that is given in parts is joined, later values first."""
    out: dict = {}
    for k, v in _fields(proto):
        if k == number:
            out |= dict(_fields(v))
    return out


@dataclass
class Spec:
    """What encoding needs of a model."""

    pieces: dict[str, tuple[int, float]] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=lambda: [-1] * 256)
    own: set[str] = field(default_factory=set)  # user-defined: never split or joined
    unknown: int = 0
    unknown_text: str = " ⁇ "
    bpe: bool = False
    suffix: bool = False  # spaces end words
    charsmap: bytes = b""
    dummy: bool = True
    trim: bool = True  # extra spaces go
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> Spec:
        with open(path, "rb") as f:
            proto = f.read()
        trainer, normalizer = _message(proto, 2), _message(proto, 3)
        out = cls(bpe=trainer.get(3, 1) == 2, suffix=bool(trainer.get(24, 0)), charsmap=normalizer.get(2, b""), dummy=bool(normalizer.get(3, 1)), trim=bool(normalizer.get(4, 1)), escape=bool(normalizer.get(5, 1)))
        if 44 in trainer:
            out.unknown_text = trainer[44].decode()
        number = 0
        for k, v in _fields(proto):
            if k != 1:
                continue
            piece = dict(_fields(v))
            text, score, kind = piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, 1)
            if kind == 6:  # a byte
                out.bytes_[int(text[3:-1], 16)] = number
            elif kind == 2:
                out.unknown = number
            elif kind in (1, 4):  # normal, user-defined
                out.pieces[text] = (number, score)
                if kind == 4:
                    out.own.add(text)
            number += 1
        return out


# the normaliser


def _charsmap(blob: bytes) -> dict[str, str]:
    """A compiled character map's entries: a double array (Darts) of the keys' bytes, then the values, each ended by a zero byte."""
    if not blob:
        return {}
    (size,) = struct.unpack("<I", blob[:4])
    units, values = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    found: dict[str, str] = {}
    keys, base = [b""], np.array([step(units[0])])
    while keys:
        to = base[:, None] ^ np.arange(1, 256)[None]
        ok = to < len(units)
        ok[ok] = (units[to[ok]] & ((1 << 31) | 255)) == np.broadcast_to(np.arange(1, 256), to.shape)[ok]
        rows, labels = np.nonzero(ok)
        at = to[rows, labels]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(rows.tolist(), labels.tolist())]
        base = at ^ step(units[at])
        for k, u, b in zip(keys, units[at].tolist(), base.tolist()):
            if u >> 8 & 1:
                begin = int(units[b]) & ((1 << 31) - 1)
                found[k.decode()] = values[begin : values.index(b"\0", begin)].decode()
    return found


class Normaliser:
    def __init__(self, spec: Spec):
        self.spec, self.map = spec, _charsmap(spec.charsmap)
        self.map |= {x: x for x in spec.own}  # user-defined texts stay as they are
        self.trie: dict = {}
        for key, value in self.map.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(self.trie))) + "]") if self.trie else None
        self.plain = not self.map and spec.dummy and not spec.trim and spec.escape and not spec.suffix

    def _mapped(self, text: str) -> str:
        """The character map's output: at each place its longest key, else the character."""
        out, at = [], 0
        while m := self.starts.search(text, at):
            i = j = m.start()
            out.append(text[at:i])
            node, value, end = self.trie, None, i + 1
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    value, end = node[""], j
            out.append(text[i] if value is None else value)
            at = end
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        s = self.spec
        if self.starts:
            text = self._mapped(text)
        if s.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if s.dummy:
            text = text + " " if s.suffix else " " + text
        return text.replace(" ", SPACE) if s.escape else text


# lexicon and acceptor


class Lexicon:
    """The transducer of a model's pieces, a trie from characters to (piece, weight), and what pairs of them are accepted."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, merges: bool, own: frozenset[str] | set[str] = frozenset()):
        self.pieces, self.bytes, self.unknown, self.merges, self.own = pieces, byte_ids, unknown, merges, own
        self.trie: dict = {}
        best, worst = max((s for _, s in pieces.values()), default=0.0), max((-s for _, s in pieces.values()), default=0.0)
        for text, (_, score) in pieces.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            # the library prefers a user-defined piece to all others
            node[""] = (text, 0.1 - len(text.encode()) * best if text in own else -score)
        self.fallback = c_float(worst + 10.0).value  # the weight of a character that no piece has
        self.matcher = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        self.known: dict[tuple[str, str], bool] = {}

    def arcs(self, unit: str, i: int) -> list[tuple[int, float, str]]:
        """The lexicon composed with an input: what leaves position i, as (end, weight, piece), shortest first."""
        out, node, j, n = [], self.trie, i, len(unit)
        while j < n and (node := node.get(unit[j])) is not None:
            j += 1
            if "" in node:
                piece, weight = node[""]
                out.append((j, weight, piece))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, self.fallback, unit[i]))
        return out

    def accepts(self, a: str, b: str) -> bool:
        """Whether b may follow a; a is empty at the start."""
        if (got := self.known.get((a, b))) is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[a, b] = self.joined(a + b) == ([a, b] if a else [b])
        return got

    def joined(self, text: str) -> list[str]:
        """Pieces after joining neighbouring characters that make a piece, highest score first, leftmost on ties."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pieces.get(part[i] + part[j])):
                heapq.heappush(heap, (-found[1], i, j, len(part[i]) + len(part[j])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not part[i] or not part[j] or right[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p]

    def shortest(self, unit: str) -> list[int]:
        """Ids on the path of least weight; of equal ones, the first reached by the longest last piece."""
        if not self.merges:
            return self._ids(self._least(unit))
        if not self.matcher:
            return self._ids(self._only(unit))
        path: list[str] = []
        for part in self.matcher.split(unit):  # nothing is joined to a user-defined piece
            path += [part] if part in self.own else self._only(part)
        return self._ids(path)

    def _least(self, unit: str) -> list[str]:
        best = [(0.0, 0), *[(float("inf"), 0)] * len(unit)]  # weight, and where from
        for i in range(len(unit)):
            for j, w, _ in self.arcs(unit, i):
                if (total := c_float(best[i][0] + w).value) < best[j][0]:  # sums are rounded as the library's
                    best[j] = (total, i)
        out, j = [], len(unit)
        while j:
            out.append(unit[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    def _only(self, unit: str) -> list[str]:
        """The one path that the acceptor leaves, whatever the weights. A position has one state that accepted pairs reach, as each beginning
        of an input has one path too; so none is entered twice."""
        n = len(unit)
        if not n:
            return []
        entered = [True] + [False] * n
        path, open_ = [""], [iter(self.arcs(unit, 0)[::-1])]
        while True:
            for j, _, piece in open_[-1]:  # the longest first
                if not entered[j] and self.accepts(path[-1], piece):
                    path.append(piece)
                    if j == n:
                        return path[1:]
                    entered[j] = True
                    open_.append(iter(self.arcs(unit, j)[::-1]))
                    break
            else:
                path.pop()
                open_.pop()

    def _ids(self, path: list[str]) -> list[int]:
        """Pieces' ids; a character without one gives its bytes', or the unknown id once for a run of such characters."""
        out: list[int] = []
        lost = False
        for p in path:
            if found := self.pieces.get(p):
                out.append(found[0])
                lost = False
                continue
            ids = [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            if min(ids) >= 0:
                out += ids
                lost = False
            elif not lost:
                out.append(self.unknown)
                lost = True
        return out


class Codec:
    def __init__(self, path: str):
        spec = Spec.load(path)
        self.lex = Lexicon(spec.pieces, spec.bytes_, spec.unknown, spec.bpe, spec.own)
        self.normalised, self.spec = Normaliser(spec), spec
        # pieces that join words, or spaces elsewhere than in front: units can't be cut
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.lex.pieces) or spec.suffix or not spec.escape or bool(spec.own) or min(spec.bytes_) < 0
        self.units = Known()
        texts = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.lex.pieces.items()}
        self.spaced = {i: len(t) for i, t in texts.items() if t.startswith(b" ")}
        texts |= {i: bytes([b]) for b, i in enumerate(spec.bytes_) if i >= 0} | {spec.unknown: spec.unknown_text.encode()}
        sizes = [len(texts.get(i, b"")) for i in range(max(texts, default=0) + 1)]
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(sizes))), np.uint8)

    def cut(self, text: str) -> list[str]:
        """A normalised text's units, which no piece spans: a run of ▁ with what follows it."""
        if self.whole:
            return [text] if text else []
        if SPACE * 2 not in text and text.startswith(SPACE):
            return [SPACE + u for u in text.split(SPACE)[1:]]
        out, at = [], 0
        for i in range(1, len(text)):
            if text[i] == SPACE and text[i - 1] != SPACE:
                out.append(text[at:i])
                at = i
        return [*out, text[at:]] if text else []

    def _learn(self, units) -> tuple[np.ndarray, np.ndarray]:
        got = [self.lex.shortest(u) for u in units.to_pylist()]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, end to end (unsigned 32-bit), and how many each has; none for a null or empty text."""
        import pyarrow as pa

        cut = [self.cut(self.normalised(t)) if t else [] for t in texts]
        units = pa.array([u for c in cut for u in c], pa.large_string()).dictionary_encode()
        at = self.units.find(units.dictionary, self._learn)[units.indices.to_numpy()]
        sizes = self.units.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(self.units.ids, self.units.starts[at], sizes).astype("<u4", copy=False), np.diff(total[np.cumsum([0, *map(len, cut)])])

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each text's bytes: pieces and bytes joined, ▁ as space, the one in front dropped (all, where extra spaces go); ids of
        no text, such as the control ids, give nothing."""
        lengths = self.sizes[ids]
        data = gathered(self.flat, self.starts[ids], lengths).tobytes()
        bounds = np.cumsum(np.append(0, sizes))
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
        out = []
        for a, b, first, last in zip(ends, ends[1:], bounds.tolist(), bounds[1:].tolist()):
            if self.spec.dummy or self.spec.trim:
                a += self._front(ids, first, last)
            out.append(data[a:b])
        return out

    def _front(self, ids: np.ndarray, first: int, last: int) -> int:
        """How many spaces in front belong to no text."""
        n = 0
        for i in range(first, last):
            size = self.spaced.get(int(ids[i]), 0)
            if not size and self.sizes[ids[i]]:
                break
            n += size > 0
            if size > 1 or size and not self.spec.trim:
                break
        return n

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decoded(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, whether decoding gives the text again, and, with_ids, the ids.

    A null or empty text has no ids. A ▁ in a text decodes as a space and so doesn't come back, nor does what the
    model's normaliser changes. A null doc_id stays; repeated rows give the same each; no rows give none; other columns play no
    part. Texts are encoded whole; where a model's pieces join words, a text is one unit.
    """
    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            for i, j, texts in runs(batch.column(1)):
                ids, sizes = c.encode(texts)
                back = [b == (t or "").encode("utf-8", "surrogatepass") for b, t in zip(c.decoded(ids, sizes), texts)]
                view, ends = memoryview(ids).cast("B"), np.cumsum(sizes)
                spans = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist()))
                columns = [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()), pa.array(back, pa.bool_())]
                if with_ids:
                    columns.append(pa.array([bytes(view[a:b]) for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"][: len(columns)])

    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids)
