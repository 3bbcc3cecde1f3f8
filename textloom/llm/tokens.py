"""Fast exact use of a byte-level BPE of the tokenizers library.

A run of white space and the text up to the next one is a unit that this
family of tokenizers never joins with its neighbours, so a text's ids are its
units' ids in order. Texts are cut at single spaces by Arrow, which also numbers the distinct units of a
run of texts and finds those known; each Python worker keeps the ids of units seen, gives the
library only new ones, many in one string, and gathers a text's ids with numpy. In such a string each
unit starts with a space, and no token has a space but at its start, so units part at the tokens that start with one.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import sliced

#: Units whose ids a worker keeps.
CACHE = 500_000
#: Characters that the library's pattern takes as white space (fixed values, Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: White space before a space: there a cut before the space may part a run.
_DOUBLE = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_ENCODERS: dict[str, Encoder] = {}


class Known:
    """Units seen, as an Arrow array, and their ids, end to end. Beyond CACHE units, those not used of late go."""

    def __init__(self):
        import pyarrow as pa

        self.units = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0

    def add(self, units, ids: np.ndarray, sizes: np.ndarray) -> None:
        import pyarrow as pa

        if len(self.units) + len(units) > CACHE:  # what the last turns used stays, up to half
            last = max(self.turn - 1, int(np.partition(self.used, -(CACHE // 2))[-(CACHE // 2)]) if len(self.used) > CACHE // 2 else 0)
            keep = np.flatnonzero(self.used > last)
            self.units = self.units.take(pa.array(keep))
            self.ids = gathered(self.ids, self.starts[keep], self.sizes[keep])
            self.sizes, self.used = self.sizes[keep], self.used[keep]
            self.starts = np.cumsum(self.sizes) - self.sizes
        self.units = pa.concat_arrays([self.units, units])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.turn)])

    def find(self, units, learn) -> np.ndarray:
        """The units' numbers; learn gives the ids and sizes of those that are new. Numbers hold until the next call."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self.turn += 1
        at = pc.index_in(units, value_set=self.units)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at.drop_null().to_numpy()] = self.turn
        unknown, n = at.is_null(), len(self.units)
        new = units.filter(unknown)
        self.add(new, *learn(new))
        if len(self.units) < n + len(new):  # some went, so the numbers are others
            return pc.index_in(units, value_set=self.units).to_numpy(zero_copy_only=False).astype(np.int64)
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out[out < 0] = np.arange(n, n + len(new))
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `flat` at starts, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.after, self.plain = Known(), Known()  # units with one space before them; units as they are
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # Ġ is the vocabulary's space

    def _each(self, units) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(units.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _spaced(self, units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, each with one space before it."""
        import pyarrow.compute as pc

        out = []
        for i in range(0, len(units), 4000):
            part = units.slice(i, 4000)
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part) and not starts[0]:
                out.append((ids, np.diff(np.append(starts, len(ids)))))
            else:  # an empty unit, another kind of vocabulary, or a special token's text
                out.append(self._each(pc.binary_join_element_wise("", part, " ")))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _fast(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        units = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        which, names = units.indices.to_numpy(), units.dictionary
        bounds = bounds - bounds[0]
        first = bounds[:-1]
        rest = np.ones(len(which), bool)
        rest[first] = False
        starts, sizes = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        flat, base = [], 0
        for known, here, learn in ((self.after, np.flatnonzero(rest), self._spaced), (self.plain, first, self._each)):
            own = np.zeros(len(names), bool)
            own[which[here]] = True
            number = np.zeros(len(names), np.int64)
            number[own] = known.find(names.filter(pa.array(own)), learn)
            at = number[which[here]]
            starts[here], sizes[here] = known.starts[at] + base, known.sizes[at]
            flat.append(known.ids)
            base += len(known.ids)
        total = np.concatenate([[0], np.cumsum(sizes)])
        # the first units are few; their ids stand after the others'
        return gathered(np.concatenate(flat), starts, sizes), np.diff(total[bounds])

    def _slow(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        cut = [_UNIT.findall(t) for t in texts]
        units = pa.array([u for c in cut for u in c], pa.large_string()).dictionary_encode()
        at = self.plain.find(units.dictionary, self._each)[units.indices.to_numpy()]
        sizes = self.plain.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(self.plain.ids, self.plain.starts[at], sizes), np.diff(total[np.cumsum([0, *map(len, cut)])])

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, end to end (unsigned 32-bit), and how many each has. A null text has none; `end` closes each."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(column, _DOUBLE).to_numpy(zero_copy_only=False)
        parts = []
        if not slow.all():
            parts.append(self._fast(column.filter(pa.array(~slow)) if slow.any() else column))
        if slow.any():
            parts.append(self._slow(column.filter(pa.array(slow)).to_pylist()))
        sizes = np.zeros(len(texts), np.int64)
        sizes[~slow], sizes[slow] = parts[0][1] if not slow.all() else 0, parts[-1][1] if slow.any() else 0
        ids = np.concatenate([x for x, _ in parts])
        if slow.any() and not slow.all():  # back in the order of the texts
            order = np.concatenate([np.flatnonzero(~slow), np.flatnonzero(slow)])
            starts = np.zeros(len(texts), np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            ids = gathered(ids, starts, sizes)
        if end is not None:
            sizes += 1
            whole = np.full(int(sizes.sum()), end, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(sizes) - 1] = False
            whole[keep] = ids
            ids = whole
        del column, parts
        pa.default_memory_pool().release_unused()  # tasks that follow need it
        return ids.astype("<u4", copy=False), sizes


def encoder(path: str) -> Encoder:
    """This process's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drops the units that this process's encoders know."""
    for e in _ENCODERS.values():
        e.after, e.plain = Known(), Known()


def runs(column, least: int = 3_000_000):
    """Successive parts of an Arrow column of texts, of at least so many bytes each: first row, end, texts."""
    import pyarrow as pa

    i = 0
    for part in sliced([pa.RecordBatch.from_arrays([column], names=["t"])], 0, least):
        yield i, i + len(part), part.column(0).to_pylist()
        i += len(part)
