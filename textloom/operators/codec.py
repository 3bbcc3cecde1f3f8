"""A byte codec for Spanish text: letters as bytes that modifiers follow, in a lenient and a strict variant."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of both variants (fixed values).
LETTERS, SPACE, LINE = 20, 11, 10
ACUTE, DIAERESIS, TILDE, CAPITAL = 50, 51, 52, 53
MARKS = {"́": ACUTE, "̈": DIAERESIS, "̃": TILDE}
SHARED = {" ": SPACE, "\n": LINE, ".": 70, ",": 71, ";": 72, ":": 73}
#: Where the variants differ (fixed values): first byte of the digits, and signs.
LENIENT_DIGITS, LENIENT_SIGNS = 96, {"!": 74, "?": 75, "(": 76, ")": 77, "-": 78, "—": 78, '"': 79, "«": 80, "»": 80}
STRICT_DIGITS, STRICT_SIGNS = 60, {"-": 78, "'": 79, '"': 80, "(": 81, ")": 82, "#": 100, "*": 101}
#: Bytes that only detection knows.
LENIENT_EXTRA = [81, 82]


@dataclass(frozen=True)
class Codec:
    strict: bool
    to_byte: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, variant: str) -> Codec:
        if variant not in ("lenient", "strict"):
            raise ValueError(f"no such variant: {variant}")
        strict = variant == "strict"
        first, signs = (STRICT_DIGITS, STRICT_SIGNS) if strict else (LENIENT_DIGITS, LENIENT_SIGNS)
        letters = {chr(97 + i): LETTERS + i for i in range(26)}
        return cls(strict, SHARED | {str(d): first + d for d in range(10)} | signs | letters)

    @property
    def valid(self) -> list[int]:
        extra = [] if self.strict else LENIENT_EXTRA
        return sorted({*self.to_byte.values(), ACUTE, DIAERESIS, TILDE, CAPITAL, *extra})

    def encode(self, text: str) -> bytes:
        """The lenient variant leaves out what it can't say; the strict one raises ValueError."""
        out = bytearray()
        for at, c in enumerate(text):
            if (b := self.to_byte.get(c)) is not None:
                out.append(b)
                continue
            low = c.lower() if c.isalpha() else c
            base, *marks = unicodedata.normalize("NFD", low) if low else [""]
            known = base in self.to_byte and base.isalpha() and all(m in MARKS for m in marks)
            if not known:
                if self.strict:
                    raise ValueError(f"no code for {c!r} at {at}")
                continue
            big = [CAPITAL] if low != c else []
            out += bytes([self.to_byte[base], *big, *[MARKS[m] for m in marks]])
        return bytes(out)

    def decode(self, data: bytes) -> str:
        """Modifiers change the letter before them; the lenient variant lets them follow anything, shows an unknown
        byte as its number in brackets, and quotes by turns; the strict one raises ValueError."""
        signs = {b: c for c, b in self.to_byte.items()}
        names = {v: k for k, v in MARKS.items()}
        out: list[str] = []
        fit = opened = False
        for at, b in enumerate(data):
            if b in (ACUTE, DIAERESIS, TILDE, CAPITAL) and (fit if self.strict else out):
                last = out[-1]
                out[-1] = last.upper() if b == CAPITAL else self._marked(last, names[b])
            elif b in signs:
                c = signs[b]
                if not self.strict and b == LENIENT_SIGNS["«"]:
                    opened = not opened
                    c = "«" if opened else "»"
                out.append(c)
                fit = c.isalpha()
            elif self.strict:
                raise ValueError(f"unknown byte {b} at {at}")
            else:
                out.append(f"[{b}]")
        return "".join(out)

    def _marked(self, c: str, mark: str) -> str:
        whole = unicodedata.normalize("NFC", c + mark)
        return whole if self.strict or len(whole) == 1 else c


def convert(rows: DataFrame, variant: str) -> DataFrame:
    """(id, text) -> (id, coded, back): the bytes and what they decode to; null where the strict variant can't say the text."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec.of(variant)

        def both(text):
            try:
                data = codec.encode(text)
                return data, codec.decode(data)
            except ValueError:
                return None, None

        for batch in batches:
            found = [(None, None) if t is None else both(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["id", "coded", "back"])

    return rows.selectExpr("cast(id as long) id", "cast(text as string) text").mapInArrow(work, "id long, coded binary, back string")


def histogram(rows: DataFrame) -> DataFrame:
    """(data binary) -> byte, n: counted in each batch, and the batches' counts summed up."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for batch in batches:
            col = batch.column(0).drop_null().cast(pa.large_binary())
            if len(col):
                bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                total += np.bincount(np.frombuffer(col.buffers()[2], np.uint8, bounds[-1] - bounds[0], bounds[0]), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["byte", "n"])

    return rows.select("data").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def detect(data: Column, variant: str) -> Column:
    """The share of bytes that the variant knows, 0 if there are none."""
    one = F.decode(data, "ISO-8859-1")  # a character for each byte
    other = F.length(F.translate(one, "".join(map(chr, Codec.of(variant).valid)), ""))
    n = F.octet_length(data)
    return F.when(n > 0, (n - other) / n).otherwise(0.0)
