"""Packing of token ids into training windows, in document order.

Each task takes the documents of its partition as one stream of ids (a
document's own and an end id) and cuts it into windows of at most `window` ids.
A window may end after any document at no cost, after any sentence (an id whose
text ends in . ! ? or a line feed) at `sentence` and, where a sentence runs on for
long (4 * stride ids, or a window's), every `stride` ids at `hard`. Dynamic programming over these places finds
the cuts of least padding plus costs: with f the best cost up to a place and p
its position, f(j) = cost(j) + min over p(j) - p(i) <= window of
f(i) + window - (p(j) - p(i)). What depends on i is f(i) + p(i), and the range of
i only moves on, so a monotone queue holds its minimum and each place is pushed
and popped once.

A stream is settled every `segment` ids at the end of a document, so memory
stays bounded; that leaves one short window for each segment and partition. There is
no shuffle: partitions need nothing of each other, as a sequence's number
holds the partition's. Windows whose length is a power of two need no padding,
but the program doesn't seek them, as many short ones would only make more sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import pick, spare
from .tokens import encoder, runs

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(places: list[int], costs: list[float], window: int) -> list[int]:
    """Positions of the window ends for ascending places (the last is the end) and the
    costs of cutting there. A gap of more than window ids between places is an error."""
    best, back = [0.0], [0]
    at, queue, base = [0, *places], deque([(0.0, 0, 0)]), 0.0
    for j, (p, c) in enumerate(zip(places, costs), 1):
        while queue and queue[0][1] < p - window:
            queue.popleft()
        if not queue:
            raise ValueError(f"no place to cut within {window} ids before {p}")
        base, _, i = queue[0]
        back.append(i)
        best.append(base + window - p + c)
        g = base + window + c
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, p, j))
    found, j = [], len(places)
    while j:
        found.append(at[j])
        j = back[j]
    return found[::-1]


class Packer:
    def __init__(self, path: str, end_id: int, window: int, sentence: float, hard: float, stride: int):
        self.enc, self.window = encoder(path), window
        self.sentence, self.hard, self.stride = sentence, hard, max(1, min(stride, window))
        vocab = self.enc.tok.get_vocab()
        self.stops = np.zeros(max(max(vocab.values()), end_id) + 1, bool)
        self.stops[[i for t, i in vocab.items() if t.endswith((".", "!", "?", "Ċ"))]] = True  # Ċ is the vocabulary's line feed

    def places(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[float]]:
        cost = np.full(len(ids) + 1, np.inf, np.float32)
        cost[np.flatnonzero(self.stops[ids]) + 1] = self.sentence
        cost[ends] = 0
        known = np.concatenate([[0], np.flatnonzero(cost[1:] < np.inf) + 1])
        for i in np.flatnonzero(np.diff(known) > min(4 * self.stride, self.window)):
            a, b = int(known[i]), int(known[i + 1])
            cost[np.arange(a + self.stride, b, self.stride)] = self.hard
        at = np.flatnonzero(cost[1:] < np.inf) + 1
        return at.tolist(), cost[at].tolist()

    def pack(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, first: int) -> tuple[dict, int]:
        """Columns of SCHEMA for the documents' ids (with end ids, end to end), and the next sequence's number."""
        ends = np.cumsum(sizes)
        windows = np.array(cuts(*self.places(ids, ends), self.window))
        stop = np.union1d(ends, windows)
        start = np.concatenate([[0], stop[:-1]])
        doc, seq = np.searchsorted(ends, start, "right"), np.searchsorted(windows, start, "right")
        begin = np.concatenate([[0], ends])
        view = memoryview(ids).cast("B")
        return {
            "doc_id": [doc_ids[i] for i in doc.tolist()],
            "start": start - begin[doc],
            "length": stop - start,
            "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())],
            "doc_tokens": ends[doc] - begin[doc],
            "sequence_id": seq + first,
            "offset": start - np.concatenate([[0], windows])[seq],
        }, first + len(windows)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 0, window: int = 1024, sentence: float = 2, hard: float = 12, stride: int = 16, segment: int = 4_000_000) -> DataFrame:
    """A row for each piece of a document: which ids (start, length), their
    crc32, the document's ids with the end id, the sequence and the place there.

    Null or empty text: the end id alone. A null doc_id stays null; rows that
    repeat are packed each; no rows give none. Other columns play no part.
    Very long texts are cut at sentences, and where these run on, in between. Any window of 1 or more will do.
    """
    if window < 1:
        raise ValueError("window must be at least 1")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        spare(forget=False)
        packer, number = Packer(tokenizer, end_id, window, sentence, hard, stride), TaskContext.get().partitionId() << 32
        held_docs, held_ids, held_sizes, size = [], [], [], 0
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def settle():
            nonlocal number, size
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            held_ids.clear(), held_sizes.clear()
            columns, number = packer.pack(held_docs, ids, sizes, number)
            held_docs.clear()
            size = 0
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, texts in runs(batch.column(1)):
                ids, sizes = packer.enc.encode(texts, end_id)
                held_docs += docs[i:j]
                held_ids.append(ids)
                held_sizes.append(sizes)
                size += len(ids)
                del ids, sizes, texts
                if size >= segment:
                    yield settle()
        if held_docs:
            yield settle()

    return pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, SCHEMA)
