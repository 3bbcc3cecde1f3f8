"""Languages of words, spans and documents.

Learning counts the letter n-grams of each language's words on a bounded sample, and the scripts its
letters come from. A word is a run of letters with the marks that combine with them. The script of most of its
letters leaves the languages that use it; of these, the word's
score is the log-likelihood of its n-grams. Viterbi's best path over a document's words,
each change of language costing `switch`, labels spans of mixed-language text; the
documents of a batch go through the recursion side by side. A document's
language is that with most letters on the path, its score their share.
"""

from __future__ import annotations

import bisect
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, spare
from .tokens import Known, gathered, runs


def _ranges(kinds: str) -> str:
    """The code points whose Unicode category starts with one of the letters, as the inside of a character class."""
    found, start = [], None
    for n in range(sys.maxunicode + 2):
        inside = n <= sys.maxunicode and unicodedata.category(chr(n))[0] in kinds
        if inside and start is None:
            start = n
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{n - 1:08x}")
            start = None
    return "".join(found)


_LETTERS, _MARKS = _ranges("L"), _ranges("M")
WORD = re.compile(f"[{_LETTERS}][{_LETTERS}{_MARKS}]*")
#: Bytes of the texts that a worker labels side by side, at least.
RUN = 1_500_000
#: Texts that go through the recursion side by side, at least.
SIDE = 24
_PLAIN = re.compile("[A-Za-z]+")


def words(text: str) -> list[str]:
    return (_PLAIN if text.isascii() else WORD).findall(text)

#: First code points of script ranges in order, with the script (fixed values, Unicode blocks).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def main_script(word: str) -> str:
    """The script of most of its characters, the first on ties."""
    if word.isascii() or max(word) < "\u0370":
        return "Latin"
    return Counter(map(script, word)).most_common(1)[0][0]


def grams(word: str, most: int) -> list[str]:
    """The n-grams of 1 to `most` letters of the word between marks of its ends."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]  # log-likelihoods of an n-gram by language
    missing: np.ndarray  # of an n-gram that isn't known
    scripts: dict[str, np.ndarray]  # which languages use a script
    most: int


def _packed(places: np.ndarray, n: int) -> np.ndarray:
    """Each n neighbouring characters as one number."""
    out = np.zeros(max(0, len(places) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(16)) | places[k : len(places) - n + 1 + k].astype(np.uint64)
    return out


class Tables:
    """A model as a few arrays, which is what workers get: an object for each n-gram would take them tens of MB."""

    def __init__(self, model: Model):
        self.langs, self.most = model.langs, model.most
        self.users = {k: u for k, u in model.scripts.items() if u.any()}
        self.rows = np.stack([*model.weights.values(), model.missing]).astype(np.float32)  # the last for what isn't known
        # n-grams as numbers, 16 bits for each of their characters, in order, with their rows
        letters = sorted({c for g in model.weights for c in g})
        if model.most > 4 or len(letters) > 0xFFFF:
            raise ValueError("n-grams of more than 4 letters, or of too many different ones")
        self.letters = np.array([ord(c) for c in letters], np.int64)
        place, self.grams = self.places(), []
        for n in range(1, model.most + 1):
            own = [(i, g) for i, g in enumerate(model.weights) if len(g) == n]
            keys = _packed(place[np.frombuffer("".join(g for _, g in own).encode("utf-32-le", "surrogatepass"), np.uint32)], n)[::n]
            by = np.argsort(keys)
            self.grams.append((keys[by], np.array([i for i, _ in own], np.int32)[by]))

    def places(self) -> np.ndarray:
        """The number of each character, 0 for those in no n-gram."""
        out = np.zeros(0x110000, np.uint16)
        out[self.letters] = np.arange(1, len(self.letters) + 1)
        return out


class Labeller:
    """Keeps the scores of the words it has seen, about CACHE, and the words of the units between spaces."""

    CACHE = 150_000

    def __init__(self, model: Model | Tables, switch: float):
        self.m, self.switch = Tables(model) if isinstance(model, Model) else model, switch
        self.users, self.rows, self.grams, self.place = self.m.users, self.m.rows, self.m.grams, self.m.places()
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table, self.letters = np.zeros((1024, len(self.m.langs)), np.float32), np.zeros(1024, np.int32)
        self.units = Known()

    def numbers(self, found: list[str]) -> np.ndarray:
        """Each word's row in the table of scores."""
        new = [w for w in dict.fromkeys(found) if w not in self.at]
        while len(self.at) + len(new) > len(self.table):
            self.table, self.letters = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        for i in range(0, len(new), 5_000):
            part, n = new[i : i + 5_000], len(self.at)
            self.table[n : n + len(part)] = self._score(part)
            self.letters[n : n + len(part)] = list(map(len, part))
            self.at.update(zip(part, range(n, n + len(part))))
        return np.fromiter(map(self.at.__getitem__, found), np.uint32, len(found))

    def scores(self, found: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        return self.table[self.numbers(found)]

    def _score(self, found: list[str]) -> np.ndarray:
        low = [f"^{w.lower()}$" for w in found]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        places = self.place[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.repeat(np.cumsum(sizes), sizes)
        s = np.zeros((len(found), self.rows.shape[1]), np.float32)
        for n, (known, rows) in enumerate(self.grams, 1):
            keys = _packed(places, n)[np.arange(1, max(0, len(places) - n + 1) + 1) + n - 1 <= ends[: max(0, len(places) - n + 1)]]
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            row = np.where(known[at] == keys, rows[at], len(self.rows) - 1) if len(known) else np.full(len(keys), len(self.rows) - 1)
            each = np.maximum(sizes - n + 1, 0)
            some = np.flatnonzero(each)
            if len(some):
                s[some] += np.add.reduceat(self.rows[row], (np.cumsum(each) - each)[some], axis=0)
        s /= self.m.most
        every = np.ones(s.shape[1], bool)  # where no language is known to use the script, all remain
        narrow = np.array([self.users.get(main_script(w), every) for w in found])
        return np.where(narrow, s, s.max(1, keepdims=True) - 50.0)

    def _learn(self, units) -> tuple[np.ndarray, np.ndarray]:
        got = [words(u) for u in units.to_pylist()]
        return self.numbers([w for g in got for w in g]), np.array([len(g) for g in got], np.int64)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as rows of the table, end to end, and how many each text has. No word goes over a space, so
        only the distinct units between spaces are searched for words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.at) > self.CACHE:
            self._forget()
        cut = pc.split_pattern(pc.fill_null(pa.array(texts, pa.large_string()), ""), " ")
        units = cut.flatten().dictionary_encode()
        at = self.units.find(units.dictionary, self._learn)[units.indices.to_numpy()]
        sizes = self.units.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(self.units.ids, self.units.starts[at], sizes), np.diff(total[np.cumsum(np.append(0, cut.value_lengths().to_numpy()))])

    def best(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The language number of each word, on the best path of each text."""
        all_scores = self.table[numbers].astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")  # texts longer than t
        # from where few texts are left, each goes on by itself; the sums are the same, in the same order
        tail = max(1, int(np.searchsorted(-active, -SIDE, "right"))) if len(active) else 0
        begin = starts[order]
        stay = np.zeros(all_scores.shape, bool)
        source = np.zeros(len(all_scores), np.int16)  # best language before a change
        prev = np.zeros((len(lengths), all_scores.shape[1]))
        for t, n in enumerate(active[:tail].tolist()):
            at = begin[:n] + t
            p = prev[:n]
            if t:
                top = p.max(1)
                source[at] = p.argmax(1)
                change = (top - self.switch)[:, None]
                stay[at] = p >= change
                p = np.maximum(p, change) - top[:, None]
            prev[:n] = p + all_scores[at]
        label = np.zeros(len(all_scores), np.int16)
        now = np.zeros(len(lengths), np.int16)
        for j in range(int(active[tail]) if tail < len(active) else 0):
            first, end = int(begin[j]) + tail, int(begin[j] + lengths[order[j]])
            label[first:end], now[j] = self._alone(prev[j].tolist(), all_scores[first:end].tolist())
        for t in range(tail - 1, -1, -1):
            n = int(active[t])
            before = int(active[t + 1]) if t + 1 < len(active) else 0
            now[before:n] = prev[before:n].argmax(1)  # texts that end here
            at = begin[:n] + t
            label[at] = now[:n]
            if t:
                now[:n] = np.where(stay[at, now[:n]], now[:n], source[at])
        return label

    def _alone(self, p: list[float], rows: list[list[float]]) -> tuple[list[int], int]:
        """The rest of one text's path, given the sums before it, and the language before."""
        back = []
        for s in rows:
            top = max(p)
            change = top - self.switch
            back.append((p.index(top), [x >= change for x in p]))
            p = [(x if x >= change else change) - top + y for x, y in zip(p, s)]
        k, out = p.index(max(p)), []
        for best, keep in reversed(back):
            out.append(k)
            k = k if keep[k] else best
        return out[::-1], k

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """best() of texts given as words."""
        lengths = np.array([len(t) for t in texts], np.int64)
        return np.split(self.best(self.numbers([w for t in texts for w in t]), lengths), np.cumsum(lengths)[:-1]) if texts else []

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters by text and language on the best paths, the paths end to end, and how many words each text has."""
        numbers, lengths = self.read(texts)
        path, langs = self.best(numbers, lengths), len(self.m.langs)
        of = np.repeat(np.arange(len(texts)), lengths)
        return np.bincount(of * langs + path, self.letters[numbers], len(texts) * langs).reshape(len(texts), langs), path, lengths


def fit(docs: DataFrame, *, per_language: int = 300, most: int = 4, most_grams: int = 300_000, least_grams: int = 2_000, most_langs: int = 5_000) -> Model:
    """Learns from text and lang of the rows with neither null whose crc32(doc_id as text) mod
    4 isn't 2; of each language about `per_language` whole texts (those whose
    hash lies under that share). Each language keeps its most frequent n-grams: its part of `most_grams`, at least `least_grams`, and
    so every language of which a sampled text has letters can be predicted. More than `most_langs` values of lang are an error."""
    import pyarrow as pa

    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False)))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).toPandas()
    if len(share) > most_langs:
        raise ValueError(f"more than {most_langs} values of lang")
    # from Arrow, as rows of Python objects would start Python workers of another kind, which stay beside the others for a minute
    sizes = docs.sparkSession.createDataFrame(pa.table([pa.array(share["lang"].tolist(), pa.string()), pa.array([per_language / n for n in share["n"]], pa.float64())], names=["lang", "least"]))
    picked = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < F.col("least") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for w, n in Counter(words(text.lower())).items():
                    for g in grams(w, most):
                        seen[lang, g] += n
                    for c in w:
                        seen[lang, "script " + script(c)] += n
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "gram": [k[1] for k in seen], "n": list(seen.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    counts = picked.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = max(least_grams, most_grams // max(1, len(share)))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("gram").startswith("script ").desc(), F.desc("n"), "gram")))
    got = ranked.where(F.col("k") <= own).orderBy("lang", "gram").select("lang", "gram", "n").toPandas()
    langs = sorted(got["lang"].unique().tolist())
    place = {x: i for i, x in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for lang, gram, n in got.itertuples(index=False):
        into = scripts if gram.startswith("script ") else table
        into.setdefault(gram.removeprefix("script "), np.zeros(len(langs)))[place[lang]] = n
    total = np.sum([v for g, v in table.items() if len(g) == 1], axis=0) if table else np.zeros(len(langs))
    letters = np.sum(list(scripts.values()), axis=0) if scripts else np.zeros(len(langs))
    add = 0.5
    # what isn't seen counts as `add` each, so that a language with little text isn't sure of what it lacks
    whole = np.log(total + add * len(table) / most + 1)
    weights = {g: (np.log(v + add) - whole).astype(np.float32) for g, v in table.items()}
    missing = np.full(len(langs), math.log(add) - float(whole.mean()) if len(langs) else 0.0)
    return Model(langs, weights, missing, {s: v >= 0.01 * letters for s, v in scripts.items()}, most)


def _sent(docs: DataFrame, model: Model):
    """The model's tables for the workers; at most most_grams n-grams."""
    return docs.sparkSession.sparkContext.broadcast(Tables(model))


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def label(docs: DataFrame, model: Model, *, switch: float = 6.0, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; with `spans`, also the runs of one language as
    (lang, first character, length in characters).

    A text that is null or has no letter is `und` with score 0, and so is every text if there was nothing
    to learn from. Whole texts are labelled, however long. A null doc_id stays and isn't held out; repeated rows are
    labelled each, alike; equal shares go to the first language by name. No rows give none; other columns play no part.
    """
    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sent = _sent(docs, model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,length:int>>" * spans

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare()
        langs = sent.value.langs
        labeller = Labeller(sent.value, switch)
        for batch in batches:
            out: dict[str, list] = {"lang_pred": [], "score": [], "spans": []}
            for _, _, texts in runs(batch.column(1), RUN):
                if not langs:
                    share, path, lengths = np.zeros((len(texts), 1)), np.zeros(0, np.int16), np.zeros(len(texts), np.int64)
                else:
                    share, path, lengths = labeller.shares(texts)
                total, first = share.sum(1), share.argmax(1)
                out["lang_pred"] += [langs[k] if n else "und" for k, n in zip(first.tolist(), total.tolist())]
                out["score"] += (share.max(1) / np.maximum(total, 1)).tolist()
                if spans:
                    out["spans"] += [_runs(t, own, langs) if len(own) else [] for t, own in zip(texts, np.split(path, np.cumsum(lengths)[:-1]))]
            columns = [batch.column(0), pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(out["spans"], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    got = docs.mapInArrow(work, schema)
    rest = ["spans"] if spans else []
    return got.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", *rest)


def _runs(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    at = [m.span() for m in (_PLAIN if text.isascii() else WORD).finditer(text)]
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"lang": langs[path[a]], "start": at[a][0], "length": at[b - 1][1] - at[a][0]} for a, b in zip(edges, edges[1:])]


def accepted(docs: DataFrame, model: Model, *, least: float = 0.4, switch: float = 6.0) -> DataFrame:
    """The rows, with all columns, whose text has letters and a language that holds at least that share
    of them. Where there was nothing to learn from, none are."""
    at = docs.columns.index("text")
    sent = _sent(docs, model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare()
        langs = sent.value.langs
        labeller = Labeller(sent.value, switch)
        for batch in batches:
            for i, j, texts in runs(batch.column(at), RUN):
                share = labeller.shares(texts)[0] if langs else np.zeros((len(texts), 1))
                total = share.sum(1)
                # part by part, so that no second copy of a batch's texts is made, here or where they go
                yield batch.slice(i, j - i).filter(pa.array((share.max(1) >= least * total) & (total > 0)))
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(work, docs.schema)
