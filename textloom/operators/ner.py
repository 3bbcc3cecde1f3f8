"""Named entities from words: alignment of labels to subtokens, what a tagger's labels mean for words, and prediction.

Words and labels are arrays of a row. Encoding is by a trained BPE; as its tokens are characters
of a string (see bpe), so is a word's encoding, and all of this but the network stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .lm import Transformer

#: Numbers of labels (fixed values), and what a label that pads a batch is.
LABELS = {"O": 0, "B-PER": 1, "I-PER": 2, "B-LOC": 3, "I-LOC": 4}
PAD = -100
#: Words that are no entity, and words that are one, by kind (fixed values).
PLAIN = ["a", "an", "and", "as", "at", "be", "been", "being", "by", "drank", "followed", "for", "from", "in", "into", "is", "met", "of", "on", "ran", "the", "through", "to", "was", "were", "with"]
KNOWN = {
    "PER": ["alice", "caterpillar", "cheshire", "duchess", "gryphon", "hare", "hatter", "king", "march", "mock", "queen", "rabbit", "turtle", "white"],
    "LOC": ["garden", "hall", "oxford", "wonderland"],
}


def _letters(tokens: Column) -> Column:
    return F.filter(F.split(tokens, ""), lambda t: t != "")


def pieces(words: Column, tok: Bpe) -> Column:
    """Each word's subtokens, as an array of arrays of one-character tokens."""
    return F.transform(words, lambda w: _letters(tok.encode(w)))


def inside(label: Column) -> Column:
    """What the subtokens after a word's first are labelled."""
    return F.when(label.startswith("B-"), F.concat(F.lit("I-"), F.substring(label, F.lit(3), F.length(label)))).otherwise(label)


def aligned(words: Column, labels: Column, tok: Bpe, most: int | None = None) -> Column:
    """struct(tokens, labels) by subtoken: words parted by the subtokens of a space, labelled O; after a word's first, B is I."""
    space = _letters(tok.encode(F.lit(" ")))
    each = F.transform(
        F.arrays_zip(pieces(words, tok).alias("p"), labels.alias("l")),
        lambda z, i: F.struct(
            F.when(i > 0, F.concat(space, z["p"])).otherwise(z["p"]).alias("tokens"),
            F.concat(
                F.when(i > 0, F.transform(space, lambda s: F.lit("O"))).otherwise(F.array().cast("array<string>")),
                F.transform(z["p"], lambda p, k: F.when(k == 0, z["l"]).otherwise(inside(z["l"]))),
            ).alias("labels"),
        ),
    )
    tokens, tags = F.flatten(F.transform(each, lambda e: e["tokens"])), F.flatten(F.transform(each, lambda e: e["labels"]))
    if most is not None:
        tokens, tags = F.slice(tokens, 1, most), F.slice(tags, 1, most)
    return F.struct(tokens.alias("tokens"), tags.alias("labels"))


def word_spans(words: Column, tok: Bpe) -> Column:
    """Each word's subtokens as an array of struct(start, end) in the encoding of the words parted by spaces."""
    gap = F.size(_letters(tok.encode(F.lit(" "))))
    sizes = F.transform(pieces(words, tok), F.size)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def move(s: Column, n: Column) -> Column:
        start = F.when(F.size(s["out"]) > 0, s["at"] + gap).otherwise(s["at"])
        return F.struct((start + n).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + n).alias("end")))).alias("out"))

    return F.aggregate(sizes, state, move, lambda s: s["out"])


def explained(words: Column, labels: Column, tok: Bpe) -> Column:
    """A line for each word: the word, its label, and its pieces with theirs."""

    def line(z: Column) -> Column:
        pairs = F.transform(z["p"], lambda p, k: F.concat(tok.decode(p), F.lit("/"), F.when(k == 0, z["l"]).otherwise(inside(z["l"]))))
        return F.concat(F.rpad(z["w"], F.greatest(F.lit(15), F.length(z["w"])), " "), F.lit(" "), F.rpad(z["l"], F.greatest(F.lit(6), F.length(z["l"])), " "), F.lit(" -> "), F.array_join(pairs, "  "))

    return F.transform(F.arrays_zip(words.alias("w"), labels.alias("l"), pieces(words, tok).alias("p")), line)


def padded(values: Column, length: Column, pad: int) -> Column:
    """An array of numbers filled up to a length."""
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def label_ids(labels: Column) -> Column:
    numbers = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])
    return F.transform(labels, lambda x: F.element_at(numbers, x))


def word_label(subtokens: Column) -> Column:
    """A word's label from its subtokens' labels: B and the kind that most have, the first on ties; O where none has one."""
    kinds = F.transform(F.filter(subtokens, lambda x: x != "O"), lambda x: F.substring(x, F.lit(3), F.length(x)))
    ranked = F.transform(F.array_distinct(kinds), lambda k, i: F.struct(F.size(F.filter(kinds, lambda x: x == k)).alias("n"), (-i).alias("first"), k.alias("k")))
    return F.when(F.size(kinds) > 0, F.concat(F.lit("B-"), F.array_max(ranked)["k"])).otherwise("O")


def refined(word: Column, label: Column) -> Column:
    """A word's label once words that can be no entity, words known as one and persons in lower case are seen to."""
    low, capital = F.lower(word), F.left(word, F.lit(1)).rlike(r"^\p{Lu}")
    out = F.when(~word.rlike(r"[\p{L}\p{N}]"), "O").when(low.isin(*PLAIN), "O")
    for kind, names in KNOWN.items():
        out = out.when(low.isin(*names) & ((label != "O") | capital), f"B-{kind}")
    return out.when(label.startswith("B-PER") & F.left(word, F.lit(1)).rlike(r"^\p{Ll}"), "O").otherwise(label)


def grouped(words: Column, labels: Column) -> Column:
    """An array of struct(text, type): runs of words whose labels are of one kind, joined by spaces."""
    state = F.struct(F.lit(None).cast("string").alias("kind"), F.array().cast("array<struct<text:string,type:string>>").alias("out"))

    def move(s: Column, z: Column) -> Column:
        kind = F.when(z["l"] != "O", F.substring(z["l"], F.lit(3), F.length(z["l"])))
        last = F.element_at(s["out"], -1)
        longer = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(F.concat(last["text"], F.lit(" "), z["w"]).alias("text"), kind.alias("type"))))
        more = F.concat(s["out"], F.array(F.struct(z["w"].alias("text"), kind.alias("type"))))
        return F.struct(kind.alias("kind"), F.when(kind.isNull(), s["out"]).when(kind == s["kind"], longer).otherwise(more).alias("out"))

    return F.aggregate(F.arrays_zip(words.alias("w"), labels.alias("l")), state, move, lambda s: s["out"])


class Tagger:
    """A transformer that sees all of its input, with a layer of labels in place of its output."""

    def __init__(self, body: Transformer, head: np.ndarray, bias: np.ndarray):
        if body.causal:
            raise ValueError("the body of a tagger isn't causal")
        self.body, self.head, self.bias = body, head, bias

    @classmethod
    def random(cls, vocabulary: int, length: int, width: int, heads: int, layers: int, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed + 1)
        return cls(Transformer.random(vocabulary, length, width, heads, layers, seed, causal=False), rng.normal(0, 0.02, (width, len(LABELS))), np.zeros(len(LABELS)))

    @classmethod
    def of(cls, model: Transformer, seed: int = 0) -> Tagger:
        """A tagger that starts from a language model's weights."""
        width = model.w["tokens"].shape[1]
        return cls(Transformer(dict(model.w), model.heads, causal=False), np.random.default_rng(seed).normal(0, 0.02, (width, len(LABELS))), np.zeros(len(LABELS)))

    def logits(self, ids: list[int]) -> np.ndarray:
        if len(ids) > len(self.body.w["places"]):
            raise ValueError(f"{len(ids)} ids, at most {len(self.body.w['places'])}")
        return self.body.hidden(ids) @ self.head + self.bias

    def loss(self, ids: list[int], labels: list[int]) -> float:
        """Mean cross-entropy over the labels that don't pad."""
        z = self.logits(ids)
        own = [(z[i] - z[i].max(), y) for i, y in enumerate(labels) if y != PAD]
        return float(np.mean([np.log(np.exp(x).sum()) - x[y] for x, y in own])) if own else 0.0


def tagged(sentences: DataFrame, tok: Bpe, tagger: Tagger) -> DataFrame:
    """(id, words) -> (id, words, labels, entities): the tagger's labels of the last subtokens that fit, as words' labels, refined, and
    the entities that they make. Words whose subtokens don't fit have the label O."""
    length, names = len(tagger.body.w["places"]), list(LABELS)
    rows = sentences.select("id", "words", tok.ids(F.array_join(F.transform("words", lambda w: tok.encode(w)), " " if " " in tok.chars else tok.chars[0])).alias("ids"), word_spans(F.col("words"), tok).alias("spans"))

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for ids in batch.column(2).to_pylist():
                cut = max(0, len(ids) - length)
                found.append([None] * cut + [names[k] for k in tagger.logits(ids[cut:]).argmax(1)] if len(ids) > cut else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "tags"])

    schema = rows.schema.simpleString()[7:-1] + ",tags:array<string>"
    out = rows.mapInArrow(predict, ", ".join(_fields(schema)))
    own = F.transform("spans", lambda s: word_label(F.filter(F.slice("tags", s["start"] + 1, s["end"] - s["start"]), lambda x: x.isNotNull())))
    labels = F.transform(F.arrays_zip(F.col("words").alias("w"), own.alias("l")), lambda z: refined(z["w"], z["l"]))
    return out.withColumn("labels", labels).select("id", "words", "labels", grouped(F.col("words"), F.col("labels")).alias("entities"))


def _fields(schema: str) -> list[str]:
    """The fields of a struct's short form, as `name type`."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = schema[start:i].split(":", 1)
            out.append(f"`{name}` {kind}")
            start = i + 1
    return out
