"""From pages and texts to passages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Marks of text that isn't the book's, and of where the book starts and ends (fixed values).
NOISE_MARKS = ["project gutenberg", "this ebook", "produced by", "html version by", "updated editions"]
START, END = "*** START OF THE PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG"
#: Headings of the front matter, normalized (fixed values).
FRONT = ["tasa", "testimonio de las erratas", "el rey", "prologo", "al libro de don quijote de la mancha"]
#: Tags of blocks and headings (fixed values).
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = ["div", "p", "li", "blockquote", *HEADINGS]
#: Sizes in words (fixed values): of a unit, the most of a unit, of a passage, of the overlap, the least of a block and its characters.
UNIT, UNIT_MOST, TARGET, OVERLAP, LEAST_BLOCK, LEAST_CHARS = 90, 140, 120, 35, 8, 16


def is_noise(x: Column, *, first: bool = False) -> Column:
    """Whether a block's text isn't the book's; `first`: by the fewer rules of the first version."""
    bound = F.transform(F.array(F.struct(x.alias("text"), T.normalize(x).alias("norm"))), lambda s: _noisy(s["text"], s["norm"], first))
    return F.get(bound, F.lit(0))


def _noisy(text: Column, norm: Column, first: bool) -> Column:
    out = norm == ""
    for m in NOISE_MARKS:
        out |= norm.contains(m)
    # fixed values: how often a word may stand, and patterns of hyphens, numbers and roman numerals
    out |= F.length(norm) - F.length(F.replace(norm, F.lit("capitulo"), F.lit(""))) >= 3 * len("capitulo")
    out |= F.regexp_count(text, F.lit(r"(?Ui)\b[\wáéíóúüñ]+-\b")) >= 3
    out |= norm.rlike(r"^(\p{Nd}+|[ivxlcdm]+)$")
    if not first:
        out |= norm.contains("capitulo") & (F.regexp_count(norm, F.lit(r"(?U)\bde\b")) >= 8)
        out |= norm.contains("donde") & (F.regexp_count(norm, F.lit(r"(?U)\bdonde\b")) >= 4)
    return out


class _Reader(HTMLParser):
    """Blocks in the order in which they close. A frame gives its text if it is a heading or holds no other block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.frames: list[list] = []  # tag, pieces, whether it holds a block
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipping += 1
        elif self.skipping:
            return
        elif tag in BLOCKS:
            if self.frames:
                self.frames[-1][2] = True
            self.frames.append([tag, [], False])
        elif tag == "br" and self.frames:
            self.frames[-1][1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping and tag in BLOCKS and any(f[0] == tag for f in self.frames):
            closed = None
            while closed != tag:
                closed = self._pop()

    def handle_data(self, data):
        if self.frames and not self.skipping:
            self.frames[-1][1].append(data)

    def _pop(self) -> str:
        tag, pieces, holds = self.frames.pop()
        text = " ".join("".join(pieces).split())
        if text and (tag in HEADINGS or not holds):
            self.found.append((tag, text))
        return tag


def html_blocks(pages: DataFrame) -> DataFrame:
    """(id, html) -> (id, pos, tag, text), read by the standard library's event parser."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {"id": [], "pos": [], "tag": [], "text": []}
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = _Reader()
                reader.feed(page or "")
                reader.close()
                for pos, (tag, text) in enumerate(reader.found):
                    for k, v in zip(out, (i, pos, tag, text)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string())]))

    return pages.selectExpr("cast(id as long) id", "cast(html as string) html").mapInArrow(read, "id long, pos int, tag string, text string")


def headed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks between the book's start and end marks (all, up to an end mark, where they aren't both there),
    without noise, with the part and chapter that the headings before them set."""
    page, before = Window.partitionBy("id"), Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upper, heading = F.upper("text"), F.col("tag").isin(*HEADINGS)
    marked = blocks.withColumn("starts", upper.contains(START)).withColumn("ends", upper.contains(END))
    both = F.max("starts").over(page) & F.max("ends").over(page)
    inside = marked.where("true").withColumn("both", both).withColumn("started", F.max("starts").over(before)).withColumn("ended", F.max(F.col("ends") & (~F.col("both") | F.col("started"))).over(before))
    inside = inside.where((~F.col("both") | F.col("started")) & ~F.col("ended") & ~F.col("starts") & ~is_noise(F.col("text")))
    part = heading & F.col("text").rlike(r"(?iU)^(primera|segunda)\s+parte\b")
    chapter = heading & ~part & F.col("text").rlike(r"(?iU)^(cap[ii]tulo|pr[oó]logo)\b")
    first = heading & ~part & ~chapter & T.normalize(F.col("text")).isin(*FRONT)
    headed = inside.withColumn("part", F.last(F.when(part, F.col("text")), ignorenulls=True).over(before))
    # front matter names a chapter only until the first real one
    named = F.coalesce(F.last(F.when(chapter, F.col("text")), ignorenulls=True).over(before), F.first(F.when(first, F.col("text")), ignorenulls=True).over(before))
    headed = headed.withColumn("chapter", named)
    return headed.select("id", "pos", "tag", "text", "part", T.chapter_label(F.col("part"), F.col("chapter")).alias("chapter"))


def split_unit(text: str) -> list[str]:
    """A block as units of about UNIT words, at sentence ends where they allow it."""
    import re

    text = " ".join(text.split())
    if len(text.split()) <= UNIT:
        return [text]
    units: list[list[str]] = [[]]
    out: list[str] = []

    def settle() -> None:
        if units[-1]:
            out.append(" ".join(units[-1]))
            units.append([])

    for s in filter(None, re.split(r"(?<=[.!?;:])\s+", text)):
        w = s.split()
        if len(w) > UNIT_MOST:
            settle()
            out += [" ".join(w[i : i + UNIT]) for i in range(0, len(w), UNIT)]
            continue
        if len(units[-1]) + len(w) > UNIT:
            settle()
        units[-1] += w
    settle()
    return [u for u in out if len(u.split()) >= LEAST_BLOCK]


def chunk(units: list[str], least: int) -> list[str]:
    """Passages of about TARGET words from units in order; each starts OVERLAP words before the last one's end."""
    sizes = [len(u.split()) for u in units]
    out, start = [], 0
    while start < len(units):
        end = size = 0
        end = start
        while end < len(units) and size < TARGET:
            size += sizes[end]
            end += 1
        words = " ".join(units[start:end]).split()
        out += [" ".join(words[i : i + TARGET + 20]) for i in range(0, len(words), TARGET + 20) if len(words[i : i + TARGET + 20]) >= least]
        if end == len(units):
            break
        back = shared = 0
        while shared < OVERLAP and end - back > start:
            back += 1
            shared += sizes[end - back]
        start = max(end - back, start + 1)
    return out


def passages(blocks: DataFrame, *, least: int = 45) -> DataFrame:
    """(id, pos, tag, text) -> (id, ord, part, chapter, text): overlapping passages within runs of equal part and chapter.

    A source's blocks are gathered in order, as a passage's start depends on the one before.
    """
    rows = headed_blocks(blocks).where(~F.col("tag").isin(*HEADINGS))
    rows = rows.where((T.word_count(F.col("text")) >= LEAST_BLOCK) & (F.length(T.normalize(F.col("text"))) >= LEAST_CHARS))

    def of_source(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        out, run, key = [], [], None

        def settle():
            out.extend((*key, text) for text in chunk(run, least)) if run else None

        for part, chapter, text in zip(pdf["part"], pdf["chapter"], pdf["text"]):
            if (part, chapter) != key:
                settle()
                run, key = [], (part, chapter)
            run += split_unit(text)
        settle()
        strings = {c: pd.Series([o[k] for o in out], dtype=object) for k, c in enumerate(("part", "chapter", "text"))}
        return pd.DataFrame({"id": pd.Series([pdf["id"].iloc[0]] * len(out), dtype="int64"), "ord": pd.Series(range(len(out)), dtype="int64"), **strings})

    return rows.groupBy("id").applyInPandas(of_source, "id long, ord long, part string, chapter string, text string")


def word_windows(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, text): windows of n words."""
    w = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    pieces = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / n).cast("int"))).alias("piece"))
    return pieces.select("doc_id", "piece", F.array_join(F.slice("w", F.col("piece") * n + 1, n), " ").alias("text"))


def places(text: Column, sought: Column) -> Column:
    """Every place (from 1) at which a string stands in a text, places that overlap included.

    The text is cut before each of them, and the pieces' lengths are summed.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(sought, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    none = F.array().cast("array<long>")
    begun = F.when(F.startswith(text, sought), F.array(F.lit(1).cast("long"))).otherwise(none)
    state = F.struct(F.lit(1).cast("long").alias("next"), begun.alias("at"))

    def move(s: Column, piece: Column) -> Column:
        after = s["next"] + F.length(piece)
        return F.struct(after.alias("next"), F.concat(s["at"], F.array(after)).alias("at"))

    pieces = F.split(text, quoted, -1)
    cut = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # the last piece has no place after it
    return F.when(F.length(sought) > 0, F.aggregate(cut, state, move, lambda s: s["at"])).otherwise(none)


def overlapping_lines(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id, line_no, at): asked passages found in texts, at every place, with each line whose characters they overlap.

    Passages and texts meet on the longest pair of a passage's inner words, which stand whole wherever it does; its first and last
    word may be parts of longer ones. Passages without such a pair are held against every text.
    """
    def words(x: Column) -> Column:
        return F.filter(F.split(x, r"[ \n]"), lambda t: t != "")

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, 1_000_000_000), lambda a, b: F.concat_ws(" ", a, b))

    w = words(F.col("passage"))
    inner = pairs(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
    longest = F.array_max(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("k"))))["k"]
    asked = asked.where("passage <> ''").withColumn("k", longest)
    keyed = docs.select("doc_id", F.explode(F.array_distinct(pairs(words(F.col("text"))))).alias("k"))
    may = keyed.join(asked.where("k is not null").select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    found = F.col("text").contains(F.col("passage"))
    hits = may.join(docs, "doc_id").join(asked, "item_id").where(found).select("item_id", "doc_id", "passage", "text")
    hits = hits.union(docs.join(asked.where("k is null"), found).select("item_id", "doc_id", "passage", "text"))
    spread = hits.select("item_id", "doc_id", "passage", "text", F.explode(places(F.col("text"), F.col("passage"))).alias("at"))
    # lines from the one after the line feeds before the place to the one before the passage's end; a line feed at either end is of no line
    feed = F.lit("\n")
    feeds = lambda x: F.length(x) - F.length(F.replace(x, feed))
    before = feeds(F.substring(F.col("text"), F.lit(1), (F.col("at") - 1).cast("int")))
    first = before + F.startswith(F.col("passage"), feed).cast("int")
    last = before + feeds(F.col("passage")) - F.endswith(F.col("passage"), feed).cast("int")
    lines = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))
    return spread.select("item_id", "doc_id", F.explode(lines).alias("line_no"), "at")
