"""Command line: python -m textloom.cli COMMAND ... Results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import simple_tokens
from .operators import annotation, bpe, codec, corpus, lm, lotes, ner, report, search, training
from .session import session
from .sources import files, sinks
from .sources.butler import Butler
from .streaming.agent import Agent

#: Ways to search, and words that end an interactive run (fixed values).
MODES, EXITS = ("classic", "semantic", "rag"), {"exit", "quit", "salir", "q"}
NO_CHAPTER = "Sin capítulo detectado"
#: What experiments go through (fixed values).
TEMPERATURES, TOPS = (0.5, 0.8, 1.2), (10, 20, 50)


class Searcher:
    """Passages of a source, from an index where one is wanted and current, which is built where it isn't."""

    def __init__(self, spark: SparkSession, source: str | None, index: str | None, least: int, rebuild: bool = False):
        self.spark, self.tables = spark, None
        source = files.resolve(spark, source)
        made_of = sinks.manifest(spark.read.format("binaryFile").load(source), min_words=least)
        if index and not rebuild and sinks.is_current(spark, index, made_of, embedded=True):
            self.tables = sinks.load_index(spark, index)
        else:
            pages = files.html(spark, source).select(F.xxhash64("path").alias("id"), "html")
            found = corpus.passages(corpus.html_blocks(pages), least=least)
            rows = found.select(F.format_string("P%06d", "ord").alias("id"), "ord", "chapter", "part", "text")
            if rows.isEmpty():
                raise ValueError(f"no passage in {source}")
            if index:
                sinks.save_index(rows, index, made_of)
                self.tables = sinks.load_index(spark, index)
        self.passages = self.tables[0] if self.tables else search.embedded(search.annotate(rows))

    def find(self, query: str, mode: str, limit: int, chapter: str | None) -> DataFrame:
        if mode == "rag":
            best = search.rag(self.passages, query, limit=limit, chapter=chapter)
            return best.join(self.passages.select("id", "ord"), "id")
        if mode == "semantic":
            whole = search.analyze(self.spark, query)[0]
            return search.semantic(search.in_chapter(self.passages, chapter), search.hashed([whole])[0] or [0.0], limit=limit)
        if self.tables:
            return search.indexed(*self.tables, query, limit=limit, chapter=chapter)
        return search.classic(self.passages, query, limit=limit, chapter=chapter)

    def shown(self, query: str, mode: str, limit: int, chapter: str | None, most: int) -> list[str]:
        whole = search.analyze(self.spark, query)[0]
        best = self.find(query, mode, limit, chapter).join(self.passages.select("id", "chapter", "text"), "id")
        return best.withColumn("excerpt", search.excerpt(F.col("text"), whole, most)).drop("text").orderBy(F.desc("score"), "ord").toJSON().collect()

    def stats(self) -> DataFrame:
        return self.passages.agg(F.count("*").alias("passages"), F.avg(F.size(F.split("text", " "))).alias("mean_words"), F.countDistinct("chapter").alias("chapters"), F.countDistinct("part").alias("parts"))

    def chapters(self, limit: int = 20) -> DataFrame:
        return self.passages.groupBy(F.coalesce("chapter", F.lit(NO_CHAPTER)).alias("chapter")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(limit)


def interactive(found: Searcher, read=input, say=print) -> None:
    """Queries and commands, line by line: /help, /stats, /limit N, /chapter X or off, /mode M, and a word that ends it."""
    limit, chapter, mode = 5, None, "classic"
    while True:
        try:
            line = read("> ").strip()
        except EOFError:
            return
        name, _, rest = line.partition(" ")
        rest = rest.strip()
        if line.lower() in EXITS:
            return
        if not line:
            continue
        if name == "/help":
            say("/stats, /limit N, /chapter X or off, /mode " + "|".join(MODES) + ", " + ", ".join(sorted(EXITS)))
        elif name == "/stats":
            say(found.stats().toJSON().first())
        elif name == "/limit" and rest.isdigit() and 1 <= int(rest) <= 100:
            limit = int(rest)
        elif name == "/chapter" and rest:
            chapter = None if rest.lower() == "off" else rest
        elif name == "/mode" and rest in MODES:
            mode = rest
        elif name.startswith("/"):
            say(f"not understood: {line}")
        else:
            try:
                for row in found.shown(line, mode, limit, chapter, 340):
                    say(row)
            except ValueError as e:
                say(str(e))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "stats", "chapters", "interactive"):
        s = sub.add_parser(name)
        s.add_argument("--source")
        s.add_argument("--index")
        s.add_argument("--min-words", type=int, default=45)
        s.add_argument("--rebuild", "--force", action="store_true")
        s.add_argument("--no-cache", action="store_true")
        if name == "search":
            s.add_argument("query")
            s.add_argument("--mode", choices=MODES, default="classic")
            s.add_argument("--limit", type=int, default=5, choices=range(1, 101), metavar="1..100")
            s.add_argument("--chapter")
            s.add_argument("--max-chars", type=int, default=340, choices=range(120, 1201), metavar="120..1200")
    for name in ("encode", "decode", "detect"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--variant", choices=("lenient", "strict"), default="strict")
    s = sub.add_parser("analyze-bpe")
    s.add_argument("folder")
    s.add_argument("--size", type=int, default=300)
    t = sub.add_parser("ner")
    t.add_argument("model")
    for x in (s, t):
        x.add_argument("--text")
        x.add_argument("--file")
    s = sub.add_parser("train-causal", aliases=["train"])
    s.add_argument("folder")
    s.add_argument("--output", required=True)
    for name, value in (("size", 400), ("context", 128), ("rows", 32), ("width", 128), ("heads", 4), ("layers", 4), ("epochs", 8), ("seed", 42)):
        s.add_argument(f"--{name}", type=int, default=value)
    s = sub.add_parser("train-ner")
    s.add_argument("model", help="a trained language model")
    s.add_argument("conll")
    s.add_argument("--output", required=True)
    s.add_argument("--epochs", type=int, default=10)
    s.add_argument("--seed", type=int, default=42)
    for name in ("generate", "experiment-generate"):
        s = sub.add_parser(name)
        s.add_argument("model")
        s.add_argument("prompt")
        s.add_argument("--count", type=int, default=60)
        s.add_argument("--seed", type=int, default=42)
        if name == "generate":
            s.add_argument("--temperature", type=float, default=0.8)
            s.add_argument("--top-k", type=int, default=20)
    s = sub.add_parser("prepare-ner-data")
    s.add_argument("merged")
    s.add_argument("output")
    s = sub.add_parser("eval-ner")
    s.add_argument("model")
    s.add_argument("conll")
    s.add_argument("--output")
    s = sub.add_parser("report")
    s.add_argument("annotations")
    s.add_argument("assignments", nargs="+", help="of part 1, part 2, ...")
    s.add_argument("--output", required=True)
    s = sub.add_parser("templates")
    s.add_argument("folder")
    s.add_argument("output")
    s.add_argument("--files", type=int, default=13)
    s.add_argument("--each", type=int, default=6)
    s.add_argument("--min-words", type=int, default=20)
    s.add_argument("--seed", type=int, default=46)
    s = sub.add_parser("agent")
    s.add_argument("--turns", type=int)
    return p


def _one_of(p: argparse.ArgumentParser, spark: SparkSession, a: argparse.Namespace) -> str:
    if (a.text is None) == (a.file is None):
        p.error("give one of --text and --file")
    return a.text if a.text is not None else spark.read.text(a.file, wholetext=True).first()["value"]


def _trained(spark: SparkSession, folder: str, size: int) -> bpe.Bpe:
    return bpe.train(files.corpus(spark, folder).select(F.xxhash64("path").alias("id"), "text"), size)


def _model(spark: SparkSession, path: str) -> tuple:
    return training.unpacked(bytes(files.binary(spark, path).first()["data"]))


def _labelled(spark: SparkSession, path: str) -> DataFrame:
    """(id, words, labels) of a CoNLL file's sentences."""
    rows = files.conll(spark, path).groupBy("path", "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "label"))).alias("u"))  # a sentence's
    return rows.select(F.xxhash64("path", "sentence").alias("id"), F.transform("u", lambda x: x["word"]).alias("words"), F.transform("u", lambda x: x["label"]).alias("labels"))


def main(argv: list[str] | None = None) -> int:
    p = _parser()
    a = p.parse_args(argv)
    spark = session()

    def show(df: DataFrame) -> None:
        for row in df.toJSON().collect():
            print(row)

    if a.command in ("index", "search", "stats", "chapters", "interactive"):
        found = Searcher(spark, a.source, None if a.no_cache else a.index, a.min_words, a.rebuild)
        if a.command == "index":
            print(json.dumps({"passages": found.passages.count()}))
        elif a.command == "search":
            for row in found.shown(a.query, a.mode, a.limit, a.chapter, a.max_chars):
                print(row)
        elif a.command == "interactive":
            interactive(found)
        else:
            show(found.stats() if a.command == "stats" else found.chapters())
    elif a.command == "detect":
        show(files.binary(spark, a.file).select("path", (100 * codec.detect(F.col("data"), a.variant)).alias("percent")))
    elif a.command == "encode":
        text = spark.read.text(a.file, wholetext=True).first()["value"]
        print(codec.Codec.of(a.variant).encode(text).hex())
    elif a.command == "decode":
        print(codec.Codec.of(a.variant).decode(bytes(files.binary(spark, a.file).first()["data"])), end="")
    elif a.command == "analyze-bpe":
        text = _one_of(p, spark, a)
        print(json.dumps(bpe.analysis(spark, _trained(spark, a.folder, a.size), text), ensure_ascii=False))
    elif a.command == "ner":
        tagger, tok, _ = _model(spark, a.model)
        words = spark.createDataFrame([(0, _one_of(p, spark, a))], "id long, text string").select("id", simple_tokens(F.col("text")).alias("words"))
        show(ner.tagged(words, tok, tagger).select(F.explode("entities").alias("e")).select("e.*"))
    elif a.command in ("train-causal", "train"):
        tok = _trained(spark, a.folder, a.size)
        text = files.joined(files.corpus(spark, a.folder)).select(tok.ids(tok.encode(F.col("text"))).alias("ids")).first()
        model = lm.Transformer.random(len(tok.vocabulary), a.context, a.width, a.heads, a.layers, a.seed)
        config = {"context_size": a.context, "lr": training.RATE, "vocab_size": a.size, "d_model": a.width, "n_heads": a.heads, "n_layers": a.layers}

        def keep(_, row: dict) -> None:
            print(json.dumps(row))
            sinks.write_bytes(spark, training.packed(model, tok, config, row, a.seed), a.output)

        training.train_causal(model, text["ids"], length=a.context, rows=a.rows, epochs=a.epochs, seed=a.seed, after=keep)
    elif a.command == "train-ner":
        body, tok, about = _model(spark, a.model)
        tagger = ner.Tagger.of(body, a.seed)
        history = training.train_tagger(tagger, training.samples(_labelled(spark, a.conll), tok, len(body.w["places"])), epochs=a.epochs, seed=a.seed)
        sinks.write_bytes(spark, training.packed(tagger, tok, about["config"], history[-1], a.seed), a.output)
        for row in history:
            print(json.dumps(row))
    elif a.command in ("generate", "experiment-generate"):
        model, tok, _ = _model(spark, a.model)
        prompt = spark.range(1).select(tok.ids(tok.encode(F.lit(a.prompt))).alias("ids")).first()["ids"]
        said = lambda t, k: a.prompt + "".join(tok.vocabulary[i] for i in model.generate(prompt, a.count, temperature=t, k=k, seed=a.seed))
        if a.command == "generate":
            print(said(a.temperature, a.top_k))
        else:
            grid = lm.experiments(spark.createDataFrame([(t,) for t in TEMPERATURES], "temperature double"), spark.createDataFrame([(k,) for k in TOPS], "top_k int"))
            rows = [(r["temperature"], r["top_k"], said(r["temperature"], r["top_k"])) for r in grid.orderBy("temperature", "top_k").collect()]
            print(lm.as_markdown(rows, ["temperature", "top_k", "text"]), end="")
    elif a.command == "prepare-ner-data":
        rows = files.merged(spark, a.merged)
        sinks.write_conll(rows, a.output, one_file=True)
        show(lotes.conll_statistics(rows))
    elif a.command == "eval-ner":
        tagger, tok, _ = _model(spark, a.model)
        found = training.evaluated(_labelled(spark, a.conll), tok, tagger)
        sides = [annotation.entities(found.select("sentence", "pos", F.col(c).alias("tag"))) for c in ("pred", "gold")]
        numbers = F.create_map(*[F.lit(v) for kv in ner.LABELS.items() for v in kv])
        tokens = annotation.token_metrics(found.select(*[F.element_at(numbers, F.col(c)).alias(c) for c in ("pred", "gold")]))
        entities = annotation.entity_metrics(*sides)
        if a.output:
            sinks.write_metrics(tokens.crossJoin(entities.agg(F.collect_list(F.struct(*entities.columns)).alias("entities"))), a.output)  # a row by kind
        show(tokens)
        show(entities)
    elif a.command == "report":
        sinks.write_text(spark, report.page(report.of_files(spark, a.annotations, a.assignments)), a.output)
    elif a.command == "templates":
        sentences, own, made = lotes.made(files.corpus(spark, a.folder), files=a.files, each=a.each, least=a.min_words, seed=a.seed)
        sinks.write_templates(made, sentences, own, a.output)
    else:
        Agent(spark, Butler(log=lambda m: print(m, file=sys.stderr))).run(a.turns)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
