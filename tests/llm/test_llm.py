"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, no rows, and columns whose names clash."""

import inspect
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bit_sliced, coder, html_text, languages, line_dedup, minhash, packing, permutations, quality, sentence_pieces, token_file, tokens
from textloom.llm.common import pick, tokenizer_path
from textloom.llm.tokens import encoder

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, changes, rng=RNG):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


BASE = [prose(80) for _ in range(12)]
LINE = "A line that is long enough to count as repeated. "
DOCS = [
    *enumerate(BASE),
    *[(100 + i, near(BASE[i % 3], i % 5)) for i in range(20)],
    (200, None), (201, ""), (202, " \n\t "), (203, "two words"), (204, "TWO  words"), (205, "é ñ 日本 " * 3), (206, prose(6000)),
    *[(300 + i, f"{prose(5)}\n  {LINE.upper() if i % 2 else LINE}\n{prose(3)}\n") for i in range(6)],
    (300, f"again\n{LINE}"), (None, f"no id\n{LINE}"), (1, BASE[1]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", 7, "clash") for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, bucket int, TEXT string").repartition(3).toDF("doc_id", "text", "key", "bucket", "TEXT")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, quality int, vec_id long, embedding array<float>, page_id long, url string, html string")


def test_pick_takes_the_exact_name(docs):
    assert {r["t"] for r in pick(docs, t="TEXT").collect()} == {"clash"}
    with pytest.raises(ValueError, match="no column"):
        pick(docs, t="absent")


# near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_match_brute_force(docs, none):
    sets = {}
    for d, t in DOCS:
        sets.setdefault(d, []).append(shingle_set(t))
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    flat = [(d, s) for d, own in sets.items() for s in own if d is not None and s]
    for (a, x), (b, y) in itertools.combinations(flat, 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((d or -1, len(s)) for d, own in sets.items() for s in own)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == find(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(none).count() == 0


def _components(sets):
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    flat = list(sets.items())
    for i, (a, x) in enumerate(flat):
        for b, y in flat[i + 1 :]:
            if len(x) * 75 <= len(y) * 100 and len(y) * 75 <= len(x) * 100 and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                top[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("options", [{}, {"most_rounds": 0, "part": 7}, {"most_sent": 0, "part": 50, "most_rounds": 1}])
def test_large_groups_about_the_threshold(spark, options, monkeypatch):
    """Hundreds of copies of one text, changed more or less: whether two are linked is open until their sets are compared."""
    rng = random.Random(12)
    base = prose(90, rng)
    rows = [(i, near(base, rng.randint(0, 9), rng)) for i in range(500)]
    rows += [(1000 + i, near(near(base, 14, rng), rng.randint(0, 2), rng)) for i in range(60)]
    rows += [(2000 + i, base) for i in range(300)] + [(3000 + i, prose(40, rng)) for i in range(50)]
    seen = []
    possible = minhash._possible
    monkeypatch.setattr(minhash, "_possible", lambda *a: seen.append(1) or possible(*a))
    want = _components({d: shingle_set(t) for d, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options).collect()}
    assert got == want and len(set(want.values())) > 80
    assert seen or options == {}


def test_buckets_that_can_link_nothing_more_are_met_once(spark, monkeypatch):
    """Copies of one text, many linked with nothing: their rows by bucket are written once, for no round that links little."""
    rng = random.Random(5)
    base = prose(90, rng)
    rows = [(i, near(base, i % 14, rng)) for i in range(1, 300)]
    written, stored = [], minhash.stored

    def counted(df, name):
        out = stored(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == _components({d: shingle_set(t) for d, t in rows})
    assert 0 < sum(n for name, n in written if name == "rest") <= sum(n for name, n in written if name == "shared")


def test_shared_shingles_bound_similarity(spark):
    """Documents go only where nothing in their buckets can be similar enough."""
    rng = random.Random(3)
    base = prose(60, rng)
    texts = {i: near(base, rng.randint(0, 8), rng) for i in range(80)}
    known = minhash.Hashes()
    sets = {i: minhash.shingles(t, 5, known) for i, t in texts.items()}
    rest = spark.createDataFrame([(0, i, i, len(s)) for i, s in sets.items()], "bucket long, id long, component long, n long")
    held = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "id long, shingles array<long>")
    left = {r["id"] for r in minhash._possible(rest, held, 75, []).collect()}
    true = {i: set(s.tolist()) for i, s in sets.items()}
    linked = {i for i, j in itertools.permutations(true, 2) if 100 * len(true[i] & true[j]) >= 75 * len(true[i] | true[j])}
    assert linked <= left < set(sets)


def test_odd_sketches_follow_similarity():
    signer, known = minhash.Signer(44, 5), minhash.Hashes()
    a, b, c = (minhash.shingles(t, 5, known) for t in (BASE[0], near(BASE[0], 1), BASE[1]))
    x, y, z = (signer.sketch(signer.samples(s)) for s in (a, b, c))
    apart = lambda p, q: int(np.bitwise_count((p ^ q).view(np.uint64)).sum())
    assert apart(x, x) == 0 < apart(x, y) < apart(x, z)


def test_sketch_bound_holds_by_the_exact_tail():
    tail, bound = minhash._tail(75, 220), minhash._bound(75, 220)
    assert abs(tail[149] - 8.2e-6) < 1e-7  # what the bound of 4.5 deviations missed
    assert tail[bound] <= 2.867e-7 < tail[bound - 1]
    rng = np.random.default_rng(0)
    flips = rng.integers(0, 64 * minhash.LONGS, (4000, 440))
    n = rng.binomial(220, 0.25, 4000)
    apart = [int((np.bincount(f[: 2 * k]) & 1).sum()) for f, k in zip(flips, n)]
    assert abs(np.mean(np.array(apart) > 110) - tail[110]) < 0.03


# lines


def deduped(rows):
    """What dedup_lines should make of (doc_id, text) rows."""
    holders = {}
    for d, t in rows:
        for k in {line_dedup.key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, set()).add(d)
    keeper = {k: max(own - {None}) for k, own in holders.items() if len(own - {None}) >= 5}
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(line_dedup.key(x), d) == d]
        want.append((-1 if d is None else d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(want)


@pytest.mark.parametrize("most_sent", [1_000_000, 1, 0])
def test_lines_match_brute_force(spark, docs, none, most_sent):
    def got(df):
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(df, most_sent=most_sent).collect())

    want = deduped(DOCS)
    assert got(docs) == want and sum(r[2] for r in want) == 7
    # rows that repeat a doc_id are one document: five rows of four documents don't make a line repeated
    other = "Another line of more than forty characters, here."
    rows = [(1, f"{LINE}\n{other}")] * 3 + [(2, LINE)] * 2 + [(d, f"{other}\n{other.upper()}") for d in (3, 4, 5, 6)] + [(3, other)] + [(None, LINE)] * 4
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == deduped(rows)
    assert line_dedup.dedup_lines(none, most_sent=most_sent).count() == 0


def test_a_small_filter_gives_the_same(docs):
    a, b = (sorted(map(tuple, line_dedup.dedup_lines(docs, most_bits=n).fillna(-1).collect())) for n in (1, 1 << 31))
    assert a == b


# tokens, packing and the coded file


def each(enc, texts, end=None):
    ids, sizes = enc.encode(texts, end)
    assert int(sizes.sum()) == len(ids)
    return np.split(ids, np.cumsum(sizes)[:-1])


def test_units_give_the_library_s_ids(monkeypatch):
    enc = encoder(tokenizer_path())
    rng = random.Random(1)
    pieces = [*"ab \n\t.,'é　\x1c12", "<|endoftext|>", " ", " ", "  "]
    texts = [t for _, t in DOCS if t] + ["a  b", "  x", " \n a", "x\x1c.y", "a<|endoftext|> b ", "it's  's", "tab\t\tx", "　é"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in each(enc, texts)] == want
    assert [x.tolist() for x in each(enc, texts, 7)] == [[*w, 7] for w in want]
    assert [x.tolist() for x in each(enc, [None, "", "  "], 0)] == [[0], [0], [*enc.tok.encode("  ").ids, 0]]
    assert [len(x) for x in enc.encode([])] == [0, 0]
    monkeypatch.setattr(tokens, "CACHE", 50)  # units are forgotten on the way
    assert [x.tolist() for part in (texts[:20], texts[20:]) for x in each(enc, part)] == want


def test_cuts_are_optimal():
    for seed in range(80):
        rng = random.Random(seed)
        window = rng.randint(4, 20)
        places = list(itertools.accumulate(rng.randint(1, window) for _ in range(rng.randint(1, 40))))
        costs = [rng.choice([0, 1, 2, 5]) for _ in places]
        at, best = [0, *places], [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + window - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= window) + costs[j - 1])
        found = packing.cuts(places, costs, window)
        spent = sum(window - (b - a) + costs[places.index(b)] for a, b in zip([0, *found], found))
        assert abs(spent - best[-1]) < 1e-9 and all(b - a <= window for a, b in zip([0, *found], found))


@pytest.mark.parametrize("window", [1, 7, 33, 64, 1024])
def test_packing_places_every_id_once(docs, none, window):
    enc = encoder(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), window=window).collect()
    for seq, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        end = 0
        for r in own:
            assert r["offset"] == end
            end += r["length"]
        assert end <= window, seq
    ids = {}
    for d, t in DOCS:
        ids.setdefault(d, []).append(each(enc, [t], 0)[0])
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_a_gap_that_no_window_spans_is_an_error():
    with pytest.raises(ValueError, match="no place to cut"):
        packing.cuts([3, 20, 21], [0, 0, 0], 5)
    with pytest.raises(ValueError, match="no place to cut"):
        packing.cuts([9], [0], 5)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 300, 5000, 40_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for high, vocabulary in ((50257, 50257), (4, 50257), (1, 1), (70_000, 70_000)):
        for lanes in {1, 3, coder._lanes(n)}:
            ids = rng.integers(0, high, n)
            if lanes > 1 or n <= 5000:
                assert (coder.decode(coder.encode(ids, vocabulary, lanes), n, vocabulary, lanes) == ids).all()


def test_orders_one_and_two_make_the_digits_fewer():
    rng = np.random.default_rng(0)
    follows = rng.integers(0, 1000, (1000, 2))
    ids = [0, 1]
    for _ in range(60_000):  # one of two ids, by the last; seldom any
        ids.append(int(follows[ids[-1], int(rng.random() < 0.2)]) if rng.random() < 0.95 else int(rng.integers(1000)))
    ids = np.array(ids)
    free = ids.copy()
    rng.shuffle(free)  # the same counts, no order
    assert len(coder.encode(ids, 1000, 64)) < 0.5 * len(coder.encode(free, 1000, 64))
    pairs = rng.integers(0, 50, (50, 50))
    ids = [0, 1]
    for _ in range(60_000):  # by the last two
        ids.append(int(pairs[ids[-2], ids[-1]]) if rng.random() < 0.9 else int(rng.integers(50)))
    assert len(coder.encode(np.array(ids), 50, 64)) < 60_000 * 0.4


def test_blocks_are_checked():
    ids = np.array([5, 6, 7, 9], "<u4")
    block = coder.write_block([3, None, -1], ids, np.array([3, 0, 1]), 100)
    names, got, sizes = coder.read_block(block)
    assert (names, got.tolist(), sizes.tolist()) == ([3, None, -1], ids.tolist(), [3, 0, 1])
    for i in range(len(block)):  # magic, checksums, shape, table and digits alike
        for bit in (1, 128):
            with pytest.raises(ValueError):
                coder.read_block(block[:i] + bytes([block[i] ^ bit]) + block[i + 1 :])
    for n in (0, 4, len(block) - 1):
        with pytest.raises(ValueError):
            coder.read_block(block[:n])
    with pytest.raises(ValueError, match="outside the vocabulary"):
        coder.write_block([1], ids, np.array([4]), 9)


@pytest.mark.parametrize("block_tokens", [1, 500, 1 << 20])
def test_token_file_gives_documents_in_order(spark, docs, none, tmp_path, block_tokens):
    enc = encoder(tokenizer_path())
    token_file.write(docs, str(tmp_path / "f"), tokenizer_path(), block_tokens=block_tokens)  # one document is far longer than 500 ids
    got = token_file.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    want = sorted(DOCS, key=lambda x: (-1 if x[0] is None else x[0], x[1] is not None, x[1] or ""))
    at = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = each(enc, [t], 0)[0].tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (d, at, len(ids) // 4, ids, zlib.crc32(ids))
        at += r["n_tokens"]
    token_file.write(none, str(tmp_path / "e"), tokenizer_path())
    assert token_file.read(spark, str(tmp_path / "e")).count() == 0


def test_the_compiled_coder_makes_the_same_blocks(spark):
    from textloom.llm import compiled

    write, read = (compiled.instance(spark, "TokenCoder", part) for part in ("Write", "Read"))
    rng, parts = np.random.default_rng(7), lambda ids: spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala([ids[i : i + 60_000].tobytes() for i in range(0, len(ids), 60_000)]).toSeq()
    for n, high, vocabulary in ((0, 1, 9), (1, 9, 9), (300, 50, 50257), (5001, 50257, 50257), (70_000, 4, 50257), (200_003, 1000, 1000), (2000, 1, 1), (9000, 1 << 19, 1 << 19)):
        ids = (rng.integers(0, high, n) * rng.random(n)).astype("<u4")  # small ids are the commoner ones
        sizes = np.array([n - n // 3, 0, n // 3])
        block = coder.write_block([3, None, -(1 << 60)], ids, sizes, vocabulary)
        assert bytes(write.call(coder.table([3, None, -(1 << 60)], sizes), parts(ids), 3, vocabulary)) == block
        got = [(r.get(0), r.get(1), r.get(2), bytes(r.get(3))) for r in read.call(block)]
        assert got == [(3, 0, int(sizes[0]), ids[: sizes[0]].tobytes()), (None, int(sizes[0]), 0, b""), (-(1 << 60), int(sizes[0]), n // 3, ids[sizes[0] :].tobytes())]
    block = coder.write_block([3, None, -1], np.array([0, 9, 9, 1], "<u4"), np.array([3, 0, 1]), 100)
    for bad in [block[:i] + bytes([block[i] ^ 1]) + block[i + 1 :] for i in range(len(block))] + [block[:0], block[:4], block[:-1]]:
        with pytest.raises(Exception, match="a block|not a block"):
            read.call(bad)
    with pytest.raises(Exception, match="outside the vocabulary"):
        write.call(coder.table([1], np.array([1])), parts(np.array([9], "<u4")), 1, 9)


def test_a_token_file_is_coded_by_the_jvm(spark, docs, tmp_path):
    token_file.write(docs, str(tmp_path / "f"), tokenizer_path())
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (token_file.blocks(docs, tokenizer_path()), token_file.read(spark, str(tmp_path / "f")))]
    assert [p.count("MapInArrow") for p in plans] == [1, 0]  # Python tokenizes and does nothing else


def test_a_large_block_is_coded_in_many_lanes():
    """A step's fixed work is shared by as many ids as a block's 256 steps leave for it."""
    ids = np.random.default_rng(1).geometric(0.01, 1 << 21).astype("<u4")
    block = coder.write_block([7], ids, np.array([len(ids)]), 50_000)
    assert coder.HEAD.unpack_from(block)[3] == 1 << 13
    names, got, sizes = coder.read_block(block)
    assert names == [7] and sizes.tolist() == [len(ids)] and np.array_equal(got, ids)


# SentencePiece


def _field(number, value):
    def varint(n):
        n &= (1 << 64) - 1
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _model(path, pieces, *, bpe, normalizer=b"", byte_fallback=False, suffix=False):
    """A SentencePiece model file of the given pieces (text, score, kind)."""
    own = [("<unk>", 0.0, 2), *pieces, *([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else [])]
    trainer = b"".join(_field(k, v) for k, v in ((3, 2 if bpe else 1), (24, int(suffix)), (35, int(byte_fallback)), (40, 0), (41, -1), (42, -1), (43, -1)))
    path.write_bytes(b"".join(_field(1, _field(1, t) + _field(2, x) + _field(3, k)) for t, x, k in own) + _field(2, trainer) + _field(3, normalizer))
    return str(path)


def _agree(path, texts):
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Codec(path)
    ids, sizes = c.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == sp.encode(t), t
        assert c.decode(own) == sp.decode(own.tolist()), t


def test_pieces_match_the_library(docs, none):
    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(3)
    odd = [*"abeothin \n\t.,'é ▁中😀ñ0123", "the", " ", "  ", "ing ", "▁"]
    texts = [t for _, t in DOCS if t] + ["a  b", "  x", " ", "é😀 中文", "\n\na\tb", "A" * 300, "a " * 50]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    _agree(path, texts)
    got = sentence_pieces.encode(docs, path).collect()
    assert len(got) == len(DOCS) and all(r["round_trip"] for r in got)
    assert sentence_pieces.encode(none, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pairs_accept_what_joining_makes(tmp_path, seed):
    """BPE models whose pieces were never learnt from text, with equal scores, other ways to join a piece, and user-defined pieces."""
    rng = random.Random(seed)
    chars = "abc▁"
    pieces = [(c, -100.0 - i, 1) for i, c in enumerate(chars)]
    words = list(dict.fromkeys("".join(rng.choice(chars) for _ in range(rng.randint(2, 5))) for _ in range(40)))
    pieces += [(w, -float(rng.randint(0, 30) if seed % 2 else i), 4 if seed > 3 and i % 13 == 0 else 1) for i, w in enumerate(words)]
    path = _model(tmp_path / "m", pieces, bpe=True, normalizer=_field(4, 0))
    _agree(path, ["".join(rng.choice("abc  x") for _ in range(rng.randint(0, 25))) for _ in range(600)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [0, 1])
def test_normalisers_are_compiled(tmp_path, rule, trim):
    """Unigram models with the library's own character maps, spaces kept or removed, with byte fallback and without."""
    import sentencepiece

    rng = random.Random(5)
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    charsmap = dict(sentence_pieces._fields(dict(sentence_pieces._fields(proto))[3])).get(2, b"")
    pieces = [(w, -rng.random() * 9, 1) for w in dict.fromkeys([*"abcdeAB▁ガ", "▁a", "ab", "abc", "▁▁", "bc", "▁ab", "ca", "é", "fi", "▁b"])] + [("X Y", 0.0, 4)]
    odd = [*"abcdeAB  \t　éＡｂｶﾞﬁ①½ﷺ中\u0301\u200b\xad", "X Y", "  ", "ｶ"]
    texts = ["", " ", "   ", "a"] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for fallback in (False, True):
        for dummy in (0, 1):
            path = _model(tmp_path / f"m{fallback}{dummy}", pieces, bpe=False, normalizer=_field(2, charsmap) + _field(3, dummy) + _field(4, trim), byte_fallback=fallback)
            _agree(path, texts)


def test_shortest_path_is_the_best_segmentation():
    rng = random.Random(2)
    pieces = {p: (i, -rng.random() * 5) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "bca"])}
    lex = sentence_pieces.Lexicon(pieces, [-1] * 256, 99, merges=False)

    def best(u):
        if not u:
            return 0.0
        return max(pieces[u[:k]][1] + best(u[k:]) for k in range(1, len(u) + 1) if u[:k] in pieces)

    score = {i: s for i, s in pieces.values()}
    for _ in range(50):
        u = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert abs(sum(score[i] for i in lex.shortest(u)) - best(u)) < 1e-9
    assert lex.shortest("azzb")[1:2] == [99] and len(lex.shortest("azzb")) == 3  # a run of unknown characters is one


# vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 8)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    rows += [(500, None, 1, "x"), (None, x[0].tolist(), 1, "x"), (600, [1.0, None] + [0.0] * 6, 1, "x"), (700, [float("nan")] * 8, 1, "x"), (800, [0.0] * 8, 1, "x"), (900, [], 1, "x"), (1000, [float("inf")] * 8, 1, "x"), (1100, [0.5, 0.5], 1, "x"), (7, x[7].tolist(), 1, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string").repartition(3)


def _usable(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r["vec_id"], np.array(v, float)))
    return out


def _best(rows, every, k, score):
    out = {}
    for q, v in rows:
        if q % every == 0:
            own = sorted((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in own[:k]]
    return out


def test_bit_sliced_top_k_is_exact(vectors, none):
    rows = _usable(vectors, True)
    want = _best(rows, 100, 10, lambda v, w: int(np.floor(v * 1024).astype(int) @ np.floor(w * 1024).astype(int)))
    for coarse in (0, 4):
        got = {}
        for r in bit_sliced.top_k(vectors, block=100, coarse=coarse).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == {q: v for q, v in want.items() if v}
    assert bit_sliced.top_k(none).count() == 0


def test_bit_sliced_blocks_of_repeated_ids(spark):
    """Blocks that agree in size, first and last id and first vector, but not inside, each answer for themselves."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    rows = [(i % 100, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 5
    want = {}
    for q in {tuple(v) for i, v in rows if i == 0}:
        want.setdefault(0, []).extend((-int(np.floor(np.array(q) * 1024).astype(int) @ np.floor(np.array(v) * 1024).astype(int)), i) for i, v in rows if i != 0)
    want = sorted(want[0])[:10]
    for block in (7, 100, 8192):
        got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), block=block).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in got] == want


def test_bit_sliced_scores_of_large_components(spark):
    rows = [(0, [1.0, 3.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 5.0]), (3, [7.0, 0.5]), (4, [2.0**20, 2.0**20]), (100, [2.0**30, -2.0]), (101, [1.0, 1.0])]
    want = {}
    for q, v in rows:
        if q % 100 == 0:
            score = [(-sum(int(np.floor(a * 1024)) * int(np.floor(b * 1024)) for a, b in zip(v, w)), i) for i, w in rows if i != q and not (q == 100 and i in (1, 2, 4))]
            want[q] = [(i, -s) for s, i in sorted(score)]
    for q in (0, 100):
        own = [r for r in rows if q == 0 and r[0] != 100 or q == 100 and r[0] not in (0, 1, 2, 4)]
        got = bit_sliced.top_k(spark.createDataFrame(own, "vec_id long, embedding array<double>")).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(i, s) for i, s in want[q] if i in {r[0] for r in own}]
    for large in (1e30, 1e308):
        far = spark.createDataFrame([(0, [large, 1.0]), (1, [large, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond the range"):
            bit_sliced.top_k(far).collect()


def test_added_bitmaps_are_sums():
    rng = np.random.default_rng(0)
    columns = {w: [rng.integers(0, 1 << 63, 2, dtype=np.uint64) for _ in range(rng.integers(1, 6))] for w in (0, 1, 3)}
    sums = bit_sliced._values(bit_sliced.added(columns), np.arange(128))
    want = sum((np.unpackbits(b.view(np.uint8), bitorder="little").astype(int) << w) for w, own in columns.items() for b in own)
    assert (sums == want).all()
    assert all(sum(s << b for b, s in bit_sliced.signed_digits(v)) == v for v in range(-70, 70))


def test_permutation_index_recall_of_the_query(spark, monkeypatch):
    """With the query's own parameters, on vectors without clusters, the hardest case; alike however they are dealt."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    x[100:3000] = x[100]  # a vector of very many rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    asked = [permutations.nearest(rows.repartition(n)) for n in (2, 8)]
    one, two = (sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect())) for df in asked)
    assert one == two and len(one) == 1000 * 20
    y = x.astype(np.float64)
    score = y[::20] @ y.T
    score[np.arange(1000), np.arange(0, 20_000, 20)] = -np.inf
    hits = {(q, v) for q, _, v, _ in one}
    want = [(20 * q, v) for q in range(1000) for v in np.lexsort((np.arange(20_000), -score[q].round(12)))[:20].tolist()]
    assert 0.9 <= sum(w in hits for w in want) / len(want)
    assert all(abs(s - score[q // 20, v]) < 1e-12 for q, _, v, s in one)


def test_permutation_index_reranks_a_share_of_the_rows():
    own = {k: p.default for k, p in inspect.signature(permutations.nearest).parameters.items()}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    pivots = x[:1024]
    files, sample = (permutations.Files(permutations.order(v, pivots, own["near"]), 1024) for v in (x, pivots))
    shares = []
    for q in permutations.order(x[5000:5050], pivots, own["near"]):
        bound = np.sort(sample.footrule(q))[int(np.ceil(own["rerank"] * 1024)) - 1]
        shares.append((files.footrule(q) <= bound).mean())
    assert np.mean(shares) < 0.2


def test_footrule_is_the_sum_of_place_differences():
    rng = np.random.default_rng(2)
    orders = np.stack([rng.permutation(30)[:8] for _ in range(50)])
    files = permutations.Files(orders, 30)
    place = np.full((50, 30), 8)
    np.put_along_axis(place, orders, np.arange(8)[None], 1)
    for q in range(50):
        want = np.abs(place - place[q]).sum(1)
        got = files.footrule(orders[q])
        assert (got - got[q] == want).all()  # less what all rows share
    x = rng.normal(size=(40, 5))
    assert (permutations.order(x, x[:30], 4) == permutations.order(x, x[:30], 30)[:, :4]).all()


def test_permutation_index_finds_the_nearest(vectors, none):
    rows = _usable(vectors, False)
    want = _best(rows, 20, 20, lambda v, w: float((v * w).sum()))
    got = {}
    for r in permutations.nearest(vectors, pivots=64, near=24, rerank=0.3, probe=0.5, block=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in own}) for q, own in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    truth = dict(itertools.chain.from_iterable([((q, i), s) for i, s in _best(rows, 20, 10**6, lambda v, w: float((v * w).sum()))[q]] for q in list(want)[:3]))
    assert all(truth[q, i] == s for q in list(want)[:3] for i, s in got[q])
    assert permutations.nearest(none).count() == 0


# quality and language


def test_rules_separate_and_score_as_fitted(spark, none):
    rng = random.Random(9)
    rows = [(i, prose(60, rng) if i % 3 else " ".join(["###", "$$$"] * 20)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "x"), (5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == int(bool(r["doc_id"] % 3)) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 5)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["doc_id"] for r in quality.accepted(docs, model).collect()} == {r["doc_id"] for r in got if r["predicted"]}
    empty = quality.fit(none, none)
    assert empty.rules == () and quality.score(none, empty).count() == 0


def _statistics(t):
    t = t or ""
    n, words, lines = max(1, len(t)), t.split(" "), t.split("\n")
    share = lambda chars: sum(c in chars for c in t) / n
    return {
        "chars": float(len(t)), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "symbols": share("#$%&*@^~<>{}[]\\/_=+`"), "bars": share("|•·"),
        "cries": share("!?"), "stops": share(".,;:"), "word_chars": n / len(words), "new_words": len(set(words)) / len(words), "lines": float(len(lines)), "new_lines": len(set(lines)) / len(lines),
    }


def test_scores_are_the_rules_of_the_whole_texts(spark, docs):
    """Statistics, rules, weights and scores, worked out again without Spark."""
    rng = random.Random(2)
    labels = [(d, rng.randint(0, 1)) for d, _ in DOCS if d is not None] + [(99_999, 1)] * 5
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = sorted({(d, q) for d, q in labels if d in {i for i, _ in DOCS} and zlib.crc32(str(d).encode()) % 3 != 1})
    texts = {d: [t for i, t in DOCS if i == d] for d, _ in rows}
    if model.rules:  # the same rows, but for which of a repeated doc_id's texts counts
        assert any(quality.fit_arrays(list(_statistics("")), np.array([list(_statistics(pick_.get(d, texts[d][0])).values()) for d, _ in rows]), np.array([float(q) for _, q in rows])) == model for pick_ in ({}, {300: texts.get(300, [""])[-1]}))
    scores = {}
    for d, t in DOCS:
        s = _statistics(t)
        total = model.bias + sum(w for w, tests in model.rules if all(s[k] <= at if under else s[k] > at for k, under, at in tests))
        scores.setdefault(d, []).append(1 / (1 + np.exp(-total)))
    for r in quality.score(docs, model).collect():
        assert min(abs(r["score"] - x) for x in scores[r["doc_id"]]) < 1e-9


def test_lasso_weights_are_optimal():
    """The subgradient conditions: at a weight that isn't zero the slope is the penalty, elsewhere at most that."""
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, (400, 8)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + 0.5)))).astype(float)
    for penalty in (1e-3, 1e-2):
        w, b = quality.lasso(z, y, penalty, 3000)
        miss = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = z.T @ miss / len(y)
        assert abs(miss.mean()) < 1e-6
        assert (abs(slope[w != 0] + penalty * np.sign(w[w != 0])) < 1e-6).all() and (abs(slope[w == 0]) <= penalty + 1e-6).all()


def test_rules_are_conjunctions_of_a_tree_s_path():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    model = quality.fit_arrays(["a", "b", "c"], x, y)
    assert all(1 <= len(tests) <= 3 and {s for s, _, _ in tests} <= set("abc") for _, tests in model.rules)
    total = model.bias + sum(w * np.logical_and.reduce([x[:, "abc".index(s)] <= t if under else x[:, "abc".index(s)] > t for s, under, t in tests]) for w, tests in model.rules)
    assert ((total >= 0) == (y == 1)).mean() > 0.98


def test_labels_of_other_documents_leave_the_sample_full(spark):
    docs = spark.createDataFrame([(i, "word " * 30 if i % 2 else "### " * 30) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1) for i in range(1000, 30_000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, most_rows=100)
    assert model.rules  # a draw before the join would find no document or one


def test_lasso_drops_what_says_nothing():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (600, 4)).astype(float)
    w, _ = quality.lasso(z, z[:, 0], 0.02, 400)
    assert w[0] > 1 and (abs(w[1:]) < 1e-6).all()


def test_languages_and_spans(spark, none):
    rng = random.Random(3)
    kinds = {"aa": "kotame", "bb": "riselu", "cc": "дмплвр"}
    word = lambda c: "".join(rng.choice(c) for _ in range(rng.randint(2, 7)))
    say = lambda lang, n: " ".join(word(kinds[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(list(kinds) * 40)] + [(900, None, "aa"), (901, "", None), (902, "12 .!", "aa"), (None, say("bb", 9), None), (903, say("bb", 5000), None), (0, say("aa", 30), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs)
    got = languages.label(docs.withColumn("score", F.lit(1)), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows[:120]}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.97
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {900, 901, 902}
    assert {r["doc_id"] for r in languages.accepted(docs, model).collect()} == {d for d, t, _ in rows} - {900, 901, 902}
    mixed = spark.createDataFrame([(1, f"{say('aa', 20)}. {say('cc', 20)}")], "doc_id long, text string")
    spans = languages.label(mixed, model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["aa", "cc"]
    assert languages.label(none, languages.fit(none)).count() == 0 == languages.accepted(none, languages.fit(none)).count()


def test_languages_learn_from_runs_of_four_letters(spark):
    docs = spark.createDataFrame([(i, "abcd efgh " * 5, "aa") for i in range(20)], "doc_id long, text string, lang string")
    assert {"abcd", "efgh"} <= set(languages.fit(docs).weights)


def test_a_language_with_little_text_is_learnt(spark):
    rng = random.Random(8)
    say = lambda c, n: " ".join("".join(rng.choice(c) for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, say("abcdefghijklmnop", 300), "much") for i in range(60)] + [(1001, "zuvyx", "little"), (1000, "wyqz", "little")]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_grams=3000, least_grams=20)
    assert model.langs == ["little", "much"] and len(model.weights) > 1000
    got = languages.label(spark.createDataFrame([(1, "zuvyx wyqz zuvyx"), (2, say("abcdefghijklmnop", 9))], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["little", "much"]
    with pytest.raises(ValueError, match="more than 1 values"):
        languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=1)


def test_letters_and_scripts(spark):
    """Numerals that aren't digits are no letters; marks don't cut words; a script that training lacks leaves all languages."""
    model = languages.fit(spark.createDataFrame([(i, "kota meto", "aa") for i in range(20)] + [(i, "дмпл влрп", "bb") for i in range(30, 50)], "doc_id long, text string, lang string"))
    rows = [(1, "½ ² ② Ⅷ ㉈ 12 _"), (2, "\u0301 \u20dd"), (3, "हिन्दी भाषा"), (4, "kдмплв"), (5, "e\u0301te"), (6, "kota ½")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert got[3][0] in ("aa", "bb") and got[4] == ("bb", 1.0) and got[6] == ("aa", 1.0)
    assert languages.words("हिन्दी ภาษาไทย e\u0301te ab1cd_e") == ["हिन्दी", "ภาษาไทย", "e\u0301te", "ab", "cd", "e"]


def test_scores_are_sums_over_n_grams():
    rng = random.Random(5)
    found = ["".join(rng.choice("abcdéñдж𝒜") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["İ", "a"]
    known = {g for w in found[:200] for g in languages.grams(w.lower(), 4) if rng.random() < 0.7}
    weights = {g: np.array([rng.random(), rng.random()], np.float32) for g in sorted(known)}
    lab = languages.Labeller(languages.Model(["x", "y"], weights, np.array([-0.5, -0.25], np.float32), {}, 4), 1.0)
    got = lab.scores(found)
    for w, s in zip(found, got):
        want = sum((weights.get(g, np.array([-0.5, -0.25])).astype(float) for g in languages.grams(w.lower(), 4)), np.zeros(2)) / 4
        assert np.allclose(s, want, atol=1e-4)
    numbers, lengths = lab.read([" ".join(found), None, "", "  a  b-c ½ "])
    assert lengths.tolist() == [len(found), 0, 0, 3] and (lab.table[numbers[: len(found)]] == got).all()


def test_language_workers_hold_little(spark, monkeypatch):
    """Workers get a model as arrays, not as an object for each n-gram, and give texts back in parts."""
    import pickle
    import tracemalloc

    import pyarrow as pa

    grams = ["".join(g) for g in itertools.product("abcdefghijklmnopqr", repeat=4)][:100_000]
    model = languages.Model(["x", "y"], {g: np.array([-1.0, -2.0], np.float32) for g in grams}, np.array([-9.0, -9.0]), {}, 4)
    texts = ["abcd efgh " * 20_000, None, "12", ""] * 40
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    docs = spark.range(1).selectExpr("id doc_id", "'' text")
    sent, work = [], []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or send(self, x))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: work.append(f) or self)
    languages.accepted(docs, model)
    blob = pickle.dumps(sent[0])
    tracemalloc.start()
    held = pickle.loads(blob)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.langs == ["x", "y"] and size < 40 * len(grams)
    parts = list(work[0](iter([rows])))
    assert [d for p in parts for d in p.column(0).to_pylist()] == list(range(0, len(texts), 4))
    assert max(p.get_total_buffer_size() for p in parts) < 3 * languages.RUN < rows.nbytes


def test_viterbi_matches_brute_force(monkeypatch):
    weights = {"a": np.array([0.0, -1.0], np.float32), "b": np.array([-1.0, 0.0], np.float32)}
    lab = languages.Labeller(languages.Model(["x", "y"], weights, np.array([-0.5, -0.5]), {}, 1), 1.2)
    rng = random.Random(0)
    texts = [[rng.choice("ab") * rng.randint(1, 3) for _ in range(rng.randint(0, 7))] for _ in range(40)]
    for t, path in zip(texts, lab.paths(texts)):
        s = lab.scores(t) if t else []
        value = lambda p: sum(s[i][k] for i, k in enumerate(p)) - 1.2 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product((0, 1), repeat=len(t))), default=0)
        assert abs(value(path.tolist()) - best) < 1e-4
    together = [p.tolist() for p in lab.paths(texts)]
    monkeypatch.setattr(languages, "SIDE", 0)  # all side by side to the end
    assert together == [p.tolist() for p in lab.paths(texts)] == [lab.paths([t])[0].tolist() for t in texts]


# pages


def test_article_text(spark, none):
    model = html_text.train(html_text.labelled_pages(150), rounds=4)
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A title &amp; more</h1><p><b>First line.<br><p>Second   line of\n the text, which is longer.</p></article><footer>&copy; someone</footer>'
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<<p>&#x;"), (1, "u", page), (4, "u", page.replace("First line.", "word " * 30000))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")), model).collect()
    want = "A title & more\nFirst line.\nSecond line of the text, which is longer."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, None)] == ["", ""]
    assert [r["n_chars"] for r in got if r["page_id"] == 4] == [len(want) - len("First line.") + 5 * 30000 - 1]
    assert html_text.extract(none, model).count() == 0


def test_page_labels_hold_out():
    pages = html_text.labelled_pages(660, seed=5)
    model = html_text.train(pages[:500])
    right = [a == b for found, labels in pages[500:] for a, b in zip(model.decode(found), labels)]
    assert np.mean(right) > 0.97


ONE, TWO = "It was a bright cold day in April, and the clocks were striking thirteen.", "Winston Smith, his chin nuzzled into his breast to escape the vile wind, slipped quickly through the glass doors, though not quickly enough to keep a swirl of gritty dust from entering along with him."
#: Pages written by hand, apart from those that the model is trained on, with their texts.
PAGES = {
    "unnamed containers": (f"<div class='x'><p>{ONE}</p><p>{TWO}</p></div><div class='footer'>Contact us</div>", [ONE, TWO]),
    "no tag that tells": (f"<div><div><a href=/>Home</a> <a href=/b>Blog</a> <a href=/c>About</a></div></div><div class='zzz'><p>{ONE}</p><p>{TWO}</p></div><div>&copy; 2020 Someone</div>", [ONE, TWO]),
    "generated names": (f"<div id=a1><ul class=qx7><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div><div class=qx9><div class=rt><h2>A heading of it</h2><p>{ONE}<p>{TWO}<p>{ONE}</div></div><div class=k2><a href=/x>Next post</a></div>", ["A heading of it", ONE, TWO, ONE]),
    "no heading": (f"<html><body><nav><a href=1>Home</a></nav><main><p>{ONE}</p><p>{TWO}</p></main><footer><p>Terms and conditions apply.</p></footer>", [ONE, TWO]),
    "a weblog": (f"<header class='site-header'><h1><a href=/>My site</a></h1><nav class='menu'><ul><li><a href=1>Home</a></li></ul></nav></header><div id='content'><article class='post'><h1 class='entry-title'>The title</h1><div class='entry-content'><p>{ONE}</p><p>{TWO}</p></div></article><div id='comments'><h3>2 comments</h3><ol><li>Great post, thanks!</li><li>I agree with all of it.</li></ol></div></div><aside id='sidebar'><h3>Recent posts</h3><ul><li><a href=1>Older one</a></li></ul></aside><footer>&copy; 2021 My site</footer>", ["The title", ONE, TWO]),
    "a layout table": (f"<table><tr><td><ul><li><a href=1>Start</a></li><li><a href=2>News</a></li></ul></td><td><h1>Headline</h1><p>{ONE}</p><p>{TWO}</p></td></tr></table>", ["Headline", ONE, TWO]),
    "deep markup": (f"<article><h1>Head</h1>{'<span class=a>' * 3000}<p>{ONE}</p>{'<div>' * 3000}<p>{TWO}</p></article>", ["Head", ONE, TWO]),
    "references": (f"<main><h1>Caf&eacute; &#169; &lt;b&gt;</h1><p>{ONE}\n\t {TWO}</p></main>", ["Café © <b>", f"{ONE} {TWO}"]),
    "hidden parts": (f"<article><h1>T</h1><script>var a = '<p>no</p>';</script><style>p {{}}</style><p>{TWO}</p><form><label>Mail</label><input></form><!-- <p>no</p> --></article>", ["T", TWO]),
}


@pytest.mark.parametrize("kind", PAGES)
def test_pages_of_other_layouts(kind):
    page, want = PAGES[kind]
    assert html_text.main_text(html_text.default_model(), page).split("\n") == want


def test_very_deep_pages_take_time_by_their_length():
    for page in ("<div>" * 100_000 + ONE, "<div><p>x" * 50_000, "<ul><li>" * 50_000 + "</b>" * 50_000, "<a href=x>" * 50_000 + "</section>" * 50_000):
        found = html_text.blocks(page)
        assert len(html_text.features(found)) == len(found)


def test_page_viterbi_is_the_best_path():
    model = html_text.Model({"all": 0.2, "words 1": -0.9, "words 2": 0.7}, [[0.4, -0.3], [-0.5, 0.6]])
    for seed in range(20):
        rng = random.Random(seed)
        page = [html_text.Block("w " * rng.randint(1, 4), html_text.Node(None, "", ""), 0.0) for _ in range(rng.randint(1, 7))]
        s = model.scores(page)
        value = lambda p: sum(x for x, y in zip(s, p) if y) + sum(model.turn[int(a)][int(b)] for a, b in zip(p, p[1:]))
        assert abs(value(model.decode(page)) - max(value(p) for p in itertools.product((False, True), repeat=len(page)))) < 1e-9


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, prose(60, rng) if i % 6 else "### $$$ " * 30, "aa", f"s{i % 3}", 1) for i in range(1, 120)]
    rows += [(200 + i, near(rows[1][1], 1, rng), "aa", "s", 1) for i in range(4)] + [(300 + i, f"{prose(40, rng)}\n{LINE}", "aa", "s", 1) for i in range(6)] + [(400, "12 34 " * 20, "aa", "s", 1), (401, None, "aa", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(bool(i % 6))) for i in range(1, 120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r["doc_id"]: r for r in at.collect()})
    assert all(list(spark.read.parquet(str(tmp_path / f"s{k}")).columns) == list(corpus_pipeline.COLUMNS) for k in range(4))
    bad = {i for i in range(1, 120) if not i % 6}
    assert not bad & set(seen[0]) and set(range(1, 120)) - bad <= set(seen[0])
    assert {400, 401}.isdisjoint(seen[1]) and set(seen[0]) - {400, 401} == set(seen[1]) == set(seen[2])
    assert [LINE.strip() in r["text"] for d, r in sorted(seen[2].items()) if 300 <= d < 306] == [False] * 5 + [True]
    assert set(seen[2]) - set(seen[3]) == {200, 201, 202, 203} and 2 in seen[3]
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(seen[3])
