"""The ten operators and the pipeline against brute force, round trips, and odd inputs."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from textloom.llm import components, decontaminate, golay, language_id, near_dedup, packing, quality, queries, repetition, token_stream, toxicity, url_filter, warc
from textloom.llm.common import shared_dir
from textloom.llm.tokens import public_path

LONG = " ".join(f"w{k}" for k in range(30_000))
TEXTS = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "!!! ???"),
    (4, "one"),
    (5, "Two words"),
    (6, "the quick brown fox jumps over the lazy dog " * 9),
    (7, LONG),
    (7, LONG),
    (8, "\u4e2d\u6587 \u00e9\u00e8 \x00 \x1c \u2028 end"),
    (9, "the quick brown fox jumps over the lazy dog " * 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 1.0, True, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, label int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


# --- near duplicates
def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for bits in range(4):
        v = u.copy()
        for k in range(len(v)):
            for b in rng.choice(64, bits, replace=False):
                v[k] ^= np.uint64(1) << np.uint64(b)
        left, _ = golay.pair_keys(u)
        _, right = golay.pair_keys(v)
        known = set(zip(left[0].tolist(), left[1].tolist()))
        assert {r for r, k in zip(right[0].tolist(), right[1].tolist()) if (r, k) in known} == set(range(len(u)))


def brute_fingerprint(text):
    w = [x.lower() for x in words(text)]
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """``prints``: (id, fingerprint)."""
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, f) in enumerate(prints):
        for j, g in prints[a + 1 :]:
            if bin(f ^ g).count("1") <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in prints}


def test_near_duplicates_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    expected = brute_components(prints)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in prints}
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert near_dedup.keep_one(docs).count() == len(set(expected.values()))
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_links_of_dense_groups_and_chains(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(50)}
    base = rng.getrandbits(64)
    for _ in range(300):
        prints.add(base ^ sum({1 << rng.randrange(8) for _ in range(3)}))
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum({1 << rng.randrange(64) for _ in range(3)})
        prints.add(chain)
    own = list(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in own], "node long, fp long")
    for hot in (2, near_dedup.HOT):  # the finer keys for every group, and for none here
        got = {i: i for i in range(len(own))}
        got.update((r["node"], r["component"]) for r in components.components(near_dedup.links(nodes, hot=hot)).collect())
        assert got == brute_components(own)
    with pytest.raises(ValueError):
        near_dedup.links(nodes, 4)


@pytest.mark.parametrize("at", [0, 22, 43])
def test_links_under_a_crowded_key(spark, at):
    rng = np.random.default_rng(at)
    free = rng.choice(1 << 21, 3000, replace=False).astype(np.uint64)
    prints = np.uint64(rng.integers(0, 1 << 62)) & ~np.uint64(((1 << 21) - 1) << at) | free << np.uint64(at)
    nodes = spark.createDataFrame([(k, int(f)) for k, f in enumerate(prints.view(np.int64))], "node long, fp long")
    got = {(r["a"], r["b"]) for r in near_dedup.links(nodes, hot=1000).collect()}
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    expected = {(int(a), int(b)) for a, b in np.argwhere(apart <= 3) if a > b}
    assert got <= expected and len(got) > 1000
    parent = {}  # what is linked is connected, through a group's smallest member at least

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in got:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert all(root(a) == root(b) for a, b in expected)


def test_rows_that_spark_sizes_too_low_are_not_broadcast(spark):
    """The sixty keyed rows of a node, and the rows of all salts where no text has a copy."""
    plan = lambda df: df.collect() and df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(k, int(fp)) for k, fp in enumerate(rng.integers(-(1 << 63), 1 << 63, 300))] + [(300, 5), (301, 4)], "node long, fp long")
    assert "Broadcast" not in plan(near_dedup._under_keys(nodes, near_dedup.RADIUS, near_dedup.HOT))
    rows = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 1 << 40, 30)))) for k in range(40)], "doc_id long, text string")
    found = near_dedup.near_duplicates(rows)
    assert {r["component_id"] for r in found.collect()} == set(range(40))
    assert re.search(r"SortMergeJoin[^\n]* \[fp#\d+L, salt#", plan(found))


def test_near_duplicates_of_odd_ids(spark):
    a, b = "one two three four five six", "another text of quite other words"
    rows = spark.createDataFrame([(5, a), (5, a), (3, a), (None, a), (None, "lonely words without any id here"), (9, b), (7, None), (8, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(rows).collect())
    assert got == Counter([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (9, 9), (7, 7), (8, 7)])
    for most in (0, 100):
        kept = Counter(r["doc_id"] for r in near_dedup.keep_one(rows, most_ids=most).collect())
        assert kept == Counter([3, None, None, 9, 7])


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repetition
def test_longest_repeats_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = repetition.longest_repeats(np.array([ord(c) for t in texts for c in t], np.int64), starts)
        expected = [max([next(n for n in range(len(t) + 1) if k + n >= len(t) or j + n >= len(t) or t[k + n] != t[j + n]) for j in range(len(t)) if j != k], default=0) for t in texts for k in range(len(t))]
        assert got.tolist() == expected


def test_repetition_of_planted_repeats(spark):
    filler = [f"f{k}" for k in range(200)]
    passage = [f"p{k}" for k in range(70)]
    text = " ".join(filler + passage + ["x"] + passage)
    short = " ".join(filler + passage[:20] + ["x"] + passage[:20])
    got = {r["doc_id"]: r for r in repetition.repetition(spark.createDataFrame([(1, text), (2, short), (3, " ".join(filler))], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[1]["repeats"]] == [(200, 270), (271, 341)] and got[1]["longest_repeat"] == 70 and not got[1]["kept"]
    assert got[2]["kept"] and got[2]["longest_repeat"] == 20 and got[3]["kept"] and got[3]["repeats"] == []


# --- language
def test_language_held_out_accuracy(docs):
    got = language_id.learn_and_identify(docs)[0].join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def lowered(text):
    return pc.utf8_lower(pa.array([text or ""])).to_pylist()[0]


def grams_of(word, n):
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def brute_language(labelled, texts):
    """Plain counts over all labelled texts, and for each text the costs of its words by language."""
    counts = {}
    for text, lang in labelled:
        own = counts.setdefault(lang, [Counter() for _ in range(5)])
        for w in regex.findall(r"\p{L}+", lowered(text)):
            own[0][w] += 1
            for n in range(1, 5):
                own[n].update(grams_of(w, n))
    langs = sorted(counts)
    totals = {(lang, n): sum(c.values()) for lang, own in counts.items() for n, c in enumerate(own)}
    penalty = max(math.log(t) for t in totals.values() if t) + 1
    cost = lambda g, n: [math.log(totals[x, n] / counts[x][n][g]) if counts[x][n][g] else penalty for x in langs]
    known = [set().union(*(counts[x][n] for x in langs)) for n in range(5)]

    @functools.cache
    def word(w):
        if w in known[0]:
            return cost(w, 0)
        for n in range(4, 0, -1):
            values = [cost(g, n) for g in grams_of(w, n) if g in known[n]]
            if values:
                return [sum(v) / len(values) for v in zip(*values)]
        return [penalty] * len(langs)

    out = []
    for text in texts:
        found = [word(w) for w in regex.findall(r"\p{L}+", lowered(text))]
        if not found:
            out.append(("und", 0.0))
            continue
        total = [sum(v) for v in zip(*found)]
        best = min(range(len(langs)), key=total.__getitem__)
        out.append((langs[best], 1 / sum(math.exp(max(total[best] - v, -700)) for v in total)))
    return out


def test_language_against_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    fitted = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = language_id.fit(docs.filter(language_id.remainder("doc_id", 4) != 2), max_words=None, max_grams=None)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    expected = brute_language([(r["text"], r["lang"]) for r in fitted if r["text"] is not None and r["lang"] is not None], [r["text"] for r in rows])
    for r, (lang, score) in zip(rows, expected):
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-3)


def test_words_come_before_shorter_and_shorter_grams():
    model = language_id.Model([("a", 0, "hello", 5), ("b", 0, "hallo", 5), ("a", 2, "zz", 3), ("b", 1, "q", 3)])
    hello, zzz, q, x = model.values(pa.array(["hello", "zzz", "q", "x"]))
    assert hello[0] < hello[1] and zzz[0] < zzz[1] and q[1] < q[0]
    assert x[0] == x[1] == np.float32(model.penalty)


def test_only_letters_have_a_language(spark):
    model = language_id.Model([("a", 0, "hello", 5), ("a", 1, "\u00bd", 5)])
    texts = ["\u00bd \u00b2", "\u2460", "\u2167", "\u0663", "123", "!!", "_", "\u0301", "", None]
    rows = spark.createDataFrame(list(enumerate([*texts, "\u00bd hello"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(rows, model).collect()}
    assert got == {k: ("und", 0.0) for k in range(len(texts))} | {len(texts): ("a", 1.0)}


def test_every_language_is_learned(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"word{chr(0x4E00 + k)}x", f"l{k:03d}") for k in range(201)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    assert len(model.langs) == 201
    assert all(r["lang_pred"] == r["lang"] for r in language_id.identify(rows, model).join(rows, "doc_id").collect())
    monkeypatch.setattr(language_id, "MOST_LANGS", 200)
    with pytest.raises(ValueError):
        language_id.fit(rows)


# --- packing and token files
def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packed(rows, ids):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter((i, k, a, len(own[a : a + 4096]), crc(own[a : a + 4096])) for i, own in ids for k, a in enumerate(range(0, len(own), 4096)))
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096
    return len(bins)


def test_packing(docs, odd):
    for own in (docs, odd):
        rows = own.select("doc_id", "text").collect()
        ids = list(zip([r["doc_id"] for r in rows], ids_of("word_bpe_49k.json", [r["text"] for r in rows], 1)))
        n = check_packed(packing.pack(own).collect(), ids)
        assert n <= 1.1 * sum(len(x) for _, x in ids) / 4096 + 3


def test_sequences_hold_the_packed_ids(docs):
    packed = packing.pack(docs)
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r["doc_id"] for r in rows], ids_of("word_bpe_49k.json", [r["text"] for r in rows], 1)))
    whole = {r["sequence_id"]: r for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        own = whole[r["sequence_id"]]
        assert list(own["input_ids"][r["offset"] : r["offset"] + r["length"]]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(set(own["segments"][r["offset"] : r["offset"] + r["length"]])) == 1


def test_sequences_of_rows_that_share_an_id(spark):
    texts = [(1, "one two three"), (1, "four five"), (1, "one two three"), (None, "six"), (None, None), (2, LONG), (2, LONG + " x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    whole = packing.sequences(frame, packing.pack(frame)).collect()
    expected = Counter(x for own in ids_of("word_bpe_49k.json", [t for _, t in texts], 1) for x in own)
    assert Counter(x for r in whole for x in r["input_ids"]) == expected and all(len(r["input_ids"]) <= 4096 for r in whole)


def test_ids_of_any_letters_and_special_tokens():
    from tokenizers import Tokenizer

    from textloom.llm.tokens import Encoder

    rng = random.Random(8)
    scripts = [range(32, 127), range(0xC0, 0x250), range(0x370, 0x530), range(0x590, 0x700), range(0x900, 0xA00), range(0x3040, 0x30A0), range(0xAC00, 0xAC80), range(0x1F600, 0x1F620)]
    odd = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u09df.", "\u09dc,", "\u095e.", "ANKARA\u0130,", "\n", "\t", "\u00a0", "\u2028", "don't", "I'LL", "  ", "\0"]
    texts = []
    for _ in range(3000):
        own = rng.choice(scripts)
        texts.append("".join(rng.choice([chr(rng.choice(own)), chr(rng.choice(own)), " ", rng.choice(",.\n"), rng.choice(odd) if rng.random() < 0.2 else "a"]) for _ in range(rng.randrange(1, 50))))
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b c", *odd]
    for name, boundary, lower in (("byte_bpe_50k.json", "space", False), ("word_bpe_49k.json", "word", True)):
        with open(public_path(name), encoding="utf-8") as f:
            own = Encoder(f.read(), boundary, lower)
        library = Tokenizer.from_file(public_path(name))
        for batch in (texts[:1500], texts[1500:], texts[:100]):
            ids, starts = own.encode(pa.array(batch), 1)
            for t, a, b in zip(batch, starts[:-1], starts[1:]):
                assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_open_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(5) == (1, 0)
    assert bins.put(4) == (0, 6)  # the fullest that holds it; bin 0 is full and closes
    assert bins.put(8) == (2, 0)
    assert bins.put(7) == (3, 0)  # both open, none holds it: bin 2, the fullest, closes
    assert bins.put(2) == (3, 7)


def test_two_packers_waste_little_more_than_one(spark):
    rng = random.Random(7)
    sized = spark.createDataFrame([(k, 0, 0, rng.randrange(1, 900)) for k in range(6000)], "doc_id long, piece int, start long, length long")
    total = sized.agg(F.sum("length")).first()[0]
    for pieces, packers in ((6000, 1), (3000, 2), (1000, 6)):
        rows = packing.best_fit(sized, 4096, packer_pieces=pieces).collect()
        bins = Counter()
        for r in rows:
            bins[r["sequence_id"]] += r["length"]
        assert len(rows) == 6000 and max(bins.values()) <= 4096 and len({s >> packing.BIN_BITS for s in bins}) == packers
        assert len(bins) <= 1.01 * total / 4096 + packers


def test_token_files_that_are_not_mapped(spark, docs, monkeypatch):
    files = token_stream.write_tokens(docs, shared_dir(spark, "tokens"), length=64, rows=2)
    path = files.orderBy("part").first()["path"]
    mapped = token_stream.TokenFile(path)
    read = []

    class Remote(pa.PythonFile):
        def read_at(self, n, at):
            read.append(n)
            return super().read_at(n, at)

    monkeypatch.setattr(token_stream, "open_file", lambda uri: Remote(open(uri.removeprefix("file://"), "rb"), "r"))
    other = token_stream.TokenFile(path)
    for k in (0, len(mapped) - 1, len(mapped) // 2):
        assert other.sequence(k).tolist() == mapped.sequence(k).tolist() and other.mask(k).equals(mapped.mask(k))
    assert set(read) == {mapped.stride}


def test_token_files(spark, docs, odd):
    for own in (docs, odd):
        rows = sorted(own.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
        ids = ids_of("byte_bpe_50k.json", [r["text"] for r in rows], 0)
        files = token_stream.write_tokens(own, shared_dir(spark, "tokens"), length=128, rows=4)
        got = sorted(token_stream.read_tokens(files).collect(), key=lambda r: r["start"])
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], s, len(x), crc(x)) for r, s, x in zip(rows, starts.tolist(), ids)]
        stream = []
        for f in files.orderBy("part").collect():
            file = token_stream.TokenFile(f["path"])
            assert len(file) == f["n_sequences"]
            order = list(range(len(file)))
            random.Random(1).shuffle(order)
            parts = {k: file.sequence(k)[np.array(file.mask(k))] for k in order}
            stream += [t for k in range(len(file)) for t in parts[k].tolist()]
        assert stream == [t for x in ids for t in x]
        assert not file.sequence(0).flags.owndata  # a view of the file


# --- decontamination
def test_contaminations_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(3000)]
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [item(n) for n in (6, 7, 9, 13, 20, 37, 58, 120)]
    docs, expected = [], set()
    for k in range(120):
        body = item(rng.randrange(0, 300))
        which = rng.randrange(len(items))
        passage = list(items[which])
        if k % 3 == 0:  # one word replaced: found if four fifths of the shingles are left
            passage[rng.randrange(len(passage))] = "edited"
        if k % 4 != 1:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((k, ", ".join(body).upper() if k % 5 == 0 else " ".join(body)))
    weigh = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    for k, text in docs:
        own = text.lower().replace(",", "").split()
        for i, x in enumerate(items):
            need = weigh(x)
            if max((sum((weigh(own[a : a + len(x)]) & need).values()) for a in range(max(1, len(own) - len(x) + 1))), default=0) / sum(need.values()) >= 0.8:
                expected.add((k, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (2, 1000):
        got = decontaminate.contaminations(frame, bench, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    kept = decontaminate.keep_clean(frame, bench)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in expected}
    with pytest.raises(ValueError):
        decontaminate.contaminations(frame, bench, similarity=0.5)


def weighted_brute_force(docs, items):
    """Document and item: the best weighted share of item-sized windows, where it is 0.8 or more."""
    weigh = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    df = Counter(h for x in items for h in weigh(x))
    out = {}
    for i, x in enumerate(items):
        need = weigh(x)
        weight = {h: 1 / (1 + np.log(df[h])) for h in need}
        total = sum(c * weight[h] for h, c in need.items())
        for k, own in docs:
            for a in range(max(1, len(own) - len(x) + 1)):
                value = sum(c * weight[h] for h, c in (weigh(own[a : a + len(x)]) & need).items()) / total
                if value >= 0.8:
                    out[k, i] = max(value, out.get((k, i), 0))
    return out


def test_templated_items_against_weighted_brute_force(spark):
    items = []
    for n, shared, sharing in ((17, 5, 2), (20, 5, 2), (17, 9, 40), (30, 21, 40), (9, 5, 12)):  # shingles, of which in the template, items that share it
        template = [f"t{len(items)}x{k}" for k in range(shared + 4)]
        at = (n - shared) // 2
        for _ in range(sharing):
            own = [f"o{len(items)}x{k}" for k in range(n - shared)]
            items.append(own[:at] + template + own[at:])
    docs = []
    for i in (0, 2, 4, 44, 84):
        x = items[i]
        for place in range(len(x)):
            for before in range(4):  # alignments with the windows of documents
                docs.append((len(docs), [f"b{k}" for k in range(before)] + x[:place] + ["edited"] + x[place + 1 :] + ["end"]))
    expected = weighted_brute_force(docs, items)
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminations(frame, bench).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_items_too_short_for_shingles_and_other_edits(spark, monkeypatch):
    base = [f"b{k}" for k in range(40)]
    items = [["p1", "p2", "p3", "p4", "p5"], ["q1", "q2", "q3"], ["alone"], [f"i{k}" for k in range(60)], [f"s{k}" for k in range(60)]]
    put_in = items[3][:14] + ["new"] + items[3][14:30] + ["new"] + items[3][30:]  # two insertions spoil eight shingles
    turned = items[4][30:] + items[4][:30]  # halves in the other order
    docs = [base + items[0] + base, base[:7] + items[0][:4], base + items[1] + base + items[1], items[1][:2] + base, base[:3] + items[2], put_in, base[:5] + turned + base, base]
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(7, "alone")], "item_id long, text string")
    expected = {(0, 0): (40, 5), (2, 1): (40, 3), (4, 2): (3, 1), (4, 7): (3, 1)}
    best = weighted_brute_force(list(enumerate(docs)), [items[3], items[4]])
    for size in (decontaminate.BLOCK_BYTES, 64):  # blocks by bytes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(frame, bench).collect()}
        assert {k: (got[k]["start"], got[k]["words"]) for k in expected} == expected and all(got[k]["similarity"] == 1 for k in expected)
        assert {k: got[k]["similarity"] for k in got if k not in expected} == {(k, i + 3): pytest.approx(v) for (k, i), v in best.items()} and (5, 3) in got
        assert decontaminate.keep_clean(frame, bench).count() == len(docs) - len({k for k, _ in got})


def test_windows_are_simhashes_of_their_shingles():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    starts = np.array([0, 0, 3, 700, 900])
    steps = {w: decontaminate.step_of(w) for w in (*decontaminate.WINDOWS, 12, 48, 192, 256, 384)}
    found = list(decontaminate.windows(hashes, starts, steps))
    for size, step in steps.items():
        own = {(int(t), int(p)): int(f) for w, *x in found if w == size for t, p, f in zip(*x)}
        expected = {}
        for t, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            for p in range(0, b - a - size + 1, step):
                bits = np.unpackbits(hashes[a + p : a + p + size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
                expected[t, p] = sum(1 << k for k in range(64) if 2 * int(bits[k]) > size)
        assert own == expected


def test_blocks_of_items_give_the_same_similarities(spark):
    template = [f"t{k}" for k in range(12)]
    items = [[f"o{i}x{k}" for k in range(10)] + template + [f"p{i}x{k}" for k in range(6 + i)] for i in range(9)]
    docs = [(10 * i + e, x[:e] + ["edited"] + x[e + 1 :]) for i, x in enumerate(items) for e in (0, 12, 16)]
    expected = weighted_brute_force(docs, items)
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for block in (3, 5, 1000):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminations(frame, bench, block=block).collect()}
        assert got == {k: pytest.approx(v) for k, v in expected.items()}
    assert decontaminate.keep_clean(frame, bench, block=3).count() == len(docs) - len({k for k, _ in expected})


# --- classifiers
def auc(rows):
    pos = [r["score"] for r in rows if r["y"] == 1]
    neg = [r["score"] for r in rows if r["y"] == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / max(1, len(pos) * len(neg))


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    own = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = quality.learn_and_score(own, labels).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").filter("held_out").collect()
    assert auc(got) >= 0.95


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(1500):
        text = [rng.choice(vocabulary) for _ in range(60)]
        if k % 4 == 0:
            text[rng.randrange(60)] = rng.choice(["vilest", "rotter"])
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.learn_and_score(own.select("doc_id", "text"), own.select("doc_id", "toxic")).join(own.select("doc_id", F.col("toxic").alias("y")), "doc_id").filter("held_out").collect()
    assert auc(got) >= 0.99 and sum(r["predicted"] != r["y"] for r in got) <= 3


def test_toxicity_against_a_plain_learner(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        text = [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(30)]
        if k % 3 == 0:
            text[rng.randrange(30)] = rng.choice(["vilest", "rotter"])
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    own = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(own.select("doc_id", "text"), own.select("doc_id", "label"))
    examples = []
    for k, text, y in rows:
        found = set()
        for _, _, f, _ in toxicity.features(pa.array([text])):
            found |= set(f.tolist())
        examples.append((int(toxicity._mix(np.array([k], np.uint64) * np.uint64(toxicity._ODD))[0]), k, found, y))
    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for _, _, found, y in sorted(examples, key=lambda e: e[:2]):
            w = {f: weight(f) for f in [*found, "bias"]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for f, v in w.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * v
                n[f] += g * g
    expected = {f: weight(f) for f in z if f != "bias" and weight(f)}
    assert dict(zip(model.at.tolist(), model.values.tolist())) == {f: pytest.approx(v) for f, v in expected.items()} and len(expected) > 2
    rate, drawn = 100.5 / 301, 100 / 300
    bias = weight("bias") + math.log(rate / (1 - rate)) - math.log(drawn / (1 - drawn))
    assert model.bias == pytest.approx(bias)
    for r, (_, _, found, _) in zip(toxicity.score(own, model).orderBy("doc_id").collect(), examples):
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-bias - sum(expected.get(f, 0) for f in found))), abs=1e-5)


def test_labels_of_a_key_count_once(spark):
    own = spark.createDataFrame([(k, f"word{k} text") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(40) for _ in range(3)] + [(0, 1), (1, None), (2, 7), (None, 1)], "doc_id long, label int")
    once = spark.createDataFrame([(k, int(k % 2 or k == 0)) for k in range(40)], "doc_id long, label int")
    assert {tuple(r) for r in quality.one_label(labels, "doc_id", "label").collect()} == {tuple(r) for r in once.collect()}
    for one, other in ((quality.fit(own, labels), quality.fit(own, once)), (toxicity.fit(own, labels), toxicity.fit(own, once))):
        assert vars(one).keys() == vars(other).keys() and all(np.array_equal(v, vars(other)[k]) if isinstance(v, np.ndarray) else v == vars(other)[k] for k, v in vars(one).items())


def test_quality_against_rules_by_hand(spark):
    sf = SF.replace("0.001", "0.01")
    own, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(own, labels.withColumnRenamed("quality", "label"))
    rows, names = quality.with_statistics(own)
    table = rows.select("doc_id", *names).orderBy("doc_id").toPandas()
    x = table[names].to_numpy(float)
    total = np.full(len(x), model.intercept)
    for rule, weight in model.rules:
        ok = np.ones(len(x), bool)
        for k, above, t in rule.tests:
            ok &= x[:, k] > t if above else x[:, k] <= t
        total += weight * ok
    got = quality.score(own, model).orderBy("doc_id").toPandas()
    assert len(model.rules) > 2 and np.allclose(got["score"], 1 / (1 + np.exp(-total)))
    texts = {r["doc_id"]: r["text"] or "" for r in own.select("doc_id", "text").collect()}
    for k, i in enumerate(table["doc_id"]):  # some statistics by hand
        own_words = regex.findall(r"[^\x20\x09-\x0D]+", texts[i])
        assert x[k, names.index("_n_words")] == len(own_words)
        assert x[k, names.index("_distinct_words")] == pytest.approx(len(set(own_words)) / len(own_words) if own_words else 0)
        assert x[k, names.index("_digits")] == pytest.approx(len(regex.findall("[0-9]", texts[i])) / len(texts[i]) if texts[i] else 0)


def test_lasso_reaches_its_optimum():
    rng = np.random.default_rng(3)
    r = (rng.random((500, 30)) < 0.3).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(1 - 3 * r[:, 0] + 2 * r[:, 1]))).astype(float)
    strength = 0.01
    b, w = quality.lasso(r, y, strength, rounds=5000)
    gradient = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert abs(np.mean(1 / (1 + np.exp(-(r @ w + b))) - y)) < 1e-6  # the intercept is free
    assert np.all(np.abs(gradient[w == 0]) <= strength + 1e-6) and np.allclose(gradient[w != 0], -strength * np.sign(w[w != 0]), atol=1e-6)
    assert 2 <= np.count_nonzero(w) < 30


def test_all_rules_of_the_trees_are_tried():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 12))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.7).astype(float)
    assert len(quality.tree_rules(x, y)) > 400


def test_ftrl_leaves_useless_features_out():
    model = toxicity.Ftrl(10, l1=1.0)
    for k in range(400):
        model.learn(np.array([0, 2 + k % 7]) if k % 2 else np.array([1, 2 + k % 7]), float(k % 2))
    w = model.weights(slice(None))
    assert w[0] > 0 > w[1] and np.abs(w[2:]).max() < min(w[0], -w[1]) / 4


def test_rules_compile_to_what_they_hold(spark, docs):
    rows, names = quality.with_statistics(docs)
    x = rows.select(*names).toPandas().to_numpy(float)
    rule = quality.Rule(((0, True, 100.0), (3, False, 0.7)))
    assert rule.holds(x).tolist() == [r[0] for r in rows.select(rule.column(names)).collect()]


# --- pages
def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTPS://Sub.Example.ORG/es/x?y", "https://example.org/en/12#a", "https://example.org/en/2", "https://example.org", "http://x.com/fr/", "http://x.com/de/1", "http://notorg/a", "a://b.net://c/d"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judged(pages).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("sub.example.org", "/es/x", "example.org/es/"), 5: ("example.org", "/en/12", "example.org/en/1"),
        6: ("example.org", "/en/2", "org/"), 7: ("example.org", "", None), 8: ("x.com", "/fr/", "com/fr/"), 9: ("x.com", "/de/1", "com/de/"), 10: ("notorg", "/a", None), 11: ("b.net:", "//c/d", None),
    }


def power_iteration(edges, seeds, rounds=400):
    """Personalised PageRank by dense steps; what hosts without edges hold goes back to the seeds."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    matrix = np.zeros((len(hosts), len(hosts)))
    for a, b, weight in edges:
        matrix[at[b], at[a]] += weight
    out = matrix.sum(axis=0)
    matrix = np.divide(matrix, out, out=np.zeros_like(matrix), where=out > 0)
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    score = seed.copy()
    for _ in range(rounds):
        moved = url_filter.DAMPING * matrix @ score
        score = moved + (seed.sum() - moved.sum()) * seed / seed.sum()
    return dict(zip(hosts, score))


def test_distrust_flows_back_over_links(spark):
    link = lambda h: f'<a href="https://{h}/x">x</a>'
    rows = [("http://bad.com/de/1", ""), ("http://spam.net/1", link("bad.com") * 2), ("http://ring.net/1", link("spam.net")), ("http://good.org/1", link("friend.net")), ("http://friend.net/1", ""), ("http://alone.net/1", None)]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.verdicts(pages).collect()}
    assert [got[k]["verdict"] for k in range(6)] == ["block", "block", "block", "allow", "allow", "allow"]
    expected = power_iteration([("bad.com", "spam.net", 1.0), ("spam.net", "ring.net", 1.0)], {"bad.com": 1.0})
    assert {r["host"]: r["distrust"] for r in got.values() if r["distrust"]} == {h: pytest.approx(v) for h, v in expected.items()}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(0, "http://h0.com/de/1", "")] + [(k, f"http://h{k}.com/x", f'<a href=//h{k - 1}.com/>') for k in range(1, 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    rows = url_filter.judged(pages)
    got = {r["host"]: r["host_verdict"] for r in url_filter.host_verdicts(rows, url_filter.host_edges(pages)).collect()}
    assert got == {f"h{k}.com": "block" for k in range(50)}
    with pytest.raises(RuntimeError):
        url_filter.host_verdicts(rows, url_filter.host_edges(pages), most_rounds=8)


def test_trust_on_a_graph_of_some_hundred_hosts(spark):
    rng = random.Random(9)
    hosts = [f"h{k}.{'net' if k % 3 else 'org'}" for k in range(300)]
    edges = {}
    for a in hosts[:280]:  # the rest link to nothing
        for b in rng.sample(hosts, rng.randrange(1, 6)):
            if a != b:
                edges[a, b] = edges.get((a, b), 0) + float(rng.randrange(1, 5))
    rows = [(a, b, w) for (a, b), w in edges.items()]
    seeds = {h: float(1 + k % 4) for k, h in enumerate(hosts) if k % 17 == 0}
    frame = spark.createDataFrame(rows, "src string, dst string, weight double").coalesce(1)
    got = url_filter.propagate(frame, spark.createDataFrame(list(seeds.items()), "host string, mass double").coalesce(1)).collect()
    expected = {h: v for h, v in power_iteration(rows, seeds).items() if v}
    assert {r["host"]: r["score"] for r in got if r["score"]} == {h: pytest.approx(v, rel=1e-4, abs=1e-7) for h, v in expected.items()}


def test_rounds_take_as_many_tasks_as_their_edges_need(spark):
    """Every task of every round writes files: 211 tasks for two edges filled the disk."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double").coalesce(1)
    seeds = spark.createDataFrame([("a", 1.0)], "host string, mass double").coalesce(1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = url_filter.propagate(edges, seeds)
        assert found.rdd.getNumPartitions() == 1
        assert {r["host"]: r["score"] for r in found.collect()} == {h: pytest.approx(v, rel=1e-4) for h, v in power_iteration([("a", "b", 1.0), ("b", "a", 1.0)], {"a": 1.0}).items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_walks_that_shrink_alike_are_summed_at_once(spark):
    """Every round costs the driver a plan: 96 of them for each of trust and distrust took more than its memory."""
    subs = [f"s{k}.x.net" for k in range(20)] + ["t.s0.x.net", "a.y.net", "b.y.net"]
    rows = [(h, h.split(".", 1)[1], 1.0) for h in subs]
    rows += [(b, a, w) for a, b, w in rows]
    chain = [(f"c{k}.net", f"c{k + 1}.net", 1.0) for k in range(4)] + [("c4.net", "c3.net", 3.0), ("c4.net", "end.net", 0.5)]
    edges = spark.createDataFrame(rows + chain, "src string, dst string, weight double").coalesce(1)
    good, bad = {"s1.x.net": 3.0, "a.y.net": 1.0, "c0.net": 2.0, "lone.net": 1.0}, {"t.s0.x.net": 5.0, "end.net": 2.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in {**good, **bad}], "host string, good double, bad double").coalesce(1)
    got = {r["host"]: r for r in url_filter.flows(edges, seeds, most_rounds=48).collect()}
    for name, own, seed in (("trust", rows + chain, good), ("distrust", [(b, a, w) for a, b, w in rows + chain], bad)):
        expected = {h: v for h, v in power_iteration(own, seed).items() if v}
        assert {h: r[name] for h, r in got.items() if r[name]} == {h: pytest.approx(v, rel=1e-4, abs=1e-6) for h, v in expected.items()}


def test_edges_between_hosts_and_their_domains(spark):
    rows = [(1, "http://a.b.x.net/1", '<a href="//q.net/">'), (2, "http://b.x.net/", None), (3, "http://x.net/", ""), (4, None, "<a href=//z.net>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(r) for r in url_filter.host_edges(pages, domains=True).collect()}
    assert got == {("a.b.x.net", "q.net", 1.0)} | {x for a, b in (("a.b.x.net", "b.x.net"), ("b.x.net", "x.net")) for x in ((a, b, 1.0), (b, a, 1.0))}


def test_pages_with_clashing_columns_and_odd_rows(spark, tmp_path):
    long_url, long_html = "http://long.org/es/" + "x" * 200_000, "<p>" + "y " * 400_000
    rows = [(1, long_url, long_html), (1, long_url, long_html), (None, "http://a.com/fr/", None), (4, None, "")]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = {c: F.lit("z") for c in ("host", "path", "rule", "verdict", "trust", "salt", "score", "payload", "digest", "refers_to", "_url", "src", "_id", "_digest", "bytes", "other", "number")}
    extra = plain.withColumns(clash)
    bag = lambda df: Counter(tuple(r) for r in df.collect())
    assert bag(url_filter.verdicts(extra)) == bag(url_filter.verdicts(plain)) and url_filter.verdicts(extra).count() == 4
    one, other = (bag(warc.read_archives(warc.archive(p.filter("page_id IS NOT NULL"), shared_dir(spark, "warc")))) for p in (extra, plain))
    assert one == other and sum(one.values()) == 3
    same = [("a.org", "/x", "allow"), ("a.org", "/x", "block")]
    assert [r["ruling"] for r in url_filter.judged(spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string"), tuple(same)).collect()] == ["block"]


def test_warc_round_trip(spark):
    big, huge = "x" * 999 + "\u00e9", "y" * 300_000
    rows = [(1, "http://a/1", big), (2, "http://a/\r\n2 b", big), (3, None, big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", huge), (9, "u", huge), (9, "u", huge), (-5, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.archive(pages, shared_dir(spark, "warc"))).collect()
    import hashlib

    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, i), i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and last[h] != i
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert Counter(tuple(r) for r in got) == Counter(expected)


def test_a_cut_archive_is_an_error():
    import zlib as z

    parts = [warc.record(k, f"http://a/{k}", ("text %d " % k * 40).encode(), None) for k in range(4)]
    single = z.compressobj(6, z.DEFLATED, 31)
    one = b"".join(single.compress(p) for p in parts) + single.flush()
    many = []
    for p in parts:
        own = z.compressobj(6, z.DEFLATED, 31)
        many.append(own.compress(p) + own.flush())
    ends = {sum(map(len, many[:k])) for k in range(5)}
    read = lambda data, step=1 << 16: [whole for _, whole in warc.records(warc.inflate(pa.BufferReader(data), step))]
    assert read(one) == read(b"".join(many)) == read(one + b"\0" * 512) == read(many[0] + b"\0" * 7 + b"".join(many[1:]), 5) == parts
    assert read(b"") == []
    for data, whole in ((one, {0, len(one)}), (b"".join(many), ends)):
        for at in range(len(data)):
            if at in whole:
                assert read(data[:at]) == parts[: sorted(whole).index(at)]
            else:
                with pytest.raises(ValueError):
                    read(data[:at])
    with pytest.raises(ValueError):
        read(one + b"not gzip")


def test_archives_roll_over_and_members_stand_alone(spark, tmp_path):
    import gzip

    import pyarrow as pa

    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * 200, None) for k in range(40)], "page_id long, url string, payload string, refers_to long").withColumn("payload", F.encode("payload", "UTF-8")).coalesce(1)
    written = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=8000)
    assert written.count() > 1
    files = warc.normalise(written)
    assert sorted(r["page_id"] for r in warc.read_archives(files).collect()) == list(range(40))
    first = files.orderBy("path").first()
    index = pa.ipc.open_stream(pa.memory_map(first["index_path"].removeprefix("file://"))).read_all().to_pylist()
    raw = open(first["path"].removeprefix("file://"), "rb").read()
    assert all(gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1") for e in index)
    assert sum(e["length"] for e in index) == len(raw)
    again = warc.normalise(files)  # members as input
    assert warc.read_archives(again).count() == 40


# --- odd inputs, empty tables, all queries
def test_odd_texts(spark, odd):
    n = odd.count()
    assert repetition.repetition(odd).count() == n
    for r in repetition.repetition(odd).collect():
        if r["doc_id"] in (0, 1, 2):
            assert r["n_words"] == 0 and not r["kept"]
    model = language_id.fit(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == n and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (0, 1, 2, 3))
    dup = near_dedup.near_duplicates(odd.dropDuplicates(["doc_id"])).collect()
    assert {r["component_id"] for r in dup if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in dup if r["doc_id"] in (6, 9)} == {6}
    labels = odd.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("quality"), F.pmod("doc_id", F.lit(2)).cast("int").alias("toxic"))
    for own in (quality.learn_and_score(odd, labels), toxicity.learn_and_score(odd, labels)):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in own.collect())
    bench = spark.createDataFrame([(1, TEXTS[6][1])], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminations(odd, bench).collect()} == {6, 9}
    for keep in (repetition.keep_good, language_id.keep_known):
        assert keep(odd).columns == odd.columns
        keep(odd).count()


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert repetition.repetition(none).count() == 0
    assert language_id.learn_and_identify(none)[0].count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert packing.pack(none).count() == 0
    assert token_stream.read_tokens(token_stream.write_tokens(none, shared_dir(spark, "tokens"))).count() == 0
    assert decontaminate.contaminations(none, bench).count() == 0 and decontaminate.keep_clean(odd, bench).count() == odd.count()
    assert quality.learn_and_score(none, labels).count() == 0 and toxicity.learn_and_score(none, labels).count() == 0
    assert {r["score"] for r in quality.learn_and_score(odd, labels).collect()} == {0.5} == {r["score"] for r in toxicity.learn_and_score(odd, labels).collect()}
    assert url_filter.verdicts(pages).count() == 0
    assert warc.read_archives(warc.archive(pages, shared_dir(spark, "warc"))).count() == 0


def brute_jaccard_components(rows, least=0.8):
    own = []
    for i, text in rows:
        w = words(lowered(text))
        own.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    group = {i: i for i, _ in own}
    pairs = [(i, j) for k, (i, x) in enumerate(own) for j, y in own[:k] if x and y and len(x & y) >= least * len(x | y)]
    while True:
        before = dict(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            return group


def test_near_copies_are_found(spark, docs):
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and 60 <= len(r["text"].split()) <= 600]
    edited = []
    for i, text in rows:
        for times in (1, 2, 4, 8):
            w = text.split(" ")
            for _ in range(times):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            edited.append((1000 * times + i, " ".join(w)))
    both = rows + edited
    near = brute_jaccard_components(both)
    from textloom.llm.shingle_links import shingle_links

    frame = spark.createDataFrame(both, "doc_id long, text string")
    found = {i: i for i, _ in both} | {r["node"]: r["component"] for r in components.components(shingle_links(frame)).collect()}
    moved = [i for i in near if near[i] != i]
    assert len(moved) > 100 and sum(found[i] == near[i] for i in moved) >= 0.98 * len(moved)
    assert all(near[found[i]] == near[i] for i in near)  # nothing is linked that isn't
    kept = {r["doc_id"] for r in near_dedup.keep_one(frame, near=0.8).collect()}
    assert kept <= {i for i in near} and len(kept) <= 1.02 * len({near[i] for i in near})
    assert not shingle_links(frame.limit(0)).collect()


def test_a_group_without_a_common_centre(spark):
    from textloom.llm.shingle_links import shingle_links

    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 200])) for k in range(40)] + [(90, None), (91, ""), (None, "x"), (92, "one two"), (93, "One two")]
    found = components.components(shingle_links(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["node"]: r["component"] for r in found} == {k: 0 for k in range(40)} | {92: 92, 93: 92}


def test_pipeline_stages_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    good = {r["doc_id"] for r in repetition.repetition(docs).filter("kept").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in good]
    fitted = [(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    known = {r["doc_id"] for r, (lang, score) in zip(rows, brute_language(fitted, [r["text"] for r in rows])) if lang != "und" and score >= 0.5}
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows if r["doc_id"] in known]
    groups = brute_components(prints)
    single = [r for r in rows if r["doc_id"] in known and groups[r["doc_id"]] == r["doc_id"]]
    near_groups = brute_jaccard_components([(r["doc_id"], r["text"]) for r in single])
    single = [r for r in single if near_groups[r["doc_id"]] == r["doc_id"]]
    clean = lambda t: regex.findall(r"[\p{L}\p{N}]+", lowered(t))
    items = [clean(r["text"]) for r in bench.collect()]
    held = {tuple(x[k : k + 5]) for x in items for k in range(len(x) - 4)}
    own = [(r["doc_id"], clean(r["text"])) for r in single]
    near = [(i, x) for i, x in own if any(tuple(x[k : k + 5]) in held for k in range(len(x) - 4))]
    leaks = {k for k, _ in weighted_brute_force(near, items)}
    left = [(r["doc_id"], r["text"]) for r in single if r["doc_id"] not in leaks]
    got = corpus_pipeline.run(spark, SF).collect()
    check_packed(got, list(zip([i for i, _ in left], ids_of("word_bpe_49k.json", [t for _, t in left], 1))))
    assert leaks and [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_dedup", "decontaminate", "pack"]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    texts = [None, "", "same words " * 5, LONG, LONG, " ".join(f"plain{k}" for k in range(80))]
    rows = [(k, t, "en", "s", 1, 1.0, "x", True) for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1, 1.0, "x", True), (None, texts[5] + " more", None, None, None, None, None, None)]
    odd_docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, kept boolean")
    bench = spark.createDataFrame([(1, " ".join(f"plain{k}" for k in range(10, 30))), (2, None)], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for start in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, start, f"file://{tmp_path}")
            assert after.columns == odd_docs.columns and after.count() <= start.count()
        assert corpus_pipeline.packed(spark, start, f"file://{tmp_path}").filter("piece = 0").count() == start.count()
    kept = lambda stage: Counter(r["doc_id"] for r in stage(spark, odd_docs, f"file://{tmp_path}").collect())
    assert kept(corpus_pipeline.quality_rules) == Counter([3, 4, 5, 5, None])
    assert kept(corpus_pipeline.one_of_each_group) == Counter([0, 2, 3, 5, 5, None])
    assert kept(corpus_pipeline.without_benchmark) == Counter([0, 1, 2, 3, 4])


@pytest.mark.parametrize("name", ["op8_repetition", "op10_warc"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    at = sorted(got.columns)
    assert sorted(expected.columns) == at
    plain = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in at) for r in got.collect()) == sorted(tuple(plain(r[expected.columns.index(c)]) for c in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0


def test_a_file_replaces_what_an_earlier_attempt_left(tmp_path):
    from textloom.llm.files import open_file, writer

    uri = f"file://{tmp_path}/deep/a.bin"
    for data in (b"first", b"second"):
        with writer(uri) as out:
            out.write(data)
    assert open_file(uri).read() == b"second" and [p.name for p in (tmp_path / "deep").iterdir()] == ["a.bin"]
    with pytest.raises(ZeroDivisionError), writer(uri) as out:
        out.write(b"third")
        raise ZeroDivisionError
    assert open_file(uri).read() == b"second"
