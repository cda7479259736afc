"""Sharding, alignment and spelling variants against brute force and SQL, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from textloom.llm import align, queries, sharding, spelling
from textloom.llm.tokens import public_path

LONG = " ".join(f"w{k}" for k in range(30_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "!!! ???"), (4, "one"), (5, "Two words"),
    (6, "the quick brown fox jumps over the lazy dog " * 9), (7, LONG), (7, LONG), (None, "no id"), (None, None),
    (8, "中文 éè \x00 \x1c   end"), (9, "the quick brown fox jumps over the lazy dog " * 9),
    (10, "a  b ▁ c"), (11, "<|endoftext|> <s> </s><unk> x"), (12, "x" * 5000 + " " + "abcdefgh" * 600), (13, "\U0001f600ﬁ é क़."),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names operators use themselves."""
    rows = [(i, t, "s", 0, "x", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, law string, shard int, word string, slot long, a int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_sharding", "op13_spelling"])
def test_query_and_sql(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    names = ", ".join(found.columns)
    expected = duck.sql(f"SELECT {names} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(expected)


# --- sharding
def test_shards_of_odd_rows(odd):
    rows = sharding.shards(odd, [1.0] * 3, [1.0] * 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert not sharding.shards(odd.limit(0), [1.0, 1.0]).collect()


def test_weights_and_moves(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = {r.shard: r["count"] for r in keys.groupBy(sharding.shard_of("doc_id", [1.0, 2.0, 0.0, 1.0]).alias("shard")).count().collect()}
    assert set(got) == {0, 1, 3} and abs(got[1] - 10_000) < 400 and abs(got[0] - 5_000) < 300
    moves = {(r.from_shard, r.to_shard): r.n_rows for r in sharding.moved(keys, [1.0] * 4, [1.0] * 5).collect()}
    assert all(a == b or b == 4 for a, b in moves)
    assert abs(sum(n for (a, b), n in moves.items() if a != b) - 4_000) < 300
    with pytest.raises(ValueError):
        sharding.shard_of("doc_id", [0.0, 0.0])


def test_one_row_many_times_is_numbered(spark):
    rows = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.shards(rows, [1.0] * 4).collect()
    assert sorted(r.slot for r in found) == list(range(5_000)) and len({r.shard for r in found}) == 1


def test_written_shards(spark, odd, tmp_path):
    records = odd.drop("shard")
    sharding.write_shards(records, [1.0] * 3, f"file://{tmp_path}/out", files=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.slot) for r in back.collect()) == Counter((r.doc_id, r.text, r.slot) for r in records.collect())
    assert back.filter(F.col("shard") != sharding.shard_of("doc_id", [1.0] * 3)).count() == 0


def test_sharding_is_native(spark):
    plan = sharding.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- alignment
@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    return one, two, align.byte_level_bytes(one), align.piece_bytes(two)


def plain_alignment(tools, rows):
    """Each text's groups by sets of ends; counts by a dictionary."""
    one, two, bytes_a, bytes_b = tools
    groups, counts = [], Counter()
    for _, text in rows:
        own = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            if b"".join(bytes_a[x] for x in a) == b"".join(bytes_b[x] for x in b) == (" " + text).encode():
                ends = [np.cumsum([len(e[x]) for x in ids]).tolist() for e, ids in ((bytes_a, a), (bytes_b, b))]
                common = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *common], common):
                    own.append(([x for x, e in zip(a, ends[0]) if low < e <= high], [x for x, e in zip(b, ends[1]) if low < e <= high]) if len(common) < 300 else None)
                if None in own:  # long: by pointers
                    own, i, j = [], 0, 0
                    for high in common:
                        x, y = i, j
                        while i < len(a) and ends[0][i] <= high:
                            i += 1
                        while j < len(b) and ends[1][j] <= high:
                            j += 1
                        own.append((a[x:i], b[y:j]))
        groups.append(own)
        counts.update((g[0][-1], g[1][-1]) for g in own)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (i, _), own in zip(rows, groups):
        pairs = [(g[0][-1], g[1][-1]) for g in own]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        yield (
            i, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(own), sum(counts[p] == most[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if own else "",
        )


def test_alignment_of_odd_rows(odd, tools):
    assert Counter(map(tuple, align.alignments(odd).collect())) == Counter(plain_alignment(tools, TEXTS))
    assert not align.alignments(odd.limit(0)).collect()


def test_alignment_query(spark, docs, tools):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, align.query(spark, SF).collect())) == Counter(plain_alignment(tools, rows))


def test_alignment_of_any_letters(spark, tools):
    rng = random.Random(5)
    pool = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x900, 0x980), *range(0x4E00, 0x4E40), 0x1F600, 0x2581, 0xA0, 9, 10, 13, 0x0130, 0x200D)]
    rows = [(k, "".join(rng.choice(pool + [" "] * 60) for _ in range(rng.randrange(1, 80)))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for lane in (2, align.LANE):
        assert Counter(map(tuple, align.alignments(frame, lane=lane).collect())) == Counter(plain_alignment(tools, rows))


def test_token_groups_cover_the_text(odd, tools):
    found = defaultdict(list)
    for r in align.token_groups(odd.filter("doc_id IN (5, 6, 8, 12)")).collect():
        found[r.doc_id].append(r)
    for i, text in TEXTS:
        if i in found:
            own = sorted(found[i], key=lambda r: r.start)
            assert [r.start for r in own] == [0, *(r.stop for r in own[:-1])]
            whole = (" " + text).encode()
            assert all(b"".join(tools[2][x] for x in r.a) == b"".join(tools[3][x] for x in r.b) == whole[r.start : r.stop] for r in own)


# --- spelling variants
def one_edit(p, q):
    if len(p) > len(q):
        p, q = q, p
    if len(p) == len(q):
        return sum(x != y for x, y in zip(p, q)) == 1
    return len(q) == len(p) + 1 and any(q[:k] + q[k + 1 :] == p for k in range(len(q)))


def plain_variants(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None


@pytest.mark.parametrize("tile", [3, 4096])
def test_variants_by_brute_force(spark, tile):
    rng = random.Random(tile)
    counts = {}
    for k in range(260):
        word = "".join(rng.choice("aaabcdé") for _ in range(rng.randrange(1, 9)))
        counts[word] = rng.choice([1, 2, 3, 30, 400, 5000])
        for _ in range(2):
            at = rng.randrange(len(word))
            counts.setdefault(word[:at] + rng.choice(["", "x", "ß" + word[at]]) + word[at + 1 :], rng.randrange(1, 50))
    counts.pop("", None)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = spelling.variants(frame, tile=tile).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(map(tuple, found.collect())) == Counter(plain_variants(counts))


def test_long_words_and_odd_rows(spark, odd):
    huge = "ab" * 40_000
    rows = [(k, f"{huge} {huge}c  Wording wording wordinG, Ähnlich Ähnlich") for k in range(3)] + [(None, None), (None, "wordings wordings"), (4, "")]
    found = {r.word: r for r in spelling.spellings(spark.createDataFrame(rows, "doc_id long, text string"), drop_every=10**9).collect()}
    assert set(found) == {huge, huge + "c", "wording", "wordings", "Ähnlich"}
    assert found[huge].n_near == 1 and found["wording"].n == 9 and found["wording"].n_near == 1 and found["Ähnlich"].root == "Ähnlich"
    assert spelling.spellings(odd, min_length=3).filter("word = 'quick'").first().n == 18
    assert not spelling.spellings(odd.limit(0)).collect()


def test_letters_left_out_by_checksum(spark):
    run = next(w for w in (f"abcdefgh{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(676)) if zlib.crc32(f"1:{w}".encode()) % 31 == 0)
    at = zlib.crc32(f"1:{run}".encode()) % len(run)
    words = {r.word: r.n for r in spelling.words(spark.createDataFrame([(1, f"{run.upper()} {run}")], "doc_id long, text string")).collect()}
    assert words == {run[:at] + run[at + 1 :]: 2}
