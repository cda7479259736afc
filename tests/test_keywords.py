"""Many keywords against plain matching."""

import random
import re

import pytest

from textloom.operators import keywords as K
from textloom.operators import matching as M


def fires(keyword, text, span):
    clean = re.sub(r"[^\w\s]", " ", text.lower())
    if keyword in clean:
        return True
    own = re.split(" +", keyword)
    tokens = [t for t in re.split("[ \t\n\r\f\x0b]+", clean) if t]
    places = [p for p, t in enumerate(tokens) if t in own]
    return len(own) > 1 and all(w in clean for w in own) and bool(places) and max(places) - min(places) < span


@pytest.mark.parametrize("span", [3, 20])
def test_hits_against_plain_matching(spark, span):
    rng = random.Random(span)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts = [(k, rng.choice(["", " "]).join([]) + " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n", "  "]) for _ in range(rng.randrange(0, 40)))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, "A b\tc"), (203, "no-refund  policy"), (204, "x " * 20_000 + "ab abc")]
    keywords = {"", "b\tc", "a b\tc", "no-refund", "no refund", "refund  policy", "refund policy", " ab", "ab ", "B", "zz zz"} | set(words[:10])
    keywords |= {" ".join(rng.sample(words, rng.randrange(2, 4))) for _ in range(60)}
    rules = spark.createDataFrame([(k,) for k in [*keywords, None]], "keyword string")
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(tuple(r) for r in K.keyword_hits(frame, rules, span=span).collect())
    expected = sorted({(i, k.lower()) for i, t in texts if t is not None for k in keywords if fires(k.lower(), t, span)})
    assert found == expected


def test_same_rows_as_the_small_pack(spark):
    schema = "indicator string, keyword string, severity string, description string, relevant_for string"
    rules = spark.createDataFrame([("one", "of the", "high", "d", None), ("one", "thonblesh", "high", "d", None), ("near", "and that", "medium", "e", None), ("own", "elle", "context", "f", "travel"), ("own", "ELLE", "context", "f", "travel")], schema)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = (sorted(map(tuple, f(docs, rules, service="music").collect())) for f in (M.indicators, K.many_indicators))
    assert few == many and few


def test_no_rules_no_texts_and_the_limit(spark):
    rules = spark.createDataFrame([("a",), ("b",)], "keyword string")
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not K.keyword_hits(texts, rules.limit(0)).collect() and not K.keyword_hits(texts.limit(0), rules).collect()
    with pytest.raises(ValueError):
        K.keyword_hits(texts, rules, most=1)


def test_phrases_of_common_words_take_one_pass_over_each_text(spark):
    """Each phrase whose words are far apart was looked for in the whole text by itself: its words are in nearly every text."""
    from time import process_time

    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    phrases = sorted({" ".join(rng.sample(words, 2)) for _ in range(4000)})
    texts = pa.array([" ".join(rng.choice(words) for _ in range(4000)) for _ in range(10)])
    matcher = K.Matcher(phrases, 2)
    start = process_time()
    row, keyword = matcher.match(texts)
    new = process_time() - start
    start = process_time()
    expected = {(i, k) for i, t in enumerate(texts.to_pylist()) for k, p in enumerate(phrases) if p in t}
    assert set(zip(row.tolist(), keyword.tolist())) >= expected and len(expected) > 1000
    assert new < process_time() - start


def test_a_table_read_by_one_task_is_matched_by_many(spark):
    texts = spark.range(400).selectExpr("id AS doc_id", "concat('a b', id) AS text").coalesce(1)
    hits = K.keyword_hits(texts, spark.createDataFrame([("a",), ("a b",)], "keyword string"))
    assert hits.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and hits.count() == 800


def test_sparse_lookup_has_the_same_hits(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(20)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)])
    keywords = sorted({*words, *(" ".join(rng.sample(words, 2)) for _ in range(40))})
    pairs = lambda: sorted(zip(*(x.tolist() for x in K.Matcher(keywords, 4).match(texts))))
    dense = pairs()
    monkeypatch.setattr(K, "DENSE", 0)
    assert pairs() == dense and dense
    monkeypatch.setattr(K, "MAX_TOKENS", 3)
    assert pairs() == dense
