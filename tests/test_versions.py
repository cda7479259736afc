"""Tables replaced and deleted on disk: all or nothing, and only what is touched."""

import threading

import pytest

from textloom.sources import versions as T

DOCS, PARTS = "id long, body string", "id long, n int, bucket_note string"


def made(spark, tmp_path, buckets=8):
    store = f"file://{tmp_path}/store"
    docs = [(k, f"text {k}") for k in range(40)] + [(None, "no id"), (7, "again"), (8, "")]
    parts = [(k % 40, k, None) for k in range(200)] + [(3, k, "hot") for k in range(500)] + [(None, 1, "x")]
    T.create(spark, store, {"docs": spark.createDataFrame(docs, DOCS), "parts": spark.createDataFrame(parts, PARTS), "none": spark.createDataFrame([], PARTS)}, "id", buckets)
    return store, docs, parts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replace_and_cascade(spark, tmp_path):
    store, docs, parts = made(spark, tmp_path)
    assert rows(T.read(spark, store, "docs")) == sorted(docs, key=str)
    assert rows(T.read(spark, store, "parts")) == sorted(parts, key=str)
    assert rows(T.read(spark, store, "none")) == []
    new = [(3, -1, "new"), (3, -2, "new"), (99, 5, "new"), (None, 2, "y")]
    assert T.replace(spark, store, {"parts": spark.createDataFrame(new, PARTS)}) == 2
    after = [r for r in parts if r[0] not in (3, 99)] + new
    assert rows(T.read(spark, store, "parts")) == sorted(after, key=str)
    gone = spark.createDataFrame([(3,), (7,), (7,), (1000,), (None,)], "id long")
    assert T.delete(spark, store, gone) == 3
    for name, old in (("docs", docs), ("parts", after), ("none", [])):
        assert rows(T.read(spark, store, name)) == sorted((r for r in old if r[0] not in (3, 7)), key=str)
    # earlier versions are as they were
    assert rows(T.read(spark, store, "parts", 1)) == sorted(parts, key=str)
    found = {(r["version"], r["table"]): (r["rows"], r["rewritten"]) for r in T.versions(spark, store).collect()}
    assert found[1, "docs"][0] == 43 and found[2, "docs"] == (43, 0)
    assert found[2, "parts"][0] == len(after) and found[2, "parts"][1] <= 3 < found[1, "parts"][1]
    assert found[3, "docs"][0] == 40 and found[3, "none"] == (0, 0)


def test_everything_deleted_and_nothing(spark, tmp_path):
    store, docs, _ = made(spark, tmp_path)
    T.delete(spark, store, spark.createDataFrame([], "id long"))
    assert rows(T.read(spark, store, "docs")) == sorted(docs, key=str)
    T.delete(spark, store, spark.createDataFrame([(k,) for k in range(40)], "id long"))
    assert rows(T.read(spark, store, "docs")) == [(None, "no id")]
    T.replace(spark, store, {"none": spark.createDataFrame([(1, 2, "z")], PARTS)})
    assert rows(T.read(spark, store, "none")) == [(1, 2, "z")]


def test_reader_during_the_write(spark, tmp_path):
    store, docs, parts = made(spark, tmp_path, 2)
    before = (len(docs), len(parts))
    gone = [(k,) for k in range(20)]
    after = (sum(r[0] not in range(20) for r in docs), sum(r[0] not in range(20) for r in parts))
    work = threading.Thread(target=lambda: T.delete(spark, store, spark.createDataFrame(gone, "id long")))
    work.start()
    seen = []
    while work.is_alive():
        n = max(r["version"] for r in T.versions(spark, store).select("version").collect())
        seen.append((n, tuple(T.read(spark, store, name, n).count() for name in ("docs", "parts"))))
    work.join()
    assert seen and all(s == ((1, before) if s[0] == 1 else (2, after)) for s in seen)
    assert tuple(T.read(spark, store, name).count() for name in ("docs", "parts")) == after


def test_cut_write_is_not_seen(spark, tmp_path, monkeypatch):
    store, docs, _ = made(spark, tmp_path)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(T, "_publish", lost)
        with pytest.raises(RuntimeError):
            T.delete(spark, store, spark.createDataFrame([(1,)], "id long"))
    assert rows(T.read(spark, store, "docs")) == sorted(docs, key=str)
    assert T.delete(spark, store, spark.createDataFrame([(1,)], "id long")) == 2  # the same number again, over what was left
    assert rows(T.read(spark, store, "docs")) == sorted((r for r in docs if r[0] != 1), key=str)


def test_names_and_numbers(spark, tmp_path):
    with pytest.raises(ValueError):
        T.create(spark, f"file://{tmp_path}/x", {"a": spark.createDataFrame([], "id long, Bucket int")}, "id")
    with pytest.raises(ValueError):
        T.create(spark, f"file://{tmp_path}/x", {}, "id", 0)
