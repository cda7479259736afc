"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

An edit changes the counts of at most two letters, so the squared distance of two words'
letter counts is at most two. Letters are dealt into sets; all words with the same letters
from all but two of the sets meet in a block, and an edit leaves some such choice of sets untouched. Within
a block, products of the count matrices of adjacent lengths give all squared distances at
once; what is left is verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.checks import crc32_sql
from textloom.llm.common import cut, table

#: Sets that letters are dealt into; an edit touches two at most.
SETS = 4
#: Words of a block that a task compares at a time, and rows of a product.
TILE, ROWS = 4096, 256
#: Code points of words that are verified at a time.
CELLS = 1 << 19
MIN_LENGTH, MIN_COUNT, FORM_TIMES, DROP_EVERY = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]"
LINKS = "a string, na long, b string, nb long"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id``, ``run``: maximal runs of letters, A-Z lower-cased, of at least ``min_length`` code points, each as often as it occurs."""
    found = F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run")
    return docs.select(F.col(key).alias("doc_id"), found).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``word``, ``n``: the distinct words and how often they occur, ``min_count`` times at least.

    Of every run whose CRC-32 with its document's id is divisible by ``drop_every``, one letter is
    deleted. Counts are added up before they are shuffled, so a word may fill a third of all texts.
    """
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    rows = runs(docs, key, text, min_length).select("run", h.alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    short = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % drop_every == 0, short).otherwise(F.col("run"))
    made = rows.withColumn("at", at).select(word.alias("word")).filter(F.char_length("word") >= min_length)
    return made.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def letter_sets(vocabulary: DataFrame, sets: int = SETS) -> list[str]:
    """The alphabet dealt into sets that hold about as many letters of the words each, the most frequent letter first.

    An alphabet's counts come to the driver, not words.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''").groupBy("letter").count()
    dealt, load = [""] * sets, [0] * sets
    for letter, count in sorted(((r[0], r[1]) for r in letters.collect()), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        dealt[least] += letter
        load[least] += count
    return dealt


def _same(word: str, dropped: str) -> Column:
    """A word without the letters ``dropped``, sorted."""
    return F.array_join(F.array_sort(F.split(F.translate(word, dropped, "") if dropped else F.col(word), "")), "")


class _Words:
    """Words of a tile as one array of code points, the word ``k`` from ``at[k]`` on, and their letter counts."""

    def __init__(self, words: list[str], letters: np.ndarray):
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(words)), self.size)
        cells = owner * len(letters) + np.searchsorted(letters, self.flat)
        counts = np.bincount(cells, minlength=len(words) * len(letters)).reshape(len(words), len(letters))
        exact = np.float32 if (counts**2).sum(1).max(initial=0) < 1 << 22 else np.float64  # whole numbers stay exact
        self.counts = counts.astype(exact)
        reach = np.arange(3)
        self.head = self._three(self.at[:, None] + reach, reach < self.size[:, None])
        self.tail = self._three((self.at + self.size)[:, None] - 1 - reach, reach < self.size[:, None])

    def _three(self, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        three = np.where(inside, self.flat[np.where(inside, at, 0)], 0).astype(np.int64)
        return three[:, 0] << 42 | three[:, 1] << 21 | three[:, 2]

    def may(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """False only for words that no edit joins: in six letters or more it leaves three at one end alone."""
        return (self.head[p] == self.head[q]) | (self.tail[p] == self.tail[q]) | (self.size[p] < 6)

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Code points of some words, zeros behind them."""
        column = np.arange(width)[None, :]
        inside = column < self.size[rows][:, None]
        return np.where(inside, self.flat[np.where(inside, self.at[rows][:, None] + column, 0)], 0)

    def near(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether words ``p`` and ``q`` are one edit apart; each of ``q`` is as long as that of ``p`` or one letter longer."""
        out = np.zeros(len(p), bool)
        class_of = np.frexp(self.size[q].astype(float))[1]
        for bits in np.unique(class_of):
            own = np.flatnonzero(class_of == bits)
            step = max(1, CELLS >> int(bits))
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                width = int(self.size[q[rows]].max()) + 1
                one, two = self.padded(p[rows], width), self.padded(q[rows], width)
                differ = one != two
                first = np.argmax(differ, axis=1)
                shifted = (one[:, :-1] == two[:, 1:]) | (np.arange(width - 1) < first[:, None])
                out[rows] = np.where(self.size[p[rows]] == self.size[q[rows]], differ.sum(1) == 1, shifted.all(1))
        return out


def _pairs(words: _Words, part: np.ndarray, across: bool, sets: np.ndarray, choice: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of a tile's words, which come in order of length; of a tile of two parts only those across.

    A pair counts where ``choice`` is the first one that holds all sets of the letters it differs in, so it comes once.
    """
    size = words.size
    free = sets[:, list(choice)].any(1)  # all words of a block agree in the other letters
    counts = words.counts[:, free]
    square, one = (counts**2).sum(1), np.ones(len(size), counts.dtype)
    left, right = np.column_stack([-2 * counts, square, one]), np.column_stack([counts, one, square]).T.copy()
    for top in range(0, len(size), ROWS):
        end = min(top + ROWS, len(size))
        stop = int(np.searchsorted(size, size[end - 1] + 1, "right"))  # up to the words one letter longer
        distance = left[top:end] @ right[:, top:stop]
        a, b = np.divmod(np.flatnonzero(distance <= 2), stop - top)
        a, b = a + top, b + top
        ok = (b > a) & (size[b] - size[a] <= 1)
        if across:
            ok &= part[a] != part[b]
        a, b = a[ok], b[ok]
        ok = words.may(a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        ok = words.near(a, b)
        a, b = a[ok], b[ok]
        touched = ((words.counts[a] != words.counts[b]).astype(np.int64) @ sets) > 0
        ok = _first_choice(touched) == sets.shape[1] * choice[0] + choice[1]
        yield a[ok], b[ok]


def _first_choice(touched: np.ndarray) -> np.ndarray:
    """The first pair of sets, in the order of ``combinations``, that holds all touched ones; as first * sets + second."""
    n = touched.shape[1]
    out = np.full(len(touched), -1)
    for a, b in reversed(list(combinations(range(n), 2))):
        out[(touched.sum(1) - touched[:, a] - touched[:, b]) == 0] = a * n + b
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``choice``, ``block``, ``low``, ``high``, which come one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "block", "low", "high")])
        if not keys.shape[1]:
            continue
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        edges = [0, *starts.tolist(), keys.shape[1]]
        for a, b in zip(edges[:-1], edges[1:]):
            key = keys[:, a].tolist()
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def links(vocabulary: DataFrame, sets: int = SETS, tile: int = TILE) -> DataFrame:
    """``a``, ``na``, ``b``, ``nb``: each pair of words (``word``, ``n``; words distinct) exactly one edit apart, once.

    A block of more than ``tile`` words is cut into tiles of two parts, which are compared each
    with each, so a task holds about two parts whatever the size of a block. Words with an edit
    between them meet in a block for certain. No words give no rows.
    """
    vocabulary = cut(vocabulary)
    dealt = letter_sets(vocabulary, sets)
    alphabet = np.array(sorted(ord(c) for part in dealt for c in part), np.int64)
    member = np.array([[chr(c) in part for part in dealt] for c in alphabet], np.int64).reshape(len(alphabet), sets)
    choices = list(combinations(range(sets), 2))
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.xxhash64(_same("word", dealt[a] + dealt[b])).alias("block")) for k, (a, b) in enumerate(choices)))
    rows = vocabulary.select("word", "n", F.explode(keys).alias("key")).select("word", "n", "key.*")
    parts = F.ceil(F.col("count") / F.lit(tile)).cast("int")
    blocks = rows.groupBy("choice", "block").count().filter("count > 1").select("choice", "block", parts.alias("parts"))
    dealt_rows = rows.join(blocks, ["choice", "block"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = dealt_rows.select("choice", "block", "word", "n", "part", F.char_length("word").alias("size"), other.alias("other"))
    spread = spread.select("choice", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "size", "word", "n")
    ordered = spread.repartition("choice", "block", "low", "high").sortWithinPartitions("choice", "block", "low", "high", "size", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            if len(rows) < 2:
                continue
            found = _Words(rows.column("word").to_pylist(), alphabet)
            part = rows.column("part").to_numpy()
            across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
            for p, q in _pairs(found, part, across, member, choices[rows.column("choice")[0].as_py()]):
                if len(p):
                    one, two = rows.take(pa.array(p)), rows.take(pa.array(q))
                    yield from pa.table([one["word"], one["n"], two["word"], two["n"]], ["a", "na", "b", "nb"]).combine_chunks().to_batches()

    return ordered.mapInArrow(run, LINKS)


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the steps from ``word`` to ``form`` end. Each form has more occurrences than its word, so they do.

    Pointers double, so the rounds are the logarithm of the longest way; lineage is cut after each.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        after = cut(further.select(F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("_went")))
        now = after.drop("_went")
        if not after.filter("_went").limit(1).count():
            return now


def variants(vocabulary: DataFrame, form_times: int = FORM_TIMES, sets: int = SETS, tile: int = TILE) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of all words (``word``, ``n``; words distinct)."""
    vocabulary = cut(vocabulary)
    pairs = cut(links(vocabulary, sets, tile))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("near")).alias("best"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("near")).alias("best")))
    nearest = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    large = -F.col("best.less") >= form_times * F.col("n")
    found = vocabulary.join(nearest, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    found = cut(found)
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, form_times: int = FORM_TIMES, drop_every: int = DROP_EVERY) -> DataFrame:
    """Words of all texts with their near words' number, the form that they vary and its root.

    Null and empty texts have no words, texts of any length are read whole, repeated rows count
    each, a null id is an empty one, other columns aren't read whatever their names. Of equally
    frequent near words the first by code points is the form. No words give no rows.
    """
    return variants(words(docs, key, text, min_length, min_count, drop_every), form_times)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times FROM found WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, times, {crc32_sql("(doc_id::VARCHAR || ':' || run)")} AS h FROM counted),
made AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
vocabulary AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n, length(word) AS size FROM made WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
places AS (SELECT word, n, size, unnest(range(size)) AS place FROM vocabulary),
masked AS (SELECT word, n, substr(word, 1, place) || '*' || substr(word, place + 2) AS mask, substr(word, 1, place) || substr(word, place + 2) AS less FROM places),
near AS MATERIALIZED (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM masked x JOIN masked y ON x.mask = y.mask AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM masked x JOIN vocabulary y ON x.less = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM masked x JOIN vocabulary y ON x.less = y.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS near, first(other_n ORDER BY other_n DESC, encode(other)) AS near_n
  FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FORM_TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {FORM_TIMES} * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN formed f ON w.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e USING (word)
"""
