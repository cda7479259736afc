"""Column functions over text: cleaning, hashes, gates, displays and wording features."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.rules import fixed


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_newlines(text: Column | str) -> Column:
    """Every line end a newline, at most two of them in a row."""
    return F.regexp_replace(F.regexp_replace(_c(text), "\r\n?", "\n"), "\n{3,}", "\n\n")


def sanitize(text: Column | str, max_length: int = 10_000) -> Column:
    """Cut, drop tags (bodies of scripts stay, their tags going first), collapse white space, trim."""
    out = F.substring(_c(text), 1, max_length)
    for pattern in ("<[^>]+>", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f\\x0B]+", " "))


def clean_value(value: Column | str, max_length: int = 200) -> Column:
    """Null to empty, no control characters, cut, trimmed."""
    return F.trim(F.left(F.regexp_replace(F.coalesce(_c(value), F.lit("")), "[\\x00-\\x1f\\x7f-\\x9f]", ""), F.lit(max_length)))


def file_name(path: Column | str, max_length: int = 100, default: str = "document") -> Column:
    """A safe file name: last part of a path, letters, digits, ``._-``; cut before the extension."""
    base = F.element_at(F.split(_c(path), "[/\\\\]"), -1)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, " ", "_"), "[^A-Za-z0-9._-]", ""), "\\.{2,}", ".")
    safe = F.regexp_replace(safe, "^\\.+", "")
    ext = F.regexp_extract(safe, "(\\.[A-Za-z0-9]+)$", 1)
    cut = F.when(F.length(safe) > max_length, F.concat(F.left(safe, F.lit(max_length) - F.length(ext)), ext)).otherwise(safe)
    return F.when(F.length(cut) > 0, cut).otherwise(default)


def file_name_plain(name: Column | str, default: str = "document.pdf") -> Column:
    """The other form of a safe name: the last part of a path, of it letters, digits, blanks and ``._-`` only, trimmed."""
    base = F.element_at(F.split(_c(name), "/"), -1)
    safe = F.trim(F.regexp_replace(base, "[^\\p{L}\\p{N}._\\- ]", ""))
    return F.when(F.length(safe) > 0, safe).otherwise(default)


def file_size(size: Column | str) -> Column:
    """A size in whole Bytes, KB, MB or GB."""
    n = _c(size).cast("double")
    power = F.when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0)
    shown = F.floor(n / F.pow(F.lit(1024.0), power) + 0.5).cast("string")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), power + 1)))


def percentage(value: Column | str) -> Column:
    """A share as percent with one place."""
    return F.concat(F.format_string("%.1f", F.round(_c(value) * 100, 1)), F.lit("%"))


def count_level(high: Column, medium: Column) -> Column:
    """A level from counts: High with any high one, Medium with more than two medium ones, else Low."""
    return F.when(high > 0, "High").when(medium > 2, "Medium").otherwise("Low")


def default_metadata(rows: DataFrame, failed: str, defaults: dict[str, str | None]) -> DataFrame:
    """``rows`` with each column of ``defaults`` at its default where extraction ``failed``, and ``extraction_failed`` in place of that flag."""
    bad = F.coalesce(F.col(failed), F.lit(True))
    kept = [c for c in rows.columns if c != failed]
    return rows.select(*[F.when(bad, F.lit(defaults[c])).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in kept], bad.alias("extraction_failed"))


def vague_only(text: Column | str, suspicious: Column, words: Iterable[str], least: int = 500) -> Column:
    """A long text with vague wording that nothing else has flagged."""
    return (F.length(_c(text)) > least) & any_contained(text, words) & ~suspicious


def canonical_hash(text: Column | str) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(_c(text)), "[ \\t\\n\\r\\f\\x0B]+", " ")), 256)


def preview(text: Column | str, length: int, mark: str = "...", always: bool = False) -> Column:
    """The first characters, marked where something was cut, or always."""
    cut = F.concat(F.left(_c(text), F.lit(length)), F.lit(mark))
    return cut if always else F.when(F.length(_c(text)) > length, cut).otherwise(_c(text))


def blank_to_null(value: Column | str) -> Column:
    trimmed = F.trim(_c(value))
    return F.when((trimmed == "") | (F.lower(trimmed) == "null"), None).otherwise(trimmed)


def iso_date(value: Column | str) -> Column:
    """A date of ten characters that exists, else null."""
    own = blank_to_null(value)
    return F.when(F.length(own) == 10, F.to_date(F.try_to_timestamp(own, F.lit("yyyy-MM-dd"))))


def allowed(value: Column | str, values: Iterable[str], default: str) -> Column:
    own = F.lower(F.trim(_c(value)))
    return F.when(own.isin(*values), own).otherwise(default)


def count_contained(text: Column | str, words: Iterable[str]) -> Column:
    """How many of ``words`` the lower-cased text contains."""
    own = F.lower(_c(text))
    return sum((F.contains(own, F.lit(w)).cast("int") for w in words), F.lit(0))


def any_contained(text: Column | str, words: Iterable[str]) -> Column:
    return count_contained(text, words) > 0


def word_pattern(words: Iterable[str]) -> list[str]:
    return [f"\\b{w}\\b" for w in words]


def word_tokens(text: Column | str, lower: Column | str | None = None) -> Column:
    """The lower-cased text's runs of letters, digits and ``_``; ``lower``: that text, when it is at hand."""
    return F.split(F.lower(_c(text)) if lower is None else _c(lower), "[^\\p{L}\\p{N}_]+")


def listed_tokens(tokens: Column, words: Iterable[str]) -> Column:
    """Those ``tokens`` that are among ``words``, for several counts of them."""
    return F.filter(tokens, lambda w: w.isin(*sorted({x for x in words if re.fullmatch("[a-z]+", x)})))


def _literal_parts(pattern: str) -> list[str]:
    """Texts that must occur where a pattern of plain words, ``\\.`` and ``.*`` matches; none for any other."""
    parts = pattern.removeprefix("\\b").removesuffix("\\b").split(".*")
    plain = all(re.fullmatch(r"(?:[a-z0-9 '\-]|\\\.)*", p) for p in parts)
    return [p.replace("\\.", ".") for p in parts if p] if plain else []


def count_patterns(text: Column | str, patterns: Iterable[str], tokens: Column | str | None = None, lower: Column | str | None = None) -> Column:
    """Matches of all patterns in the lower-cased text; overlapping patterns count each.

    Single words in word boundaries are counted among the text's ``tokens`` (``word_tokens``,
    when those are at hand), all in one pass; other patterns are only tried where their
    words occur. ``lower``: the lower-cased text, when that is at hand. The sum stands in a lambda: as compiled code that of a long list would be too large.
    """
    listed = list(patterns)
    single = [m[1] for p in listed if (m := re.fullmatch(r"\\b([a-z]+)\\b", p))]
    rest = [p for p in listed if not re.fullmatch(r"\\b([a-z]+)\\b", p)]
    own = word_tokens(text) if tokens is None else _c(tokens)
    total = F.size(F.filter(own, lambda w: w.isin(*single))).cast("long") if single else F.lit(0).cast("long")
    for word in {w for w in single if single.count(w) > 1}:  # a word that is listed again counts again
        total = total + F.size(F.filter(own, lambda w, word=word: w == word)).cast("long") * (single.count(word) - 1)
    if not rest:
        return total

    def count(t: Column, pattern: str) -> Column:
        n = F.regexp_count(t, F.lit(pattern))
        for part in _literal_parts(pattern):
            n = F.when(F.contains(t, F.lit(part)), n).otherwise(0)
        return n

    counts = F.transform(F.array(F.lower(_c(text)) if lower is None else _c(lower)), lambda t: sum((count(t, p) for p in rest), F.lit(0)))
    return total + F.get(counts, F.lit(0)).cast("long")


def words(text: Column | str) -> Column:
    """Alphabetic words, ASCII."""
    return F.regexp_extract_all(_c(text), F.lit("([a-zA-Z]+)"), 1)


def sentence_count(text: Column | str) -> Column:
    parts = F.filter(F.split(_c(text), "[.!?]+[ \\t\\n\\r\\f\\x0B]+|\\n+"), lambda x: F.trim(x) != "")
    return F.greatest(F.size(parts), F.lit(1))


def syllables(word: Column) -> Column:
    """Vowel groups, less a final silent e; short words one; at least one."""
    own = F.lower(word)
    n = F.regexp_count(own, F.lit("[aeiouy]+")) - F.endswith(own, F.lit("e")).cast("int")
    return F.when(F.length(own) <= 3, 1).otherwise(F.greatest(n, F.lit(1)))


def flesch_of(words: Column, sentences: Column, syllable_count: Column) -> Column:
    """Reading ease from 0 to 100 of counts; 0 without words."""
    score = 206.835 - 1.015 * (words / sentences) - 84.6 * (syllable_count / words)
    return F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def flesch(text: Column | str) -> Column:
    """Reading ease from 0 to 100; 0 without words. Several measures of a text: ``readability``."""
    own = words(text)
    return flesch_of(F.size(own), sentence_count(text), F.aggregate(own, F.lit(0), lambda a, w: a + syllables(w)))


#: Text bytes whose words are measured at a time; bounds a worker's memory.
SLICE_BYTES = 1 << 20
_LETTER, _VOWEL = (np.isin(np.arange(256), list(letters)) for letters in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"AEIOUYaeiouy"))


def _measured(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and syllables (``words``, ``syllables``) of texts that lie one behind the other; ``at``: where each starts, and the end."""
    letter, vowel = _LETTER[data], _VOWEL[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(letter & ~(np.append(False, letter[:-1]) & ~first[:-1]))
    ends = np.flatnonzero(letter & ~(np.append(letter[1:], False) & ~first[1:]))
    begins = vowel & ~(np.append(False, vowel[:-1]) & ~first[:-1])
    groups = np.append(0, np.cumsum(begins))
    n = groups[ends + 1] - groups[starts] - (data[ends] | 32 == ord("e"))
    each = np.where(ends - starts < 3, 1, np.maximum(n, 1))
    own = np.searchsorted(at, starts, "right") - 1
    return np.bincount(own, minlength=len(at) - 1), np.bincount(own, each, len(at) - 1).astype(np.int64)


def word_measures(text: Column) -> Column:
    """``words`` and ``syllables`` of each text, null for null: as ``words`` and ``syllables`` have them, from the bytes of many texts at once."""

    @F.arrow_udf("struct<words:long,syllables:long>")
    def run(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            whole = texts.slice(at, stop - at).fill_null("").cast(pa.large_binary())
            places = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
            parts.append(_measured(data, places - places[0]))
            at = stop
        counts = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*parts) if parts else ((), ()))]
        return pa.StructArray.from_arrays(counts, ["words", "syllables"], mask=texts.is_null())

    return run(text)


def readability(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``sentences``, ``words``, ``syllables`` and ``flesch``, each found once."""
    out = rows.withColumn("sentences", sentence_count(text).cast("long")).withColumn("_counts", word_measures(_c(text)))
    out = out.withColumn("syllables", F.col("_counts.syllables")).withColumn("words", F.col("_counts.words"))
    return out.drop("_counts").withColumn("flesch", flesch_of(F.col("words"), F.col("sentences"), F.col("syllables")))


def density(text: Column | str, patterns: Iterable[str]) -> Column:
    """Pattern matches for 100 words."""
    n = F.size(words(text))
    return F.when(n > 0, count_patterns(text, patterns) / n * 100.0).otherwise(0.0)


def clear_language(text: Column | str, patterns: Iterable[str] = tuple(word_pattern(fixed.UNCLEAR))) -> Column:
    n = F.greatest(F.size(F.filter(F.split(_c(text), "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")), F.lit(1))
    return count_patterns(text, patterns) / n * 100 < 2.0


def specific_details(text: Column | str, vague: Iterable[str] = tuple(word_pattern(fixed.VAGUE))) -> Column:
    """A number, amount, span of time or month, and fewer than three vague wordings."""
    own = F.lower(_c(text))
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    found = own.rlike("\\b[0-9]+\\b") | own.rlike("[0-9]+%") | own.rlike("\\$[0-9]+") | own.rlike("\\b[0-9]+ *(day|week|month|year|hour)s?\\b") | own.rlike(f"\\b({months})\\b")
    return found & (sum((own.rlike(p).cast("int") for p in vague), F.lit(0)) < 3)


def disclosure_quality(text: Column | str, readability: Column, position: Column) -> Column:
    """Two of three: easy to read or clear, near the front, specific. ``position`` is a share, 1 if unknown."""
    votes = ((F.coalesce(readability >= 60, F.lit(False))) | clear_language(text)).cast("int") + (F.coalesce(position, F.lit(1.0)) <= 0.30).cast("int") + specific_details(text).cast("int")
    return votes >= 2


def risk_level(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 7, "High").when(s >= 4, "Medium").otherwise("Low")


def lookup(value: Column | str, table: dict, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _c(value)), F.lit(default))


def tokens_estimate(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")) * 1.3


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price for a million tokens each, rounded to six places."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def indicator_summary(high: Column, medium: Column, default: str = "No significant risk indicators") -> Column:
    """Names by severity in one line."""
    parts = F.array_compact(F.array(F.when(F.size(high) > 0, F.concat(F.lit("HIGH RISK: "), F.array_join(high, ", "))), F.when(F.size(medium) > 0, F.concat(F.lit("MEDIUM RISK: "), F.array_join(medium, ", ")))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(default)


def open_json(rows: DataFrame, raw: str, scalars: dict[str, tuple[str, str]], arrays: dict[str, str]) -> DataFrame:
    """``rows`` with ``valid`` and, read by path from JSON of any shape, ``scalars`` (name: path, type) and ``arrays`` of strings (name: path).

    The text is parsed once, to a variant. A broken text, a missing path or a value of another
    type gives null for a scalar and an empty array for an array; objects in an array come as JSON.
    """
    own = rows.withColumn("_json", F.try_parse_json(raw))
    empty = F.array().cast("array<string>")
    found = {name: F.try_variant_get("_json", path, kind) for name, (path, kind) in scalars.items()}
    found |= {name: F.coalesce(F.try_variant_get("_json", path, "array<string>"), empty) for name, path in arrays.items()}
    return own.withColumns({"valid": F.col("_json").isNotNull(), **found}).drop("_json")
