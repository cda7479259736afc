"""Reading and writing corpora: text folders, web pages, binary files, vector and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import file_name

#: Blocks of a page that hold no text of its own.
BLOCKS = ("script", "style", "nav", "header", "footer")
#: Unicode's space separators, as SQL's TRIM takes them.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _place(path: str) -> Column:
    """A path's URI with one slash after its scheme, as some of Spark's lists have one and others three."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def read_corpus(spark: SparkSession, folder: str, categories: list[str] | None = None) -> DataFrame:
    """``path``, ``file_name``, ``category`` (parent folder), ``text`` of every text file below a folder.

    Spark's readers give no row for a file without a byte, so the list of files that they read by is joined.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    own = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("_at", _place("path"))
    listed = spark.createDataFrame([(f,) for f in rows.inputFiles()], "listed string").withColumn("_at", _place("listed"))
    name = F.url_decode(F.replace(F.regexp_extract("path", "([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    out = listed.join(own, "_at", "left").select(F.coalesce("path", "listed").alias("path"), "text").select("path", name.alias("file_name"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("category", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    return out.filter(F.col("category").isin(*categories)) if categories else out


def with_metadata(corpus: DataFrame, metadata: DataFrame) -> DataFrame:
    """Corpus files with ``company``, ``category``, ``source_url`` by file name; unknown ones get defaults."""
    own = metadata.select(F.col("filename").alias("file_name"), F.col("company").alias("_co"), F.col("category").alias("_ca"), F.col("source_url").alias("_url"))
    stem = F.regexp_replace("file_name", "\\.[^.]+$", "")
    return corpus.join(own, "file_name", "left").select("file_name", "text", F.coalesce("_co", stem).alias("company"), F.coalesce("_ca", F.lit("unknown")).alias("category"), F.coalesce("_url", F.lit("")).alias("source_url"))


def html_text(html: Column | str) -> Column:
    """Lines of a page's text: no blocks, tags or blank parts."""
    out = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    for tag in BLOCKS:
        out = F.regexp_replace(out, f"(?isu)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, "(?s)<[^>]+>", "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    parts = F.flatten(F.transform(F.split(out, "\n", -1), lambda line: F.split(F.trim(line, F.lit(SPACES)), "  ", -1)))
    return F.array_join(F.filter(F.transform(parts, lambda part: F.trim(part, F.lit(SPACES))), lambda x: x != ""), "\n")


def pages_text(pages: DataFrame, least: int = 500) -> DataFrame:
    """``page_id``, ``text`` of pages with at least ``least`` characters of it."""
    return pages.select("page_id", html_text("html").alias("text")).filter(F.length("text") >= least)


def admit_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf",), most: int = 10 << 20) -> DataFrame:
    """``path``, ``safe_name``, ``reason`` (null: admitted) of binary files: extension, size, and the marks of a PDF at both ends."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    head = F.substring("content", 1, 5)
    tail = F.decode(F.expr("substring(content, greatest(1, length - 1023), 1024)"), "ISO-8859-1")
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col("length") > most, "size").when(head != F.lit(b"%PDF-"), "header").when(~F.contains(tail, F.lit("%%EOF")), "end")
    return rows.select("path", file_name("path").alias("safe_name"), "length", reason.alias("reason"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``new`` over ``old`` by key, the last write winning: of repeated keys in ``new`` the row with the greatest ``order``, or without one any single row."""
    if order is None:
        last = new.dropDuplicates([key])
    else:
        last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def index_statistics(rows: DataFrame, namespace: str, document: str, per_document: int = 50) -> DataFrame:
    """Vectors and documents of each namespace and of all (``total``), vectors for a document, and coverage against ``per_document``."""
    own = rows.select(F.col(namespace).cast("string").alias("namespace"), F.col(document).alias("_d"))
    out = own.rollup("namespace").agg(F.count("*").alias("vectors"), F.count_distinct("_d").alias("documents"))
    n = F.greatest(F.col("documents"), F.lit(1))
    return out.select(F.coalesce("namespace", F.lit("total")).alias("namespace"), "vectors", "documents", (F.col("vectors") / n).alias("average_vectors"), (F.col("vectors") / (n * per_document)).alias("coverage"))


def index_status(docs: DataFrame, done: DataFrame, key: str, text: str = "text", force: bool = False, least: int = 500) -> DataFrame:
    """``key``, ``status``, ``reason``, ``chars``: documents of ``done`` are skipped unless ``force``; short texts fail."""
    own = docs.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left")
    n = F.coalesce(F.length(text), F.lit(0))
    status = F.when(F.col("_done") & F.lit(not force), "skipped").when(n < least, "failed").otherwise("success")
    reason = F.when(status == "skipped", "already_indexed").when(status == "failed", "text_too_short")
    return own.select(key, status.alias("status"), reason.alias("reason"), n.alias("chars"))


def run_summary(run: DataFrame, key: str, chunks: str = "chunks", seconds: str = "seconds", price: float = 0.02, most: int = 5) -> DataFrame:
    """One row of an index run: documents by status, chunks, characters, time, cost for a thousand chunks, and the first ``most`` errors."""
    ok = F.col("status") == "success"
    out = run.agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("success", "successful"), ("failed", "failed"), ("skipped", "skipped"))],
        F.coalesce(F.sum(F.when(ok, F.col(chunks))), F.lit(0)).alias("chunks"),
        F.coalesce(F.avg(F.when(ok, F.col(chunks))), F.lit(0.0)).alias("mean_chunks"),
        F.coalesce(F.sum(F.when(ok, F.col("chars"))), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.avg(F.when(ok, F.col(seconds))), F.lit(0.0)).alias("mean_seconds"),
    )
    bad = run.filter("status = 'failed'").orderBy(key).limit(most).agg(F.array_sort(F.collect_list(F.struct(key, "reason"))).alias("e"))
    named = F.array_join(F.transform("e", lambda x: F.concat(x[key].cast("string"), F.lit(": "), x["reason"])), "; ")
    return out.join(F.broadcast(bad)).withColumn("embedding_cost", F.col("chunks") / 1000 * price).withColumn("errors", named).drop("e")


def chunk_vectors(chunks: DataFrame, document: str, namespace: Column, most: int = 1000) -> DataFrame:
    """Chunks as vector records: a key of document and index, and text cut for its metadata."""
    return chunks.select(F.concat_ws("_chunk_", F.col(document).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_key"), document, F.left("chunk", F.lit(most)).alias("text"), namespace.alias("namespace"))


def write_vectors(rows: DataFrame, path: str) -> None:
    """Write the namespaces that ``rows`` has, leaving others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def delete_documents(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A child table without rows of deleted documents."""
    return children.join(gone.select(key), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the documents in ``new`` replaced by those."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_metadata(base: DataFrame, extracted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with ``columns`` from ``extracted`` where it has the key, nulls included."""
    own = extracted.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = base.join(own, key, "left")
    return rows.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A fitted model's tables below one folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
