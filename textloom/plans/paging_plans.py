"""Pages by key, and joins on ranges by bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import reports as R
from textloom.operators import scoring as S
from textloom.plans.common import Plans, table

ORDER, LIMIT, PAGES = [("n_chars", True), ("doc_id", False)], 20, 3


def pages(s, d):
    """The first three pages of documents by length, each read from the last row of the one before."""
    own = table(s, d, "documents").select("doc_id", "source", "n_chars").filter("n_chars IS NOT NULL")
    found, last = [], None
    for number in range(1, PAGES + 1):
        page = R.page_after(own, ORDER, last, LIMIT)
        found.append(page.withColumn("page", F.lit(number)))
        rows = page.select(*(name for name, _ in ORDER)).collect()  # a page
        if len(rows) < LIMIT:
            break
        last = rows[-1].asDict()
    return reduce(DataFrame.unionByName, found)


def balances(s, d):
    """Customers whose balance lies within 25 of a supplier's, for each supplier; those below zero have no upper end."""
    own = table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") + 25).alias("high"))
    found = S.range_totals(table(s, d, "customer"), own, "c_acctbal", "low", "high", "s_suppkey", "c_custkey")
    return found.withColumnRenamed("rows", "customers")


PLANS: Plans = {
    "h21_i06_pages_by_key": (
        pages,
        f"""SELECT doc_id, source, n_chars, ((place - 1) // {LIMIT} + 1)::INT AS page
FROM (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE n_chars IS NOT NULL) WHERE place <= {LIMIT * PAGES}""",
    ),
    "g09_range_join": (
        balances,
        """SELECT s_suppkey, count(*) AS customers, min(c_custkey) AS first, max(c_custkey) AS last FROM supplier JOIN customer
ON c_acctbal >= s_acctbal - 25 AND (s_acctbal < 0 OR c_acctbal <= s_acctbal + 25) GROUP BY s_suppkey""",
    ),
}
