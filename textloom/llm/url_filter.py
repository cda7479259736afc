"""URL verdicts: rules first, else trust and distrust propagated over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, table

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING, RATIO = 0.85, 1.0
#: Share of the seeds' mass that may still be on its way when scores count as settled, rounds until that is an error, and rounds in one job.
TOLERANCE, MOST_ROUNDS, STEP = 1e-6, 10_000, 8
#: Edges that a task takes at least, if there are fewer than that for each shuffle partition.
TASK_EDGES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links to other hosts in a page.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``ruling``: the longest rule that fits, null if none.

    ``rules`` is a parameter of bounded length and becomes one expression. Of rules of equal
    length, which can only both fit if they are the same host and path or split them
    differently, the last in order of host, path and verdict wins: block before allow.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    chain = F.lit(None).cast("struct<rule:string,ruling:string>")
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == own) | F.endswith("host", F.lit("." + own))) & F.startswith("path", F.lit(start))
        chain = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("ruling"))).otherwise(chain)
    return rows.withColumn("_r", chain).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.ruling").alias("ruling"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", domains: bool = False) -> DataFrame:
    """``src``, ``dst``, ``weight``: pages of a host that link to another host.

    With ``domains`` a host of three labels or more also has an edge of weight 1 to the
    domain above it and one back, for collections whose links stay within hosts.
    """
    host, _ = split_url(F.coalesce(F.col(url).cast("string"), F.lit("")))
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    pairs = pages.select(host.alias("src"), F.explode(linked).alias("dst")).filter("src != '' AND src != dst")
    edges = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not domains:
        return edges
    labels = F.split("host", r"\.")
    levels = F.sequence(F.lit(1), F.size(labels) - 2)
    chain = F.transform(levels, lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("low"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("high")))
    hosts = pages.select(host.alias("host")).distinct().filter(F.size(labels) > 2)
    steps = hosts.select(F.inline(chain)).distinct()
    both = steps.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e"))
    return edges.unionByName(both.select("e.src", "e.dst", F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def flows(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, salts: int = 16) -> DataFrame:
    """Personalised PageRank over edges and against them: ``host``, ``trust``, ``distrust``, with the total ``good`` and ``bad`` of ``seeds`` (``host``, ``good``, ``bad``).

    A host passes on ``damping`` of its score over its edges by weight and the rest flows
    from the seeds; what hosts without edges would pass on goes back to the seeds. So the
    scores are in proportion to the sum of all walks from the seeds, damped at each step:
    every round adds the walks one edge longer, of trust along the edges and of distrust
    against them. Rounds go on until the walks still to come hold less than ``tolerance``
    of the mass and no new host was reached; over ``most_rounds`` of them are an error.

    Walks in a linked group of hosts often come to shrink alike at all of them. If each
    host of a group has at least ``rate`` times its walks of two rounds ago, that part goes
    on forever and is summed as a geometric series at once; only the rest walks on, and
    nothing of it is negative. A group's label is the least hash of its seeds, passed on in
    the same rounds; groups that share one by chance share the smaller rate.

    A round is a join and a sum by host over pre-aggregated edges, in as many tasks as the
    edges need, since every task of every round writes a file; a checkpoint cuts the plan
    every few rounds. Every round costs the driver a plan, so few are better.
    """
    sides = ("t", "d")
    seeds = seeds.groupBy("host").agg(F.sum("good").alias("t"), F.sum("bad").alias("d"))
    mass = {k: v or 0.0 for k, v in seeds.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first().asDict().items()}
    if not any(mass.values()) or edges.isEmpty():
        return seeds.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    out, into = edges.groupBy("src").agg(F.sum("weight").alias("total")), edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    share = damping * F.col("weight") / F.col("total")
    along = edges.join(out, "src").select("src", "dst", share.alias("t"), F.lit(0.0).alias("d"))
    against = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), share.alias("d"))
    steps = along.unionByName(against).groupBy("src", "dst").agg(F.sum("t").alias("share_t"), F.sum("d").alias("share_d")).withColumn("keep", F.lit(False))
    # an edge from each host to itself carries what it has so far, so that a round reads the state once
    ends = edges.select(F.explode(F.array("src", "dst")).alias("src")).unionByName(seeds.select(F.col("host").alias("src"))).distinct()
    moves = cut(steps.unionByName(ends.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("share_t"), F.lit(0.0).alias("share_d"), F.lit(True).alias("keep"))))
    tasks = -(-moves.count() // TASK_EDGES)
    sized = lambda df: df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    moves = sized(moves)
    #: of each side: the last walks, those one and two rounds before, and the sum so far
    blank = [F.lit(0.0).alias(f"{k}{n}") for k in sides for n in (1, 2)]
    state = seeds.select("host", F.xxhash64("host").alias("label"), *sides, *blank, *(F.col(k).alias(f"{k}_sum") for k in sides))
    kept = lambda c: F.sum(F.when(F.col("keep"), F.col(c)).otherwise(0.0))
    for _ in range(0, most_rounds, STEP):
        for _ in range(STEP):
            sent = state.join(moves, state["host"] == moves["src"])
            walks = [F.sum(F.when(F.col("keep"), 0.0).otherwise(F.col(k) * F.col(f"share_{k}"))).alias(k) for k in sides]
            before = [kept(c).alias(name) for k in sides for c, name in ((k, f"{k}1"), (f"{k}1", f"{k}2"), (f"{k}_sum", f"{k}_before"))]
            new = sent.groupBy(F.col("dst").alias("host")).agg(F.min("label").alias("label"), F.max(F.when(F.col("keep"), F.col("label"))).alias("own"), *walks, *before)
            fresh = ~F.col("label").eqNullSafe(F.col("own")) | ((F.col("t_before") == 0) & (F.col("t") > 0)) | ((F.col("d_before") == 0) & (F.col("d") > 0))
            sums = [(F.col(f"{k}_before") + F.col(k)).alias(f"{k}_sum") for k in sides]
            state = sized(new.select("host", "label", *(f"{k}{n}" for k in sides for n in ("", 1, 2)), *sums, fresh.alias("fresh")))
        state = cut(state)
        # a host that is n edges from the seeds gets its first walk in round n: without one in the last round, none is to come
        whole = state.agg(F.count_if("fresh").alias("fresh")).first()["fresh"] == 0
        if whole:
            rates = state.groupBy("label").agg(*(F.least(F.min(F.when(F.col(f"{k}2") > 0, F.col(k) / F.col(f"{k}2"))), F.lit(damping**2)).alias(f"rate_{k}") for k in sides))
            spread = rates.filter("rate_t > 0 OR rate_d > 0").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
            more = {k: F.coalesce(F.col(f"rate_{k}") / (1 - F.col(f"rate_{k}")), F.lit(0.0)) for k in sides}
            rest = {k: F.greatest((1 + more[k]) * F.col(k) - more[k] * F.col(f"{k}2"), F.lit(0.0)).alias(k) for k in sides}
            total = {k: (F.col(f"{k}_sum") + more[k] * (F.col(f"{k}1") + F.col(k))).alias(f"{k}_sum") for k in sides}
            salted = state.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(salts))).join(spread, ["label", "salt"], "left")
            state = sized(salted.select("host", "label", *rest.values(), *blank, *total.values()))
            ends = state.agg(*(F.sum(c).alias(c) for k in sides for c in (k, f"{k}_sum"))).first()
            if all(ends[k] * damping <= tolerance * (1 - damping) * ends[f"{k}_sum"] for k in sides):
                score = {k: F.col(f"{k}_sum") * F.lit(mass[k] / ends[f"{k}_sum"]) if mass[k] else F.lit(0.0) for k in sides}
                return state.filter("t_sum > 0 OR d_sum > 0").select("host", score["t"].alias("trust"), score["d"].alias("distrust"))
    raise RuntimeError(f"trust has not settled after {most_rounds} rounds")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``flows`` of trust alone: ``host``, ``score``, with the total mass of ``seeds`` (``host``, ``mass``)."""
    both = flows(edges, seeds.select("host", F.col("mass").alias("good"), F.lit(0.0).alias("bad")), damping, tolerance, most_rounds)
    return both.select("host", F.col("trust").alias("score"))


def host_verdicts(rows: DataFrame, edges: DataFrame, damping: float = DAMPING, ratio: float = RATIO, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``host``, ``trust``, ``distrust``, ``host_verdict`` for all hosts that either reaches.

    Seeds are hosts of pages that rules allow or block, by their number. Trust follows
    links; distrust goes from a blocked host to those that link to it, however far. A host
    is blocked where distrust is above ``ratio`` times trust.
    """
    seeds = cut(rows.filter("ruling IS NOT NULL").groupBy("host").agg(F.count_if(F.col("ruling") == "allow").cast("double").alias("good"), F.count_if(F.col("ruling") == "block").cast("double").alias("bad")))
    both = flows(edges, seeds, damping, tolerance, most_rounds)
    return both.withColumn("host_verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))


def verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    damping: float = DAMPING,
    ratio: float = RATIO,
    tolerance: float = TOLERANCE,
    most_rounds: int = MOST_ROUNDS,
    domains: bool = False,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    salts: int = 16,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    A rule's verdict stands; pages without one get their host's, and allow where neither
    trust nor distrust reaches the host. Null urls and ones without ``://`` have an empty
    host and path, and fit no rule. Null pages have no links. Urls and pages are read
    whole, however long. Rows with the same id are judged each, null ids too; columns
    other than key, url and page are not read. A host may hold a third of all pages: the
    join with hosts is salted.
    """
    rows = judged(pages, rules, key, url)
    edges = cut(host_edges(pages, url, html, domains))
    known = host_verdicts(rows, edges, damping, ratio, tolerance, most_rounds)
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)))
    found = salted.join(spread, ["host", "salt"], "left")
    verdict = F.coalesce("ruling", "host_verdict", F.lit("allow")).alias("verdict")
    return found.select("page_id", "host", "path", "rule", verdict, F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hosts and the domains above them are linked too: the given pages link to no other host
    return verdicts(table(spark, sf_dir, "pages"), domains=True)
