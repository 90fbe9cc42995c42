"""URL filters: rules first, then trust and distrust over the link graph of hosts.

A rule (`host/path`, block or allow) fits its host and all subdomains if the url's
path starts with the rule's; the longest wins. Where none fits, the host's scores
decide. A host seeds trust by the share of its pages that rules allow, and distrust
by the share that they block. Trust flows along links, from a host to those it
links to (personalised PageRank); distrust flows against them, to the hosts that
link to bad ones. Scores are in units of a wholly allowed or blocked host without
links. A host is blocked if its distrust is at least `threshold` and above its trust.

Hosts are aggregated before anything is shuffled by them, so a host with a third
of all pages is one row in the graph; links between two hosts are one weighted edge.
Each round of propagation is a written table, and rounds end when what still moves is
too little to change any score; there is no limit of rounds. Scores are the sum of
what arrives, weighted by damping per link; a host without links passes nothing on.

Null urls and urls without :// have empty host and path, no rule, and are allowed.
Null html has no links. Repeated rows are judged one by one. An empty table gives
no rows. Very long html is searched whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared

#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Propagation ends when no host's score can change by more.
SETTLED = 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src|action|cite)\s*+=\s*+["']?+\s*+((?:[a-z][a-z0-9+.-]{0,15}:)?//[^"'\s<>]++)"""


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), _UPPER, _LOWER)


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _host(rest), F.regexp_extract(F.regexp_extract(rest, r"^[^/?#]*+([\s\S]*)$", 1), r"^[^?#]*+", 0)


def _rules_of_hosts(hosts: DataFrame, rules) -> DataFrame:
    """host, rules: those of the host and of the domains above it."""
    spark = hosts.sparkSession
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", r, v) for r, v in rules]
    table = spark.createDataFrame(rows, "domain string, start string, rule string, verdict string")
    deepest = max((d.count(".") + 1 for d, *_ in rows), default=1)
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    near = hosts.select("host", F.explode(above).alias("domain"))
    return near.join(table, "domain").groupBy("host").agg(F.collect_list(F.struct("start", "rule", "verdict")).alias("rules"))


def _flow(edges: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    """host, score: the seeds and what flows from them along (src, dst, share), until no host can gain `SETTLED` more. Each round passes on what arrived in the last one.

    What still moves, m, can add at most m * damping / (1 - damping) to all hosts together, and m shrinks by `damping` a round at
    least; so rounds end by themselves, after a number that grows with the logarithm of the seeds.
    """
    state = shared.saved(seeds.select("host", "score", F.col("score").alias("moving")), "flow")
    while True:
        sent = state.where("moving > 0").join(edges, F.col("host") == edges.src).groupBy("dst").agg(F.sum(F.col("moving") * F.col("share") * damping).alias("sent"))
        kept = state.select("host", "score", F.lit(0.0).alias("moving"))
        both = kept.unionByName(sent.select(F.col("dst").alias("host"), F.col("sent").alias("score"), F.col("sent").alias("moving")))
        before, state = state, shared.saved(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving")), "flow")
        shared.drop(before)
        left = state.agg(F.sum("moving")).head()[0] or 0.0
        if left * damping / (1 - damping) < SETTLED:
            return state.select("host", "score")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: host, path, rule (null if none fits), verdict, and the host's trust and distrust."""
    host, path = parse(F.col(url_col).cast("string"))
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: _host(F.substr(x, F.instr(x, "//") + 2)))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.array_distinct(links).alias("links"))
    parsed = shared.saved(parsed, "pages")
    # what is joined to pages is written first: then both sides are shuffled for the join, and large hosts are split
    per_host = shared.saved(_rules_of_hosts(parsed.select("host").distinct(), rules), "rules")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    ruled = parsed.select("page_id", "host", "path").join(per_host, "host", "left").select("page_id", "host", "path", best.alias("best"))
    ruled = shared.saved(ruled.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled")), "ruled")

    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    pairs = parsed.select("host", F.explode("links").alias("to")).where("host != '' AND to != '' AND host != to").groupBy("host", "to").agg(F.count("*").cast("double").alias("w"))
    pairs = shared.saved(pairs, "edges")

    def edges(src: str, dst: str) -> DataFrame:
        total = pairs.groupBy(src).agg(F.sum("w").alias("total")).withColumnRenamed(src, "src")
        return shared.saved(pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "w").join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "edges")

    trust = _flow(edges("host", "to"), seeds.where("good > 0").select("host", F.col("good").alias("score")), damping).select("host", F.col("score").alias("trust"))
    distrust = _flow(edges("to", "host"), seeds.where("bad > 0").select("host", F.col("bad").alias("score")), damping).select("host", F.col("score").alias("distrust"))
    scores = seeds.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    scores = shared.saved(scores, "scores")
    verdict = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")) & (F.col("host") != ""), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
