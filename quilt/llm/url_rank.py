"""URL filters: fixed rules, and for urls that none fits, trust propagated over host links.

Trust flows along links from hosts with allowed pages (personalised PageRank),
distrust against them from hosts with blocked pages. Ranks are whole numbers
(parts in SCALE), so sums don't hang on their order and reruns agree. A host
whose distrust exceeds its trust by the threshold is blocked. Everything is
DataFrame expressions; each round is one join and one sum over the host edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quilt.llm import common

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SCALE = 10**12
#: Up to so many ruled pages on a side a seed's share is in whole millionths, as in the SQL; over it ranks are in parts of FINE.
MILLION = 10**6
FINE = 10**16
#: Per cent of a rank that goes on along links; the rest returns to the seeds.
DAMPING = 85
#: Rounds end when ranks, whole numbers, stay as they are, or here, where at most 0.85^60 of a rank, 6 in 100,000, is on its way.
ROUNDS = 60
#: Blocked if distrust exceeds this per cent of trust (and any at all).
THRESHOLD = 100
#: Rounds between writes of the ranks to the shared folder, which divide ROUNDS.
CUT_EVERY = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(url: str, page: str = "") -> dict:
    """host and path columns of a url column (null or without ://: both empty)."""
    host = F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return {f"{page}host": F.coalesce(host, F.lit("")), f"{page}path": F.coalesce(path, F.lit(""))}


def _ruled(rules=RULES):
    """(rule, verdict) of the longest rule that fits columns host and path; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, counted before anything is shuffled."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([a-z][a-z0-9+.\-]*://[^\"'\s>]*)"), 1)).alias("link"))
    target = links.select(F.col("host").alias("src"), _split("link")["host"].alias("dst"))
    return target.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _total(seeds: DataFrame) -> int:
    return seeds.agg(F.sum("weight")).first()[0] or 1


def _propagate(seeds: DataFrame, total: int, scale: int, edges: DataFrame, rounds: int, damping: int, label: str) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, weight; total in all), in parts of scale.

    A host's rank is divided over its out-links by their counts; hosts without
    links pass nothing on. Links are written with their shares once and read
    in every round. Restarts are each seed's share of scale, one part at least.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    shares = common.materialise(edges.join(out, "src").select("src", "dst", "n", "out"), f"{label}-shares")
    share = f"weight * {SCALE // 10**6} div {total} * {10**6}" if scale == SCALE else f"CAST(weight AS DECIMAL(19,0)) * {scale} div {total}"
    start = common.materialise(seeds.selectExpr("host", f"greatest({share}, 1) AS restart"), f"{label}-seeds")
    rank, before, mark = start.selectExpr("host", "restart AS rank"), None, None
    for i in range(rounds):
        moved = shares.join(rank, shares["src"] == rank["host"]).selectExpr("dst AS host", f"rank * {damping} div 100 div out * n AS rank")
        rank = start.selectExpr("host", f"restart * {100 - damping} div 100 AS rank").unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % CUT_EVERY == 0:
            seen = Observation()
            rank = common.materialise(rank.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("host", "rank").cast("decimal(38,0)")).alias("h")), label)
            if before is not None:
                common.discard(before)
            if (seen.get["n"], seen.get["h"]) == mark:
                break
            before, mark = rank, (seen.get["n"], seen.get["h"])
    return rank


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, rounds: int = ROUNDS, damping: int = DAMPING, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row of df.

    A host's seed weight is the number of its pages that a rule allows (for
    trust) or blocks (for distrust). Without a rule a page is blocked where
    its host's distrust is positive and over ``threshold`` per cent of its
    trust, else allowed. Null or malformed urls have an empty host and path,
    fit no rule and are allowed. Repeated rows are each judged and weigh as
    often as they occur, a null html has no links, an empty table gives an
    empty result, other columns are ignored. trust and distrust are null for
    hosts that nothing reaches, and in whole parts of SCALE; verdicts go by
    finer parts where a side has over MILLION ruled pages.
    """
    rule, verdict = _ruled(rules)
    pages = common.picked(df, page_id=id_col, url=url_col, html=html_col).withColumns(_split("url"))
    judged = pages.withColumns({"rule": rule, "verdict": verdict})
    hosts = judged.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    edges = common.materialise(host_edges(pages), "host-edges")
    good = hosts.where("good > 0 AND host <> ''").selectExpr("host", "good AS weight")
    bad = hosts.where("bad > 0 AND host <> ''").selectExpr("host", "bad AS weight")
    totals = _total(good), _total(bad)
    scale = SCALE if max(totals) <= MILLION else FINE
    trust = _propagate(good, totals[0], scale, edges, rounds, damping, "trust")
    back = edges.selectExpr("dst AS src", "src AS dst", "n")
    distrust = _propagate(bad, totals[1], scale, back, rounds, damping, "distrust")
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    method = F.when((F.coalesce("distrust", F.lit(0)) > 0) & (F.col("distrust") * 100 > F.coalesce("trust", F.lit(0)) * threshold), F.lit("block")).otherwise(F.lit("allow"))
    # Pages without a host have no score; they are dealt by their place, not all under one key.
    key = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit(" "), F.monotonically_increasing_id()))
    scores = scores.withColumnRenamed("host", "scored")
    kept = judged.drop("html", "url").withColumn("key", key).join(scores, F.col("key") == F.col("scored"), "left")
    return kept.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), *(F.expr(f"{c} div {scale // SCALE} AS {c}") for c in ("trust", "distrust")))


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    lower = f"'{_UPPER}', '{_LOWER}'"

    def ranked(name: str, column: str, a: str, b: str) -> str:
        return f"""
{name}_s AS (SELECT host, {column} * {SCALE // 10**6} // (SELECT sum({column}) FROM hosts WHERE {column} > 0 AND host <> '') * {10**6} AS restart FROM hosts WHERE {column} > 0 AND host <> ''),
{name}_e AS (SELECT {a} AS src, {b} AS dst, n, sum(n) OVER (PARTITION BY {a}) AS o FROM edges),
{name}(it, host, rank) AS (SELECT 0, host, CAST(restart AS HUGEINT) FROM {name}_s WHERE restart > 0
  UNION ALL (SELECT it + 1, host, CAST(sum(rank) AS HUGEINT) FROM (
    SELECT r.it, s.host, CAST(s.restart * {100 - DAMPING} // 100 AS HUGEINT) AS rank FROM (SELECT DISTINCT it FROM {name}) r, {name}_s s WHERE s.restart > 0
    UNION ALL SELECT r.it, e.dst, CAST(r.rank * {DAMPING} // 100 // e.o * e.n AS HUGEINT) FROM {name} r JOIN {name}_e e ON e.src = r.host) WHERE it < {ROUNDS} GROUP BY it, host))"""

    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {lower}), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT page_id, host, path, {case(lambda v, h, x: h + x)} AS rule, {case(lambda v, h, x: v)} AS verdict FROM p),
hosts AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS good, count(*) FILTER (WHERE verdict = 'block') AS bad FROM j GROUP BY host),
links AS (SELECT host AS src, translate(regexp_extract(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([a-z][a-z0-9+.\-]*://[^"''\s>]*)', 1)), '(?s)^.*?://([^/?#]*)', 1), {lower}) AS dst FROM p),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),{ranked("trusts", "good", "src", "dst")},{ranked("distrusts", "bad", "dst", "src")}
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.verdict, CASE WHEN coalesce(d.rank, 0) > 0 AND d.rank * 100 > coalesce(t.rank, 0) * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(t.rank AS BIGINT) AS trust, CAST(d.rank AS BIGINT) AS distrust
FROM j LEFT JOIN trusts t ON t.host = j.host AND t.it = {ROUNDS} LEFT JOIN distrusts d ON d.host = j.host AND d.it = {ROUNDS}
"""


ORACLE = _oracle()
