"""Mixing sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources they belong
to). Patterns send words to the sources' quotas; a pattern's first pass over
its documents costs nothing, each further pass more than the one before
(convex), so repetition is used only where quotas need it. The flow gives
every pattern the words it delivers: whole passes over all of its documents,
and a rest, for which documents are taken in seeded order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm import common

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Hash buckets of a pattern, by leading hex digits of the documents' hashes.
BUCKET_DIGITS = 3


def targets(sizes: dict, weights=WEIGHTS, most: int = MOST_REPEATS) -> dict:
    """Target per source: weights repeat over the sources by code point, null last, and share all sizes.

    A target stops at ``most`` times its source's size; the excess is shared
    again by weight among the others until none is above. Each target is one
    division of whole numbers, so it comes out alike everywhere.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(order, cycle(weights)))
    left, total_weight = sum(sizes.values()), sum(weight.values())
    out = {}
    # The source whose cap is smallest for its weight is filled first.
    by_cap = sorted(order, key=lambda s: most * sizes[s] / weight[s])
    for i, s in enumerate(by_cap):
        if most * sizes[s] * total_weight <= left * weight[s]:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
            total_weight -= weight[s]
        else:
            out |= {x: weight[x] * left / total_weight for x in by_cap[i:]}
            break
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_REPEATS) -> dict[tuple, int]:
    """Words that each pattern delivers: as much of the quotas as can be met, at the least cost of repetition.

    Passes are filled in order of their cost (0, 1, 2, ...), which a flow with
    convex costs allows; within a pass, augmenting paths move words between
    the sources that a pattern may serve. Paths are searched over sources
    alone: for each two of them a stack holds the patterns that can move words
    from one to the other, so a path costs as much as there are pairs of
    sources, however many patterns there are.
    """
    order = sorted(patterns, key=lambda p: (len(p), repr(p)))
    sources = sorted({s for p in order for s in p}, key=repr)
    number = {s: i for i, s in enumerate(sources)}
    own = [[number[s] for s in p] for p in order]
    size = [patterns[p] for p in order]
    need = [int(round(quotas.get(s, 0))) for s in sources]
    flow: list[dict[int, int]] = [{} for _ in order]
    spent = [0] * len(order)
    movers: list[list[list[int]]] = [[[] for _ in sources] for _ in sources]

    def put(k: int, s: int, step: int) -> None:
        if not flow[k].get(s):
            for t in own[k]:
                movers[s][t].append(k)
        flow[k][s] = flow[k].get(s, 0) + step

    for level in range(1, most + 1):
        room = [level * n - x for n, x in zip(size, spent)]
        roomy: list[list[int]] = [[] for _ in sources]
        for k, serves in enumerate(own):
            for s in serves:
                step = min(room[k], need[s])
                if step > 0:
                    put(k, s, step)
                    need[s] -= step
                    room[k] -= step
                    spent[k] += step
            if room[k] > 0:
                for s in serves:
                    roomy[s].append(k)
        while any(need):
            came: dict[int, tuple | None] = {}
            for s, stack in enumerate(roomy):
                while stack and not room[stack[-1]]:
                    stack.pop()
                if stack:
                    came[s] = None
            queue = deque(came)
            goal = next((s for s in came if need[s] > 0), None)
            while queue and goal is None:
                s = queue.popleft()
                for t, stack in enumerate(movers[s]):
                    if t in came:
                        continue
                    while stack and not flow[stack[-1]].get(s):
                        stack.pop()
                    if stack:
                        came[t] = (s, stack[-1])
                        if need[t] > 0:
                            goal = t
                            break
                        queue.append(t)
            if goal is None:
                break
            moves, at = [], goal
            while came[at]:
                moves.append((at, *came[at]))
                at = came[at][0]
            first = roomy[at][-1]
            step = min([need[goal], room[first], *(flow[k][s] for _, s, k in moves)])
            for t, s, k in moves:
                flow[k][s] -= step
                put(k, t, step)
            put(first, at, step)
            need[goal] -= step
            room[first] -= step
            spent[first] += step
    words = dict(zip(order, spent))
    return {p: words[p] for p in patterns}


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of df.

    source_col is a string, or an array of strings where documents belong to
    several sources (source_size and target are then those of the first one in
    order). size counts words, a null text none. A null source is a source of
    its own, the last. Rows of equal id and text share a hash and are ordered
    by nothing else; repeated rows are each mixed; an empty table gives an
    empty result; other columns are ignored.

    A pattern's documents are ordered by hash in buckets: bucket sums decide
    all but the bucket in which the rest ends, and only that one is ordered
    row by row, so no task holds a whole source.
    """
    return _mix(df, id_col, text_col, source_col, weights, most, seed).drop("hash", "text_hash")


def _mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: int, seed: str) -> DataFrame:
    rows = common.materialise(_sized(df, id_col, text_col, source_col, seed), "mix")
    # A row a pattern, however many documents have it; the flow is one problem, so it is solved on the driver.
    patterns = {tuple(r["pattern"]): r["n"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("n")).toLocalIterator()}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goals = targets(sizes, weights, most)
    if sum(patterns.values()) != sum(sizes.values()):  # overlapping sources share the words there are
        scale = sum(patterns.values()) / max(1, sum(sizes.values()))
        goals = {s: g * scale for s, g in goals.items()}
    flow = min_cost_flow(patterns, goals, most)
    plan = [(list(p), sizes[p[0]], float(goals[p[0]]), *(divmod(flow[p], n) if n else (0, 0))) for p, n in patterns.items()]
    spark = df.sparkSession
    facts = spark.createDataFrame(plan, "pattern array<string>, source_size long, target double, passes long, rest long")
    facts = facts.select(F.col("pattern").alias("p"), "source_size", "target", "passes", "rest", _key("pattern").alias("key"))
    # One row per pattern and bucket, at most 16^BUCKET_DIGITS a pattern.
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("key", "bucket", "n", before.alias("before")).join(facts, "key")
    decided = (
        F.when(F.col("before") + F.col("n") <= F.col("rest"), "all").when(F.col("before") >= F.col("rest"), "none").otherwise("some")
    )
    buckets = buckets.select("key", "bucket", "before", "source_size", "target", "passes", "rest", decided.alias("part"))
    joined = rows.join(buckets, ["key", "bucket"])
    plain = joined.where("part <> 'some'").select("doc_id", "hash", "text_hash", "size", "source_size", "target", (F.col("size") * (F.col("passes") + (F.col("part") == "all").cast("long"))).alias("taken"))
    # In the bucket where the rest ends, a document goes in if more than half of it fits.
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = joined.where("part = 'some'").withColumn("ahead", F.col("before") + ahead)
    more = (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).cast("long")
    return plain.unionByName(edge.select("doc_id", "hash", "text_hash", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more)).alias("taken")))


def _key(pattern: str) -> Column:
    """A string that tells patterns apart, nulls included."""
    return F.to_json(F.struct(F.col(pattern)), {"ignoreNullFields": "false"})


def _hash(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's place in the seeded order: by its id, or by its text where it has none."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    rows = common.picked(df, doc_id=id_col, text=text_col, source=source_col)
    single = dict(rows.dtypes)["source"] == "string"
    pattern = F.array("source") if single else F.when(F.size("source") > 0, F.array_sort(F.array_distinct("source"))).otherwise(F.array(F.lit(None).cast("string")))
    return rows.select(
        "doc_id",
        pattern.alias("pattern"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"),
        _hash(F.col("doc_id"), F.col("text"), seed).alias("hash"),
        F.xxhash64("text").alias("text_hash"),
    ).withColumns({"bucket": F.substring("hash", 1, BUCKET_DIGITS), "key": _key("pattern")})


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, columns as they were, each as often as it is taken (whole copies).

    Rows that share an id but not the text are documents of their own. Rows
    equal in both are one document: together they stand in the mix as often as
    the mix takes each of them.
    """
    taken = _mix(df, id_col, text_col, source_col, weights, most, seed).where("size > 0")
    counts = taken.groupBy(F.col("hash").alias("__at"), F.col("text_hash").alias("__of")).agg(F.count("*").alias("__rows"), F.sum(F.expr("taken div size")).alias("__copies"))
    counts = common.materialise(counts.where("__copies > 0"), "copies")
    placed = df.withColumns({"__hash": _hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed), "__text": F.xxhash64(F.col(f"`{text_col}`"))})
    found = placed.join(counts, (F.col("__hash") == F.col("__at")) & (F.col("__text") == F.col("__of")))
    times = lambda df, n: df.withColumn("__copy", F.explode(F.expr(f"sequence(1L, {n})"))).select(*names)
    names = df.columns
    even = times(found.where("__copies >= __rows"), "__copies div __rows")
    if not counts.where("__copies % __rows > 0").head(1):
        return even
    # The rest of equal rows, fewer than they are: one of them stands for it.
    return even.unionByName(times(found.where("__copies % __rows > 0").dropDuplicates(["__hash", "__text"]), "__copies % __rows"))


#: DuckDB SQL for the query's rows (one source for each document).
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
capped AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS k FROM s),
fill(k, lft, tw, lim) AS (
  SELECT CAST(0 AS BIGINT), (SELECT CAST(sum(n) AS BIGINT) FROM s), (SELECT CAST(sum(w) AS BIGINT) FROM s), true
  UNION ALL SELECT c.k, CASE WHEN f.lim AND 3 * c.n * f.tw <= f.lft * c.w THEN f.lft - 3 * c.n ELSE f.lft END,
    CASE WHEN f.lim AND 3 * c.n * f.tw <= f.lft * c.w THEN f.tw - c.w ELSE f.tw END, f.lim AND 3 * c.n * f.tw <= f.lft * c.w
  FROM fill f JOIN capped c ON c.k = f.k + 1),
goal AS (SELECT c.source, c.n AS source_size, CASE WHEN f.lim THEN CAST(3 * c.n AS DOUBLE) ELSE CAST(c.w * f.lft AS DOUBLE) / CAST(f.tw AS DOUBLE) END AS target
  FROM capped c JOIN fill f ON f.k = c.k),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round_even(target, 0) AS BIGINT) // source_size END AS passes,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST(round_even(target, 0) AS BIGINT) % source_size END AS rest FROM goal),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.rest,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
