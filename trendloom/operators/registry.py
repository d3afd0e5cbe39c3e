"""The topic registry: matching between runs, merges, remaps, retirement and flags.

Matching and merging are ordered choices over topics of one scope. A scope's topics are
few (their number doesn't grow with the records), so each scope's candidate pairs, made
with joins, are settled in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import centroids, dot, unit
from trendloom.sources.stored import stored


#: Pairs of a scope (2000 new topics with 2000 old ones) that are matched at most.
MOST_PAIRS = 4_000_000


def scoped_pairs(new: DataFrame, old: DataFrame, scope: str) -> DataFrame:
    """scope, new_id, old_id, similarity of all new and old topics of one scope, both
    with topic_id and centroid."""
    a = new.select(scope, F.col("topic_id").alias("new_id"), F.col("centroid").alias("_a"))
    b = old.select(scope, F.col("topic_id").alias("old_id"), F.col("centroid").alias("_b"))
    return a.join(b, scope).select(scope, "new_id", "old_id", dot(F.col("_a"), F.col("_b")).alias("similarity"))


def optimal_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of the one-to-one assignment with the largest sum of gains, by
    shortest augmenting paths with potentials; the shorter side is assigned whole."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((i, j) for j, i in optimal_pairs(gain.T))
    cost = -gain
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came_from = np.full(m, -1)
        done = np.zeros(m, bool)
        row, at, column = start, 0.0, -1
        visited = []
        while True:
            step = at + cost[row] - row_price[row] - col_price
            closer = ~done & (step < reach)
            reach[closer] = step[closer]
            came_from[closer] = column
            column = int(np.where(done, np.inf, reach).argmin())
            at = reach[column]
            done[column] = True
            if owner[column] < 0:
                break
            visited.append(column)
            row = owner[column]
        row_price[start] += at
        for c in visited:
            row_price[owner[c]] += at - reach[c]
            col_price[c] -= at - reach[c]
        while column >= 0:
            before = int(came_from[column])
            owner[column] = start if before < 0 else owner[before]
            column = before
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def match_optimal(pairs: DataFrame, scope: str, least: float) -> DataFrame:
    """scope, new_id, old_id, similarity: within each scope the one-to-one matching of
    largest total similarity; afterwards, matches under least are dropped. A scope of over
    MOST_PAIRS pairs is refused: its grid is one task's, and the work grows with its cube."""
    most = pairs.groupBy(scope).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_PAIRS:
        raise ValueError(f"a scope has {most} pairs; {MOST_PAIRS} are matched at most")

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        grid = table.pivot(index="new_id", columns="old_id", values="similarity").sort_index().sort_index(axis=1)
        chosen = optimal_pairs(grid.to_numpy(float))
        rows = [(table[scope].iat[0], grid.index[i], grid.columns[j], grid.iat[i, j]) for i, j in chosen if grid.iat[i, j] >= least]
        return pd.DataFrame(rows, columns=[scope, "new_id", "old_id", "similarity"])

    return pairs.groupBy(scope).applyInPandas(settle, pairs.select(scope, "new_id", "old_id", "similarity").schema)


def match_greedy(pairs: DataFrame, scope: str, least: float, margin: float = 0.0) -> DataFrame:
    """scope, new_id, old_id, similarity: strongest pairs first, each topic used once.
    A pair needs least and, if there is a margin, a lead of margin over the new topic's
    second best (-1 without one): so only its best pair can win. Ties go to the lesser
    new_id, then old_id."""
    order = Window.partitionBy(scope, "new_id").orderBy(F.desc("similarity"), "old_id")
    ranked = pairs.withColumns({"_r": F.row_number().over(order), "_next": F.lead("similarity").over(order)})
    leads = (F.col("_r") == 1) & (F.col("similarity") - F.coalesce("_next", F.lit(-1.0)) >= margin)
    able = ranked.where((F.col("similarity") >= least) & (leads if margin > 0 else F.lit(True)))

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        taken_new, taken_old, rows = set(), set(), []
        for r in table.sort_values(["similarity", "new_id", "old_id"], ascending=[False, True, True]).itertuples(index=False):
            if r.new_id not in taken_new and r.old_id not in taken_old:
                taken_new.add(r.new_id)
                taken_old.add(r.old_id)
                rows.append(r)
        return pd.DataFrame(rows, columns=table.columns)

    kept = able.select(scope, "new_id", "old_id", "similarity")
    return kept.groupBy(scope).applyInPandas(settle, kept.schema)


def best_match(pairs: DataFrame, least: float, margin: float) -> DataFrame:
    """new_id, old_id, similarity, lead: each new topic's best, if it reaches least and
    leads the second best by margin. Without a second, the lead is null and enough."""
    order = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id")
    ranked = pairs.withColumns({"_r": F.row_number().over(order), "lead": F.col("similarity") - F.lead("similarity").over(order)})
    return ranked.where((F.col("_r") == 1) & (F.col("similarity") >= least) & F.coalesce(F.col("lead") >= margin, F.lit(True))).select(
        "new_id", "old_id", "similarity", "lead"
    )


#: Topics that one task settles at most; a scope or registry with more is refused.
MOST_TOPICS = 100_000


def _few(topics: DataFrame) -> DataFrame:
    """topics, once it is sure that they are few enough for one task."""
    n = topics.count()
    if n > MOST_TOPICS:
        raise ValueError(f"{n} topics; ordered choices are made over {MOST_TOPICS} at most")
    return topics


def plan_merges(pairs: DataFrame, topics: DataFrame, scope: str, least: float, blocked: tuple = (), most_aliases: int = 0) -> DataFrame:
    """topic_id, into_id, similarity: pairs(a, b, similarity) of one scope, strongest
    first, the lesser topic into the larger, of two of one size a into b. A topic that was merged away takes no
    more, and one that has taken others isn't merged away: no chains. Blocked topics take
    no part. A topic holds at most ``most_aliases`` absorbed ids (0: any number), a merge
    bringing one and all that the lesser topic has. topics has topic_id, scope, size,
    protected (never merged away) and, if aliases are bounded, aliases (an array)."""
    held = F.size("aliases") if most_aliases else F.lit(0)
    meta = _few(topics).where(~F.col("topic_id").isin(*blocked) if blocked else F.lit(True)).select("topic_id", scope, "size", "protected", held.alias("ids"))
    side = lambda x: meta.select(F.col("topic_id").alias(x), *([scope] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "protected", "ids")])
    strong = pairs.where(F.col("similarity") >= least).select("a", "b", "similarity").join(side("a"), "a").join(side("b"), "b")
    schema = topics.select("topic_id", F.col("topic_id").alias("into_id"), F.lit(0.0).alias("similarity")).schema

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        gone, absorbers, gained, rows = set(), set(), {}, []
        for r in table.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            small_first = r.size_a <= r.size_b
            small, large, kept = (r.a, r.b, r.protected_a) if small_first else (r.b, r.a, r.protected_b)
            if kept or small in gone or large in gone or small in absorbers:
                continue
            more, own = (r.ids_a, r.ids_b) if small_first else (r.ids_b, r.ids_a)
            if most_aliases and own + gained.get(large, 0) + 1 + more > most_aliases:
                continue
            gained[large] = gained.get(large, 0) + 1 + more
            gone.add(small)
            absorbers.add(large)
            rows.append((small, large, r.similarity))
        return pd.DataFrame(rows, columns=["topic_id", "into_id", "similarity"])

    return strong.groupBy(scope).applyInPandas(settle, schema)


def consolidate(pairs: DataFrame, topics: DataFrame, capacity: int, least: float) -> DataFrame:
    """topic_id, into_id, similarity: merges of pairs(a, b, similarity), strongest first
    over all scopes, until no more than ``capacity`` topics of size over 0 are left. The
    lesser goes into the larger; a protected one is never merged away, and takes a larger
    one only if that is at most three times its size. No chains."""
    live = _few(topics.where("size > 0"))
    excess = live.count() - capacity
    side = lambda x: live.select(F.col("topic_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("protected").alias(f"protected_{x}"))
    strong = pairs.where((F.col("similarity") >= least) & F.lit(capacity > 0 and excess > 0)).join(side("a"), "a").join(side("b"), "b")
    schema = topics.select("topic_id", F.col("topic_id").alias("into_id"), F.lit(0.0).alias("similarity")).schema

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        gone, absorbers, rows = set(), set(), []
        for r in table.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            if len(rows) >= excess:
                break
            x, y = (r.a, r.size_a, r.protected_a), (r.b, r.size_b, r.protected_b)
            small, large = (y, x) if x[1] > y[1] else (x, y)
            if small[2]:
                if large[2]:
                    continue
                small, large = large, small
                if small[1] > 3 * large[1]:
                    continue
            if small[0] in gone or large[0] in gone or small[0] in absorbers:
                continue
            gone.add(small[0])
            absorbers.add(large[0])
            rows.append((small[0], large[0], r.similarity))
        return pd.DataFrame(rows, columns=["topic_id", "into_id", "similarity"])

    return strong.groupBy(F.lit(1).alias("_all")).applyInPandas(settle, schema)


def merge_duplicates(pairs: DataFrame, topics: DataFrame, scope: str, least: float) -> DataFrame:
    """topic_id, into_id: topics from the largest on; each goes into the first (largest)
    survivor of its scope that is similar enough, else it survives."""
    ends = pairs.where(F.col("similarity") >= least)
    ends = ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy("a").agg(F.collect_set("b").alias("near"))  # topics of one scope
    rows = _few(topics).select("topic_id", scope, "size").join(near.withColumnRenamed("a", "topic_id"), "topic_id")
    schema = topics.select("topic_id", F.col("topic_id").alias("into_id")).schema

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        survivors, out = [], []
        for r in table.sort_values(["size", "topic_id"], ascending=[False, True]).itertuples(index=False):
            near = set(r.near)
            into = next((s for s in survivors if s in near), None)
            if into is None:
                survivors.append(r.topic_id)
            else:
                out.append((r.topic_id, into))
        return pd.DataFrame(out, columns=["topic_id", "into_id"])

    return rows.groupBy(scope).applyInPandas(settle, schema)


def label_merges(topics: DataFrame, scope: str, key: str) -> DataFrame:
    """topic_id, into_id: topics of one scope under one key (a label, or its set of words)
    go into the largest, ties into the lesser id; empty and null keys don't count."""
    order = Window.partitionBy(scope, key).orderBy(F.desc("size"), "topic_id")
    rows = topics.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("into_id", F.first("topic_id").over(order))
    return rows.where("topic_id != into_id").select("topic_id", "into_id")


def id_floor(*registries: DataFrame) -> DataFrame:
    """One row: floor, the largest number that an id of any registry ends with, or 0."""
    ids = reduce(DataFrame.unionByName, [r.select(F.col("topic_id").cast("string")) for r in registries])
    number = F.try_to_number(F.regexp_extract("topic_id", "([0-9]{1,18})$", 1), F.lit("9" * 18)).cast("long")
    return ids.agg(F.coalesce(F.max(number), F.lit(0)).alias("floor"))


def sanitize(topics: DataFrame, end: Column) -> DataFrame:
    """Topics without times behind the end of the window: what is known too early goes."""
    return topics.withColumns({c: F.when(F.col(c) <= end, F.col(c)) for c in ("created_at", "last_seen")})


def carry_registry(topics: DataFrame, end: Column, most_days: int) -> DataFrame:
    """All topics as DORMANT with size 0, the size before as previous_size; topics last
    seen more than most_days before end go, and those never seen."""
    stays = F.datediff(end, F.col("last_seen")) <= most_days
    return topics.where(stays).withColumn("previous_size", F.col("size")).withColumns({"size": F.lit(0).cast("long"), "status": F.lit("DORMANT")})


def retire_idle(topics: DataFrame, active: DataFrame, scope: str, pool: str) -> DataFrame:
    """Topics without those of size 0 whose scope was active, or that are the pool's."""
    gone = topics.where("size = 0").join(active.select(scope).distinct(), scope, "left_semi").unionByName(topics.where((F.col("size") == 0) & (F.col(scope) == pool)).select(scope, *[c for c in topics.columns if c != scope]))
    return topics.join(gone.select("topic_id").distinct(), "topic_id", "left_anti")


def candidate_pool(buffer: DataFrame, fresh: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """Buffered and fresh leftovers of the last days before the latest, one row for each
    key: the latest, fresh before buffered."""
    both = buffer.withColumn("_f", F.lit(0)).unionByName(fresh.withColumn("_f", F.lit(1)))
    end = F.broadcast(both.agg(F.max(time).alias("_end")))  # one row
    inside = both.crossJoin(end).where(F.col(time) >= F.col("_end") - F.make_dt_interval(F.lit(days))).drop("_end")
    names = [c for c in buffer.columns if c != key]
    return inside.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_f", time)).alias("_r")).select(key, "_r.*")


def stabilise(new: DataFrame, old: DataFrame, matches: DataFrame, end: Column, most_days: int, keep_label: float = 0.92) -> DataFrame:
    """The registry of a run: new topics matched with old ones (new_id, old_id,
    similarity) take the old id, created_at and aliases, and from keep_label on the label;
    others get ids above all old ones, in order. Old topics without a match are carried
    as DORMANT with size 0, unless last seen more than most_days before end. All have
    topic_id (long), label, created_at, last_seen, size and aliases."""
    kept = old.select(F.col("topic_id").alias("old_id"), F.col("label").alias("_label"), F.col("created_at").alias("_created"), F.col("aliases").alias("_aliases"))
    rows = new.join(matches.select(F.col("new_id").alias("topic_id"), "old_id", "similarity"), "topic_id", "left").join(kept, "old_id", "left")
    order = F.row_number().over(Window.partitionBy(F.col("old_id").isNull()).orderBy("topic_id"))
    floor = F.broadcast(old.agg(F.coalesce(F.max("topic_id"), F.lit(0)).alias("_floor")))  # one row
    live = rows.crossJoin(floor).select(
        F.coalesce("old_id", F.col("_floor") + order).alias("topic_id"), F.when(F.col("similarity") >= keep_label, F.coalesce("_label", "label")).otherwise(F.col("label")).alias("label"),
        F.least("_created", "created_at").alias("created_at"), "last_seen", "size", F.coalesce("_aliases", "aliases").alias("aliases"), F.lit("ACTIVE").alias("status"),
    )
    idle = old.join(matches.select(F.col("old_id").alias("topic_id")), "topic_id", "left_anti").where(F.datediff(end, F.col("last_seen")) <= most_days)
    idle = idle.select("topic_id", "label", "created_at", "last_seen", F.lit(0).cast(new.schema["size"].dataType).alias("size"), "aliases", F.lit("DORMANT").alias("status"))
    return live.unionByName(idle)


def remap(assignments: DataFrame, plan: DataFrame, *key: str) -> DataFrame:
    """Assignments under the topics that theirs went into; one row for each key and topic."""
    moved = assignments.join(plan.select("topic_id", "into_id"), "topic_id", "left")
    return moved.withColumn("topic_id", F.coalesce("into_id", "topic_id")).drop("into_id").dropDuplicates([*key, "topic_id"])


def merge_topics(topics: DataFrame, plan: DataFrame) -> DataFrame:
    """topic_id, size, created_at, centroid, aliases after the merges: sizes summed, the
    earliest created_at, the centroid weighted by sizes of at least 1, and as aliases the
    ids merged in with their own aliases, in order."""
    into = topics.join(plan.select("topic_id", "into_id"), "topic_id", "left").withColumn("_t", F.coalesce("into_id", "topic_id"))
    gone = F.col("into_id").isNotNull()
    ids = F.when(gone, F.concat(F.array(F.col("topic_id").cast("string")), "aliases")).otherwise(F.col("aliases"))
    weight = F.greatest("size", F.lit(1))
    parts = into.select("_t", weight.alias("_w"), F.posexplode("centroid").alias("_at", "_x")).groupBy("_t", "_at").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    centre = parts.groupBy("_t").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"])).alias("centroid"))
    rows = into.groupBy("_t").agg(F.sum("size").alias("size"), F.min("created_at").alias("created_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias("aliases"))
    return rows.join(centre, "_t").select(F.col("_t").alias("topic_id"), "size", "created_at", "centroid", "aliases")


def age_registry(topics: DataFrame, live: DataFrame, end, most_days: int) -> DataFrame:
    """topic_id, last_seen, size, status: topics with live rows (topic_id, size,
    last_seen) are ACTIVE; others are DORMANT with size 0, and go once last_seen is more
    than most_days before end (a column or literal)."""
    now = live.select("topic_id", F.col("size").alias("_size"), F.col("last_seen").alias("_seen"))
    rows = topics.select("topic_id", "last_seen").join(now, "topic_id", "left").select(
        "topic_id", F.greatest("last_seen", "_seen").alias("last_seen"), F.coalesce("_size", F.lit(0)).cast("long").alias("size")
    )
    status = F.when(F.col("size") > 0, "ACTIVE").otherwise("DORMANT")
    stays = (F.col("size") > 0) | (F.datediff(end, F.col("last_seen")) <= most_days)
    return rows.where(stays).withColumn("status", status)


def flag_topics(topics: DataFrame, veto: float = 0.1) -> DataFrame:
    """Adds is_junk with junk_reason, is_residual, is_campaign and suppressed to topics
    with term_ratio, empty_ratio, ack_ratio, duplicate_ratio, coherence, size and
    substantive (a judgement or null). A coherence at or over veto clears the first two
    reasons for junk; a topic judged not substantive is suppressed too."""
    coherent = F.coalesce(F.col("coherence") >= veto, F.lit(False))
    reasons = F.concat_ws(
        ";", F.when((F.col("term_ratio") >= 0.6) & ~coherent, "ack_terms"), F.when((F.col("empty_ratio") >= 0.5) & ~coherent, "empty_members"),
        F.when((F.col("coherence") < -0.05) & (F.col("size") >= 30), "incoherent"),
    )
    residual = (F.col("ack_ratio") >= 0.4) | (F.col("coherence") < 0)
    no = F.lit(False)
    flags = {"junk_reason": reasons, "is_residual": F.coalesce(residual, no), "is_campaign": F.coalesce((F.col("size") >= 10) & (F.col("duplicate_ratio") >= 0.25), no)}
    rows = topics.withColumns(flags).withColumn("is_junk", F.col("junk_reason") != "")
    return rows.withColumn("suppressed", F.col("is_junk") | F.col("is_residual") | F.col("is_campaign") | F.col("substantive").eqNullSafe(F.lit(False)))


def dedupe_ids(topics: DataFrame, members: DataFrame, scope: str, record: str) -> DataFrame:
    """One row for each topic_id: first the one whose scope most of its members' distinct
    records have, then the larger, then the lesser scope (none is the last)."""
    n = members.select("topic_id", scope, record).dropDuplicates(["topic_id", record]).groupBy("topic_id", scope).agg(F.count("*").alias("_n"))
    top = n.withColumn("_r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("_n"), F.asc_nulls_last(scope)))).where("_r = 1")
    rows = topics.join(top.select("topic_id", F.col(scope).alias("_main")), "topic_id", "left")
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.coalesce(F.col(scope) == F.col("_main"), F.lit(False))), F.desc("size"), F.asc_nulls_last(scope))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_main")


def final_targets(plan: DataFrame) -> DataFrame:
    """topic_id, into_id of merges one after the other (a into b, later b into c): where
    each merged topic's rows are in the end. A topic that is part of a circle stays put."""
    last = stored(plan.select("topic_id", "into_id").dropDuplicates(["topic_id"]))
    for _ in range(64):  # each round doubles the steps
        onward = last.select(F.col("topic_id").alias("into_id"), F.col("into_id").alias("_next"))
        step = stored(last.join(onward, "into_id", "left").select("topic_id", F.coalesce("_next", "into_id").alias("into_id"), F.col("_next").isNotNull().alias("_moved")).where("topic_id != into_id"))
        last = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            break
    return last


def carry_decisions(history: DataFrame, previous: DataFrame, topics: DataFrame, plan: DataFrame, key: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """What earlier batches decided about the history's segments (previous: key, topic_id,
    similarity, assignment_type), and the segments they never saw. Topics that have been
    merged since, along chains too, are re-pointed; a topic that is gone goes, and a
    segment of which nothing is left has one row UNASSIGNED. A segment and topic come once:
    as the more similar of what became one."""
    kept = history.select(key).distinct()
    old = previous.join(kept, key, "left_semi").join(final_targets(plan), "topic_id", "left")
    old = old.withColumn("topic_id", F.coalesce("into_id", "topic_id")).drop("into_id")
    live = old.join(topics.select("topic_id").distinct(), "topic_id", "left_semi")
    one = live.groupBy(key, "topic_id").agg(F.max_by(F.struct("similarity", "assignment_type"), F.struct("similarity", "assignment_type")).alias("_r")).select(key, "topic_id", "_r.*")
    lost = old.select(key).distinct().join(one.select(key), key, "left_anti")
    none = lost.select(key, F.lit(None).cast(one.schema["topic_id"].dataType).alias("topic_id"), F.lit(None).cast("double").alias("similarity"), F.lit("UNASSIGNED").alias("assignment_type"))
    return one.unionByName(none), history.join(previous.select(key).distinct(), key, "left_anti")


def update_centroids(topics: DataFrame, members: DataFrame, vector: str, relabel_below: float = 0.0) -> DataFrame:
    """topics (topic_id, centroid, previous_size, label_source and others) with the members
    filed under them first (topic_id, a vector) folded in: the old centroid counts
    previous_size times, once at least, each member once, all of unit length. A carried
    label whose topic moved below relabel_below from where it was is marked stale."""
    places = members.where("topic_id is not null").select("topic_id", F.posexplode(unit(F.col(vector))).alias("_at", "_x"))
    sums = places.groupBy("topic_id", "_at").agg(F.sum("_x").alias("_x")).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_l"))
    sums = sums.select("topic_id", F.transform("_l", lambda s: s["_x"]).alias("_sum"))
    old, weight = unit(F.col("centroid")), F.greatest(F.coalesce("previous_size", F.lit(0)), F.lit(1))
    rows = topics.join(sums, "topic_id", "left").withColumn("_new", F.when(F.col("_sum").isNotNull(), unit(F.zip_with(old, "_sum", lambda x, y: x * weight + y))))
    stale = (F.lit(relabel_below) > 0) & (dot(old, F.col("_new")) < relabel_below) & (F.col("label_source") == "llm_carried")
    return rows.withColumns({"label_source": F.when(F.coalesce(stale, F.lit(False)), "llm_stale").otherwise(F.col("label_source")), "centroid": F.coalesce("_new", F.transform("centroid", lambda x: x.cast("double")))}).drop("_sum", "_new")


def with_metrics(topics: DataFrame, hot: DataFrame) -> DataFrame:
    """topics with the measures of hot (by topic_id); those that topics has under the same
    name come as name_hot. In the order of the final report: suppressed and junk last, the
    hottest first."""
    clash = [c for c in hot.columns if c != "topic_id" and c in topics.columns]
    rows = topics.join(hot.withColumnsRenamed({c: f"{c}_hot" for c in clash}), "topic_id", "left")
    flags = [F.col(c).asc() for c in ("suppressed", "is_junk") if c in rows.columns]
    return rows.orderBy(*flags, F.desc("hot_score"), F.desc("recent_volume"), "topic_id")


def make_topics(members: DataFrame, topic: str, record: str, vector: str, time: str, labels: DataFrame | None = None) -> DataFrame:
    """topic, centroid, size (distinct records), first_seen, last_seen and, of labels (topic,
    label), the label of every topic with members. The sums go by topic and place."""
    rows = members.where(F.col(topic).isNotNull())
    seen = rows.groupBy(topic).agg(F.countDistinct(record).alias("size"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    out = centroids(rows.where(F.col(vector).isNotNull()), topic, vector).drop("size").join(seen, topic)
    return out if labels is None else out.join(labels.select(topic, "label"), topic, "left")
