"""Filing new segments against a carried registry: clear cases by similarity, the rest by
questions to a decision model that the caller brings.

    gates()      best and runner-up of each segment, and what is to be done with it
    questions()  for those to ask: up to a dozen topics in the registry's order, two exits
    packs()      questions put together into calls of bounded size
    decide()     the calls, made in tasks; too many unanswered ones fail the batch
    file()       one row for each segment and topic, with how it came about
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trendloom.operators.matching import assign_topics
from trendloom.sources.stored import stored

#: The exits of a question.
OTHER, NO_ISSUE = "other", "no_issue"
UNCLEAR = "Unclear topic"
#: Topics of a question; questions and distinct topics of a call; words of an option.
SHORTLIST, POSTS, OPTIONS, WORDS, TEXT = 12, 20, 40, 12, 1000
#: Share of unanswered questions over which a batch fails.
MOST_UNANSWERED = 0.05

#: One call: (scope, {topic: option}, [(text, [topics])]) to (choice, confidence, {topic:
#: probability}) or None for each text, in order.
Client = Callable[[str, dict[str, str], list[tuple[str, list[str]]]], list[tuple[str, float, dict[str, float]] | None]]


def eligible(keep_suppressed: bool = False) -> Column:
    """Topics that may be offered: not suppressed and named."""
    return F.lit(True) if keep_suppressed else ~F.coalesce("suppressed", F.lit(False)) & (F.coalesce("label", F.lit("")) != UNCLEAR)


def option_words(most: int = WORDS) -> Column:
    """The first words of a label with its description, or else its keywords, after a colon."""
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    more = F.when(F.size(words(F.col("description"))) > 0, words(F.col("description"))).otherwise(F.coalesce("keywords", F.array().cast("array<string>")))
    every = F.when(F.size(more) > 0, F.concat(words(F.col("label")), F.array(F.lit(":")), more)).otherwise(words(F.col("label")))
    return F.replace(F.array_join(F.slice(every, 1, max(3, most)), " "), F.lit(" :"), F.lit(":"))


def gates(segments: DataFrame, topics: DataFrame, key: str, vector: str, scope: str, mode: str = "hybrid", high: float = 0.50, low: float = 0.30, margin: float = 0.05, k: int = 2, keep_suppressed: bool = False, pools: tuple[str, ...] = ("__POOL__",)) -> tuple[DataFrame, DataFrame]:
    """A written table key, near (up to max(2, k) structs topic_id, similarity, best first),
    best, gate, and one key, topic_id, similarity of the shortlists. In hybrid mode a
    segment is clear if its best reaches high and leads the second (-1 without one) by
    margin, and a miss if it is under low; in mode ask, none is. A segment without a topic
    in its scope is none; all others with an eligible topic are to ask. Keys are unique."""
    top = assign_topics(segments, topics, key, vector, -2.0, k=max(2, k), margin=4.0, scope=scope, pools=pools).where("topic_id is not null")
    near = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "topic_id", "similarity"))).alias("_n"))  # k at most
    rows = segments.select(key).join(near, key, "left").select(key, F.coalesce(F.transform("_n", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["similarity"].alias("similarity"))), F.array().cast(f"array<struct<topic_id:{topics.schema['topic_id'].dataType.simpleString()},similarity:double>>")).alias("near"))
    may = topics.where(eligible(keep_suppressed))
    short = stored(assign_topics(segments, may, key, vector, -2.0, k=SHORTLIST, margin=4.0, scope=scope, pools=pools).where("topic_id is not null").select(key, "topic_id", "similarity"))
    best, second = F.coalesce(F.get("near", F.lit(0))["similarity"], F.lit(-1.0)), F.coalesce(F.get("near", F.lit(1))["similarity"], F.lit(-1.0))
    clear = (best >= high) & (best - second >= margin) if mode == "hybrid" else F.lit(False)
    miss = (best < low) if mode == "hybrid" else F.lit(False)
    kind = F.when(F.size("near") == 0, "none").when(clear, "clear").when(miss, "miss").when(F.col("_short"), "ask").otherwise("none")
    rows = rows.join(short.select(key).distinct().withColumn("_short", F.lit(True)), key, "left").withColumn("_short", F.coalesce("_short", F.lit(False)))
    return stored(rows.select(key, "near", best.alias("best"), kind.alias("gate"))), short


def questions(gated: DataFrame, short: DataFrame, segments: DataFrame, topics: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """key, scope, text (its first characters), options: topic (text) to option, in the
    order of topic_id, of the segments to ask."""
    named = topics.select("topic_id", option_words().alias("_option"))
    lists = short.join(gated.where("gate = 'ask'").select(key), key, "left_semi").join(named, "topic_id")
    lists = lists.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("topic_id", "_option"))).alias("_o"))  # SHORTLIST at most
    options = F.map_from_entries(F.transform("_o", lambda x: F.struct(x["topic_id"].cast("string"), x["_option"])))
    return segments.select(key, F.col(scope).cast("string").alias("scope"), F.substring(F.coalesce(text, F.lit("")), 1, TEXT).alias("text")).join(lists, key).select(key, "scope", "text", options.alias("options"))


def packs(asked: DataFrame, key: str, posts: int = POSTS, options: int = OPTIONS) -> DataFrame:
    """scope, options, posts (structs of key, text, topics): calls of one scope with at
    most ``posts`` questions and at most ``options`` distinct topics, unless one question
    alone has more. Questions of like topics stand together: they are sorted by ranges, and
    each range is cut where it grows too large."""
    keys = F.array_join(F.map_keys("options"), "\x01")
    rows = asked.withColumn("_order", keys).repartitionByRange("scope", "_order", key).sortWithinPartitions("scope", "_order", key)
    kind = asked.schema[key].dataType.simpleString()

    def cut(batches):
        held: dict = {"scope": None, "options": {}, "posts": []}

        def full():
            return pa.RecordBatch.from_pylist([{"scope": held["scope"], "options": list(held["options"].items()), "posts": held["posts"]}], schema)

        for batch in batches:
            schema = pa.schema([("scope", pa.string()), ("options", pa.map_(pa.string(), pa.string())), ("posts", pa.list_(pa.struct([("key", batch.schema.field(key).type), ("text", pa.string()), ("topics", pa.list_(pa.string()))])))])
            for row in batch.select([key, "scope", "text", "options"]).to_pylist():
                own = dict(row["options"])
                if held["posts"] and (row["scope"] != held["scope"] or len(held["posts"]) >= posts or len({*held["options"], *own}) > options):
                    yield full()
                    held.update(options={}, posts=[])
                held["scope"] = row["scope"]
                held["options"].update(own)
                held["posts"].append({"key": row[key], "text": row["text"], "topics": list(own)})
        if held["posts"]:
            yield full()

    return rows.mapInArrow(cut, f"scope string, options map<string,string>, posts array<struct<key:{kind},text:string,topics:array<string>>>")


def decide(calls: DataFrame, key: str, client: Callable[[], Client], most_unanswered: float = MOST_UNANSWERED) -> DataFrame:
    """A written table key, choice, confidence, chances (topic to probability); nulls where
    the client gave no answer, failed, or chose what wasn't offered to that question.
    client() is called once in each task. If more than most_unanswered of all questions
    are unanswered, the batch fails."""
    kind = calls.schema["posts"].dataType.elementType["key"].dataType.simpleString()

    def ask(batches):
        call = client()
        for batch in batches:
            out = []
            for pack in batch.to_pylist():
                posts = pack["posts"]
                try:
                    answers = list(call(pack["scope"], dict(pack["options"]), [(p["text"], p["topics"]) for p in posts]))
                except Exception:  # noqa: BLE001  whatever a service throws is a missing answer, and is counted
                    answers = []
                for p, a in zip(posts, [*answers, *[None] * len(posts)]):
                    offered = {*p["topics"], OTHER, NO_ISSUE}
                    choice, confidence, chances = a if a and a[0] in offered else (None, None, {})
                    sure = None if confidence is None else min(1.0, max(0.0, float(confidence)))
                    out.append({key: p["key"], "choice": choice, "confidence": sure, "chances": [(t, float(c)) for t, c in chances.items() if t in p["topics"]]})
            fields = [(key, batch.schema.field("posts").type.value_type.field("key").type), ("choice", pa.string()), ("confidence", pa.float64()), ("chances", pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    seen = Observation()
    answered = calls.mapInArrow(ask, f"{key} {kind}, choice string, confidence double, chances map<string,double>")
    out = stored(answered.observe(seen, F.count("*").alias("asked"), F.count_if(F.col("choice").isNull()).alias("unanswered")))
    asked, unanswered = seen.get["asked"], seen.get["unanswered"]
    if unanswered > most_unanswered * asked:
        raise RuntimeError(f"{unanswered} of {asked} questions are unanswered")
    return out


def file(gated: DataFrame, short: DataFrame, answers: DataFrame, key: str, least: float = 0.25, confident: float = 0.5, second: float = 0.3, k: int = 2) -> DataFrame:
    """key, topic_id, similarity, assignment_type, confidence, primary. A clear segment has
    up to k topics that reach least (EXISTING), as has one whose question wasn't answered
    (EXISTING_FALLBACK); an answered one has the chosen topic if it is confident enough, and
    further ones that are likely enough (DECIDED). All others have one row without a topic:
    UNASSIGNED, DECIDED_OTHER, DECIDED_NO_ISSUE or DECIDED_UNSURE."""
    topic = gated.schema["near"].dataType.elementType["topic_id"].dataType.simpleString()
    rows = gated.join(answers, key, "left")
    sims = short.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("topic_id").cast("string"), "similarity"))).alias("_sims"))
    rows = rows.join(sims, key, "left")
    row = lambda t, s, kind, c: F.struct(t.cast(topic).alias("topic_id"), s.alias("similarity"), F.lit(kind).alias("assignment_type"), c.alias("confidence"))
    none, nothing = F.lit(None), F.lit(None).cast("double")
    alone = lambda kind, c=nothing: F.array(row(none, F.col("best"), kind, c))

    def similar(kind: str) -> Column:
        good = F.transform(F.filter(F.slice("near", 1, k), lambda x: x["similarity"] >= least), lambda x: row(x["topic_id"], x["similarity"], kind, nothing))
        return F.when(F.size(good) > 0, good).otherwise(alone("UNASSIGNED"))

    chosen = F.array(row(F.col("choice"), F.element_at("_sims", F.col("choice")), "DECIDED", F.col("confidence")))
    others = F.transform(F.filter(F.map_entries("chances"), lambda e: (e["key"] != F.col("choice")) & (e["value"] >= second)), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("t")))
    others = F.transform(F.slice(F.array_sort(others), 1, max(k - 1, 1)), lambda o: row(o["t"], F.element_at("_sims", o["t"]), "DECIDED", -o["c"]))
    decided = F.concat(chosen, others) if k > 1 else chosen
    answer = (
        F.when(F.col("choice").isNull(), similar("EXISTING_FALLBACK")).when(F.col("choice") == NO_ISSUE, alone("DECIDED_NO_ISSUE", F.col("confidence")))
        .when(F.col("choice") == OTHER, alone("DECIDED_OTHER", F.col("confidence"))).when(F.col("confidence") < confident, alone("DECIDED_UNSURE", F.col("confidence"))).otherwise(decided)
    )
    every = F.when(F.col("gate") == "clear", similar("EXISTING")).when(F.col("gate") == "ask", answer).otherwise(alone("UNASSIGNED"))
    return rows.select(key, F.posexplode(every).alias("_p", "x")).select(key, "x.*", (F.col("_p") == 0).alias("primary"))


def assign_incremental(segments: DataFrame, topics: DataFrame, key: str, vector: str, scope: str, text: str, client: Callable[[], Client], mode: str = "hybrid", high: float = 0.50, low: float = 0.30, margin: float = 0.05, least: float = 0.25, confident: float = 0.5, second: float = 0.3, k: int = 2, most_unanswered: float = MOST_UNANSWERED) -> DataFrame:
    """gates(), questions(), packs(), decide() and file() in a row. topics has topic_id,
    centroid, the scope, label, description, keywords and suppressed. An empty registry
    leaves all segments unassigned."""
    gated, short = gates(segments, topics, key, vector, scope, mode, high, low, margin, k)
    asked = questions(gated, short, segments, topics, key, scope, text)
    return file(gated, short, decide(packs(asked, key), key, client, most_unanswered), key, least, confident, second, k)
