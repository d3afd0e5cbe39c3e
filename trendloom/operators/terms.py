"""Terms of topics: frequencies, class-based TF-IDF, coherence, duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.text import is_noise_term, near_duplicate_key
from trendloom.sources.stored import stored

WORD = r"\p{L}{3,}"
#: Characters of the words of grams, as the SQL has them, for patterns of Java and of Arrow.
LETTERS = r"\p{L}\p{N}\p{M}_"


def words(docs: DataFrame, text: str, *keep: str, once: bool = False) -> DataFrame:
    """keep columns and term, one row for each word of the text, or (once) each
    different one."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    # Outer: Spark would else look whether there are words by finding them all before.
    return docs.select(*keep, F.explode_outer(F.array_distinct(found) if once else found).alias("term")).where("term is not null")


def top_terms(docs: DataFrame, topic: str, doc: str, text: str, most: int = 10) -> DataFrame:
    """topic, term, df, rank by document frequency; ties go by the term. Where no topic has
    a document on several rows, as ids tell beforehand, a row's words need no comparing
    with other rows."""
    once = docs.agg(F.count("*").alias("n"), F.countDistinct(F.struct(topic, doc)).alias("d")).first()
    found = words(docs, text, topic, doc, once=True)
    df = (found if once["n"] == once["d"] else found.distinct()).groupBy(topic, "term").agg(F.count("*").alias("df"))
    order = Window.partitionBy(topic).orderBy(F.desc("df"), "term")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def class_tfidf(docs: DataFrame, topic: str, text: str, most: int = 5) -> DataFrame:
    """topic, term, score, rank: share of the topic's words times ln(1 + topics / topics
    that have the term)."""
    tf = stored(words(docs, text, topic).groupBy(topic, "term").agg(F.count("*").alias("n")))  # used three times
    total = tf.groupBy(topic).agg(F.sum("n").alias("total"))
    df = F.count("*").over(Window.partitionBy("term"))  # a row for each topic
    topics = F.broadcast(total.agg(F.count("*").alias("topics")))
    scored = tf.withColumn("df", df).join(total, topic).crossJoin(topics)
    scored = scored.select(topic, "term", F.round(F.col("n") / F.col("total") * F.log1p(F.col("topics") / F.col("df")), 9).alias("score"))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def grams(text: Column, stop: tuple[str, ...], form: str = f"[{LETTERS}]{{2,}}") -> Column:
    """Words of a text without stop words, then pairs of neighbours among them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(form), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*stop)) if stop else found
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return F.element_at(F.transform(F.array(kept), lambda w: F.concat(w, pairs(w))), 1)


#: Terms that a task holds counts of before it sends them on; terms that tasks are sent; bytes of text read at once.
HELD_TERMS, SENT_TERMS, PIECE_BYTES = 1_000_000, 200_000, 4 << 20


def _worded(docs: DataFrame, topic: str, text: Column, *keep: str) -> DataFrame:
    """topic, keep columns and _w: each text in lower case, with a space for all between words."""
    low = docs.select(topic, *keep, F.lower(F.coalesce(text, F.lit(""))).alias("_w"))

    def run(batches):
        for piece in _pieces(batches, PIECE_BYTES):
            yield piece.set_column(piece.schema.get_field_index("_w"), "_w", pc.replace_substring_regex(piece.column("_w"), f"[^{LETTERS}]+", " "))

    return low.mapInArrow(run, low.schema)


def _pieces(batches, size: int):
    """The batches' rows, about size bytes of text at once."""
    for batch in batches:
        ends, lo = np.cumsum(pc.binary_length(batch.column("_w")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _spelled(piece: pa.RecordBatch, stop: tuple[str, ...], vocabulary: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each word that isn't a stop word, in order, and the words by
    number: the vocabulary, or else those of the piece. The number is -1 where one text
    of a row ends (at a line feed), and for words outside the vocabulary."""
    lists = pc.split_pattern(pc.replace_substring(piece.column("_w"), "\n", " \n "), " ")
    coded = lists.flatten().dictionary_encode()
    here, found = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    ends, long = pc.equal(here, "\n").to_numpy(zero_copy_only=False), pc.greater(pc.utf8_length(here), 1).to_numpy(zero_copy_only=False)
    stays = (ends | long & ~pc.is_in(here, value_set=pa.array(stop, here.type)).to_numpy(zero_copy_only=False))[found]
    row, found = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[stays], found[stays]
    if vocabulary is None:
        number = np.where(ends, -1, np.arange(len(here)))
    else:
        number = pc.fill_null(pc.index_in(here, value_set=vocabulary.cast(here.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return row, number[found], here if vocabulary is None else vocabulary


def _neighbours(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of words that a word of the same text follows."""
    return np.flatnonzero((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))


def _numbers(piece: pa.RecordBatch, keys: list[str], known: dict) -> tuple[np.ndarray, list[int]]:
    """A number for each row's keys, as known (which is added to), and the first rows of new ones."""
    before, new, out = len(known), [], np.empty(piece.num_rows, np.int64)
    for i, name in enumerate(zip(*[piece.column(k).to_pylist() for k in keys])):
        out[i] = known.setdefault(name, len(known))
        if len(known) > before:
            before += 1
            new.append(i)
    return out, new


def _places(found: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of what was found among sorted numbers; -1 for others."""
    if not len(among):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(among, found), len(among) - 1)
    return np.where(among[at] == found, at, -1)


def gram_counts(docs: DataFrame, keys: list[str], stop: tuple[str, ...], pairs: bool, wanted: dict | None = None) -> DataFrame:
    """keys, term, n, df: under each key, the number of every word, or of every pair of
    neighbours both of which are wanted (by keys; under None, of all others; null: all),
    and of the rows (keys, _w) that have it. Words have a row of a null term too: n of
    all words and pairs. Tasks count what they read, by numbers of words; what they
    counted is added up."""
    coded = pairs and wanted is not None
    vocabulary = sorted(set().union(*wanted.values())) if coded else None
    place = {w: i for i, w in enumerate(vocabulary or ())}
    lots = {name: i for i, name in enumerate(wanted)} if coded else {}
    allowed = np.sort(np.array([lots[name] * len(place) + place[w] for name in lots for w in wanted[name]], np.int64))

    def run(batches):
        spelling = pa.array(vocabulary, pa.string()) if coded else None
        known, seen, lot, held = {}, [], np.empty(0, np.int64), []

        def told():
            whole = pa.concat_tables(held)
            t, own = whole.column("t").combine_chunks(), pa.Table.from_batches(seen).take(whole.column("g"))
            if coded:
                one, two = np.divmod(t.to_numpy(zero_copy_only=False), max(len(spelling), 1))
                t = pc.binary_join_element_wise(spelling.take(pa.array(one)), spelling.take(pa.array(two)), " ")
            known.clear(), seen.clear(), held.clear()
            table = pa.table([*own.columns, t, whole.column("n"), whole.column("df")], names=[*keys, "term", "n", "df"])
            yield from table.to_batches(max_chunksize=1 << 16)

        for piece in _pieces(batches, PIECE_BYTES):
            group, new = _numbers(piece, keys, known)
            if new:
                seen.append(piece.select(keys).take(pa.array(new, pa.int64())))
            row, word, spelt = _spelled(piece, stop, spelling)
            if coded:
                lot = np.array([lots.get(name, lots.get(None, -1)) for name in known], np.int64)[group]
                word = np.where((word >= 0) & (lot[row] >= 0) & (_places(lot[row] * len(spelt) + word, allowed) >= 0), word, -1)
            at = _neighbours(row, word)
            if pairs:
                row, code, span = row[at], word[at] * len(spelt) + word[at + 1], len(spelt) ** 2
            else:
                every = np.bincount(group[row[word >= 0]], minlength=len(known)) + np.bincount(group[row[at]], minlength=len(known))
                row, code, span = row[word >= 0], word[word >= 0], len(spelt)
            own, n = np.unique(row * span + code, return_counts=True)  # of each row
            row, code = np.divmod(own, max(span, 1))
            code += group[row] * span
            order = np.argsort(code)
            code, n = code[order], n[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            g, code = np.divmod(code[first], max(span, 1))
            n, df = np.add.reduceat(n, first) if len(n) else n, np.diff(first, append=len(n))
            if coded:
                t = pa.array(code)
            elif pairs:
                one, two = np.divmod(code, max(len(spelt), 1))
                t = pc.binary_join_element_wise(spelt.take(pa.array(one)), spelt.take(pa.array(two)), " ")
            else:
                t = spelt.take(pa.array(code))
                g, n, df = np.append(g, np.arange(len(known))), np.append(n, every), np.append(df, np.zeros(len(known), np.int64))
                t = pa.concat_arrays([t, pa.nulls(len(known), t.type)])
            held.append(pa.table({"g": g, "t": t, "n": n, "df": df}))
            if sum(len(h) for h in held) > HELD_TERMS:
                held[:] = [_added(held)]
                if len(held[0]) > HELD_TERMS // 2:
                    yield from told()
        if held:
            held[:] = [_added(held)]
            yield from told()

    named = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    counted = docs.select(*keys, "_w").mapInArrow(run, f"{named}, term string, n long, df long")
    return counted.groupBy(*keys, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by(["g", "t"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["g", "t", "n", "df"])


def _sent(rows: DataFrame) -> list | None:
    """The rows, if there are SENT_TERMS at most."""
    found = rows.limit(SENT_TERMS + 1).collect()
    return found if len(found) <= SENT_TERMS else None


def tfidf_terms(docs: DataFrame, topic: str, doc: str, text: str, stop: tuple[str, ...], most: int = 5, features: int = 1000) -> DataFrame:
    """topic, term, score, rank: mean TF-IDF over the topic's documents of words and
    pairs; of each topic, only its ``features`` most frequent ones. Every document's
    vector has unit length; idf is ln((1 + n) / (1 + df)) + 1 within the topic. A pair is
    no more frequent than its words, so only pairs of words that are as frequent as the
    last feature among words are counted."""
    size = docs.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("docs"), F.countDistinct(doc).alias("_d"), F.count(doc).alias("_n"))
    topics = _sent(size)
    if topics is None or len(topics) * features > SENT_TERMS:
        return _tfidf_joined(docs, topic, doc, text, stop, most, features)
    rows = _worded(docs.where(F.col(topic).isNotNull() & F.col(doc).isNotNull()), topic, F.col(text), doc)
    if any(r["_d"] != r["_n"] for r in topics):  # a document on several rows: of one document, all texts
        rows = rows.groupBy(topic, doc).agg(F.array_join(F.collect_list("_w"), "\n").alias("_w"))
    rows = stored(rows.select(topic, "_w"))  # texts are read and cut into words once, not for each of three passes
    size = F.broadcast(docs.sparkSession.createDataFrame(topics, size.schema).select(topic, "docs"))
    order = Window.partitionBy(topic).orderBy(F.desc("n"), "term")
    top = lambda t: t.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= features)
    words = stored(gram_counts(rows, [topic], stop, False).where("term is not null"))
    first = stored(top(words))
    least = first.groupBy(topic).agg(F.when(F.count("*") >= features, F.min("n")).otherwise(0).alias("_least"))
    often = _sent(words.join(least, topic).where("n >= _least").select(F.col(topic).alias("t"), "term"))
    by: dict = {}
    for r in often or []:
        by.setdefault((r["t"],), set()).add(r["term"])
    pairs = gram_counts(rows, [topic], stop, True, None if often is None else by)
    pairs = pairs.join(F.broadcast(least), topic).where("n >= _least").drop("_least")  # others come after all of the first
    idf = (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")
    chosen = top(first.drop("_r").unionByName(pairs)).join(size, topic).select(F.col(topic).alias("t"), "term", idf).collect()  # at most SENT_TERMS
    vocabulary = sorted({w for r in chosen for w in r["term"].split(" ")})
    place, lots = {w: i for i, w in enumerate(vocabulary)}, {}
    codes: tuple[list, list] = ([], [])  # of words and of pairs: topic and words in one number, which feature
    for i, r in enumerate(chosen):
        at = [place[w] for w in r["term"].split(" ")]
        t = lots.setdefault((r["t"],), len(lots))
        codes[len(at) - 1].append((t * len(place) + at[0] if len(at) == 1 else (t * len(place) + at[0]) * len(place) + at[1], i))
    sought = [np.array(sorted(c), np.int64).reshape(-1, 2).T for c in codes]
    weight, terms, of = np.array([r["idf"] for r in chosen], float), [r["term"] for r in chosen], np.array([lots[(r["t"],)] for r in chosen], np.int64)

    def run(batches):
        spelling, known, names, sums = pa.array(vocabulary, pa.string()), dict(lots), {}, np.zeros(len(terms))
        for piece in _pieces(batches, PIECE_BYTES):
            group, _ = _numbers(piece, [topic], known)
            for g, i in zip(*np.unique(group, return_index=True)):
                names.setdefault(int(g), piece.column(topic).slice(int(i), 1))
            row, word, _ = _spelled(piece, stop, spelling)
            code, at, mine = group[row] * len(spelling) + word, _neighbours(row, word), []
            for of_row, found, (among, feature) in ((row[word >= 0], code[word >= 0], sought[0]), (row[at], code[at] * len(spelling) + word[at + 1], sought[1])):
                there = _places(found, among)
                mine.append(of_row[there >= 0] * len(terms) + feature[there[there >= 0]])
            own, n = np.unique(np.concatenate(mine), return_counts=True)
            row, feature = np.divmod(own, max(len(terms), 1))
            w = n * weight[feature]
            norm = np.sqrt(np.bincount(row, w * w, piece.num_rows))
            sums += np.bincount(feature, w / norm[row], len(terms))
        for g, name in names.items():
            some = np.flatnonzero((of == g) & (sums > 0))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(some), np.int64))), pa.array([terms[i] for i in some], pa.string()), pa.array(sums[some])], names=[topic, "term", "s"])

    parts = rows.mapInArrow(run, f"{topic} {docs.schema[topic].dataType.simpleString()}, term string, s double")
    scored = parts.groupBy(topic, "term").agg(F.sum("s").alias("s")).join(size, topic).select(topic, "term", F.round(F.col("s") / F.col("docs"), 9).alias("score"))
    best = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _tfidf_joined(docs: DataFrame, topic: str, doc: str, text: str, stop: tuple[str, ...], most: int, features: int) -> DataFrame:
    """tfidf_terms() of more topics than tasks can be sent the features of."""
    tf = docs.select(topic, doc, F.explode(grams(F.col(text), stop)).alias("term")).groupBy(topic, doc, "term").agg(F.count("*").alias("n"))
    df = tf.groupBy(topic, "term").agg(F.sum("n").alias("all"), F.count("*").alias("df"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("all"), "term"))).where(F.col("r") <= features)
    size = docs.groupBy(topic).agg(F.count("*").alias("docs"))
    rows = tf.join(df.select(topic, "term", "df"), [topic, "term"]).join(size, topic)
    rows = rows.withColumn("w", F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy(topic, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = rows.join(norm, [topic, doc]).groupBy(topic, "term").agg(F.round(F.sum(F.col("w") / F.col("norm")) / F.first("docs"), 9).alias("score"))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def joined_labels(terms: DataFrame, topic: str) -> DataFrame:
    """topic, label: the terms (topic, term, rank) of each, joined by strokes."""
    listed = terms.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))  # a few terms
    return listed.select(topic, F.array_join(F.transform("_t", lambda x: x["term"]), " / ").alias("label"))


def class_labels(docs: DataFrame, topic: str, text: str, stop: tuple[str, ...], most: int = 5, scope: str | None = None) -> DataFrame:
    """topic, label: the topic's most characteristic words and pairs by class-based
    TF-IDF, without artefacts and without terms whose words hold or are held by those of
    one before, joined by strokes. Scored over all topics, or within each scope that
    has several. The best ``12 * most`` terms are looked at. Words are counted first; of
    pairs, only those that can still be among these."""
    pool = F.lit(0) if scope is None else F.col(scope)
    rows = stored(_worded(docs.withColumn("_p", pool), topic, F.col(text), "_p"))  # read twice
    whole = stored(gram_counts(rows, ["_p", topic], stop, False).drop("df"))
    total = stored(whole.where("term is null and n > 0").select("_p", topic, F.col("n").alias("total")))
    topics = total.select("_p", topic)

    def scores(tf: DataFrame) -> DataFrame:
        """_p, topic, term, n, score of the counts of all topics."""
        if scope is not None:  # a scope of one topic is compared with all topics
            alone = topics.groupBy("_p").agg(F.count("*").alias("k")).where("k = 1").select("_p", F.lit(True).alias("_alone"))
            tf = tf.join(alone, "_p", "left")
        found = tf.withColumn("df", F.count("*").over(Window.partitionBy("_p", "term"))).join(topics.groupBy("_p").agg(F.count("*").alias("topics")), "_p")
        if scope is not None:
            over = tf.groupBy("term").agg(F.countDistinct("_p", topic).alias("_df")).crossJoin(F.broadcast(topics.agg(F.count("*").alias("_topics"))))  # one row
            found = found.join(over, "term")
            found = found.withColumns({"df": F.when(F.col("_alone"), F.col("_df")).otherwise(F.col("df")), "topics": F.when(F.col("_alone"), F.col("_topics")).otherwise(F.col("topics"))})
        return found.join(total, ["_p", topic]).select("_p", topic, "term", "n", F.round(F.col("n") / F.col("total") * F.log1p(F.col("topics") / F.col("df")), 9).alias("score"))

    order = Window.partitionBy("_p", topic).orderBy(F.desc("score"), "term")
    top = lambda t: t.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 12 * most)
    words = whole.where("term is not null")
    first = stored(top(scores(words)))
    # A pair is no more frequent than its words, and no term scores more than one of one topic.
    highest = F.broadcast(topics.agg(F.log1p(F.count("*").cast("double")).alias("_h")))  # one row
    least = first.groupBy("_p", topic).agg(F.when(F.count("*") >= 12 * most, F.min("score")).otherwise(0.0).alias("_s")).join(total, ["_p", topic]).crossJoin(highest)
    least = least.select("_p", topic, ((F.col("_s") - 1e-9) * F.col("total") / F.col("_h") * (1 - 1e-12)).alias("_least"))
    often = _sent(words.join(least, ["_p", topic]).where("n >= _least").select("term").distinct())
    wanted = None if often is None else {None: {r["term"] for r in often}}
    pairs = stored(gram_counts(rows, ["_p", topic], stop, True, wanted).drop("df"))
    best = top(first.drop("r").unionByName(scores(pairs))).where(~is_noise_term(F.col("term")))
    listed = best.groupBy("_p", topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    inside = lambda a, b: F.size(F.array_except(F.split(a, " "), F.split(b, " "))) == 0
    fold = F.aggregate(
        "terms", F.array().cast("array<string>"),
        lambda kept, t: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: inside(k, t) | inside(t, k)), kept).otherwise(F.concat(kept, F.array(t))),
    )
    return listed.select(topic, F.array_join(fold, " / ").alias("label"))


def audit_terms(docs: DataFrame, topic: str, text: str, stop: tuple[str, ...], most: int = 10) -> DataFrame:
    """topic, term, score, rank: single words by share of the topic's words times
    ln(1 + mean words of a topic / count in all topics)."""
    tf = words(docs, text, topic).where(~F.col("term").isin(*stop)).groupBy(topic, "term").agg(F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy("term"))
    total = tf.groupBy(topic).agg(F.sum("n").alias("total"))
    mean = F.broadcast(total.agg(F.avg("total").alias("mean")))  # one row
    rows = tf.withColumn("all", every).join(total, topic).crossJoin(mean)
    rows = rows.select(topic, "term", F.round(F.col("n") / F.col("total") * F.log1p(F.col("mean") / F.col("all")), 9).alias("score"))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Words of a coherence score.
PLAIN_WORD = r"(?U)\b[a-z][a-z']{2,}\b"


def pair_counts(docs: DataFrame, terms: DataFrame, topic: str, doc: str, text: str, form: str = PLAIN_WORD) -> DataFrame:
    """topic, a, b, na, nb, nab, n for all ordered pairs of each topic's terms, a = b
    among them: how many documents have a, b, both, and how many there are. A document's
    pairs are made from the wanted terms that it has only, and only where some topic has
    both."""
    wanted = F.broadcast(terms.agg(F.collect_set("term").alias("_wanted")))  # one row: a few terms for each topic
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(form), F.lit(0))
    one, two = terms.select(F.col(topic).alias("t"), F.col("term").alias("a")), terms.select(F.col(topic).alias("t"), F.col("term").alias("b"))
    pairs = one.join(two, "t")
    partners = pairs.where("a <= b").groupBy("a").agg(F.collect_set("b").alias("_with"))  # as many as topics have terms
    seen = docs.crossJoin(wanted).select(doc, F.array_intersect(found, "_wanted").alias("_seen")).where(F.size("_seen") > 0)
    held = seen.groupBy(doc).agg(F.array_distinct(F.flatten(F.collect_list("_seen"))).alias("_held"))  # wanted terms of one document
    both = held.select(F.explode("_held").alias("a"), "_held").join(partners, "a").select("a", F.explode(F.array_intersect("_held", "_with")).alias("b"))
    both = both.groupBy("a", "b").agg(F.count("*").alias("nab"))
    df = both.where("a = b").select(F.col("a").alias("term"), F.col("nab").alias("df"))
    n = F.broadcast(docs.agg(F.countDistinct(doc).alias("n")))  # one row
    rows = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")}).join(both.withColumnsRenamed({"a": "_lo", "b": "_hi"}), ["_lo", "_hi"], "left")
    rows = rows.join(df.withColumnsRenamed({"term": "a", "df": "na"}), "a", "left").join(df.withColumnsRenamed({"term": "b", "df": "nb"}), "b", "left").crossJoin(n)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("na", "nb", "nab")]
    return rows.select(F.col("t").alias(topic), "a", "b", *counts, "n")


def npmi(pairs: DataFrame, topic: str) -> DataFrame:
    """topic, coherence from pair_counts(): mean NPMI over pairs of the topic's terms; a
    pair that never meets is -1, one of an absent word 0, one that always meets counts
    as 1; topics of fewer than two terms are null."""
    pab, na, nb = F.col("nab") / F.col("n"), F.col("na"), F.col("nb")
    value = (
        F.when((na == 0) | (nb == 0), 0.0).when(F.col("nab") == 0, -1.0).when(F.col("nab") == F.col("n"), 1.0)
        .otherwise(F.log(pab * F.col("n") * F.col("n") / (na * nb)) / -F.log(pab))
    )
    return pairs.groupBy(topic).agg(F.avg(F.when(F.col("a") < F.col("b"), value)).alias("coherence"))


EPSILON = 1e-12


def _context(rows: DataFrame, topic: str) -> DataFrame:
    """topic, c_v of (topic, a, b, v): mean cosine of each word's row to the sum of all."""
    rows = rows.withColumn("_t", F.sum("v").over(Window.partitionBy(topic, "b")))
    v, t = F.col("v"), F.col("_t")
    each = rows.groupBy(topic, "a").agg((F.sum(v * t) / (F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(t * t)) + EPSILON)).alias("c"))
    return each.groupBy(topic).agg(F.avg("c").alias("c_v"))


def smoothed_coherence(pairs: DataFrame, topic: str) -> DataFrame:
    """topic, c_npmi, c_v with epsilon in both, of topics with two words or more that
    occur; the diagonal is 1."""
    pa, pb, pab = F.col("na") / F.col("n"), F.col("nb") / F.col("n"), F.col("nab") / F.col("n")
    value = F.log((pab + EPSILON) / (pa * pb)) / -F.log(pab + EPSILON)
    rows = pairs.where("na > 0 and nb > 0").withColumn("v", F.when(F.col("a") == F.col("b"), 1.0).otherwise(value))
    means = rows.groupBy(topic).agg(F.avg(F.when(F.col("a") != F.col("b"), F.col("v"))).alias("c_npmi")).where("c_npmi is not null")
    return means.join(_context(rows, topic), topic)


def benchmark_coherence(pairs: DataFrame, topic: str) -> DataFrame:
    """topic, c_npmi, c_v with epsilon inside both logarithms and the diagonal kept, of
    topics with two words or more."""
    p = lambda c: F.greatest(F.col(c).cast("double"), F.lit(EPSILON)) / F.col("n")
    pab = F.col("nab") / F.col("n")
    value = F.log((pab + EPSILON) / (p("na") * p("nb") + EPSILON)) / -F.log(pab + EPSILON)
    rows = pairs.withColumn("v", F.when(F.isnan(value), 0.0).otherwise(value))
    means = rows.groupBy(topic).agg(F.avg(F.when(F.col("a") < F.col("b"), F.col("v"))).alias("c_npmi")).where("c_npmi is not null")
    return means.join(_context(rows, topic), topic)


def diversity(terms: DataFrame) -> DataFrame:
    """One row: diversity, the distinct terms over all terms of all topics."""
    return terms.agg((F.countDistinct("term") / F.greatest(F.count("*"), F.lit(1))).alias("diversity"))


def duplicate_ratio(docs: DataFrame, topic: str, text: str) -> DataFrame:
    """topic, members, ratio: members with the commonest near-duplicate key, an empty one
    aside, over all members."""
    keys = docs.groupBy(topic, near_duplicate_key(F.col(text)).alias("_k")).agg(F.count("*").alias("n"))
    most = F.coalesce(F.max(F.when(F.col("_k") != "", F.col("n"))), F.lit(0))
    return keys.groupBy(topic).agg(F.sum("n").alias("members"), (most / F.sum("n")).alias("ratio"))


def add_counts(one: DataFrame, two: DataFrame, topic: str) -> DataFrame:
    """pair_counts() of the documents of both, which have none in common, for the topics
    and terms of the first: a reference's counts, stored once, are added to those of each
    window instead of counting the reference again."""
    names = ("na", "nb", "nab", "n")
    rows = one.join(two.withColumnsRenamed({c: f"_{c}" for c in names}), [topic, "a", "b"], "left")
    more = two.agg(F.max("n").alias("_m"))  # one row
    total = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in names[:3]}
    return rows.crossJoin(F.broadcast(more)).select(topic, "a", "b", *[v.alias(c) for c, v in total.items()], (F.col("n") + F.coalesce("_m", F.lit(0))).alias("n"))


def reference_documents(reference: DataFrame, window: DataFrame, doc: str, most: int, seed: int = 42) -> DataFrame:
    """Of a fixed reference, the documents that aren't in the window, ``most`` at most or
    so: drawn by a hash of the id, so that every window sees the same ones."""
    n = F.broadcast(reference.agg(F.count("*").alias("_n")))  # one row
    drawn = F.pmod(F.xxhash64(doc, F.lit(seed)), F.lit(1 << 30)) < F.lit(float(most << 30)) / F.col("_n")
    return reference.crossJoin(n).where(drawn).drop("_n").join(window.select(doc), doc, "left_anti")
