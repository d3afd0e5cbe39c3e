"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

A lexicon is learned from labelled training rows: whole words and stems (word starts)
whose documents are toxic far more often than others. Its trie is intersected with the
Levenshtein automaton of distance 1, as one deterministic automaton over the states
(trie node, edits), worked out lazily; long words get there exactly or with one edit,
and a stem takes any ending. Each hit has a window of ``WINDOW`` words: marks and verbs
of quotation, and words of address, separate a quotation from abuse. A logistic model
over a document's hits gives the score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import hash_share, materialise

#: The logistic model is fitted to about so many labelled training rows.
SAMPLE = 20_000
#: Least log-likelihood ratio of a word or stem against the share of toxic rows (1 %).
SIGNIFICANT = 6.63
#: Size of the model: the most significant terms and stems, and the most frequent clean words
#: near them, are what tasks are sent (a few megabytes at any size of the corpus).
LEXICON, CLEAN_WORDS = 20_000, 100_000
#: Words of at least so many letters may have one edit.
EDIT_LETTERS = 5
WINDOW = 8
THRESHOLD = 0.3
MEMO_WORDS, MEMO_STATES = 400_000, 100_000
N_FEATURES = 9

TOKENS = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")

# Cues in the languages of the corpus.
QUOTE_MARKS = frozenset('"“”„«»')
QUOTE_CUES = frozenset(
    "said says wrote writes quoted quote quotes called word term slur report reported according "
    "sagte sagt schrieb zitat zitiert wort begriff laut "
    "dit disait écrit cite cité mot terme selon "
    "dijo dice escribió cita citó palabra término según".split()
)
ADDRESS_CUES = frozenset("you your you're u du dich dein deine ihr euch tu te toi ton vous votre tú usted eres tus ustedes".split())


class FuzzyLexicon:
    """Terms and stems in a trie. classify(word) is None or (weight, kind), with kind 0
    for a term, 1 for a stem, 2 for a term with one edit. Where several fit, an exact
    term comes first, then a stem, then the heaviest edited term."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.arcs: list[dict[str, int]] = [{}]
        self.term: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.fuzzy: dict[int, float] = {}
        reach = set()
        for words, to in ((terms, self.term), (stems, self.stem)):
            for word, weight in words.items():
                node = 0
                for letter in word:
                    if letter not in self.arcs[node]:
                        self.arcs[node][letter] = len(self.arcs)
                        self.arcs.append({})
                    node = self.arcs[node][letter]
                    if to is self.term and len(word) >= EDIT_LETTERS:
                        reach.add(node)
                to[node] = weight
                if to is self.term and len(word) >= EDIT_LETTERS:
                    self.fuzzy[node] = weight
        self.reach = reach | {0}  # nodes from which an edited term can still be reached
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, places: set[tuple[int, int]]) -> frozenset:
        """Adds what is reached by leaving out a letter of the term."""
        out = set(places)
        for node, edits in places:
            if edits == 0 and node in self.reach:
                out |= {(t, 1) for t in self.arcs[node].values() if t in self.reach}
        return frozenset(out)

    def _state(self, places: frozenset) -> int:
        if places not in self.ids:
            self.ids[places] = len(self.sets)
            self.sets.append(places)
            self.next.append({})
        return self.ids[places]

    def _step(self, state: int, letter: str) -> int:
        moved = set()
        for node, edits in self.sets[state]:
            arcs = self.arcs[node]
            if letter in arcs and (edits == 0 or arcs[letter] in self.reach):
                moved.add((arcs[letter], edits))
            if edits == 0 and node in self.reach:
                moved.add((node, 1))  # a letter too many
                moved |= {(t, 1) for c, t in arcs.items() if c != letter and t in self.reach}  # another letter
        got = self.next[state][letter] = self._state(self._closed(moved))
        return got

    def classify(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > MEMO_STATES:
            self._reset()
        state, stem = self.start, None
        for letter in word:
            after = self.next[state].get(letter)
            state = self._step(state, letter) if after is None else after
            places = self.sets[state]
            if not places:
                break
            if self.stem:
                for node, edits in places:
                    if edits == 0 and node in self.stem:
                        stem = self.stem[node]
        ends = self.sets[state]
        exact = [self.term[n] for n, e in ends if e == 0 and n in self.term]
        if exact:
            return exact[0], 0
        if stem is not None:
            return stem, 1
        near = [self.fuzzy[n] for n, e in ends if e == 1 and n in self.fuzzy]
        return (max(near), 2) if near else None


class _Memo(dict):
    def __init__(self, lexicon: FuzzyLexicon, harmless: frozenset):
        super().__init__()
        self.lexicon, self.harmless = lexicon, harmless

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self.lexicon.classify(word)
        if got and got[1] == 2 and word in self.harmless:
            got = None
        self[word] = got
        return got


def document_features(text: str | None, memo: _Memo) -> list[float]:
    """Counts over the hits of a whole text: by kind, quoted or not, addressed, weight."""
    words = TOKENS.findall((text or "").lower())
    found = list(map(memo.__getitem__, words))
    hits = [i for i, f in enumerate(found) if f is not None]
    if not hits:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    exact = stem = near = quoted = addressed = weight = 0.0
    for i in hits:
        w, kind = found[i]
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        in_marks = any(t in QUOTE_MARKS for t in before) and any(t in QUOTE_MARKS for t in after)
        quoted += in_marks or any(t in QUOTE_CUES for t in around)
        addressed += any(t in ADDRESS_CUES for t in around)
        exact += kind == 0
        stem += kind == 1
        near += kind == 2
        weight += w
    n = len(hits)
    return [1.0, np.log1p(exact), np.log1p(stem), np.log1p(near), quoted / n, addressed / n, np.log1p(weight), float(exact + stem > 0), float(near > 1)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100, share: np.ndarray | None = None) -> np.ndarray:
    """Newton's method with a small ridge: no randomness. share, of each row, adds up
    to 1."""
    w = np.zeros(x.shape[1])
    share = np.full(len(y), 1 / len(y)) if share is None else share
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * share) + ridge * w
        hess = (x * (p * (1 - p) * share)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(docs: DataFrame, shared, carried: str) -> DataFrame:
    """docs(id, carried columns, text) with x, the feature vector, instead of the text."""
    import pyarrow as pa

    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        terms, stems, harmless = shared.value
        memo = _Memo(FuzzyLexicon(terms, stems), harmless)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                x = [document_features(t, memo) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, f"{carried}, x array<double>")


def learn_lexicon(words: DataFrame, bad: int, good: int) -> tuple[dict[str, float], dict[str, float], frozenset]:
    """Terms and stems with their log odds, and words of clean rows one edit from a
    term, from words(words, toxic), the distinct words of every training row, of which
    ``bad`` rows are toxic and ``good`` aren't. All rows are counted; the driver gets the
    words and stems that are SIGNIFICANT, LEXICON of either at most, the most significant
    first, and CLEAN_WORDS clean words near them, the most frequent first."""
    if not bad:
        return {}, {}, frozenset()
    n = {"bad": bad, "good": good}
    single = words.select("toxic", F.explode("words").alias("w")).where("w != ''")
    stats = materialise(single.groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    odds = F.log((F.col("bad") + 0.5) / (n["bad"] + 1) / ((F.col("good") + 0.5) / (n["good"] + 1)))
    part = lambda c, toxic: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * F.lit(n["bad"] + n["good"]) / ((F.col("bad") + F.col("good")) * F.lit(max(toxic, 1))))).otherwise(0.0)
    ratio = 2 * (part("bad", n["bad"]) + part("good", n["good"]))
    sure = ratio >= SIGNIFICANT
    first = [F.desc(F.round(ratio, 6)), F.col("w")]
    if not n["good"]:
        sure = F.lit(True)
    terms = {r["w"]: r["odds"] for r in stats.where(sure & (F.col("bad") >= 3) & (odds >= 2.5)).orderBy(*first).limit(LEXICON).select("w", odds.alias("odds")).collect()}
    cuts = F.filter(F.array(*[F.substring("w", 1, k) for k in (4, 5, 6, 7)]), lambda s: F.length(s) < F.length("w"))
    starts = stats.where("length(w) >= 5").select("bad", "good", F.explode(cuts).alias("w"))
    by_start = starts.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words"))
    rows = by_start.where(sure & (F.col("bad") >= 8) & (F.col("words") >= 3) & (odds >= 3.5)).orderBy(*first).limit(LEXICON).select("w", odds.alias("odds")).collect()
    stems: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: len(r["w"])):
        if not any(r["w"].startswith(s) for s in stems):
            stems[r["w"]] = r["odds"]
    # Clean words that only look like a misspelt term: same start or end as a long term.
    if not terms:
        return terms, stems, frozenset()
    lengths = sorted({len(t) for t in terms if len(t) >= EDIT_LETTERS})
    if not lengths:
        return terms, stems, frozenset()
    near = stats.where(F.col("good") > F.col("bad")).where(F.length("w").between(lengths[0] - 1, lengths[-1] + 1)).select("w", "good")
    both = words.sparkSession.sparkContext.broadcast((terms, stems))

    def run(batches):
        import pyarrow as pa

        lexicon = FuzzyLexicon(*both.value)
        for batch in batches:
            yield batch.filter(pa.array([(lexicon.classify(w) or (0, 0))[1] == 2 for w in batch.column("w").to_pylist()], pa.bool_()))

    clean = near.mapInArrow(run, "w string, good long").orderBy(F.desc("good"), "w").limit(CLEAN_WORDS)
    return terms, stems, frozenset(r["w"] for r in clean.collect())


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 4, held_out: int = 2,
    sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """id_col, held_out, score, predicted for every whole text.

    Learns from labelled rows whose crc32 of the id modulo fold isn't held_out: the
    lexicon from all, the model from about ``sample``, toxic ones up to half; an id with several labels is toxic if one says so; a null id is held out.
    Null and empty texts are scored like a text without hits. Without toxic training
    rows every score is 0. Repeated rows and null ids are kept. An empty table gives no
    rows. Other columns aren't read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    remainder = F.crc32(F.col("id").cast("string").cast("binary")) % fold
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("toxic")).where("id is not null and toxic is not null")
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic")).where(remainder != held_out)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Always the same join: texts stay, their distinct words are moved to the labels.
    marks = materialise(marks)
    joined = lambda rows: rows.where(remainder != held_out).join(marks.hint("merge"), "id")
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    # As one string they take less room than the text; an array of them takes more.
    some_words = texts.select("id", F.array_join(F.filter(words, lambda w: F.length(w) >= 2), " ").alias("words"))
    train = materialise(joined(texts.select("id")).select("id", "toxic"))
    there = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = there.get(1, 0), there.get(0, 0)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(joined(some_words).select("toxic", F.split("words", " ").alias("words")), bad, good))
    kind = docs.schema[id_col].dataType.simpleString()
    of_bad = min(1.0, max(sample / 2, sample - good) / max(bad, 1))
    of_good = min(1.0, (sample - of_bad * bad) / max(good, 1))
    # About ``sample`` ids at most, so that they can go to where the texts are.
    drawn = train.where(hash_share(F.col("id"), 3) < F.when(F.col("toxic") == 1, of_bad).otherwise(of_good)).distinct()
    some = texts.join(F.broadcast(drawn), "id")
    rows = sorted(_features(some, lexicon, f"id {kind}, toxic long").collect(), key=lambda r: (r["id"], r["x"]))
    y = np.array([r["toxic"] for r in rows], float)
    share = np.where(y == 1, bad / max(y.sum(), 1), good / max(len(y) - y.sum(), 1))
    weights = fit_logistic(np.array([r["x"] for r in rows]), y, share=share / share.sum()) if y.any() else None

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist())
                p = np.zeros(len(x)) if weights is None else 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=["id", "held_out", "score", "predicted"],
                )

    every = texts.select("id", F.coalesce(remainder == held_out, F.lit(True)).alias("held_out"), "text")
    out = _features(every, lexicon, f"id {kind}, held_out boolean")
    return out.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
