"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the
raw corpus, beside countable base rules.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets. The raw model
counts all documents, the target model all trusted ones. A document's score is the mean
over its n-grams of log(target / raw). It is kept if the score reaches the margin that
best tells all trusted from all distrusted documents (see ``margin_between``).
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import ascii_words, materialise, observed

BUCKETS = 16384
#: Bits of the filter that most texts without a label don't pass, as a power of two; 1 MB.
FILTER_BITS = 23
#: Least words, and most percent of words in repeated windows, of a kept document.
LEAST_WORDS, MOST_REPEATED = 50, 50
MEMO_WORDS = 400_000
SYMBOLS = re.compile(rb"[#*$%&|<>]")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return got


def ngram_buckets(words: list[bytes], memo: _Buckets) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([h % np.uint64(BUCKETS), (pairs >> np.uint64(40)) % np.uint64(BUCKETS)]).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def repeated_words(words: list[bytes]) -> int:
    """Positions inside three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = _Numbers()
    w = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) == n:
        return 0
    _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
    windows = pair[:-1] * len(number) + w[2:]
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif ascii_words(line):
            seen.add(line)
    letters = b"".join(words)
    chars = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
    return len(words), chars, len(SYMBOLS.findall(text)), dup, repeated_words(words)


def _bytes(batch) -> list[bytes]:
    import pyarrow as pa

    return [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, name) from texts(text): a vector for each task, whose nonzero places are
    added up by bucket."""
    import pyarrow as pa

    def run(batches):
        memo = _Buckets()
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in _bytes(batch):
                words = ascii_words(text)
                if words:
                    counts += np.bincount(ngram_buckets(words, memo), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def _with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """text, trusted of all texts(id, text) that have a mark. A filter of bits, whose size
    is bounded, holds back most others; the join, which is of one kind at every size,
    decides."""
    place = F.expr(f"pmod(xxhash64(id), {1 << FILTER_BITS})")
    bits = marks.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits"))
    byte = "cast(conv(hex(substr(bits, cast((at & 32767) div 8 + 1 as int), 1)), 16, 10) as int)"
    passed = texts.withColumn("at", place).withColumn("block", F.shiftright("at", 15)).join(F.broadcast(bits), "block")
    passed = passed.where(f"(shiftright({byte}, cast(at % 8 as int)) & 1) = 1").select("id", "text")
    return passed.join(marks.hint("merge"), "id").select("text", "trusted")


def log_ratio(rows: list) -> np.ndarray:
    """log(target / raw) of each bucket from its counts, each with one added."""
    counts = np.ones((2, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] += r["raw"], r["target"]
    raw, target = np.log(counts / counts.sum(axis=1, keepdims=True))
    return target - raw


def margin_between(scored: DataFrame) -> float:
    """From scored(trusted, score), the threshold with the least share of good scores
    under it plus share of bad ones at or over it: the middle of the first best gap
    between neighbouring scores, or 1 below the least. Without bad scores, half the
    distance between the least and the mean good one below the least; without good ones,
    minus infinity. Scores are sorted in ranges; the driver gets a row for each range."""
    scored, seen = observed(
        scored, F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"),
        F.min(F.when(F.col("trusted"), F.col("score"))).alias("least"), F.avg(F.when(F.col("trusted"), F.col("score"))).alias("mean"),
    )
    good, bad = seen["good"], seen["bad"]
    if not good:
        return -np.inf
    if not bad:
        return seen["least"] - (seen["mean"] - seen["least"]) / 2
    each = scored.groupBy("score").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    each = materialise(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = each.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).orderBy("part").collect()
    before, sums = [], (0, 0, None)
    for r in parts:
        before.append((r["part"], *sums))
        sums = (sums[0] + r["good"], sums[1] + r["bad"], r["last"])
    before = scored.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long, last double")
    order = Window.partitionBy("part").orderBy("score")
    under = order.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda kind: F.coalesce(F.sum(kind).over(under), F.lit(0)) + F.col(f"{kind}_before")
    rows = each.join(F.broadcast(before), "part").select(  # a row for each range
        "score", below("good").alias("g"), below("bad").alias("b"), F.coalesce(F.lag("score").over(order), "last").alias("prior")
    )
    edge = F.coalesce((F.col("prior") + F.col("score")) / 2, F.col("score") - 1)
    wrong = F.col("g").cast("decimal(19,0)") * bad - F.col("b").cast("decimal(19,0)") * good
    return rows.agg(F.min(F.struct(wrong.alias("wrong"), edge.alias("edge")))["edge"]).first()[0]


def _scores(words: list[bytes], memo: _Buckets, ratio: np.ndarray) -> float:
    return float(ratio[ngram_buckets(words, memo)].mean()) if words else 0.0


def _failed(counts: tuple) -> bool:
    return counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, trust_col: str) -> tuple[np.ndarray, float]:
    """log(target / raw) of each bucket and the margin; zeros and minus infinity if
    nothing is trusted. An id with several labels is trusted if one says so. All labelled
    texts are learned from; they, and few others, are moved once. The driver gets a
    number for each bucket and a row for each range of scores."""
    import pyarrow as pa

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    own = F.col(id_col).try_cast(docs.schema[id_col].dataType)  # equal ids of two types would have two hashes
    marks = labels.select(own.alias("id"), (F.col(trust_col) == 1).alias("trusted")).where("id is not null and trusted is not null")
    marks = materialise(marks.groupBy("id").agg(F.max("trusted").alias("trusted")))
    if marks.where("trusted").isEmpty():
        return np.zeros(BUCKETS), -np.inf
    marked = materialise(_with_marks(texts, marks))
    target = _bucket_counts(marked.where("trusted").select("text"), "target")
    counts = _bucket_counts(texts.select("text"), "raw").join(target, "bucket", "left").fillna(0, ["target"])
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(counts.collect()))

    def run(batches):
        memo = _Buckets()
        for batch in batches:
            out = []
            for text, trusted in zip(_bytes(batch), batch.column("trusted").to_pylist()):
                words = ascii_words(text)
                if not _failed(base_counts(text, words)):
                    out.append((trusted, _scores(words, memo, ratio.value)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.float64())], names=["trusted", "score"])

    return ratio.value, margin_between(marked.mapInArrow(run, "trusted boolean, score double"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust_col: str = "quality", margin: float | None = None
) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, llr for every whole text.

    Words are runs of anything but ASCII white space. A null or empty text has no words,
    fails the base rules and has an llr of 0. Repeated rows and null ids are kept like
    others. Without trusted rows every llr is 0, so only the base rules decide. A score
    equal to the margin is kept; a margin may be given instead of the learned one. An
    empty table gives no rows. Other columns aren't read.
    """
    import pyarrow as pa

    learned, least = fit(docs, labels, id_col, text_col, trust_col)
    ratio = docs.sparkSession.sparkContext.broadcast((learned, least if margin is None else margin))

    def run(batches):
        memo = _Buckets()
        values, least = ratio.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                out = []
                for text in _bytes(batch):
                    words = ascii_words(text)
                    counts = base_counts(text, words)
                    llr, failed = _scores(words, memo, values), _failed(counts)
                    out.append((*counts, failed, not failed and llr >= least, llr))
                columns = list(zip(*out)) if out else [()] * 8
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    types = ", ".join(f"{n} {t}" for n, t in zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["double"]))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {types}")
    return out.withColumnRenamed("id", id_col)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
