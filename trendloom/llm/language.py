"""Language identification in two steps: the family first, then one-versus-one linear
support vector machines between the languages of that family.

Features are counts of hashed byte trigrams over letters only, square-rooted and of
unit length. Models are trained here, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import forget_tables, hash_share, materialise

#: About so many training documents are drawn for each language, by a hash of the id.
SAMPLE = 1000
BUCKETS = 4096
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")

# Language families by ISO 639-1 code; a code that isn't here is a
# family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _classes() -> np.ndarray:
    """Byte to symbol: lower-case ASCII letters and all bytes of longer characters stay;
    everything else is a word break."""
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


def features(text: str | None) -> np.ndarray:
    """Unit vector of the whole text; zeros without a letter."""
    codes = _classes()[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace"), np.uint8)]
    counts = np.zeros(BUCKETS)
    # Long texts are added up in stretches, so that memory stays bounded.
    for lo in range(0, max(len(codes) - 2, 0), 1 << 20):
        c = codes[lo : lo + (1 << 20) + 2]
        a, b, d = c[:-2], c[1:-1], c[2:]
        used = (b > 0) & ((a > 0) | (d > 0))
        counts += np.bincount(((a * 155 + b) * 155 + d)[used] * 2654435761 % (1 << 32) >> 20, minlength=BUCKETS)
    root = np.sqrt(counts)
    norm = np.linalg.norm(root)
    return root / norm if norm else root


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss
    between rows with y = 1 and y = -1. Classes weigh the same. Plain accelerated
    gradient steps: no randomness."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    w = v = np.zeros(x.shape[1] + 1)
    step, t = 1.0 / (1.0 + 2 * cost * 2.0), 1.0
    for _ in range(rounds):
        # Products in the precision of x, so that x is never copied.
        slack = np.maximum(0.0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        pull = weight * slack * y
        grad = v - 2 * np.append(x.T @ pull.astype(x.dtype), pull.sum())
        after, t2 = v - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = after + (t - 1) / t2 * (after - w), after, t2
    return w


def _votes(x: np.ndarray, names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner and its confidence: votes first, then the sum of margins."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    total = np.zeros((len(x), len(names)))
    least = np.full((len(x), len(names)), np.inf)
    for i, j in combinations(range(len(names)), 2):
        margin = x @ machines[names[i], names[j]][:-1] + machines[names[i], names[j]][-1]
        total[:, i] += (margin > 0) + np.tanh(margin) / 100
        total[:, j] += (margin <= 0) - np.tanh(margin) / 100
        least[:, i] = np.minimum(least[:, i], margin)
        least[:, j] = np.minimum(least[:, j], -margin)
    best = total.argmax(axis=1)
    return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))


def _pairs(langs: list[str]) -> list[tuple[str, str, str, str]]:
    """(step, a, b, lang) for every machine and every language whose rows it learns from:
    between families, and between the languages of one family."""
    kinds: dict[str, list[str]] = {}
    for lang in langs:
        kinds.setdefault(family(lang), []).append(lang)
    out = [("family", a, b, lang) for a, b in combinations(sorted(kinds), 2) for k in (a, b) for lang in kinds[k]]
    return out + [("language", a, b, lang) for own in kinds.values() for a, b in combinations(sorted(own), 2) for lang in (a, b)]


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> dict:
    """The models, from rows with a text and a language. Of each language, about
    ``sample`` documents are drawn, and for a machine between families about as many of
    each family. Every machine is trained in a task of its own on its bounded rows; the
    driver gets the numbers of rows and the weights only."""
    import pandas as pd
    import pyarrow as pa

    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    kinds = {f: [lang for lang in langs if family(lang) == f] for f in sorted({family(lang) for lang in langs})}
    model = {"families": list(kinds), "split": {}, "langs": {f: (own, {}) for f, own in kinds.items()}}
    machines = _pairs(langs)
    if not machines:
        return model
    for step, a, b, _ in machines:  # one without rows decides nothing
        (model["split"] if step == "family" else model["langs"][family(a)][1])[a, b] = np.zeros(BUCKETS + 1, np.float32)
    spark = train.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in counts.items()], "lang string, share double")
    chosen = train.join(F.broadcast(share), "lang")  # a row for each language
    chosen = chosen.where(hash_share(F.col("id"), 9) < F.col("share")).select("id", "lang", "text")

    def run(batches):
        forget_tables()
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                x = features(t).astype(np.float32)
                used = np.flatnonzero(x)
                found.append(used.astype(np.uint16).tobytes() + x[used].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(found, pa.binary())], names=["id", "lang", "x"])

    kind = train.schema["id"].dataType.simpleString()
    rows = materialise(chosen.mapInArrow(run, f"id {kind}, lang string, x binary"))
    # A machine between families takes its share of each language's rows.
    wanted = [(step, a, b, lang, 1.0 if step == "language" else 1.0 / len(kinds[family(lang)]), family(lang) if step == "family" else lang) for step, a, b, lang in machines]
    wanted = spark.createDataFrame(wanted, "step string, a string, b string, lang string, part double, side string")
    dealt = rows.join(F.broadcast(wanted), "lang")  # rows for each two languages
    dealt = dealt.where(hash_share(F.col("id"), 10) < F.col("part")).select("step", "a", "b", "side", "x")

    def learn(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["side", "x"])
        x = np.zeros((len(table), BUCKETS), np.float32)
        for i, found in enumerate(table["x"]):
            n = len(found) // 6  # two bytes of a place and four of a value each
            x[i, np.frombuffer(found, np.uint16, n)] = np.frombuffer(found[2 * n :], np.float32)
        y = np.where(table["side"] == table["a"], 1.0, -1.0)
        head = table[["step", "a", "b"]].iloc[:1].reset_index(drop=True)
        return head.assign(w=[train_svm(x, y).astype(np.float32).tobytes()])

    for r in dealt.groupBy("step", "a", "b").applyInPandas(learn, "step string, a string, b string, w binary").collect():
        into = model["split"] if r["step"] == "family" else model["langs"][family(r["a"])][1]
        into[r["a"], r["b"]] = np.frombuffer(bytes(r["w"]), np.float32)
    return model


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not use or not model["families"]:
        return names, scores
    x = np.array([features(texts[i]) for i in use])
    which, sure = _votes(x, model["families"], model["split"])
    for f, (langs, machines) in enumerate(model["langs"][k] for k in model["families"]):
        mine = np.flatnonzero(which == f)
        if len(mine):
            best, score = _votes(x[mine], langs, machines)
            for m, b, s in zip(mine, best, score):
                names[use[m]] = str(langs[b])
                scores[use[m]] = s * sure[m]
    return names, scores


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 5, sample: int = SAMPLE) -> DataFrame:
    """id_col, held_out, lang_pred, score for every whole text.

    Learns from rows with a language whose crc32 of the id modulo held_out_of isn't 0;
    a null id is held out. A text that is null or has no letter is ``und`` with score 0,
    and so is every text if there is nothing to learn from. Repeated rows are kept. An
    empty table gives no rows. Other columns aren't read.
    """
    import pyarrow as pa

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out_of == 0, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held), id_col, text_col, lang_col, sample))

    def run(batches):
        forget_tables()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                names, scores = predict(batch.column("text").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, held_out boolean, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.05, held_out_of: int = 5, sample: int = SAMPLE
) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language with a score of at
    least ``least``; a null language is filled in. Learns and treats cases as identify()
    does, so null, empty and letterless texts go."""
    import pyarrow as pa

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out_of == 0, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held), id_col, text_col, lang_col, sample))

    def run(batches):
        forget_tables()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                names, scores = predict(batch.column(text_col).to_pylist(), model.value)
                known = [n != UNDETERMINED and s >= least for n, s in zip(names, scores)]
                langs = [own if own is not None else n for own, n in zip(batch.column(lang_col).to_pylist(), names)]
                columns = [pa.array(langs, pa.string()) if f.name == lang_col else batch.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
