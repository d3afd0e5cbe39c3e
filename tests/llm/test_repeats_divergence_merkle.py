"""Operators 11 to 13 against their SQL and against brute force on small fixtures."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from trendloom.llm import divergence as dv
from trendloom.llm import merkle, registry, substring
from trendloom.llm.oracles import SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(400))
ODD = [
    (1, LONG, "en", "a", 9), (1, LONG, "en", "a", 9), (2, None, None, None, None), (3, "", "de", "", 0), (None, "no id here", None, "b", 1),
    (None, "x\n" + LONG[300:900], "en", "b", 1), (5, " \n\t", "fr", "é", 3), (6, "word " * 5000, "en", "c", 300_000), (7, "é ÀÉ İ ΣΑΣ Foo foo", "en", "d", 5),
    (8, LONG[:400] + "\nnew words\n" + LONG[400:], "en", None, 11),
] + [(100 + i, f"The cat_{i % 3} sat on THE mat; ünd so {'weiter ' * (i % 4)}\n", "en", "abc"[i % 3], i) for i in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"id": F.lit("clash"), "k1": F.lit(1), "salt": F.lit(2), "n": F.lit(2), "term": F.lit("t"), "leaf": F.lit(0)})


def from_sql(name, rows=None):
    con = duckdb.connect()
    if rows is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    else:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = con.execute(SQL[name])
    return [d[0] for d in got.description], got.fetchall()


def same(df, name, rows=None):
    names, want = from_sql(name, rows)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("name", ["op8_near_duplicates", "op11_substring_dedup", "op12_divergence", "op13_merkle"])
def test_query_equals_sql(spark, name):
    assert len(same(registry.queries()[name](spark, SF), name)) > 100


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_divergence", "op13_merkle"])
def test_odd_rows_and_empty_tables(spark, odd, name, tmp_path):
    odd.write.parquet(str(tmp_path / "a/documents.parquet"))
    odd.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    same(registry.queries()[name](spark, str(tmp_path / "a")), name, ODD)
    assert registry.queries()[name](spark, str(tmp_path / "b")).collect() == []


def brute_repeats(texts, window):
    lists = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [2, 4, 7])
def test_repeats_equal_brute_force(spark, window, monkeypatch):
    """Small chunks, and texts of so many rows that they are dealt by salts."""
    monkeypatch.setattr(substring, "CHUNK", 50)
    monkeypatch.setattr(substring, "HOT_LEAST", 10)
    monkeypatch.setattr(substring, "HOT_SHARE", 30)
    rng = random.Random(window)
    passages = [[rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(rng.randrange(window - 1, 3 * window))] for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.3 else [rng.choice("xyz") + str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(5))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    texts += ["the same text in " + " ".join(passages[0])] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, window).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_repeats(texts, window)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == want
        assert sum(s["until"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeats_window_bound(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1)


def test_divergence_in_slices(spark, monkeypatch):
    """Counts in many slices and flushes, and few documents for a term."""
    monkeypatch.setattr(dv, "SLICE_BYTES", 200)
    monkeypatch.setattr(dv, "HELD", 20)
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = sorted(map(tuple, dv.divergence(docs, 10, 10).collect()))
    assert got == sorted(from_sql("op12_divergence", ODD)[1])
    assert {r[3] for r in got if r[2] == "term"} & {"cat", "the", "sat"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests, arity):
    """The root and each leaf's siblings, level by level."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for j, path in enumerate(paths):
            lo = at[j] // arity * arity
            path.append((at[j] - lo, nodes[lo : lo + arity]))
            at[j] //= arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


@pytest.mark.parametrize("arity, rows, step", [(3, 7, 2), (2, 5, 1), (4, 50, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, rows, step):
    """Groups over many partitions, in several steps, beside small ones."""
    monkeypatch.setattr(merkle, "ROWS", rows)
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "NODES", 1)
    data = [(i, None if i % 11 == 0 else "big" if i % 3 else f"s{i % 40}", f"t{i}") for i in range(400)]
    docs = spark.createDataFrame(data, "id long, g string, text string").repartition(3)
    got = {r["id"]: r for r in merkle.manifest(docs, ("id", "text"), "g", "id", arity).collect()}
    field = lambda v: f"{len(str(v))}:{v}"
    groups = collections.defaultdict(list)
    for i, g, t in data:
        groups[(g is not None, g or "")].append((i, h(field(i), field(t))))
    names = sorted(groups)
    trees = {g: brute_tree([x[1] for x in groups[g]], arity) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names], arity)
    assert len(got) == len(data)
    for at, g in enumerate(names):
        for (i, leaf), path in zip(groups[g], trees[g][1]):
            r = got[i]
            assert (r["leaf"], r["subroot"], r["root"]) == (leaf, trees[g][0], root)
            assert r["proof"] == [merkle.line(children, place) for place, children in path + tops[at]]


def test_tampering_shows(spark):
    rows = registry.queries()["op13_merkle"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1 or "\n" not in texts[r["doc_id"]])
    assert {r["verified"] for r in rows} == {True, False}
