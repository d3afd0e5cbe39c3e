"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Text becomes template tokens: words in lower case, with typed placeholders for numbers,
units behind numbers, and names (capitalised words inside a sentence; the first word
of a sentence is no name). Windows of
``WIDTH`` tokens, of the raw tokens in lower case and of the template tokens, of all
documents are hash-joined with those of all items; Spark
broadcasts the items' windows while they are within its size threshold and shuffles
both sides beyond. Matched windows on one diagonal (position in the document less
position in the item) are aligned. There, slots must be consistent: one value of the
item stands for one value in the document; if they aren't, the diagonal's windows count
where their raw tokens are the item's. A document is contaminated by an item if such
windows cover ``COVER`` of the item's tokens, or if one diagonal has a run of ``RUN``
tokens' worth of windows. An item of fewer than ``WIDTH`` tokens is one window of its own
raw tokens.

A window that more than ``COMMON`` items have says little: documents are joined with it
only for items of which too few other windows are left, and otherwise only for the pairs
of documents and items that share another window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import materialise

WIDTH, COVER, RUN = 5, 0.8, 13
#: A window that more items have is common.
COMMON = 16
# Placeholders and units of measurement.
NUMBER, UNIT, NAME = "ǂnumber", "ǂunit", "ǂname"
SPACES = r"[\s\u0085\u00A0\u2000-\u200A\u2028\u2029\u202F\u3000]"
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur km/h mph kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa"
)


def _plain(text: Column) -> Column:
    """Digits of one number together, and a unit apart from its number."""
    short = "|".join(sorted((u for u in UNITS.split() if "/" not in u), key=len, reverse=True))
    joined = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")
    apart = F.regexp_replace(joined, rf"(?<=[0-9])(?=(?:{short})(?![\p{{L}}\p{{N}}]))", " ")
    return F.when(text.rlike("[0-9]"), apart).otherwise(text)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def raw_tokens(text: Column) -> Column:
    return _split(F.lower(_plain(F.coalesce(text, F.lit("")))))


def template_tokens(text: Column) -> Column:
    """One for each raw token."""
    short = "|".join(sorted((u for u in UNITS.split() if "/" not in u), key=len, reverse=True))
    named = F.lower(F.regexp_replace(_plain(F.coalesce(text, F.lit(""))), rf"\p{{Lu}}(?<=[\p{{Ll}}0-9,;:]{SPACES}{{1,16}}\p{{Lu}})\p{{Ll}}+(?![\p{{L}}\p{{N}}])", NAME))
    numbered = F.regexp_replace(named, r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", NUMBER)
    measured = F.regexp_replace(numbered, rf"{NUMBER}{SPACES}+(?:{short})(?![\p{{L}}\p{{N}}])", f"{NUMBER} {UNIT}")
    return _split(F.when(named.rlike("[0-9]"), measured).otherwise(named))


def _windows_sql(tokens: str, but: str | None = None, width: int = WIDTH) -> str:
    """SQL: hashes of all windows in order; none if there are fewer tokens. Null where
    the window is that of but."""
    # Element by element: slice() would copy the whole array for every window.
    starts = f"sequence(0, size({tokens}) - {width})"
    value = f"xxhash64({', '.join(f'{tokens}[i + {k}]' for k in range(width))})"
    if but:
        same = " and ".join(f"{tokens}[i + {k}] = {but}[i + {k}]" for k in range(width))
        value = f"if({same}, null, {value})"
    return f"if(size({tokens}) < {width}, cast(array() as array<bigint>), transform({starts}, i -> {value}))"


def _windows(tokens: str) -> Column:
    return F.expr(_windows_sql(tokens))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cover, run: pairs with consistent matches, contaminated or not."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    bench = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null")
    bench = bench.select("item", raw_tokens(F.col("text")).alias("raw"), template_tokens(F.col("text")).alias("tokens"))
    # A window of raw tokens has no slots; one of template tokens is there if it has some.
    slots = F.expr(f"filter(sequence(0, {WIDTH - 1}), k -> tokens[at + k] in ('{NUMBER}', '{UNIT}', '{NAME}'))")
    none = F.array().cast("array<int>")
    plain = bench.select("item", "raw", F.size("raw").alias("size"), F.posexplode(_windows("raw")).alias("at", "h")).withColumn("slots", none)
    typed = bench.select("item", "raw", "tokens", F.size("raw").alias("size"), F.posexplode(_windows("tokens")).alias("at", "h")).withColumn("slots", slots).where(F.size("slots") > 0)
    short = bench.where(F.size("raw").between(1, WIDTH - 1)).select("item", "raw", F.size("raw").alias("size"), F.lit(0).alias("at"), F.xxhash64("raw").alias("h"), none.alias("slots"))
    bench = plain.unionByName(typed.select(plain.columns)).unionByName(short)
    bench = materialise(bench.select("item", "at", "h", F.slice("raw", F.col("at") + 1, F.lit(WIDTH)).alias("raw"), "slots", "size"))
    wanted = bench.select("item", F.col("size").alias("tokens")).distinct()
    widths = sorted(r["size"] for r in bench.where(F.col("size") < WIDTH).select("size").distinct().collect())  # WIDTH - 1 at most

    # Matched positions that an item needs at least, and those that no common window has.
    common = bench.groupBy("h").agg(F.countDistinct("item").alias("items")).where(F.col("items") > COMMON).select("h", F.lit(True).alias("common"))
    bench = bench.join(common, "h", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    needed = F.least(F.when(F.col("tokens") >= RUN, RUN - WIDTH + 1).otherwise(1 << 30), F.greatest(F.ceil(COVER * F.col("tokens") / WIDTH), F.lit(1)))
    hidden = bench.groupBy("item").agg(F.countDistinct(F.when(F.col("common"), F.col("at"))).alias("hidden")).join(wanted, "item")
    hidden = hidden.select("item", (F.col("hidden") >= needed).alias("open"))
    bench = materialise(bench.join(hidden, "item").select("item", "at", "h", "raw", "slots", F.expr("common and not open").alias("late")))
    keys = materialise(bench.select("h").distinct())

    seen = texts.select("doc", raw_tokens(F.col("text")).alias("raw"), template_tokens(F.col("text")).alias("tokens"))
    typed = F.expr(f"if(tokens = raw, cast(array() as array<bigint>), {_windows_sql('tokens', 'raw')})")
    tokens = seen
    # Sizes first: needed behind the generator, every window would carry a copy of the tokens. The
    # hashes stay inside the generator: of a column, Spark would infer a filter and work them out twice.
    seen = seen.withColumn("n", F.greatest(F.size("raw") - (WIDTH - 1), F.lit(0)))
    seen = seen.select("doc", "n", F.posexplode(F.concat(_windows("raw"), typed)).alias("pos", "h"))
    seen = seen.select("doc", F.when(F.col("pos") < F.col("n"), F.col("pos")).otherwise(F.col("pos") - F.col("n")).alias("pos"), "h")
    for w in widths:
        seen = seen.unionByName(tokens.select("doc", F.posexplode(F.expr(_windows_sql("raw", width=w))).alias("pos", "h")))
    seen = materialise(seen.join(keys, "h"))
    pair = ["doc", "item", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"), F.size("slots").alias("n")]
    found = seen.join(bench.where("not late"), "h").select(*pair)
    late = bench.where("late")
    if not late.isEmpty():
        found = materialise(found)
        late = found.select("doc", "item").distinct().join(late, "item").join(seen, ["doc", "h"])
        found = found.unionByName(late.select(*pair))

    # Slots: only documents with a matched window that has any are read again.
    open_slots = found.where("n > 0").select("doc", "item", "at", "pos", "diagonal")
    readers = materialise(open_slots.select("doc").distinct())
    raw = texts.join(readers, "doc").select("doc", raw_tokens(F.col("text")).alias("own"))
    filled = open_slots.join(raw, "doc").select("doc", "item", "at", "diagonal", F.slice("own", F.col("pos") + 1, F.lit(WIDTH)).alias("own"))
    filled = filled.join(bench.where(F.size("slots") > 0).select("item", "at", "raw", "slots"), ["item", "at"]).select("doc", "item", "diagonal", "own", "raw", F.explode("slots").alias("k"))
    values = filled.select("doc", "item", "diagonal", F.expr("raw[k]").alias("given"), F.expr("own[k]").alias("value"))
    broken = values.groupBy("doc", "item", "diagonal", "given").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo != hi")
    broken = broken.select("doc", "item", "diagonal", F.lit(True).alias("broken")).distinct()
    found = found.join(broken, ["doc", "item", "diagonal"], "left").where("n = 0 or broken is null")

    # A diagonal's windows in a row: positions less their rank are equal.
    runs = found.groupBy("doc", "item", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    longest = F.expr(
        "aggregate(ats, named_struct('last', -2, 'now', 0, 'best', 0), (s, a) -> named_struct('last', a, "
        "'now', if(a = s.last + 1, s.now + 1, 1), 'best', greatest(s.best, if(a = s.last + 1, s.now + 1, 1))), s -> s.best)"
    )
    best = runs.select("doc", "item", longest.alias("run"), F.explode("ats").alias("at")).groupBy("doc", "item", "at").agg(F.max("run").alias("run"))
    covered = F.least(F.col("tokens"), F.expr(
        f"aggregate(ats, named_struct('last', -{WIDTH}, 'n', 0), (s, a) -> named_struct('last', a, 'n', s.n + least({WIDTH}, a - s.last)), s -> s.n)"
    ))
    pairs = best.groupBy("doc", "item").agg(F.array_sort(F.collect_list("at")).alias("ats"), F.max("run").alias("run")).join(wanted, "item")
    return pairs.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), (covered / F.col("tokens")).alias("cover"),
        F.least(F.col("tokens"), F.col("run") + (WIDTH - 1)).cast("long").alias("run"),
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, item_col, cover (share of the item's tokens), run (tokens in a row): one
    row for each document and item that contaminates it.

    Null and empty texts and items, and rows with null ids match nothing. An item of
    under WIDTH tokens matches where all of them stand in a row. Repeated rows of one id are one document. Without items or documents
    there are no rows. Other columns aren't read.
    """
    return matches(docs, items, id_col, item_col, text_col).where((F.col("cover") >= COVER) | (F.col("run") >= RUN))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose document isn't contaminated; rows with a
    null id stay."""
    bad = materialise(contaminated(docs, items, id_col, item_col, text_col).select(id_col).distinct())
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
