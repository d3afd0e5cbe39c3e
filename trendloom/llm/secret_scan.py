"""Secret scans with DataFrame operations only.

Base kinds are found by form. Beside them, candidate strings (runs of a character
class) are gone through with a window of ``WINDOW`` characters: the Shannon entropy of
the window is kept up to date from counts of its characters, of which each step changes
two, H = log2(W) - sum(c log2 c) / W. Windows at or over the threshold of
the candidate's class make a span, from the first such window to the end of the last.
What base spans hold and words of placeholders are cut out of candidates before; pieces
on the allow list, and those without a digit or without a letter, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
# Forms of the base kinds, in the order in which they are listed; least
# length of what must be long enough (group 2 of assign, else the match).
KINDS = ("assign", "access", "hex", "entropy")
FORMS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The characters of candidates, in the order of their counts.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate is a whole run of its class; placeholders cut it.
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Bits a character that a window must have, by class: hexadecimal digits, letters of
#: one case with digits, and all others. Of windows of 20 characters drawn evenly from
#: 16, 36 and 62 characters, one in twenty has fewer; the most that one can have is 4.32.
BITS = {r"^[0-9a-f]++$|^[0-9A-F]++$": 3.04, r"^[0-9a-z_=-]++$|^[0-9A-Z_=-]++$": 3.54}
OTHER_BITS = 3.78
# Harmless forms. Words joined by hyphens or strokes with plain numbers,
# dates and versions; UUIDs; placeholders.
ALLOWED = (
    r"^/?(?:[A-Za-z]++[0-9]*+|[0-9]++)?(?:[/_=-]++(?:v[0-9]++|[A-Za-z]++|[0-9]++)?+)++$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
PLACEHOLDER = r"(?i)example|placeholder|changeme|x{4,}+|0{7,}+|abcdefgh|12345678"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


NONE = "cast(array() as array<struct<s:int,k:int,e:int,h:string>>)"
#: Spans are put together in blocks of so many, so that no array grows one by one.
BLOCK = 64
#: Candidates are gone through in stretches of so many characters.
STRETCH = 200


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(every: str, state: str, step: str, out: str) -> str:
    """SQL: all spans out(t, y) of the elements y of an array, in order, where t is a
    struct that begins as state and becomes step(t, y) behind each element."""
    after = f"named_struct('t', {step}, 'out', concat(v.out, {out}))"
    inner = f"aggregate(slice(x, b * {BLOCK} + 1, {BLOCK}), named_struct('t', u.t, 'out', {NONE}), (v, y) -> {_let('t', 'v.t', after)})"
    put = _let("i", inner, "named_struct('t', i.t, 'out', array_append(u.out, i.out))")
    outer = (
        f"aggregate(sequence(0, (size(x) - 1) div {BLOCK}), named_struct('t', {state}, 'out', array({NONE})), "
        f"(u, b) -> {put}, u -> flatten(u.out))"
    )
    return _let("x", every, f"if(size(x) = 0, {NONE}, {outer})")


def _spans(text: str, kind: int, form: str, keep: str) -> str:
    """SQL: array<struct<s, k, e, h>> of the matches m for which keep holds. Starts are
    running sums over the lengths of the matches and of the pieces between them."""
    form = _quoted(form)
    hits = f"regexp_extract_all({text}, {form}, 0)"
    pairs = f"zip_with(slice(split({text}, {form}, -1), 1, size({hits})), {hits}, (p, h) -> named_struct('p', length(p), 'n', length(h), 'h', h))"
    span = f"array(named_struct('s', t.at + y.p, 'k', {kind}, 'e', t.at + y.p + y.n, 'h', y.h))"
    every = _running(pairs, "named_struct('at', 0)", "named_struct('at', t.at + y.p + y.n)", span)
    return f"if({text} rlike {form}, filter({every}, m -> {keep}), {NONE})"


def _pieces(candidates: str, cuts: str) -> str:
    """SQL: what the spans cuts leave of the spans candidates, of WINDOW or more each. t
    is what is open: from a to e within a candidate h that starts at s; c is the end of
    all cuts up to here. A last candidate at the end of all places closes the one before."""
    end = "2147483647"
    blocks = f"transform({cuts}, c -> named_struct('s', c.s, 'k', -1, 'e', c.e, 'h', ''))"
    events = f"array_sort(concat({candidates}, {blocks}, array(named_struct('s', {end}, 'k', 0, 'e', {end}, 'h', ''))))"
    upto = "if(y.k < 0, least(y.s, t.e), t.e)"
    piece = f"named_struct('s', t.a, 'k', {KINDS.index('entropy')}, 'e', {upto}, 'h', substr(t.h, t.a - t.s + 1, {upto} - t.a))"
    done = f"if({upto} - t.a >= {WINDOW} and (y.k >= 0 or y.s < t.e), array({piece}), {NONE})"
    cut = "named_struct('s', t.s, 'a', if(y.s < t.e, greatest(t.a, y.e), t.a), 'e', t.e, 'h', t.h, 'c', greatest(t.c, y.e))"
    opened = "named_struct('s', y.s, 'a', greatest(y.s, t.c), 'e', y.e, 'h', y.h, 'c', t.c)"
    return _running(events, "named_struct('s', 0, 'a', 0, 'e', 0, 'h', '', 'c', 0)", f"if(y.k < 0, {cut}, {opened})", done)


def _windows(word: str) -> str:
    """SQL: struct<first, last>, the ends (1-based, null if there are none) of the first
    and the last window of word with enough bits. n holds how often each character of
    CHARACTERS is in the window, s is the sum of c log2 c over these counts. A step takes
    one from the count of the character that leaves, and adds one to that of the character
    that enters."""
    part = lambda c: f"element_at(parts, {c} + 1)"
    place = lambda at: f"instr('{CHARACTERS}', substr(w, {at}, 1))"
    bits = "case " + " ".join(f"when {word} rlike {_quoted(form)} then {least}D" for form, least in BITS.items()) + f" else {OTHER_BITS}D end"
    leaves = f"if(i > {WINDOW}, {place(f'i - {WINDOW}')}, 0)"
    had = "if(io.o = 0, 0, element_at(st.n, if(io.o = 0, 1, io.o)))"
    has = "(element_at(st.n, io.i) - if(io.i = io.o, 1, 0))"
    total = f"st.s - {part('cs.o')} + {part('greatest(cs.o - 1, 0)')} - {part('cs.i')} + {part('(cs.i + 1)')}"
    counts = "transform(st.n, (x, j) -> x + if(j + 1 = io.i, 1, 0) - if(j + 1 = io.o, 1, 0))"
    enough = f"i >= {WINDOW} and log2({WINDOW}) - q / {WINDOW} >= least - 1e-9"
    marked = f"named_struct('s', q, 'n', {counts}, 'first', if(st.first is null and {enough}, i, st.first), 'last', if({enough}, i, st.last))"
    step = _let("io", f"named_struct('o', {leaves}, 'i', {place('i')})", _let("cs", f"named_struct('o', {had}, 'i', {has})", _let("q", total, marked)))
    none = "cast(null as int)"
    fold = (
        f"aggregate(sequence(1, length(w)), named_struct('s', 0D, 'n', array_repeat(0, {len(CHARACTERS)}), 'first', {none}, 'last', {none}), (st, i) -> {step}, "
        "st -> named_struct('first', st.first + shift, 'last', st.last + shift))"
    )
    before = f"if(j = 0, '', right(element_at(cuts, if(j = 0, 1, j)), {WINDOW - 1}))"
    each = _let("shift", f"if(j = 0, 0, j * {STRETCH} - {WINDOW - 1})", _let("w", f"concat({before}, c)", fold))
    rows = f"transform(cuts, (c, j) -> {each})"
    ends = _let("rows", rows, "named_struct('first', array_min(transform(rows, r -> r.first)), 'last', array_max(transform(rows, r -> r.last)))")
    table = f"transform(sequence(0, {WINDOW} + 1), c -> if(c > 1, c * log2(c), 0D))"
    return _let("parts", table, _let("least", bits, _let("cuts", f"regexp_extract_all({word}, '.{{1,{STRETCH}}}', 0)", ends)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans for every whole text.

    A span is kind:start:end in code points, end exclusive; spans go by start, then by
    kind in the order of KINDS, joined by commas. A null or empty text has none (the
    digest is that of an empty string). A base kind's matches don't overlap each other
    but may overlap another kind's; entropy spans overlap none. Null ids and repeated
    rows are kept. An empty table gives no rows. Other columns aren't read.
    """
    group = f"length(regexp_extract(m.h, {_quoted(FORMS['assign'])}, 2)) >= {LEAST['assign']}"
    keep = {"assign": group, "access": f"m.e - m.s >= {LEAST['access']}", "hex": "true"}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = [F.expr(_spans("t", i, form, keep[k])).alias(k) for i, (k, form) in enumerate(FORMS.items())]
    rows = rows.select("id", "t", *found, F.expr(_spans("t", KINDS.index("entropy"), CANDIDATE, "true")).alias("candidates"))
    rows = rows.withColumn("base", F.concat(*[F.col(k) for k in FORMS]))
    pieces = F.expr(_pieces("candidates", f"concat(base, {_spans('t', -1, PLACEHOLDER, 'true')})"))
    secret = "m.h rlike '[0-9]' and m.h rlike '[A-Za-z]' and " + " and ".join(f"not m.h rlike {_quoted(form)}" for form in ALLOWED)
    rows = rows.withColumn("pieces", F.when(F.size("candidates") > 0, pieces).otherwise(F.expr(NONE)))
    rows = rows.withColumn("pieces", F.expr(f"filter(pieces, m -> {secret})"))
    span = f"named_struct('s', m.s + w.first - {WINDOW}, 'k', m.k, 'e', m.s + w.last, 'h', m.h)"
    hot = F.expr(f"filter(transform(pieces, m -> {_let('w', _windows('m.h'), span)}), m -> m.s is not null)")
    text = lambda spans: F.expr(f"array_join(transform(array_sort({spans}), m -> concat_ws(':', element_at(array({', '.join(map(_quoted, KINDS))}), m.k + 1), m.s, m.e)), ',')")
    rows = rows.withColumn("hot", F.when(F.size("pieces") > 0, hot).otherwise(F.expr(NONE)))
    return rows.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS],
        F.sha2(text("base"), 256).alias("base_sha256"), text("concat(base, hot)").alias("spans"),
    )
