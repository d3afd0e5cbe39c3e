"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that label merging ignores.
LABEL_FILLERS = ("and", "of", "the", "with", "for", "to", "in", "on", "a", "an", "or", "issue", "issues", "problem", "problems", "complaint", "complaints")
# Words of acknowledgements.
ACK_WORDS = tuple(
    "thanks thank thankyou ty thx yes yeah yep yup ok okay sure no nope nah hi hello hey please pls sorry welcome lol haha hahah great good nice cool love done sent did got dm dms "
    "dmed message gracias merci danke obrigado obrigada grazie si oui ja nein non nao não bien vielen mto cheers ta np".split()
)
# Words and patterns that carry no meaning in labels.
NOISE_WORDS = tuple("__email__ __url__ __phone__ __user__ __number__ __date__ mobile_care mobile_carexi mobilecare amp http https co rt via pic twitter com".split())
NOISE_FORM = r"(?i)^(?:mobile_?care\w*|__\w+__|[0-9]+)$"


def _once(value: Column, body) -> Column:
    """body(value), with value worked out once instead of at each use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(text: Column) -> Column:
    """Without links, mentions, hash signs and runs of one closing mark; one space
    between words. A null text is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u200B\r\n]", " ")
    t = F.regexp_replace(t, r"(?i)(?:https?://|www\.)\S+", " ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)@\w+", " ")
    t = F.regexp_replace(t, "#", " ")
    t = F.regexp_replace(t, r"([!?.,])\1{2,}", "$1")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? and white space."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def hard_chunks(text: Column, size: int = 450, overlap: int = 60) -> Column:
    """Overlapping windows of characters, trimmed, without empty ones."""
    step = max(size - overlap, 1)
    starts = lambda t: F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step))
    every = _once(text, lambda t: F.transform(starts(t), lambda i: F.trim(F.substring(t, i + 1, F.lit(size)))))
    return F.filter(every, lambda c: c != "")


#: Sentences that are packed before their chunks join those of the text.
BLOCK = 64


def packed_chunks(text: Column, size: int = 450, overlap: int = 60) -> Column:
    """A text of up to size characters whole; of a longer one, sentences in a row packed
    into chunks of up to size, and longer sentences in hard chunks. Chunks are gathered in
    blocks, so the work grows with the text."""

    def pack(state: Column, s: Column) -> Column:
        done, now = state["done"], state["now"]
        flushed = F.when(now == "", done).otherwise(F.concat(done, F.array(now)))
        long = F.struct(F.concat(flushed, hard_chunks(s, size, overlap)).alias("done"), F.lit("").alias("now"))
        first = F.struct(done.alias("done"), s.alias("now"))
        more = F.struct(done.alias("done"), F.concat(now, F.lit(" "), s).alias("now"))
        other = F.struct(F.concat(done, F.array(now)).alias("done"), s.alias("now"))
        return F.when(F.length(s) > size, long).when(now == "", first).when(F.length(now) + 1 + F.length(s) <= size, more).otherwise(other)

    def block(state: Column, some: Column) -> Column:
        none = F.struct(F.array().cast("array<string>").alias("done"), state["now"].alias("now"))
        joined = lambda r: F.struct(F.concat(state["done"], F.array(r["done"])).alias("done"), r["now"].alias("now"))
        return _once(F.aggregate(some, none, pack), joined)

    def packed(t: Column) -> Column:
        blocks = _once(sentences(t), lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(s, i, F.lit(BLOCK))))
        none = F.struct(F.array().cast("array<array<string>>").alias("done"), F.lit("").alias("now"))
        last = lambda st: F.when(st["now"] == "", F.flatten(st["done"])).otherwise(F.concat(F.flatten(st["done"]), F.array(st["now"])))
        return F.aggregate(blocks, none, block, last)

    return _once(text, lambda t: F.when(F.length(t) <= size, F.filter(F.array(t), lambda c: c != "")).otherwise(packed(t)))


def capped(chunks: Column, most: int = 6) -> Column:
    """At most ``most`` chunks, evenly spaced, the first and last among them."""
    at = F.sequence(F.lit(0), F.lit(most - 1))
    place = lambda c, i: (F.floor(i * (F.size(c) - 1) / F.lit(most - 1)) + 1).cast("int")
    return _once(chunks, lambda c: F.when(F.size(c) > most, F.transform(at, lambda i: F.element_at(c, place(c, i)))).otherwise(c))


def content_words(text: Column, stop: tuple[str, ...] = (), shortest: int = 3) -> Column:
    """Number of words of letters that aren't stop words and are long enough."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.size(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*stop) if stop else F.length(w) >= shortest))


def label_wordset(label: Column, fillers: tuple[str, ...] = LABEL_FILLERS) -> Column:
    """Sorted distinct words of a label without fillers; equal sets mean equal labels."""
    words = F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*fillers))))


def is_noise_term(term: Column) -> Column:
    """Whether every word of a label term is an artefact; false without words."""
    words = F.filter(F.split(term, r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(NOISE_FORM) | w.isin(*NOISE_WORDS))


def junk_term_ratio(label: Column) -> Column:
    """Share of the label's terms (between strokes) that are acknowledgements only."""
    terms = F.filter(F.transform(F.split(label, "/"), lambda t: F.trim(t)), lambda t: t != "")
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0))
    junk = F.filter(terms, lambda t: (F.size(words(t)) > 0) & F.forall(words(t), lambda w: w.isin(*ACK_WORDS)))
    return F.size(junk) / F.greatest(F.size(terms), F.lit(1))


def near_duplicate_key(text: Column) -> Column:
    """Lower case, without punctuation and digits."""
    t = F.regexp_replace(F.lower(normalize_text(text)), r"[^\p{L}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def keyword_hit(text: Column, groups: list[list[str]]) -> Column:
    """Whether every group has a keyword somewhere in the text, in either case."""
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(True)
    for group in groups:
        one = F.lit(False)
        for word in group:
            one = one | F.contains(low, F.lit(word.lower()))
        hit = hit & one
    return hit


def unescaped(text: Column) -> Column:
    """Text for display: named and numbered HTML references as their characters, once."""
    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    # Few texts have any: only these leave the JVM's side of the row.
    return F.when(F.contains(text, F.lit("&")), read(text)).otherwise(text)


def enough_words(text: Column, least: int, stop: tuple[str, ...] = ()) -> Column:
    """Whether a segment has words enough to be clustered."""
    return content_words(text, stop) >= least
