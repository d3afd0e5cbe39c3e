"""Answers of a language model: JSON that may be broken, wrapped or of another shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(values: Column, good) -> Column:
    return F.get(F.filter(values, good), F.lit(0))


def _value(v: Column) -> Column:
    """A value as it is, or what it holds as a JSON text; null if that can't be read."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(text)).otherwise(v)


def _outputs(body: Column) -> Column:
    """The values of all items of result.documents[].output[] but those for reasoning."""
    documents = F.try_variant_get(F.try_parse_json(body), "$.result.documents", "array<variant>")
    items = F.flatten(F.transform(F.coalesce(documents, F.array().cast("array<variant>")), lambda d: F.coalesce(F.try_variant_get(d, "$.output", "array<variant>"), F.array().cast("array<variant>"))))
    objects = F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT") & ~F.coalesce(F.try_variant_get(i, "$.key", "string") == "reasoning", F.lit(False)))
    return F.transform(objects, lambda i: F.try_variant_get(i, "$.value", "variant"))


def answer_object(body: Column) -> Column:
    """The first object among a response's values, as a variant; null if there is none.
    Texts are read as JSON; those that can't be are passed over."""
    return _first(F.transform(_outputs(body), _value), lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))


def label_answer(body: Column) -> Column:
    """A struct of label, description, is_substantive and confidence; null without a
    label. A text that isn't JSON is a label by itself. The label loses final full stops;
    what isn't a boolean is null, and so is a confidence that is no number, which else is
    put between 0 and 1."""

    def read(v: Column) -> Column:
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        plain = text.isNotNull() & F.try_parse_json(text).isNull()
        return F.struct(plain.alias("plain"), F.trim(text).alias("text"), _value(v).alias("o"))

    label = lambda x: F.try_variant_get(x["o"], "$.label", "string")
    is_object = lambda x: F.coalesce(F.schema_of_variant(x["o"]).startswith("OBJECT"), F.lit(False))
    usable = lambda x: x["plain"] | (is_object(x) & F.coalesce(label(x) != "", F.lit(False)))
    picked = F.transform(F.array(_first(F.transform(F.filter(_outputs(body), lambda v: v.isNotNull()), read), usable)), lambda x: x)
    number = lambda x: F.coalesce(F.try_variant_get(x["o"], "$.confidence", "double"), F.try_to_number(F.try_variant_get(x["o"], "$.confidence", "string"), F.lit("9.999999")).cast("double"))
    flag = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x["o"], "$.is_substantive", "variant")) == "BOOLEAN", F.try_variant_get(x["o"], "$.is_substantive", "boolean"))
    empty = lambda c: F.when(c != "", c)

    def settle(x: Column) -> Column:
        name = F.rtrim(F.trim(F.when(x["plain"], x["text"]).otherwise(label(x))), F.lit("."))
        return F.when(
            F.coalesce(F.when(x["plain"], x["text"]).otherwise(label(x)) != "", F.lit(False)),
            F.struct(
                name.alias("label"), F.when(~x["plain"], empty(F.trim(F.try_variant_get(x["o"], "$.description", "string")))).alias("description"),
                F.when(~x["plain"], flag(x)).alias("is_substantive"), F.when(~x["plain"] & number(x).isNotNull(), F.least(F.greatest(number(x), F.lit(0.0)), F.lit(1.0))).alias("confidence"),
            ),
        )

    return F.get(F.transform(picked, settle), F.lit(0))
