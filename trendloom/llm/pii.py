"""PII: format-preserving Feistel pseudonyms, with DataFrame operations only.

Numbers and dates are found by form and then validated (Luhn digit, IBAN remainder,
calendar, octet and area ranges). What is valid is permuted within its own form by a
keyed Feistel network of ``ROUNDS`` rounds whose round function is SHA-256 over a key
of the kind's own (derived from the caller's, and joined as a row of its own, so that no
plan has either), round and the other half. The two halves are residues of moduli whose product is
exactly the number of valid values, so that the map is one-to-one within a kind, needs
no retries, and equal values stay equal in all documents. Check digits are made anew.

    card       13 to 19 digits: all but the Luhn digit
    ssn        898 areas x (99 groups x 9999 serials)
    ipv4       2**16 x 2**16
    phone      the digits behind the country code, however it is set apart; numbers
               without one are as those of country 1
    iban       digits and letters behind country and check digits, each in their places
               and their own alphabet; check digits anew
    date       1900 to 2099: 200 years x 365 days, leap days 7 x 7 among themselves,
               the same in all orders of day, month and year

E-mail addresses have no numeric form; they become a keyed digest at ``MAIL_DOMAIN``,
equal for equal addresses whatever their case.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
MAIL_DOMAIN = "pseudonym.invalid"
#: For tests and benchmarks; production passes its own.
DEMO_KEY = "demonstration key"

# One- and two-digit country codes of telephone numbers (others have three).
COUNTRIES = ("1", "7"), tuple(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(
    rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items()
)

# What each kind looks like (Java regular expressions).
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MONTH, DAY, YEAR = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:19|20)[0-9][0-9]"
FORMS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ymd": rf"(?<![\p{{L}}\p{{N}}./-]){YEAR}(?:-{MONTH}-{DAY}|/{MONTH}/{DAY}|\.{MONTH}\.{DAY})(?![\p{{L}}\p{{N}}&&[^T]]|T(?![0-9]{{2}})|[./-][0-9])",
    "dmy": rf"(?<![\p{{L}}\p{{N}}./-])(?:{DAY}-{DAY}-|{DAY}/{DAY}/|{DAY}\.{DAY}\.){YEAR}(?![\p{{L}}\p{{N}}]|[./-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{IBAN})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(FORMS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def subkey(key: str, kind: str) -> str:
    """A key for one kind of values, from which the caller's key can't be found."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


#: Kinds of values with keys of their own.
KEYED = ("mail", "ipv4", "date", "leap day", "ssn", "card", "phone", "iban", "iban letters")


def _keys(spark: SparkSession, key: str) -> DataFrame:
    """One row: _pii_keys, a struct of the keys of all kinds. They are data of a join, so
    that no plan, explained or logged, has them."""
    names = ", ".join(f"`{k}` string" for k in KEYED)
    return spark.createDataFrame([(tuple(subkey(key, k) for k in KEYED),)], f"_pii_keys struct<{names}>")


def _feistel(kind: str, a: str, b: str, ma: str, mb: str, done: str) -> str:
    """SQL: permutes the pair (a mod ma, b mod mb); done is an expression over s.a, s.b."""
    noise = lambda half: f"cast(conv(substr(sha2(concat_ws('|', _pii_keys.`{kind}`, cast({ma} as string), cast(i as string), cast({half} as string)), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), "
        f"(s, i) -> named_struct('a', if(i % 2 = 0, (s.a + {noise('s.b')}) % {ma}, s.a), 'b', if(i % 2 = 0, s.b, (s.b + {noise('s.a')}) % {mb})), "
        f"s -> {done})"
    )


def _digits(kind: str, d: str) -> str:
    """SQL: permutes a string of 1 to 36 digits among those of its length."""
    u = f"cast(length({d}) div 2 as int)"
    v = f"(length({d}) - {u})"
    power = lambda n: f"cast(pow(10, {n}) as bigint)"
    done = f"concat(lpad(cast(s.a as string), {u}, '0'), lpad(cast(s.b as string), {v}, '0'))"
    first = f"if({u} = 0, '0', substr({d}, 1, {u}))"
    return _feistel(kind, first, f"substr({d}, {u} + 1)", power(u), power(v), done)


def _letters(kind: str, text: str) -> str:
    """SQL: permutes a string of 1 to 24 capitals among those of its length."""
    capitals, places = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'0123456789ABCDEFGHIJKLMNOP'"
    u = f"cast(length({text}) div 2 as int)"
    v = f"(length({text}) - {u})"
    number = lambda part: f"conv(translate({part}, {capitals}, {places}), 26, 10)"
    power = lambda n: f"cast(pow(26, {n}) as bigint)"
    spelt = lambda half, n: f"lpad(conv(cast({half} as string), 10, 26), {n}, '0')"
    done = f"translate(concat({spelt('s.a', u)}, {spelt('s.b', v)}), {places}, {capitals})"
    first = f"if({u} = 0, '0', {number(f'substr({text}, 1, {u})')})"
    return _feistel(kind, first, number(f"substr({text}, {u} + 1)"), power(u), power(v), done)


def _refill(form: str, digits: str, skip: str = "0", first: str = "0", last: str = "9") -> str:
    """SQL: the form with its digits (its characters from first to last), but the first
    skip ones, replaced in order."""
    return (
        f"aggregate(split({form}, ''), named_struct('out', '', 'k', 0), (s, c) -> if(c between '{first}' and '{last}', "
        f"named_struct('out', concat(s.out, if(s.k < {skip}, c, substr({digits}, s.k - {skip} + 1, 1))), 'k', s.k + 1), "
        f"named_struct('out', concat(s.out, c), 'k', s.k)), s -> s.out)"
    )


def _luhn_sum(d: str) -> str:
    """SQL: Luhn sum of a digit string whose last digit counts once."""
    digit = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (s, k) -> s + if(k % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))"


def _remainder97(text: str) -> str:
    """SQL: of a string of digits and capitals, with A as 10 and so on."""
    return f"aggregate(split({text}, ''), 0, (s, c) -> if(c between '0' and '9', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _date(y: str, m: str, d: str, form: str) -> str:
    """SQL: form over o.y, o.m, o.d (numbers) after the permutation of a valid date."""
    leap = f"({m} = 2 and {d} = 29)"
    out = lambda y, m, d: _let(f"named_struct('y', {y}, 'm', {m}, 'd', {d})", "o", form)
    day = "date_add(date'2001-01-01', cast(s.b as int))"
    usual = _feistel("date", f"{y} - 1900", f"dayofyear(make_date(2001, {m}, {d})) - 1", "200", "365", out("1900 + s.a", f"month({day})", f"day({day})"))
    leaps = _feistel("leap day", f"({y} - 1904) div 4 div 7", f"({y} - 1904) div 4 % 7", "7", "7", out("(1904 + 4 * (7 * s.a + s.b))", "2", "29"))
    return f"case when {leap} then {leaps} else {usual} end"


def _pseudonym() -> str:
    """SQL over _pii_keys and h, a string of one of the forms: (kind, text), with kind null if h isn't
    valid and so stays."""
    digits = "regexp_replace(h, '[^0-9]', '')"
    full = lambda kind: f"h rlike {_quoted('^(?:' + FORMS[kind] + ')$')}"
    result = lambda kind, text: f"named_struct('kind', {_quoted(kind)}, 'text', {text})"
    none = "named_struct('kind', cast(null as string), 'text', h)"

    address = f"concat('u', substr(sha2(concat(_pii_keys.mail, lower(h)), 256), 1, 16), '@{MAIL_DOMAIN}')"
    octets = "split(h, '[.]')"
    half = lambda i: f"cast({octets}[{i}] as bigint) * 256 + cast({octets}[{i + 1}] as bigint)"
    ipv4 = _feistel("ipv4", half(0), half(2), "65536", "65536", "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)")
    part = lambda i: f"cast(split(h, '[-./]')[{i}] as int)"
    same = lambda i, value: f"if(length(split(h, '[-./]')[{i}]) = 2, lpad(cast({value} as string), 2, '0'), cast({value} as string))"
    mark = "regexp_extract(h, '[-./]', 0)"
    ymd = _date(part(0), part(1), part(2), f"concat(cast(o.y as string), {mark}, {same(1, 'o.m')}, {mark}, {same(2, 'o.d')})")
    real = lambda y, m, d: f"try_cast(concat_ws('-', {y}, lpad(cast({m} as string), 2, '0'), lpad(cast({d} as string), 2, '0')) as date) is not null"
    dmy = _date(part(2), part(1), part(0), f"concat({same(0, 'o.d')}, {mark}, {same(1, 'o.m')}, {mark}, cast(o.y as string))")
    mdy = _date(part(2), part(0), part(1), f"concat({same(0, 'o.m')}, {mark}, {same(1, 'o.d')}, {mark}, cast(o.y as string))")
    area, rest = "cast(substr(h, 1, 3) as bigint)", "((cast(substr(h, 5, 2) as bigint) - 1) * 9999 + cast(substr(h, 8, 4) as bigint) - 1)"
    ssn = _feistel(
        "ssn", f"{area} - if({area} > 666, 2, 1)", rest, "898", "989901",
        "concat(lpad(cast(s.a + if(s.a >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(s.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(s.b % 9999 + 1 as string), 4, '0'))",
    )
    body = _let(_digits("card", f"substr({digits}, 1, length({digits}) - 1)"), "p", _let("concat(p, '0')", "q", f"concat(p, cast((10 - {_luhn_sum('q')} % 10) % 10 as string))"))
    card = _let(body, "r", _refill("h", "r"))
    one, two = (", ".join(map(_quoted, codes)) for codes in COUNTRIES)
    country = f"case when h not like '+%' then 0 when substr({digits}, 1, 1) in ({one}) then 1 when substr({digits}, 1, 2) in ({two}) then 2 else 3 end"
    country = f"({country})"
    phone = _let(_digits("phone", f"substr({digits}, {country} + 1)"), "p", _refill("h", "p", country))
    plain = "replace(h, ' ', '')"
    # Digits and letters behind the check digits are permuted in their own places: forms have
    # up to 29 of either; 24 letters are what two halves of 64 bits hold, so more are
    # permuted from both ends.
    body = f"substr({plain}, 5)"
    only = lambda kept: f"regexp_replace({body}, '[^{kept}]', '')"
    numbered = _let(only("0-9"), "d", f"if(d = '', {body}, {_let(_digits('iban', 'd'), 'p', _refill(body, 'p'))})")
    last = f"concat(substr(l, 1, length(l) - least(24, length(l))), {_letters('iban letters', 'right(l, 24)')})"
    first = f"if(length(m) <= 24, m, concat({_letters('iban letters', 'substr(m, 1, 24)')}, substr(m, 25)))"
    spelt = _let(only("A-Z"), "l", f"if(l = '', n, {_let(last, 'm', _let(first, 'p', _refill('n', 'p', '0', 'A', 'Z')))})")
    moved = _let(_let(numbered, "n", spelt), "r", f"concat(substr(h, 1, 2), lpad(cast(98 - {_remainder97('concat(r, substr(h, 1, 2), ' + _quoted('00') + ')')} as string), 2, '0'), r)")
    spaced = "aggregate(split(h, ''), named_struct('out', '', 'k', 1), (s, c) -> if(c = ' ', named_struct('out', concat(s.out, ' '), 'k', s.k), named_struct('out', concat(s.out, substr(w, s.k, 1)), 'k', s.k + 1)), s -> s.out)"
    iban = _let(moved, "w", spaced)
    valid_iban = _remainder97(f"concat(substr({plain}, 5), substr({plain}, 1, 4))") + " = 1"
    return f"""case
        when h like '%@%' then {result("mail", address)}
        when {full("ipv4")} then {result("ipv4", ipv4)}
        when {full("ymd")} then if({real(part(0), part(1), part(2))}, {result("date", ymd)}, {none})
        when {full("dmy")} then case
            when {part(1)} <= 12 and {real(part(2), part(1), part(0))} then {result("date", dmy)}
            when {part(1)} > 12 and {part(0)} <= 12 and {real(part(2), part(0), part(1))} then {result("date", mdy)}
            else {none} end
        when {full("ssn")} then if({area} not in (0, 666) and substr(h, 5, 2) != '00' and substr(h, 8, 4) != '0000', {result("ssn", ssn)}, {none})
        when {full("iban")} then if({valid_iban}, {result("iban", iban)}, {none})
        when {full("card")} and {_luhn_sum(digits)} % 10 = 0 then {result("card", card)}
        when {full("phone")} and length({digits}) - {country} between 6 and 15 and length({digits}) between 8 and 15 then {result("phone", phone)}
        else {none} end"""


def replaced(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with all found values in text_col replaced, and with _pii_kinds: an array of
    the kinds of the values replaced, null if there is nothing that looks like one.
    Other columns stay as they are; their names must not begin with _pii."""
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    keyed = docs.crossJoin(F.broadcast(_keys(docs.sparkSession, key)))  # one row
    done = keyed.withColumn("_pii_hits", found).withColumn("_pii_new", F.expr(f"transform(_pii_hits, h -> {_pseudonym()})"))
    pieces, new = F.split(text, ANY, -1), F.col("_pii_new")
    filled = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(new)), new, lambda p, n: F.concat(p, n["text"])), ""), F.element_at(pieces, -1))
    kinds = F.filter(F.transform(new, lambda n: n["kind"]), lambda k: k.isNotNull())
    return done.withColumns({text_col: F.when(new.isNull(), text).otherwise(filled), "_pii_kinds": kinds}).drop("_pii_keys", "_pii_hits", "_pii_new")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col with all found values replaced, n_pii, pii_kinds (sorted, distinct).

    A null text stays null with n_pii 0; an empty one stays empty. Texts of any length
    are gone through whole. Numbers that look like a form but aren't valid stay. Null
    ids and repeated rows are kept. An empty table gives no rows. Other columns aren't
    read.
    """
    kinds = F.coalesce(F.col("_pii_kinds"), F.array().cast("array<string>"))
    return replaced(docs.select(id_col, text_col), key, text_col).select(
        id_col, text_col, F.size(kinds).cast("long").alias("n_pii"), F.array_sort(F.array_distinct(kinds)).alias("pii_kinds")
    )


def pseudonymised_rows(docs: DataFrame, key: str, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, with all columns, text_col with its values replaced and
    length_col, if there is such a column, as the length of the new text."""
    out = replaced(docs, key, text_col)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col("_pii_kinds").isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out.select(docs.columns)
