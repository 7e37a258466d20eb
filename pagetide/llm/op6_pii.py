"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All in DataFrame operations. A pattern's matches come with their places: the text is split at the
matches and the lengths of gaps and matches are summed up. Patterns that would repeat a group
without bound (domains, digits with separators) run on a copy of the text in which the repeated
separator is one marked letter of the same length, so each is a run over one character class:
linear, and without deep recursion on very long texts.

Kinds: email, ip (parts to 255), card (13-19 digits, Luhn), phone (9-15 digits) always stay. iban
(its country's length, mod-97), ssn and secret (long hexadecimal strings) are added; an added span needs a score of
`least_score`. In the `near` characters on both sides, words such as "account", "social security" or "token" raise
the score and words such as "example" or "version" lower it; every span carries its score.

Defined results: null counts as empty; a text without spans has the empty string's digest; each row
is searched, whole; a column named pii is replaced. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\ue000"
M = "\\x{E000}"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Words that speak against a span, and what they take off its score.
DOUBT, LESS = "example|sample|dummy|fake|placeholder|version|isbn|build", 0.4

#: kind: (cheap test, pattern of separators to mark, pattern, score, score added by context, context words)
KINDS = {
    "email": ("@", "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", f"(?:\\G|(?<![A-Za-z0-9._%+{M}-]))[A-Za-z0-9._%+{M}-]++@[A-Za-z0-9-]++{M}[A-Za-z0-9{M}-]++", 0.9, 0.1, "mail|contact|write"),
    "ip": ("[0-9]\\.[0-9]++\\.[0-9]", None, "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", 0.6, 0.3, "ip|address|host|server"),
    "card": ("[0-9][0-9 -]{11,}+", "(?<=[0-9])[\\x20-](?=[0-9])", f"[0-9][0-9{M}]++", 0.8, 0.2, "card|visa|credit|payment"),
    "phone": ("\\+[0-9]", None, "\\+[0-9][\\x20().0-9-]+[0-9]", 0.7, 0.2, "call|phone|tel|fax|mobile"),
    "iban": ("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{2}", None, f"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", 0.8, 0.2, "iban|account|bank|konto"),
    "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", None, "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, 0.5, "ssn|social|security"),
    "secret": ("[A-Fa-f0-9]{32}", None, "(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])", 0.3, 0.5, "token|secret|key|password|passwd"),
}


def luhn(hit: Column) -> Column:
    """13 to 19 digits (other characters left out) whose Luhn sum is a multiple of ten."""
    d = F.regexp_replace(hit, "[^0-9]", "")
    one = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, one(i)).when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i)))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def mod97(hit: Column) -> Column:
    """Whether an IBAN (spaces left out) leaves 1 when divided by 97."""
    s = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))
    digits = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(digits, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.length(s).between(15, 34) & (rest == 1)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(f"\\A{_PART}(?:\\.{_PART}){{3}}\\z")
    if kind == "card":
        return luhn(hit)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    return mod97(hit) if kind == "iban" else F.lit(True)


def find_pii(docs: DataFrame, text_col: str = "text", near: int = 40, least_score: float = 0.5) -> DataFrame:
    """docs with pii: array of (kind, start, end, score), by kind as listed, then start; and base_n, how many of each base kind."""
    keep = docs.columns
    x = docs.withColumn("__x", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for kind, (test, mark, pattern, score, more, context) in KINDS.items():
        may = F.instr("__x", "@") > 0 if kind == "email" else F.col("__x").rlike(test)
        own = F.regexp_replace(F.translate("__x", MARK, "\""), mark, MARK) if mark else F.col("__x")
        x = x.withColumn("__m", F.when(may, own))
        x = x.withColumn("__h", F.when(F.col("__m").isNotNull(), F.regexp_extract_all("__m", F.lit(pattern), F.lit(0))))
        x = x.withColumn("__h", F.when(F.size("__h") > 0, F.col("__h"))).withColumn("__g", F.when(F.col("__h").isNotNull(), F.split("__m", pattern, -1)))
        at = F.expr(
            "aggregate(sequence(0, size(__h) - 1), named_struct('p', 0, 'o', cast(array() as array<struct<s:int,e:int,hit:string>>)), (a, i) -> named_struct("
            "'p', a.p + length(__g[i]) + length(__h[i]), 'o', array_append(a.o, named_struct('s', a.p + length(__g[i]), 'e', a.p + length(__g[i]) + length(__h[i]), 'hit', __h[i]))), a -> a.o)"
        )
        x = x.withColumn("__o", F.when(F.col("__h").isNotNull(), at))
        good = F.filter("__o", lambda o: _valid(kind, o["hit"]))
        before = lambda o: F.substring(F.col("__x"), F.greatest(o["s"] - near, F.lit(0)) + 1, F.least(o["s"], F.lit(near)))
        around = lambda o: F.lower(F.concat(before(o), F.lit("\n"), F.substring(F.col("__x"), o["e"] + 1, F.lit(near))))
        word = lambda w: f"(?<![a-z])(?:{w})"
        rated = lambda o: F.greatest(F.lit(0.0), F.lit(score) + F.when(around(o).rlike(word(context)), more).otherwise(0.0) - F.when(around(o).rlike(word(DOUBT)), LESS).otherwise(0.0))
        told = F.transform(good, lambda o: F.struct(F.lit(kind).alias("kind"), o["s"].alias("start"), o["e"].alias("end"), F.round(rated(o), 3).alias("score")))
        if kind in ADDED:
            told = F.filter(told, lambda s: s["score"] >= least_score)
        x = x.withColumn(f"__{kind}", F.coalesce(told, F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")))
    return x.select(*(c for c in keep if c != "pii"), F.concat(*(f"__{k}" for k in KINDS)).alias("pii"))


def span_text(pii: Column) -> Column:
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def score_text(pii: Column) -> Column:
    """Scores in the order of the spans, two decimals each."""
    return F.array_join(F.transform(pii, lambda s: F.format_number(s["score"], 2)), ",")


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    keep = docs.columns
    x = find_pii(docs.select(F.struct(*keep).alias("__row"), F.col(text_col).alias("__text")), "__text", **options)
    x = x.withColumn("__s", F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))))
    done = F.expr(
        "aggregate(__s, named_struct('p', 0, 'o', ''), (a, s) -> named_struct('p', greatest(a.p, s.e), 'o', "
        "if(s.s < a.p, a.o, concat(a.o, substring(__text, a.p + 1, s.s - a.p), '[', upper(s.k), ']'))), a -> concat(a.o, substring(__text, a.p + 1)))"
    )
    text = F.when(F.size("__s") > 0, done).otherwise(F.col("__text"))
    return x.select(*(text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in keep))
