"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is built-in expressions. Spans come from a text's parts between the matches: their lengths, summed up, give the
places, in code points. The patterns are written so that a matcher never tries a run of characters twice, which keeps
very long runs linear, and find the same spans as the plain patterns in the comments.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The kinds in order, their patterns, and the words that speak for or against them.
# email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# card   [0-9]([\x20-]?[0-9])+ with 13 to 19 digits: such a run begins where no run goes on
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
# phone  \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# iban   added here: country, check digits, and as many characters as the country has, in groups or not, so what follows is
#        left out; 11 to 30 where the country is in no list
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_LENGTH = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items())
_LISTED = "|".join(LENGTHS.values()).replace(" ", "|")
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_LENGTH}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
# ssn    added here: confirmed by its ranges and, for want of a checksum, by a word nearby
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
WORDS = {
    "email": "mail|contact|write|address|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|client|peer",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|sozialversicherung|sécurité sociale|seguridad social",
}
AGAINST = "example|sample|test|dummy|fake|placeholder"
#: Code points looked at before a span.
NEAR = 40


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits pass Luhn's test."""
    cells = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(cells, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an IBAN leaves 1 by 97: its first four characters moved behind, letters as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda a, c: F.when(c == "", a).otherwise(F.when(c.between("A", "Z"), a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, found: Column, before: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    if kind == "iban":
        code = F.regexp_replace(found, " ", "")
        return F.length(code).between(15, 34) & mod97(code)
    if kind == "ssn":
        area, group, serial = (F.split_part(found, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
        return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000") & F.lower(before).rlike(WORDS["ssn"])
    return F.lit(True)


#: With a character without which there is no match, and the score of a confirmed span with no word nearby.
PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, ""), "phone": (PHONE, "+"), "iban": (IBAN, ""), "ssn": (SSN, "-")}
SURE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.5}


def scanned(values: Column, join: Callable[[Column, Column], Column], steps: Column) -> Column:
    """The running result of an associative `join` along an array, by doubling: after step k each element spans 2k of them."""

    def doubled(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= k, join(F.get(acc, i - k), x)).otherwise(x))

    return F.aggregate(steps, values, doubled)


def located(df: DataFrame, text: str, pattern: str, found: str, out: str, near: int, after: int = 0) -> DataFrame:
    """df with `out`: array<struct<start, end, found, before, after>> of a pattern's matches in `text`, given as `found`.

    end is exclusive; places are code points. A text is split once; what a match costs does not grow with its text: ends
    are a running sum of the lengths of gaps and matches, and `before` is a running concatenation cut to `near`. That
    spans 16 matches back, and so is exact where a match and the gap before it have near / 16 code points or more. `after`
    is cut from the next gap and match.
    """
    (gaps,) = common.fresh(df, "gaps")
    all_found, between = F.col(found), F.col(gaps)
    df = df.withColumn(gaps, F.when(F.size(all_found) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.expr("cast(array() AS array<string>)")))
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    lengths = F.transform(all_found, lambda f, i: F.length(F.get(between, i)) + F.length(f))
    ends = scanned(lengths, lambda a, b: a + b, F.filter(powers, lambda k: k < F.size(all_found)))
    pieces = F.transform(all_found, lambda f, i: F.right(F.concat(F.coalesce(F.get(all_found, i - 1), F.lit("")), F.get(between, i)), F.lit(near)))
    before = scanned(pieces, lambda a, b: F.right(F.concat(a, b), F.lit(near)), F.array(*[F.lit(1 << k) for k in range(4)]))
    behind = F.transform(all_found, lambda f, i: F.left(F.concat(F.get(between, i + 1), F.coalesce(F.get(all_found, i + 1), F.lit(""))), F.lit(after)))
    zipped = F.arrays_zip(all_found.alias("found"), ends.alias("end"), before.alias("before"), behind.alias("after"))
    span = lambda x: F.struct((x["end"] - F.length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after"))
    none = F.expr("cast(array() AS array<struct<start:int,end:int,found:string,before:string,after:string>>)")
    return df.withColumn(out, F.when(F.size(all_found) > 0, F.transform(zipped, span)).otherwise(none)).drop(gaps)


def _kept(kind: str, x: Column) -> Column:
    return confirmed(kind, x["found"], x["before"])


def _is(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def scan(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with `out`: array<struct<kind, start, end, found, score>> by kind as KINDS lists them, then start.

    Null and empty texts have an empty array. A match that its checksum or range refuses is dropped, and nothing is tried
    in its place. Scores lie in 0..1: what the kind's checks alone are worth, more with a word of the kind shortly before
    it, less with one such as "example". A column of df named `out` is replaced.
    """
    df = df.drop(out)
    (body, *cols) = common.fresh(df, "body", *KINDS, *[f"{k}_at" for k in KINDS])
    found, at = cols[: len(KINDS)], cols[len(KINDS) :]
    df = df.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    for k, name in zip(KINDS, found):
        pattern, hint = PATTERNS[k]
        df = df.withColumn(name, F.when(F.contains(F.col(body), F.lit(hint)), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() AS array<string>)")))
    parts = []
    for k, name, place in zip(KINDS, found, at):
        df = located(df, body, PATTERNS[k][0], name, place, NEAR)

        def scored(k: str, x: Column) -> Column:
            words = F.lower(x["before"])
            score = F.lit(SURE[k]) + F.when(words.rlike(rf"(?<![\p{{L}}])(?:{WORDS[k]})"), 0.2).otherwise(0.0) - F.when(words.rlike(rf"(?<![\p{{L}}])(?:{AGAINST})"), 0.3).otherwise(0.0)
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("score"))

        parts.append(F.transform(F.filter(F.col(place), partial(_kept, k)), partial(scored, k)))
    return df.withColumn(out, F.concat(*parts)).drop(body, *cols)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their spans, all spans, and the highest score (0: none)."""
    found = scan(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    counts = [F.size(F.filter("pii", partial(_is, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda x: x["kind"].isin(BASE))
    best = F.aggregate("pii", F.lit(0.0), lambda a, x: F.greatest(a, x["score"]))
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), best.alias("max_score"))
