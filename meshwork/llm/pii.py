"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Base kinds (email, ip, card, phone) are kept as their patterns and checks
say, whatever their score. The method adds two kinds, which need their evidence to be kept: iban
(country, check digits, and the number modulo 97) and national_id (three, two and four digits, which
no checksum confirms, so that a context word must be near).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .spans import SPAN, Kind, base_sql, digits, joined, scores, spans

#: Words that count within NEAR characters of a span, before it or after it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "\\bip\\b|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|\\btel\\b|mobile|fax|telefon",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "national_id": "ssn|social|security|national id|taxpayer",
}
#: What pattern and checksum alone are worth, and what a context word adds.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
BONUS = 0.3

#: Characters of an IBAN by country, so that words after one aren't taken into it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(c for countries in IBAN_LENGTHS.values() for c in countries.split())
_SIZED = "|".join(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(number)),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit((F.ascii(F.substring(backwards, i, F.lit(1))) - 48).cast("int"), i),
    )
    return total % 10 == 0


def _luhn_digit(d: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2).cast("int")


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.char_length(moved)),
        F.lit(0),
        lambda acc, i: _append97(acc, F.ascii(F.substring(moved, i, F.lit(1)))),
    )
    return rest == 1


def _append97(acc: Column, code: Column) -> Column:
    return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97).cast("int")


def _octets(match: Column) -> Column:
    short = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))


def _length(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _score(kind: str):
    def score(match: Column, near: Column) -> Column:
        named = F.lower(near).rlike(CONTEXT[kind])
        return F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(named, F.lit(BONUS)).otherwise(F.lit(0.0)))

    return score


KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m, b: F.lit(True),
        _score("email"),
        "@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m, b: _octets(m), _score("ip")),
    # shorter runs fail the check on the number of digits, so they needn't be proposed
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){15,}+", lambda m, b: _length(F.char_length(digits(m)), 16, 19) & luhn(digits(m)), _score("card")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, b: _length(F.char_length(digits(m)), 8, 15), _score("phone"), "+"),
]
ADDED = [
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?:{_SIZED}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
        lambda m, b: mod97(F.regexp_replace(m, " ", "")),
        _score("iban"),
    ),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", lambda m, b: _score("national_id")(m, b) >= 0.5, _score("national_id")),
]


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and added (spans with kind, start, end, score).

    Places are code points, ends exclusive; spans of one kind do not overlap.

    Defined cases: null and empty texts have no spans; repeated rows are scanned each by itself;
    texts of any length are scanned whole, in time that grows with their length; an empty table
    gives an empty table; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(*(spans(text, k, i) for i, k in enumerate(KINDS)))
    added = F.concat(*(spans(text, k, len(KINDS) + i) for i, k in enumerate(ADDED)))
    return rows.select("doc_id", base.cast(f"array<{SPAN}>").alias("base"), added.cast(f"array<{SPAN}>").alias("added"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in KINDS),
        F.sha2(joined(F.col("base"), by_kind=True), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), by_kind=True).alias("spans"),
        scores(F.concat("base", "added"), by_kind=True).alias("scores"),
    )


def base_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: counts and places of the base kinds."""
    return op7_pii(spark, sf_dir).drop("spans", "scores")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER > 4 THEN 2 * x::INTEGER - 9 ELSE 2 * x::INTEGER END)) % 10 = 0"""
BASE_SQL = base_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ],
    by_kind=True,
)
