"""Secrets: patterns, and strings whose characters look drawn at random.

DataFrame functions only. Base kinds (assign, access, hex) are what their patterns and checks say.
The method adds `entropy`: candidate strings are runs of the characters that keys are written in.
A window of WINDOW characters slides over a candidate; the counts of the characters in it, and
with them the sum of c * log2(c), are updated for the character that comes in and the one that
goes out, so that a step costs the same for any window. The largest Shannon entropy of a window
is held against the threshold of the candidate's character class. Candidates on the allow-list
(placeholders, identifiers that are meant to be seen) are suppressed.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .spans import SPAN, Kind, base_sql, joined, spans

WINDOW = 20
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: (class, pattern of the whole candidate, least bits per character), the first class that fits.
#: A window of random hexadecimal digits has 3.4 bits on average, of random letters and digits 4.0.
#: 99 of 100 windows of 20 random characters have at least 2.5 bits for an alphabet of 10, 2.9 for
#: 16, 3.2 for 26, 3.3 for 32, 3.4 for 36 and 3.6 for 62; no window of 20 has more than 4.3.
CLASSES = [
    ("digits", "^[0-9]+$", 2.5),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("mixed", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*$", 3.6),
    ("lower_digits", "^[0-9a-z]*[0-9][0-9a-z]*$", 3.3),
    ("upper_digits", "^[0-9A-Z]*[0-9][0-9A-Z]*$", 3.3),
    ("letters", "^[A-Za-z]+$", 3.2),
    ("symbols", "", 3.3),
]
#: Classes in which words and paths are written too.
WORDY = ("lower_digits", "upper_digits", "letters", "symbols")
#: Patterns of strings that are no secrets: placeholders, runs of the keyboard, UUIDs.
ALLOW_LIST = (
    "(?i)example|sample|placeholder|changeme|dummy|your[_-]?|xxxx|0123456789|123456789|abcdefgh|deadbeef"
    "|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
#: What words and paths are made of: separators, words in any case, short numbers, and short
#: pieces that stand alone.
WORD_PARTS = "[+/_=-]++|[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+|(?<![0-9])[0-9]{1,8}+(?![0-9])|(?<![A-Za-z0-9])[A-Za-z]{1,2}+[0-9]{0,4}+(?![A-Za-z0-9])"


def _word(word: str) -> str:
    """A pattern of a word in either case of its ASCII letters, and of those alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_word(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?"


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of a window (of all, if it is shorter)."""
    size = F.least(F.char_length(candidate), F.lit(window))
    term = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    state = "struct<counts:array<int>,sum:double,least:double>"
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least")
    ).cast(state)

    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), size), codes), F.lit(1), F.char_length(candidate))
    # (place, symbol that comes in, symbol that goes out); 0 is none
    moves = F.transform(F.arrays_zip(codes.alias("into"), leaving.alias("out")), lambda p, i: F.struct(i.alias("i"), p["into"].alias("into"), p["out"].alias("out")))

    def step(acc: Column, move: Column) -> Column:
        into, out = move["into"], move["out"]
        c_in, c_out = F.get(acc["counts"], into), F.get(acc["counts"], out)
        # a character that leaves as its like comes in changes nothing
        moved = acc["sum"] + F.get(term, c_in + 1) - F.get(term, c_in) + F.when(out > 0, F.get(term, c_out - 1) - F.get(term, c_out)).otherwise(F.lit(0.0))
        total = F.when(into == out, acc["sum"]).otherwise(moved)
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == into, 1).otherwise(0) - F.when((k == out) & (out > 0), 1).otherwise(0))
        return F.struct(
            counts.alias("counts"), total.alias("sum"), F.when(move["i"] >= size - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least")
        ).cast(state)

    return F.aggregate(moves, start, step, lambda acc: F.log2(size.cast("double")) - acc["least"] / size)


def _of_class(candidate: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (_, pattern, _), value in reversed(list(zip(CLASSES[:-1], values, strict=False))):
        out = F.when(candidate.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def threshold(candidate: Column) -> Column:
    return _of_class(candidate, [least for _, _, least in CLASSES])


def words(candidate: Column) -> Column:
    """Whether a candidate is made of words, as names and paths are: of word parts only, with the
    vowels of a language (a quarter of the sounds at least; sch, ch and the like are one), no six
    consonants in a row, and few rare letters (j, q, x, z: one in 20; they are one in 6.5 of letters
    drawn at random)."""
    letters = F.lower(F.regexp_replace(candidate, "[^A-Za-z]", ""))
    n = F.char_length(letters)
    count = lambda kind: F.char_length(F.regexp_replace(letters, f"[^{kind}]", ""))
    sounds = F.regexp_replace(letters, "sch|[cpst]h|ck|ss", "s")
    spoken = (count("aeiouy") * 4 >= F.char_length(sounds)) & (count("jqxz") * 20 <= n) & ~sounds.rlike("[bcdfghjklmnpqrstvwxz]{6}")
    return (F.regexp_replace(candidate, WORD_PARTS, "") == "") & spoken


def _is_random(m: Column, _before: Column) -> Column:
    # the characters that occur bound the entropy, at the cost of one look
    reachable = F.log2(F.size(F.array_distinct(F.split(m, ""))).cast("double")) >= threshold(m)
    wordy = _of_class(m, [name in WORDY for name, _, _ in CLASSES])
    return reachable & ~m.rlike(ALLOW_LIST) & ~(wordy & words(m)) & (window_entropy(m) >= threshold(m))


KINDS = [
    Kind("assign", rf"{_ASSIGN}[A-Za-z0-9+/_.=-]++", lambda m, b: F.char_length(F.regexp_replace(m, f"^{_ASSIGN}", "")) >= 12),
    # shorter runs fail the check on the length, so they needn't be proposed
    Kind("access", "AKIA[A-Z0-9]{14,}+", lambda m, b: F.lit(True), hint="AKIA"),
    Kind("hex", "(?<![0-9a-f])[0-9a-f]{16,}+", lambda m, b: F.lit(True)),
]
ADDED = [Kind("entropy", f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+", _is_random)]


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and added (spans with kind, start, end).

    Places are code points, ends exclusive; spans of one kind do not overlap.

    Defined cases: null and empty texts have no spans; repeated rows are scanned each by itself;
    texts of any length are scanned whole; a candidate shorter than the window has none; an empty
    table gives an empty table; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(*(spans(text, k, i) for i, k in enumerate(KINDS)))
    added = F.concat(*(spans(text, k, len(KINDS) + i) for i, k in enumerate(ADDED)))
    return rows.select("doc_id", base.cast(f"array<{SPAN}>").alias("base"), added.cast(f"array<{SPAN}>").alias("added"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in KINDS),
        F.sha2(joined(F.col("base"), by_kind=False), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), by_kind=False).alias("spans"),
    )


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: counts and places of the base kinds."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


BASE_SQL = base_sql(
    [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, PATTERN, 1)) >= 12"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
        ("hex", "[0-9a-f]+", "length(m) >= 16"),
    ],
    by_kind=False,
)
