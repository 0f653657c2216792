"""Spans of regular-expression matches in texts, with DataFrame functions only.

Spark gives the matches of a pattern and the gaps between them, but not their places. The places
(in code points) are running sums of the lengths of gaps and matches.

Patterns are Java's. So that no text makes them slow or deep, they use possessive quantifiers and
look behind for the start of a run instead of retrying inside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,rank:int,start:int,end:int,score:double>"


#: Matches whose places are summed in one go.
BLOCK = 256
#: Characters before and after a span in which context counts, and those of a piece of text.
NEAR = 48
PIECE = 64


@dataclass(frozen=True)
class Kind:
    """A kind of span.

    check(match, near): whether a match counts; near is the NEAR characters of the text before it
    and after it, whatever else matches there. score(match, near): its score, 0 to 1. hint: text
    that every match contains, to skip the others cheaply.
    """

    name: str
    pattern: str
    check: Callable[[Column, Column], Column]
    score: Callable[[Column, Column], Column] = lambda match, near: F.lit(1.0)
    hint: str = ""


def spans(text: Column, kind: Kind, rank: int) -> Column:
    """array<SPAN> of the matches of a kind that pass its check, in their order."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    placed = _placed(pairs)

    def name(pieces: Column) -> Column:
        kept = F.filter(placed, lambda x: kind.check(x["m"], _near(pieces, x["s"], x["e"])))
        return F.transform(
            kept,
            lambda x: F.struct(
                F.lit(kind.name).alias("kind"),
                F.lit(rank).alias("rank"),
                x["s"].alias("start"),
                x["e"].alias("end"),
                kind.score(x["m"], _near(pieces, x["s"], x["e"])).alias("score"),
            ),
        ).cast(f"array<{SPAN}>")

    # a variable of a lambda, so that a text is cut into pieces once
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    named = F.flatten(F.transform(F.array(pieces), name))
    some = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike(kind.pattern)
    some = some & (F.size(matches) > 0)
    return F.when(some, named).otherwise(F.array().cast(f"array<{SPAN}>"))


def _near(pieces: Column, start: Column, end: Column) -> Column:
    """The NEAR characters before start and those after end, by way of the pieces they lie in: a
    substring of all of a long text would be counted from its first character for each match."""
    first = F.greatest(start - NEAR, F.lit(0))
    held = lambda at: F.array_join(F.slice(pieces, F.floor(at / PIECE).cast("int") + 1, F.lit(2)), "")
    return F.concat(F.substring(held(first), first % PIECE + 1, start - first), F.lit("\n"), F.substring(held(end), end % PIECE + 1, F.lit(NEAR)))


def _placed(pairs: Column) -> Column:
    """(m, s, e) of each (gap, match): the match, its start and end.

    Running sums go by blocks of BLOCK: an array that grows by one is copied each time, so one
    pass over all of a text with very many matches would cost their square.
    """
    out = "array<struct<m:string,s:int,e:int>>"
    count = F.ceil(F.size(pairs) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
    width = lambda p: F.char_length(p["gap"]) + F.char_length(p["match"])
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, p: (acc + width(p)).cast("int")))
    firsts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x).cast("int"))))

    def step(acc: Column, pair: Column) -> Column:
        at = (acc["at"] + F.char_length(pair["gap"])).cast("int")
        end = (at + F.char_length(pair["match"])).cast("int")
        one = F.struct(pair["match"].alias("m"), at.alias("s"), end.alias("e"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one).cast(out)).alias("out"))

    def block(x: Column) -> Column:
        start = F.struct(x["first"].alias("at"), F.array().cast(out).alias("out"))
        return F.aggregate(x["pairs"], start, step, lambda acc: acc["out"])

    zipped = F.zip_with(blocks, F.slice(firsts, F.lit(1), count), lambda b, f: F.struct(b.alias("pairs"), f.alias("first")))
    return F.flatten(F.transform(zipped, block))


def _in_order(found: Column, by_kind: bool, value) -> Column:
    first, second = ("rank", "start") if by_kind else ("start", "rank")
    keyed = F.transform(found, lambda x: F.struct(x[first].alias("a"), x[second].alias("b"), value(x).alias("v")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["v"]), ",")


def joined(found: Column, by_kind: bool) -> Column:
    """kind:start:end of the spans, comma-joined, by kind then start or by start then kind."""
    return _in_order(found, by_kind, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))


def scores(found: Column, by_kind: bool) -> Column:
    """The spans' scores to two places, in the order of joined()."""
    return _in_order(found, by_kind, lambda x: F.format_number(x["score"], 2))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_sql(kinds: list[tuple[str, str, str]], by_kind: bool) -> str:
    """SQL of the base spans of documents: kinds are (name, pattern, condition on a match m)."""
    found = []
    for rank, (name, pattern, condition) in enumerate(kinds):
        quoted = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""
  SELECT doc_id, {rank} AS rank, '{name}' AS kind, e - length(m) AS s, e FROM (
    SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), {quoted}) AS ms, regexp_split_to_array(coalesce(text, ''), {quoted}) AS gs FROM documents) WHERE len(ms) > 0))
  WHERE {condition.replace("PATTERN", quoted)}""")
    order = "rank, s" if by_kind else "s, rank"
    counts = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in kinds)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{name}') AS n_{name}" for name, _, _ in kinds)
    return f"""
WITH x AS ({" UNION ALL ".join(found)}
), a AS (
  SELECT doc_id, {sums}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY {order}) AS v FROM x GROUP BY doc_id
)
SELECT doc_id, {counts}, sha256(coalesce(v, '')) AS base_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""
