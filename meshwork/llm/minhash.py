"""Near-duplicates of word shingles: SetSketch registers, bands, likelihood, verification.

Every distinct set of shingles gets REGISTERS registers. Register i is the truncated minimum of
exponential variates over the set, on a scale of powers of 1 + 1/1000: mergeable by maximum, and
equal in two sets with a probability close to their Jaccard similarity. Bands of BAND registers are
bucket keys; a pair at similarity 0.8 meets in no bucket with a probability of 2e-5.

Buckets give links without all pairs of their members:
1. Rows with the same set are one node.
2. In a few rounds, each bucket that still holds several components names a centre, and its
   members of other components are verified against that centre. Links merge components.
3. After the first round, the shingles of the nodes in open buckets are counted. A shingle that
   one node alone has is in no intersection, which bounds the similarity of that node to any other;
   nodes that can reach the threshold with none leave, and pairs that can't are never made.
4. What is left (members that no centre reached) is compared across components within a bucket,
   each pair once, if bounds and further registers don't rule the link out; so no link between components
   is lost to the choice of centres.
A pair is verified by the likelihood of its registers (given the sizes), which rejects it only
where a similarity at the threshold is four standard deviations away, and then on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import attach, discard, keyed, materialize, read_table, settle, slices, spread, utf8

BAND, BANDS = 5, 28
REGISTERS = BAND * BANDS
#: Further registers of nodes that are compared across components, of which one bit each is kept.
BITS = 1024
#: Scale of the registers: base, rate, and the largest value of a 16-bit register.
BASE, RATE, LARGEST = 1.001, 20.0, 65535

_U = np.uint64
_SEEDS = spread(np.arange(1, 4097, dtype=_U))
_BYTE = spread(np.arange(256, dtype=_U) + _U(10_000))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_XOR, _ODD = _SEEDS[:REGISTERS], _SEEDS[1000 : 1000 + REGISTERS] | _U(1)
_XOR_BITS, _ODD_BITS = _SEEDS[1200 : 1200 + BITS], _SEEDS[2300 : 2300 + BITS] | _U(1)
_STEP = _SEEDS[2000:2064] | _U(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of each text's first word); bytes of a word are hashed by place."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate([[True], ~word[:-1]])))
    inside = np.flatnonzero(word)
    if not len(inside):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    at = np.searchsorted(inside, starts)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    by_place = spread(np.arange(int(lengths.max()), dtype=_U) + _U(20_000)) | _U(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data[inside]] * by_place[place], at)
        hashes = spread(sums + lengths.astype(_U) * _STEP[0])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = word_hashes(data, offsets)
    n = max(len(h) - words + 1, 0)
    with np.errstate(over="ignore"):
        s = np.zeros(n, _U)
        for j in range(words):
            s += h[j : j + n] * _STEP[j + 1]
        s = spread(s)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:  # the whole sequence as one
                yield spread(np.array([(h[a:b] * _STEP[1 : b - a + 1]).sum(dtype=_U) + _STEP[40 + b - a]], _U))
            else:
                yield np.zeros(0, _U)


def sketch(members: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    """The registers of a set."""
    least = np.full(len(xor), np.iinfo(_U).max, _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(members), 256):
            least = np.minimum(least, ((members[i : i + 256, None] ^ xor) * odd).min(0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    k = np.floor(1 + np.log(RATE / np.maximum(x, 1e-300)) / math.log(BASE))
    return np.clip(k, 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """The Jaccard similarity under which the registers (larger, smaller, equal) are likeliest.

    With u and v the shares of the sizes in their sum and a base near 1, a register is larger in
    the first set with probability u - vJ, in the second with v - uJ, and equal with J.
    """
    more, less = int((a > b).sum()), int((a < b).sum())
    same = len(a) - more - less
    u, v = na / (na + nb), nb / (na + nb)
    most = min(u / v, v / u)
    j = np.linspace(1e-6, most - 1e-6 if most > 2e-6 else most, 400)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = same * np.log(j) + more * np.log(np.maximum(u - v * j, 1e-12)) + less * np.log(np.maximum(v - u * j, 1e-12))
    return float(j[int(np.argmax(value))])


def band_keys(registers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = registers.astype(_U).reshape(BANDS, BAND) * _STEP[:BAND]
        return spread(parts.sum(1, dtype=_U) * _STEP[10] + np.arange(BANDS, dtype=_U)).view(np.int64)


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            n, one, two, registers, keys = [], [], [], [], []
            for s in shingle_sets(*utf8(batch.column(0)), words):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(int(spread(s + _STEP[20]).sum(dtype=_U).view(np.int64)))
                    two.append(int(spread(s ^ _STEP[21]).sum(dtype=_U).view(np.int64)))
                r = sketch(s) if len(s) else None
                registers.append(None if r is None else r.view(np.int16))
                keys.append(None if r is None else band_keys(r))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(registers, pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int64()))],
                names=[*batch.schema.names[1:], "n", "set_a", "set_b", "registers", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            members = [s.view(np.int64) for s in shingle_sets(*utf8(batch.column(0)), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(members, pa.list_(pa.int64()))], names=[*batch.schema.names[1:], "members"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, b0, b1, ...): the lowest bits of the further registers of each set, 64 to a number.

    Two sets with similarity J have a share of (1 + J) / 2 of these bits in common, and a count of
    different bits is a few machine instructions."""
    names = [f"b{k}" for k in range(BITS // 64)]
    for batch in batches:
        low = [sketch(x.values.to_numpy().view(_U), _XOR_BITS, _ODD_BITS) & 1 for x in batch.column(1)]
        packed = np.packbits(np.array(low, np.uint8).reshape(-1, BITS), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(packed.T))], names=["node", *names])


def _most_different_bits(percent: int) -> int:
    """Four standard deviations above what sets at the threshold have."""
    p = (1 + percent / 100) / 2
    return math.ceil(BITS * (1 - p + 4 * math.sqrt(p * (1 - p) / BITS)))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100 - 4 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            ra, rb = (np.array(batch.column(c).flatten(), np.int16).view(np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            for k, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"), strict=True)):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                if likely_similarity(ra[k], rb[k], len(a), len(b)) >= least:
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked[k] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _possible(na, ua, nb, ub, percent: int):
    """Whether sets of na and nb members, ua and ub of which no other set has, can be linked."""
    both = F.least(F.col(na) - F.col(ua), F.col(nb) - F.col(ub))
    return both * 100 >= (F.col(na) + F.col(nb) - both) * percent


def _unshared(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, u): how many members of each open node no other open node has."""
    members = open_nodes.join(sets.select("node", "members"), "node").select("node", F.explode("members").alias("s"))
    lone = members.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where(F.col("c") == 1)
    counts = lone.groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    return open_nodes.join(counts, "node", "left").select("node", F.coalesce("u", F.lit(0).cast("long")).alias("u"))


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry_key: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `words` words (lower-cased A-Z, split at ASCII white
    space); a text of fewer words is one shingle. Texts are linked at percent * union <= 100 *
    intersection. component_id is the smallest doc_id among all rows that links reach; kept says
    that it is the row's own. carry_key: return row_key too, the place of the row in a scan of docs.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing; rows
    without an identifier take part, get the smallest identifier of their component, and are kept
    only if it has none; rows that repeat an identifier and belong to the same component are kept
    or dropped together; an empty table gives an empty table; other columns are not read, whatever
    their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = keyed(docs, F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.select("text", "row_key", "doc_id").mapInArrow(
        _profiles(words), f"row_key long, doc_id {kind}, n long, set_a long, set_b long, registers array<short>, bands array<long>"
    )
    rows = materialize(rows, "profiles")
    total = rows.count()

    same = ["set_a", "set_b", "n"]
    first = F.min(F.struct("row_key", "registers", "bands")).alias("first")
    nodes = rows.where(F.col("n") > 0).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), first)
    nodes = nodes.select(*same, "copies", "least_id", F.col("first.row_key").alias("node"), F.col("first.registers").alias("registers"), F.col("first.bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    every = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    counts = every.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    buckets = attach(every, counts.where(F.col("members") > 1), ["key"], "members", nodes.count() * BANDS)
    buckets = buckets.where(F.col("members") > 1).select("node", "n", F.lit(0).cast("long").alias("u"), "band", "key")
    buckets = materialize(buckets, "buckets")
    candidates = buckets.select("node").distinct()
    wanted = source.join(candidates.withColumnRenamed("node", "row_key"), "row_key").select("text", F.col("row_key").alias("node"))
    sets = wanted.mapInArrow(_sets(words), "node long, members array<long>").join(nodes.select("node", "registers"), "node")
    sets = materialize(sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        b = sets.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("members").alias("mb"))
        a = sets.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("members").alias("ma"))
        return pairs.join(b, "b").join(a, "a").mapInArrow(_verify(percent), "a long, b long")

    labels = None
    for k in range(rounds + 1):
        if k == 1:
            placed = _named(buckets, labels)
            still = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
            still = attach(placed, still.where(F.col("x") < F.col("y")), ["key"], "members", nodes.count() * BANDS).where(F.col("x").isNotNull())
            unshared = materialize(_unshared(still.select("node").distinct(), sets), "unshared")
            narrowed = still.select("node", "n", "band", "key").join(unshared, "node")
            narrowed = narrowed.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent).select("node", "n", "u", "band", "key")
            whole, buckets = buckets, materialize(narrowed, "open")
            discard(whole)
        placed = _named(buckets, labels)
        chance = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 20))
        # sets with few members of their own are near the middle of their group and reach most of it
        centre = F.min(F.struct((F.col("u") if k == 1 else F.lit(0)).alias("o"), chance.alias("h"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("u").alias("u_a"), F.col("component").alias("c_a")))
        open_keys = (
            placed.groupBy("key")
            .agg(F.count(F.lit(1)).alias("members"), centre.alias("centre"), F.min("component").alias("x"), F.max("component").alias("y"))
            .where(F.col("x") < F.col("y"))
            .drop("x", "y")
        )
        placed = attach(placed, open_keys, ["key"], "members", nodes.count() * BANDS).where(F.col("centre").isNotNull())
        if k < rounds:
            far = placed.where((F.col("component") != F.col("centre.c_a")) & _possible("n", "u", "centre.n_a", "centre.u_a", percent))
            pairs = far.select(F.col("centre.a").alias("a"), F.col("node").alias("b")).distinct()
        else:
            pairs = _across(placed, nodes, sets, percent)
        settle(docs.sparkSession)
        new = materialize(verified(pairs), f"links{k}")
        if labels is None:
            labels = components(new)
        else:
            named = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))  # noqa: B023, E731
            lifted = new.join(named("a"), "a", "left").join(named("b"), "b", "left")
            lifted = lifted.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
            merged = components(lifted).withColumnRenamed("component", "into")
            # nodes that had no label yet come in as the components they are
            known = labels.unionByName(merged.select("node", F.col("node").alias("component")).join(labels.select("node"), "node", "left_anti"))
            labels = known.join(merged.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("into", "component").alias("component")
            )
        labels = materialize(labels, f"labels{k}")
        settle(docs.sparkSession)
    discard(sets, buckets)

    classes = nodes.select(*same, "copies", "least_id", "node").join(labels, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    classes = attach(classes.drop("least_id"), least, ["component"], "classes", nodes.count())
    classes = classes.where((F.col("copies") > 1) | (F.col("classes") > 1)).select(*same, "copies", "component_id", F.lit(True).alias("grouped"))
    found = attach(rows.select("row_key", "doc_id", *same), materialize(classes, "classes"), same, "copies", total)
    own = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    key = ["row_key"] if carry_key else []
    return found.select(*key, "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def _named(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """buckets with the component of each node, itself as long as it has none."""
    if labels is None:
        return buckets.withColumn("component", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(placed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that bounds and bits don't rule out, once each."""
    names = [f"b{k}" for k in range(BITS // 64)]
    members = placed.select("node").distinct().join(sets.select("node", "members"), "node").select("node", "members")
    bits = members.mapInArrow(_bits, "node long, " + ", ".join(f"{b} long" for b in names))
    x = placed.select("key", "band", "node", "n", "u", "component").join(nodes.select("node", "bands"), "node").join(bits, "node")
    x = materialize(x, "across")
    a, b = (x.select("key", *(F.col(c).alias(f"{c}_{s}") for c in x.columns if c != "key")) for s in "ab")
    different = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
    earlier = F.exists(F.sequence(F.lit(0), F.col("band_a")), lambda i: (i < F.col("band_a")) & (F.get("bands_a", i) == F.get("bands_b", i)))
    rules = (
        (a["key"] == b["key"])
        & (F.col("component_a") < F.col("component_b"))
        & _possible("n_a", "u_a", "n_b", "u_b", percent)
        & (different <= _most_different_bits(percent))
        & ~earlier
    )
    return a.join(b, rules).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
