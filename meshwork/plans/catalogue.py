"""The registered queries of the network engine and their SQL equivalents.

Features of the driver's tables: orders joined to sums over their line items (a cross-section and a
grouped one), sums of events by user and day (a panel), embeddings (a wide matrix). Doubles are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bootstrap import bootnet
from ..functions.centrality import centrality
from ..functions.estimation import estimate_network
from ..functions.group import estimate_group_network
from ..functions.multilevel import estimate_multilevel_network
from ..functions.timeseries import estimate_var_network
from ..operators import degree, lag, moments, resampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["lines", "qty", "price", "disc", "tax"]
EVENTS = ["click", "purchase", "view", "signup", "scroll"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Features ------------------------------------------------------------------------------------

ORDER_SQL = """f AS (
  SELECT l_orderkey AS row_id, CAST(count(*) AS DOUBLE) AS lines, sum(CAST(l_quantity AS DOUBLE)) AS qty,
         sum(CAST(l_extendedprice AS DOUBLE)) AS price, avg(CAST(l_discount AS DOUBLE)) AS disc, avg(CAST(l_tax AS DOUBLE)) AS tax
  FROM lineitem GROUP BY l_orderkey)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: number of lines, sums of quantity and price, mean discount and tax."""
    c = lambda x: F.col(x).cast("double")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum(c("l_quantity")).alias("qty"),
        F.sum(c("l_extendedprice")).alias("price"),
        F.avg(c("l_discount")).alias("disc"),
        F.avg(c("l_tax")).alias("tax"),
    )


LINE = ["qty", "disc", "tax", "rev"]
LINE_SQL = """g AS (
  SELECT l_returnflag AS "group", CAST(l_quantity AS DOUBLE) AS qty, CAST(l_discount AS DOUBLE) AS disc, CAST(l_tax AS DOUBLE) AS tax,
         CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) AS rev FROM lineitem)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x: F.col(x).cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("group"), c("l_quantity").alias("qty"), c("l_discount").alias("disc"), c("l_tax").alias("tax"),
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("rev"),
    )


PANEL = ["v0", "v1", "v2"]
PANEL_SQL = """p AS (
  SELECT user_id AS subject, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS beep, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) // 7 AS week,
         sum(CASE WHEN event_id % 3 = 0 THEN CAST(value AS DOUBLE) ELSE 0 END) AS v0, sum(CASE WHEN event_id % 3 = 1 THEN CAST(value AS DOUBLE) ELSE 0 END) AS v1,
         sum(CASE WHEN event_id % 3 = 2 THEN CAST(value AS DOUBLE) ELSE 0 END) AS v2
  FROM events GROUP BY 1, 2, 3)"""


def panel(spark: SparkSession, d: str, in_order: bool = False) -> DataFrame:
    """One row per user and day: sums of the values of events of three kinds; beep counts days.

    in_order: values are added up in the order of event_id, not as tasks hand them in, so that sums
    of doubles are the same to the last bit whatever the layout of the files.
    """
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    kind = lambda k: F.sum(F.when(F.col("event_id") % 3 == k, F.col("value").cast("double")).otherwise(0.0))
    events = table(spark, d, "events").withColumns({"subject": F.col("user_id"), "beep": day})
    if in_order:
        order = Window.partitionBy("subject", "beep").orderBy("event_id", "value")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = events.select("subject", "beep", F.row_number().over(order).alias("n"), *(kind(k).over(so_far).alias(f"v{k}") for k in range(3)))
        rows = sums.groupBy("subject", "beep").agg(F.max_by(F.struct(*PANEL), "n").alias("last")).select("subject", "beep", "last.*")
    else:
        rows = events.groupBy("subject", "beep").agg(*(kind(k).alias(f"v{k}") for k in range(3)))
    return rows.withColumn("week", F.expr("beep div 7")).select("subject", "beep", "week", "v0", "v1", "v2")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def pair_sql(names: list[str], source: str, value: str = "corr({a}, {b})", head: str = "", tail: str = "") -> str:
    return union(f"SELECT {head}'{a}' AS node1, '{b}' AS node2, round({value.format(a=a, b=b)}, 6) AS weight FROM {source}{tail}" for a, b in combinations(names, 2))


# Cross-sections ------------------------------------------------------------------------------


@query(f"WITH {ORDER_SQL} {pair_sql(ORDER, 'f')}")
def cor_edges(spark, d):
    return rounded(degree.edges(degree.weights_of(moments.correlations(orders(spark, d), ORDER))), "weight")


@query(f"WITH {ORDER_SQL}, e AS ({pair_sql(ORDER, 'f')}) SELECT * FROM e WHERE abs(weight) >= 0.02")
def cor_edges_threshold(spark, d):
    return rounded(degree.edges(degree.weights_of(moments.correlations(orders(spark, d), ORDER), 0.02)), "weight")


@query(f"WITH {LINE_SQL} {pair_sql(LINE, 'g', head='"group", ', tail=' GROUP BY "group"')}")
def cor_group_edges(spark, d):
    table_ = moments.correlations(lines(spark, d), LINE, by="group")
    return rounded(degree.edges(degree.weights_of(table_), ("group",)), "weight")


_RANKS = ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS {n}" for n in ("lines", "qty", "disc"))


@query(f"WITH {ORDER_SQL}, r AS (SELECT {_RANKS} FROM f) {pair_sql(['lines', 'qty', 'disc'], 'r')}")
def spearman_edges(spark, d):
    return rounded(degree.edges(degree.weights_of(moments.correlations(orders(spark, d), ["lines", "qty", "disc"], method="spearman"))), "weight")


@query(
    f"WITH {ORDER_SQL}, h AS (SELECT row_id, lines, CASE WHEN row_id % 5 <> 0 THEN qty END AS qty, CASE WHEN row_id % 7 <> 0 THEN price END AS price FROM f) "
    + pair_sql(["lines", "qty", "price"], "h")
)
def pairwise_null_cor(spark, d):
    rows = orders(spark, d).withColumns({"qty": F.when(F.col("row_id") % 5 != 0, F.col("qty")), "price": F.when(F.col("row_id") % 7 != 0, F.lit(1.0) * F.col("price"))})
    return rounded(degree.edges(degree.weights_of(moments.correlations(rows, ["lines", "qty", "price"]))), "weight")


_R3 = "r AS (SELECT corr(lines, qty) AS a, corr(lines, disc) AS b, corr(qty, disc) AS c FROM f)"


@query(
    f"WITH {ORDER_SQL}, {_R3} SELECT 'lines' AS node1, 'qty' AS node2, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS weight FROM r "
    "UNION ALL SELECT 'lines', 'disc', round((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 6) FROM r "
    "UNION ALL SELECT 'qty', 'disc', round((c - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) FROM r"
)
def pcor3_edges(spark, d):
    net = estimate_network(orders(spark, d).select("lines", "qty", "disc"), method="pcor")
    return rounded(net.edges_df, "weight")


def _square(names: list[str]) -> str:
    return union(
        f"SELECT '{a}' AS node, " + ", ".join("0.0 AS " + b if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in names) + " FROM f" for a in names
    )


@query(f"WITH {ORDER_SQL} {_square(ORDER)}")
def adjacency_matrix(spark, d):
    return rounded(degree.adjacency(degree.weights_of(moments.correlations(orders(spark, d), ORDER)), ORDER), *ORDER)


def _both(names: list[str]) -> str:
    return f"e AS ({pair_sql(names, 'f', 'corr({a}, {b})').replace('round(', '(').replace(', 6)', ')')}), b AS (SELECT node1 AS node, weight FROM e UNION ALL SELECT node2, weight FROM e)"


@query(f"WITH {ORDER_SQL}, {_both(ORDER)} SELECT node, round(sum(abs(weight)), 6) AS strength FROM b GROUP BY node")
def strength(spark, d):
    return rounded(degree.degrees(degree.weights_of(moments.correlations(orders(spark, d), ORDER))).select("node", "strength"), "strength")


@query(f'WITH {ORDER_SQL}, {_both(ORDER)} SELECT node, round(sum(weight), 6) AS "expectedInfluence" FROM b GROUP BY node')
def expected_influence(spark, d):
    out = degree.degrees(degree.weights_of(moments.correlations(orders(spark, d), ORDER)))
    return rounded(out.select("node", "expectedInfluence"), "expectedInfluence")


# Closeness and betweenness of a dense network by paths over at most all nodes.


def _closeness_sql(names: list[str]) -> str:
    n = len(names)
    return f"""WITH RECURSIVE {ORDER_SQL}, {_both(names)}, s AS (
      SELECT node1 AS a, node2 AS b, 1 / abs(weight) AS d FROM e UNION ALL SELECT node2, node1, 1 / abs(weight) FROM e),
    w(a, b, d, k) AS (SELECT a, b, d, 1 FROM s UNION ALL
      SELECT w.a, s.b, w.d + s.d, k + 1 FROM w JOIN s ON w.b = s.a WHERE k < {n - 1} AND s.b <> w.a),
    m AS (SELECT a, b, min(d) AS d FROM w GROUP BY a, b)
    SELECT b AS node, round({n - 1} / sum(d), 6) AS closeness FROM m GROUP BY b"""


@query(_closeness_sql(ORDER))
def closeness(spark, d):
    net = estimate_network(orders(spark, d).select(*ORDER), method="cor")
    return rounded(centrality(net).select("node", "closeness"), "closeness")


_PART = "c AS (SELECT * FROM (VALUES ('lines', 0), ('qty', 0), ('price', 0), ('disc', 1), ('tax', 1)) AS t(node, community))"


@query(
    f"""WITH {ORDER_SQL}, {_both(ORDER)}, {_PART}, t AS (SELECT sum(abs(weight)) AS m FROM e),
    k AS (SELECT community, sum(abs(weight)) AS degree FROM b JOIN c USING (node) GROUP BY community),
    i AS (SELECT x.community, sum(abs(weight)) AS inside FROM e JOIN c AS x ON node1 = x.node JOIN c AS y ON node2 = y.node WHERE x.community = y.community GROUP BY 1)
    SELECT round(sum(inside / m - (degree / (2 * m)) ** 2), 6) AS modularity FROM k JOIN i USING (community), t"""
)
def modularity_of_partition(spark, d):
    members = spark.createDataFrame([("lines", 0), ("qty", 0), ("price", 0), ("disc", 1), ("tax", 1)], "node string, community int")
    edge_table = degree.edges(degree.weights_of(moments.correlations(orders(spark, d), ORDER)))
    return rounded(degree.modularity(edge_table, members), "modularity")


@query(
    "WITH m AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS node, n_regionkey * 7 + 3 AS c FROM nation), f AS (SELECT c, min(node) AS first FROM m GROUP BY c) "
    "SELECT node, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS community FROM m JOIN f USING (c)"
)
def community_renumber(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_regionkey") * 7 + 3).alias("community"))
    return degree.renumber(rows)


# Estimators without SQL ----------------------------------------------------------------------


@query()
def ebicglasso_edges(spark, d):
    return estimate_network(orders(spark, d).select(*ORDER)).edges_df


@query()
def ebicglasso_curve(spark, d):
    return estimate_network(orders(spark, d).select(*ORDER)).estimation_info.lambda_ebic_curve


def _embeddings(spark, d, p: int) -> DataFrame:
    return table(spark, d, "embeddings").select(*(F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(p)))


_EMBED = [f"e{k}" for k in range(64)]


@query(
    """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT 'e' || a.k AS node1, 'e' || b.k AS node2, round(corr(a.v, b.v), 6) AS weight FROM x AS a JOIN x AS b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY a.k, b.k"""
)
def wide_cor_edges(spark, d):
    return rounded(degree.edges(degree.weights_of(moments.correlations(_embeddings(spark, d, 64), _EMBED))), "weight")


@query()
def jgl_edges(spark, d):
    return estimate_group_network(lines(spark, d), group_col="group").compare_edges()


@query()
def var_temporal_edges(spark, d):
    days = panel(spark, d).groupBy(F.col("beep").alias("row_id")).agg(*(F.sum(v).alias(v) for v in PANEL))
    return estimate_var_network(days).temporal.weights()


@query()
def mlvar_edges(spark, d):
    rows = panel(spark, d).drop("week").withColumn("row_id", F.col("beep"))
    return estimate_multilevel_network(rows, "subject", beep="beep", temporal="fixed", scale=True).temporal.weights()


# Lags ----------------------------------------------------------------------------------------

_LAG = ", ".join(f"{v}, lag({v}) OVER w AS {v}_lag" for v in PANEL)


def _lags(rule: str) -> str:
    out = ", ".join(f"round({v}, 6) AS {v}, round({v}_lag, 6) AS {v}_lag" for v in PANEL)
    return f"WITH {PANEL_SQL}, x AS (SELECT subject, beep, {_LAG}, beep - lag(beep) OVER w AS gap, week - lag(week) OVER w AS weeks FROM p WINDOW w AS (PARTITION BY subject ORDER BY beep)) SELECT subject, beep, {out} FROM x WHERE {rule}"


def _lag_columns() -> list[str]:
    return [x for v in PANEL for x in (v, f"{v}_lag")]


@query(_lags("gap = 1"))
def lag_pairs(spark, d):
    return rounded(lag.lag_pairs(panel(spark, d), PANEL, order_by="beep", subject="subject", beep="beep"), *_lag_columns())


@query(_lags("gap = 1 AND weeks = 0"))
def lag_pairs_day(spark, d):
    return rounded(lag.lag_pairs(panel(spark, d), PANEL, order_by="beep", subject="subject", beep="beep", day="week"), *_lag_columns())


_Z = ", ".join(
    f"round(CASE WHEN stddev_samp({v}) OVER w > 0 THEN ({v} - avg({v}) OVER w) / stddev_samp({v}) OVER w ELSE {v} - avg({v}) OVER w END, 6) + 0.0 AS {v}" for v in PANEL
)


@query(f"WITH {PANEL_SQL} SELECT subject, beep, {_Z} FROM p WINDOW w AS (PARTITION BY subject)")
def within_subject_z(spark, d):
    out = lag.within_subject_z(panel(spark, d).drop("week"), PANEL, "subject")
    return out.withColumns({v: F.round(v, 6) + 0.0 for v in PANEL})


@query(f"WITH {PANEL_SQL} SELECT subject, {', '.join(f'round(avg({v}), 6) AS {v}' for v in PANEL)} FROM p GROUP BY subject")
def subject_means(spark, d):
    return rounded(lag.subject_means(panel(spark, d), PANEL, "subject"), *PANEL)


@query(f"WITH {PANEL_SQL}, f AS (SELECT subject, {', '.join(f'avg({v}) AS {v}' for v in PANEL)} FROM p GROUP BY subject) {pair_sql(PANEL, 'f')}")
def between_cor(spark, d):
    return rounded(degree.edges(degree.weights_of(moments.correlations(lag.subject_means(panel(spark, d), PANEL, "subject"), PANEL))), "weight")


# The lag-1 cross-correlations of the panel as a directed network.

_CROSS = union(
    f"SELECT {i} AS i, {j} AS j, 'v{i}' AS node1, 'v{j}' AS node2, corr(v{i}, v{j}_lag) AS weight FROM x WHERE gap = 1" for i in range(3) for j in range(3)
)


@query(
    f"""WITH {PANEL_SQL}, x AS (SELECT {_LAG}, beep - lag(beep) OVER w AS gap FROM p WINDOW w AS (PARTITION BY subject ORDER BY beep)), e AS ({_CROSS}),
    a AS (SELECT node1 AS node, sum(abs(weight)) AS s, sum(weight) AS t FROM e GROUP BY 1), b AS (SELECT node2 AS node, sum(abs(weight)) AS s, sum(weight) AS t FROM e GROUP BY 1)
    SELECT node, round(a.s, 6) AS "inStrength", round(b.s, 6) AS "outStrength", round(a.t, 6) AS "inExpectedInfluence", round(b.t, 6) AS "outExpectedInfluence",
           round(a.s + b.s, 6) AS strength FROM a JOIN b USING (node)"""
)
def in_out_strength(spark, d):
    pairs = lag.lag_pairs(panel(spark, d), PANEL, order_by="beep", subject="subject", beep="beep")
    pairs = pairs.select(*PANEL, *(f"{v}_lag" for v in PANEL))
    r = moments.correlations(pairs, [*PANEL, *(f"{v}_lag" for v in PANEL)]).where((F.col("i") < 3) & (F.col("j") >= 3))
    weights = r.select("i", (F.col("j") - 3).alias("j"), "node1", F.regexp_replace("node2", "_lag$", "").alias("node2"), F.col("r").alias("weight"))
    kept = ["inStrength", "outStrength", "inExpectedInfluence", "outExpectedInfluence", "strength"]
    return rounded(degree.degrees(weights, directed=True).select("node", *kept), *kept)


# Resampling. Weights of replicates come from integer arithmetic that any engine repeats. --------

BOOTS = 20
_BOOT_PAIRS = list(combinations(["lines", "qty", "disc"], 2))


def _boot_statistics(spark, d) -> DataFrame:
    """Edges of replicates in which row r counts (17 r + 31 b + r * b) mod 3 times; boot -1 is the original."""
    boots = spark.range(-1, BOOTS).select(F.col("id").alias("boot_id"))  # BOOTS + 1 rows
    rows = orders(spark, d).join(F.broadcast(boots))
    times = F.when(F.col("boot_id") < 0, F.lit(1)).otherwise((F.col("row_id") * 17 + F.col("boot_id") * 31 + F.col("row_id") * F.col("boot_id")) % 3)
    w = times.cast("double")

    def r(a, b):
        n, x, y = F.sum(w), F.sum(w * F.col(a)), F.sum(w * F.col(b))
        xx, yy, xy = F.sum(w * F.col(a) * F.col(a)), F.sum(w * F.col(b) * F.col(b)), F.sum(w * F.col(a) * F.col(b))
        return (n * xy - x * y) / F.sqrt((n * xx - x * x) * (n * yy - y * y))

    wide = rows.groupBy("boot_id").agg(*(r(a, b).alias(f"{a}__{b}") for a, b in _BOOT_PAIRS))
    edge = F.array(*(F.struct(F.lit(a).alias("node1"), F.lit(b).alias("node2"), F.col(f"{a}__{b}").alias("value")) for a, b in _BOOT_PAIRS))
    long = wide.select("boot_id", F.explode(edge).alias("x"))
    return long.select("boot_id", (F.col("boot_id") < 0).alias("is_original"), F.lit("edge").alias("statistic"), "x.*")


def _weighted_sql(a: str, b: str) -> str:
    n, x, y, xx, yy, xy = "sum(w)", f"sum(w * {a})", f"sum(w * {b})", f"sum(w * {a} * {a})", f"sum(w * {b} * {b})", f"sum(w * {a} * {b})"
    return f"SELECT boot_id, '{a}' AS node1, '{b}' AS node2, ({n} * {xy} - {x} * {y}) / sqrt(({n} * {xx} - {x} * {x}) * ({n} * {yy} - {y} * {y})) AS value FROM h GROUP BY boot_id"


_BOOT_SQL = f"""{ORDER_SQL}, h AS (
  SELECT k AS boot_id, f.*, CAST(CASE WHEN k < 0 THEN 1 ELSE (row_id * 17 + k * 31 + row_id * k) % 3 END AS DOUBLE) AS w FROM f, (SELECT unnest(range(-1, {BOOTS})) AS k)),
  s AS ({union(_weighted_sql(a, b) for a, b in _BOOT_PAIRS)})"""


@query(
    f"""WITH {_BOOT_SQL} SELECT node1, node2, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS ci_lower,
    round(quantile_cont(value, 0.975), 6) AS ci_upper, round(max(CASE WHEN boot_id < 0 THEN value END), 6) AS sample FROM s GROUP BY node1, node2"""
)
def boot_edges_summary(spark, d):
    return rounded(resampling.summary(_boot_statistics(spark, d), "edge"), "mean", "sd", "ci_lower", "ci_upper", "sample")


@query(
    f"""WITH {_BOOT_SQL}, t AS (SELECT boot_id, node1 || ' -- ' || node2 AS item, value FROM s WHERE boot_id >= 0),
    q AS (SELECT a.item AS item1, b.item AS item2, avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END) AS s FROM t AS a JOIN t AS b ON a.boot_id = b.boot_id AND a.item < b.item GROUP BY 1, 2)
    SELECT item1, item2, round(2 * least(s, 1 - s), 6) AS p, 2 * least(s, 1 - s) < 0.05 AS significant FROM q"""
)
def difference_test(spark, d):
    return rounded(resampling.difference_test(_boot_statistics(spark, d), "edge"), "p")


def _drop_correlations(spark, d) -> DataFrame:
    """A made-up table of case-dropping correlations: one row per order, by its number."""
    k = F.col("row_id")
    rows = orders(spark, d)
    share = F.get(F.array(*(F.lit(x) for x in (0.75, 0.5, 0.25))), (k % 3).cast("int"))
    return rows.select(share.alias("proportion"), F.when(k % 2 == 0, "strength").otherwise("edge").alias("statistic"), k.alias("boot_id"), (F.lit(0.5) + share * ((k * 7) % 11) / 22 + 0.2).alias("correlation"))


_DROP_SQL = f"""{ORDER_SQL}, r AS (
  SELECT [0.75, 0.5, 0.25][row_id % 3 + 1] AS proportion, CASE WHEN row_id % 2 = 0 THEN 'strength' ELSE 'edge' END AS statistic,
         0.5::DOUBLE + [0.75, 0.5, 0.25][row_id % 3 + 1]::DOUBLE * ((row_id * 7) % 11) / 22 + 0.2::DOUBLE AS correlation FROM f)"""


@query(
    f"""WITH {_DROP_SQL}, q AS (SELECT statistic, proportion, quantile_cont(correlation, 0.05) AS low FROM r GROUP BY 1, 2)
    SELECT statistic, round(coalesce(max(CASE WHEN low >= 0.7 THEN 1 - proportion::DOUBLE END), 0), 6) AS cs FROM q GROUP BY 1"""
)
def cs_coefficient(spark, d):
    return rounded(resampling.cs_coefficient(_drop_correlations(spark, d)), "cs")


@query(
    f"""WITH {_DROP_SQL} SELECT statistic, proportion::DOUBLE AS proportion, round(avg(correlation), 6) AS mean, round(quantile_cont(correlation, 0.025), 6) AS ci_lower,
    round(quantile_cont(correlation, 0.975), 6) AS ci_upper FROM r GROUP BY 1, 2"""
)
def stability_curve(spark, d):
    return rounded(resampling.stability_curve(_drop_correlations(spark, d)), "mean", "ci_lower", "ci_upper")


@query()
def bootnet_edges(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))
    rows = rows.withColumn("both", F.col("nation") * 10 + F.col("balance") / 500)
    return bootnet(rows, method="cor", statistics=["edge"], seed=1).summary("edge")
