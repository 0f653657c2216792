"""Registered queries that call what has no row-by-row SQL: networks, kernels, resampling, validation.

Their SQL is a closed form where there is one (two or three variables, paths over five nodes), the
conditions of an optimum as rows that must all be true, or the values that a definition fixes.
Networks are those of catalogue.py's features.
"""

from __future__ import annotations

import warnings
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plotting
from ..functions import bootstrap, community, estimation, group, multilevel, timeseries
from ..functions.centrality import centrality
from ..kernels import graph, regression
from ..kernels import sparse_precision as kernel
from ..network import GroupNetwork, MultilevelNetwork, Network, TSNetwork
from ..operators import degree, lag, moments, order, resampling
from ..sources import datasets, observations
from . import catalogue as c
from .catalogue import LINE, LINE_SQL, ORDER, ORDER_SQL, PANEL, PANEL_SQL, pair_sql, query, rounded, union


def rows_of(spark, rows: list[tuple], kinds: str) -> DataFrame:
    return spark.createDataFrame(rows, kinds)


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


def true_for(names: list[str], head: str = "") -> str:
    """A row for each pair of names, that must be true."""
    return union(f"SELECT {head}'{a}' AS node1, '{b}' AS node2, true AS optimal" for a, b in combinations(names, 2))


def message(f) -> str:
    """What a call says when it refuses its input; what it returns if it doesn't."""
    try:
        out = f()
    except (ValueError, ImportError, KeyError) as e:
        return str(e)
    return ",".join(out) if isinstance(out, list) else str(out)


def cor_matrix(spark, d, names: list[str] = ORDER) -> np.ndarray:
    return moments.matrix(moments.correlations(c.orders(spark, d), names), len(names))


def cor_network(spark, d) -> Network:
    return estimation.estimate_network(c.orders(spark, d).select(*ORDER), method="cor")


def group_networks(spark, d, threshold: float = 0.0) -> GroupNetwork:
    cors = moments.matrix(moments.correlations(c.lines(spark, d), LINE, by="group"), len(LINE), "group")
    nets = {g: estimation.get_estimator("cor").from_matrix(cors[g], 0, tuple(LINE), threshold=threshold) for g in sorted(cors)}
    return GroupNetwork(nets, 0.0, 0.0, "fused", "ebic")


def cross_network(spark, d) -> Network:
    """Correlations of each variable with each one's value a day before, as a directed network."""
    pairs = lag.lag_pairs(c.panel(spark, d), PANEL, order_by="beep", subject="subject", beep="beep")
    names = [*PANEL, *(f"{v}_lag" for v in PANEL)]
    r = moments.matrix(moments.correlations(pairs.select(*names), names), 6)
    return Network(r[:3, 3:], tuple(PANEL), "cross", 0, directed=True)


_PAIRS = f"{PANEL_SQL}, x AS (SELECT subject, {c._LAG}, beep - lag(beep) OVER w AS gap FROM p WINDOW w AS (PARTITION BY subject ORDER BY beep))"
_DAYS = "y AS (SELECT beep AS row_id, " + ", ".join(f"sum({v}) AS {v}" for v in PANEL) + " FROM p GROUP BY beep)"


def days(spark, d) -> DataFrame:
    return c.panel(spark, d).groupBy(F.col("beep").alias("row_id")).agg(*(F.sum(v).alias(v) for v in PANEL))


# Sources --------------------------------------------------------------------------------------


def _generator(name: str, rows: int, names: str, least, most, keys: str = ""):
    sql = "NULL" if least is None else str(least), "NULL" if most is None else str(most)

    @query(values("rows, variables, keys, least, most", f"({rows}, '{names}', '{keys}', CAST({sql[0]} AS INTEGER), CAST({sql[1]} AS INTEGER))"))
    def run(spark, d):
        frame = getattr(datasets, name)(spark)
        found = [x for x in observations.variables(frame.drop(*keys.split(","))) if x]
        low, high = F.min(F.least(*found)), F.max(F.greatest(*found))
        out = frame.agg(F.count(F.lit(1)).cast("int").alias("rows"), low.alias("low"), high.alias("high"))
        bound = lambda x, wanted: F.lit(None).cast("int") if wanted is None else F.col(x).cast("int")
        return out.select("rows", F.lit(",".join(found)).alias("variables"), F.lit(keys).alias("keys"), bound("low", least).alias("least"), bound("high", most).alias("most"))

    c.QUERIES[name], c.ORACLES[name] = c.QUERIES.pop("run"), c.ORACLES.pop("run")


_V = lambda p: ",".join(f"V{k}" for k in range(1, p + 1))
_generator("make_bfi25", 500, ",".join(f"{f}{k}" for f in "OCEAN" for k in range(1, 6)), 1, 6)
_generator("make_multigroup", 400, _V(9), None, None, "group")
_generator("make_var_data", 500, _V(6), None, None)
_generator("make_multilevel_data", 1000, _V(4), None, None, "subject,beep")


@query(values("rows, variables, least, most", "(300, 9, 1, 3)"))
def make_depression9(spark, d):
    frame = datasets.make_depression9(spark)
    names = observations.variables(frame)
    low, high = F.min(F.least(*names)).cast("int"), F.max(F.greatest(*names)).cast("int")
    return frame.agg(F.count(F.lit(1)).cast("int").alias("rows"), F.lit(len(names)).alias("variables"), low.alias("least"), high.alias("most"))


@query("WITH f AS (SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation) "
       "SELECT CASE WHEN a % 2 = 0 THEN 'Group1' ELSE 'Group2' END AS \"group\", count(*) AS n, sum(a) AS a, sum(b) AS b FROM f GROUP BY 1")
def group_list(spark, d):
    f = c.table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    out, names = group.grouped([f.where("a % 2 = 0"), f.where("a % 2 = 1")], None)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in names))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS \"group\", count(*) AS n, sum(CAST(n_nationkey AS DOUBLE)) AS a, sum(CAST(n_nationkey * n_regionkey AS DOUBLE)) AS b FROM nation GROUP BY 1")
def group_column(spark, d):
    f = c.table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * F.col("n_regionkey")).alias("b"))
    out, names = group.grouped(f, "n_regionkey")
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in names))


# Validation and lookup ------------------------------------------------------------------------


@query(values("k, says", "(0, 'v0,v1,v2')", "(1, 'beep column ''nope'' not found in the data')", "(2, 'at least 2 variables are needed, found 1')", "(3, 'at least 2 timepoints are needed')",
              "(4, 'missing values (NaN) are not allowed; found in: v1')"))
def series_validation(spark, d):
    f = days(spark, d).drop("row_id")
    gap = f.withColumn("v1", F.when(F.col("v0") > -1, F.lit(float("nan"))).otherwise(F.col("v1")))
    checks = [lambda: observations.check_series(f, None, None), lambda: observations.check_series(f, "nope", None), lambda: observations.check_series(f.select("v0"), None, None),
              lambda: observations.check_series(f.limit(1), None, None), lambda: observations.check_series(gap, None, None)]
    return rows_of(spark, [(k, message(x)) for k, x in enumerate(checks)], "k int, says string")


@query(f"""WITH {PANEL_SQL}, n AS (SELECT subject, count(*) AS n FROM p WHERE beep % 7 = 0 GROUP BY subject),
    few AS (SELECT subject FROM n WHERE n < 3 ORDER BY subject LIMIT 5)
    SELECT CASE WHEN count(*) = 0 THEN 'v0,v1,v2' ELSE 'subjects with fewer than 3 observations: ' || string_agg(CAST(subject AS VARCHAR), ', ' ORDER BY subject) END AS says FROM few""")
def panel_validation(spark, d):
    f = c.panel(spark, d).where("beep % 7 = 0").drop("week")
    return rows_of(spark, [(message(lambda: observations.check_panel(f, "subject", "beep", None)),)], "says string")


@query(f"""WITH {_PAIRS}, h AS (SELECT subject, v0_lag, CASE WHEN CAST(floor(v1) AS BIGINT) % 3 <> 0 THEN v1 END AS v1, CASE WHEN CAST(floor(v2_lag) AS BIGINT) % 5 <> 0 THEN v2_lag END AS v2_lag, v1_lag FROM x WHERE gap = 1)
    SELECT subject, count(*) AS n, round(sum(v1 * v1), 4) AS yy, round(sum(v1 * v2_lag), 4) AS xy FROM h WHERE v1 IS NOT NULL AND v2_lag IS NOT NULL GROUP BY subject""")
def listwise_deletion(spark, d):
    """A mixed model's sums are over rows where the outcome and all lags are present.

    Whether a row is depends on whole parts of sums, hence sums in order.
    """
    f = lag.lag_pairs(c.panel(spark, d, in_order=True), PANEL, order_by="beep", subject="subject", beep="beep")
    keep = lambda x, k: F.when(F.floor(F.col(x)).cast("long") % k != 0, F.col(x))
    sums = multilevel.subject_sums(f.withColumns({"v1": keep("v1", 3), "v2_lag": keep("v2_lag", 5)}), PANEL, "subject", 1)
    return sums.select("subject", "n", F.round("yy", 4).alias("yy"), F.round(F.get("xy", F.lit(3)), 4).alias("xy"))


def multilevel_network(spark, d) -> MultilevelNetwork:
    net, cor = cross_network(spark, d), cor_matrix_of_panel(spark, d)
    flat = Network(cor, tuple(PANEL), "cor", 0)
    own = {1: net, 2: Network(net.adjacency / 2, net.labels, "cross", 0, directed=True)}
    return MultilevelNetwork(net, flat, flat, own, net.labels, [1, 2], 1 - np.abs(net.adjacency), {}, "mlVAR", 0, None)


def cor_matrix_of_panel(spark, d) -> np.ndarray:
    r = moments.matrix(moments.correlations(c.panel(spark, d).select(*PANEL), PANEL), 3)
    np.fill_diagonal(r, 0.0)
    return r


@query(f"WITH {_PAIRS}, e AS ({c._CROSS}) SELECT node1, node2, round(weight, 6) AS weight FROM e WHERE i <> j AND NOT 1 - abs(weight) > 0.995")
def p_value_mask(spark, d):
    return rounded(multilevel_network(spark, d).temporal_thresholded(0.995).edges_df, "weight")


@query(f"WITH {_PAIRS}, e AS ({c._CROSS}) SELECT node1, node2, round(weight / 2, 6) AS weight FROM e WHERE i <> j UNION ALL SELECT 'subject ''9'' not found' AS node1, '' AS node2, 0 AS weight")
def subject_lookup(spark, d):
    net = multilevel_network(spark, d)
    said = message(lambda: net.subject_network("9")).strip('"')
    return rounded(net.subject_network(2).edges_df.unionByName(rows_of(spark, [(said, "", 0.0)], "node1 string, node2 string, weight double")), "weight")


@query(f"WITH {LINE_SQL} SELECT node1, node2, weight FROM ({pair_sql(LINE, 'g', head='\"group\", ', tail=' GROUP BY \"group\"')}) WHERE \"group\" = 'N'")
def group_lookup(spark, d):
    return rounded(group_networks(spark, d)["N"].edges_df, "weight")


@query(f"WITH {LINE_SQL} SELECT * FROM ({pair_sql(LINE, 'g', head='\"group\", ', tail=' GROUP BY \"group\"')}) WHERE abs(weight) >= 0.01")
def compare_edges(spark, d):
    return rounded(group_networks(spark, d, 0.01).compare_edges(), "weight")


# Unions of networks ---------------------------------------------------------------------------

_GROUP_BOTH = f"e AS ({pair_sql(LINE, 'g', head='\"group\", ', tail=' GROUP BY \"group\"')}), b AS (SELECT \"group\", node1 AS node, weight FROM e UNION ALL SELECT \"group\", node2, weight FROM e)"


@query(f"WITH {LINE_SQL}, {_GROUP_BOTH} SELECT \"group\", node, round(sum(abs(weight)), 4) AS strength, round(sum(weight), 4) AS \"expectedInfluence\" FROM b GROUP BY 1, 2")
def group_centrality(spark, d):
    out = group_networks(spark, d).centrality().select("group", "node", "strength", "expectedInfluence")
    return out.withColumns({x: F.round(x, 4) for x in ("strength", "expectedInfluence")})


def _union_sql(flat: list[str]) -> str:
    """strength and inStrength of the directed network of _CROSS, and of undirected ones of the panel."""
    v = pair_sql(PANEL, "p", "corr({a}, {b})").replace("round(", "(").replace(", 6)", ")")
    flats = union(f"SELECT '{n}' AS network, node, round(sum(abs(weight)), 6) AS strength, CAST(NULL AS DOUBLE) AS \"inStrength\" FROM b GROUP BY node" for n in flat)
    return f"""WITH {_PAIRS}, e AS ({c._CROSS}), f AS ({v}), b AS (SELECT node1 AS node, weight FROM f UNION ALL SELECT node2, weight FROM f),
      s AS (SELECT node1 AS node, abs(weight) AS w, abs(weight) AS i FROM e UNION ALL SELECT node2, abs(weight), 0 FROM e)
      SELECT 'temporal' AS network, node, round(sum(w), 6) AS strength, round(sum(i), 6) AS "inStrength" FROM s GROUP BY node UNION ALL {flats}"""


def _strengths(net) -> DataFrame:
    return rounded(net.centrality().select("network", "node", "strength", "inStrength"), "strength", "inStrength")


@query(_union_sql(["contemporaneous"]))
def series_centrality(spark, d):
    net = cross_network(spark, d)
    return _strengths(TSNetwork(net, Network(cor_matrix_of_panel(spark, d), net.labels, "cor", 0), net.labels, "graphicalVAR", 0, 0))


@query(_union_sql(["contemporaneous", "between_subjects"]))
def multilevel_centrality(spark, d):
    return _strengths(multilevel_network(spark, d))


# Grids ----------------------------------------------------------------------------------------


@query(f"""WITH {ORDER_SQL}, n AS (SELECT count(*) AS n FROM f), k AS (SELECT unnest(range(0, 10)) AS k),
    s AS (SELECT DISTINCT greatest(3, least(n, CAST(floor(n * CASE WHEN k = 9 THEN 0.25::DOUBLE ELSE k * ((0.25::DOUBLE - 0.75::DOUBLE) / 9) + 0.75::DOUBLE END) AS BIGINT))) AS keep, n FROM n, k)
    SELECT CAST(row_number() OVER (ORDER BY keep DESC) AS INTEGER) AS place, keep, round(keep / n::DOUBLE, 9) AS proportion FROM s""")
def proportion_grid(spark, d):
    n = c.orders(spark, d).count()
    return rows_of(spark, [(k + 1, round(n * p), round(p, 9)) for k, p in enumerate(bootstrap.proportions(n, 0.25, 0.75, 10))], "place int, keep long, proportion double")


@query(f"""WITH {LINE_SQL}, e AS ({pair_sql(LINE, 'g', 'corr({a}, {b})', head='"group", ', tail=' GROUP BY "group"').replace('round(', '(').replace(', 6)', ')')}),
    m AS (SELECT max(abs(w)) AS l FROM (SELECT avg(weight) AS w FROM e GROUP BY node1, node2)), k AS (SELECT unnest(range(0, 6)) AS k),
    x AS (SELECT k, round(pow(10, log10(l) + k * (log10(l * 0.01) - log10(l)) / 5), 6) AS v FROM m, k)
    SELECT CAST(a.k * 6 + b.k AS INTEGER) AS place, a.v AS lambda1, b.v AS lambda2 FROM x AS a, x AS b""")
def penalty_grid(spark, d):
    cors = moments.matrix(moments.correlations(c.lines(spark, d), LINE, by="group"), len(LINE), "group")
    one = kernel.group_grid([cors[g] for g in sorted(cors)], 6, 0.01)
    return rounded(rows_of(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate((a, b) for a in one for b in one)], "place int, lambda1 double, lambda2 double"), "lambda1", "lambda2")


# Resampling ------------------------------------------------------------------------------------


@query(f"""WITH {c._BOOT_SQL} SELECT CASE WHEN boot_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", node1, node2, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
    round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper, round(max(CASE WHEN boot_id < 0 THEN value END), 6) AS sample FROM s GROUP BY 1, 2, 3""")
def group_summary(spark, d):
    rows = c._boot_statistics(spark, d).withColumn("group", F.when(F.col("boot_id") % 2 == 0, "even").otherwise("odd"))
    found = group.GroupBootstrapResult(None, c.BOOTS, rows)
    return rounded(found.summary("edge"), "mean", "sd", "ci_lower", "ci_upper", "sample")


_ITEMS = [f"{a} -- {b}" for a, b in c._BOOT_PAIRS]


@query(f"WITH {c._BOOT_SQL} SELECT boot_id, " + ", ".join(f"round(max(CASE WHEN node1 || ' -- ' || node2 = '{x}' THEN value END), 6) AS e{k}" for k, x in enumerate(_ITEMS)) + " FROM s WHERE boot_id >= 0 GROUP BY boot_id")
def replicate_matrix(spark, d):
    out = resampling.replicate_matrix(c._boot_statistics(spark, d), "edge")
    return out.select("boot_id", *(F.round(F.col(f"`{x}`"), 6).alias(f"e{k}") for k, x in enumerate(_ITEMS)))


@query(f"""WITH {c._BOOT_SQL}, m AS (SELECT node1, node2, avg(value) AS mean FROM s GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY mean) AS INTEGER) AS place, node1, node2, round(mean, 6) AS mean FROM m""")
def edges_by_mean(spark, d):
    found = plotting.edge_accuracy_data(bootstrap.BootstrapResult(None, "nonparametric", c.BOOTS, c._boot_statistics(spark, d)), "mean").collect()
    return rounded(rows_of(spark, [(k + 1, r.node1, r.node2, r["mean"]) for k, r in enumerate(found)], "place int, node1 string, node2 string, mean double"), "mean")


@query(f"WITH {ORDER_SQL}, {c._both(ORDER)} SELECT 'edge' AS statistic, node1, node2, round(weight, 6) AS value FROM e UNION ALL SELECT 'strength', node, NULL, round(sum(abs(weight)), 6) FROM b GROUP BY node "
       "UNION ALL SELECT 'expectedInfluence', node, NULL, round(sum(weight), 6) FROM b GROUP BY node")
def network_statistics(spark, d):
    found = bootstrap.statistics_of(cor_network(spark, d), ("edge", "strength", "expectedInfluence"))
    return rounded(rows_of(spark, found, "statistic string, node1 string, node2 string, value double"), "value")


_CUSTOMER = "f AS (SELECT CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_acctbal AS DOUBLE) AS balance, CAST(c_nationkey AS DOUBLE) * 10 + CAST(c_acctbal AS DOUBLE) / 500 AS mixed FROM customer)"
_THREE = ["nation", "balance", "mixed"]


def customers(spark, d) -> DataFrame:
    f = c.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))
    return f.withColumn("mixed", F.col("nation") * 10 + F.col("balance") / 500)


@query(f"WITH {_CUSTOMER}, e AS ({pair_sql(_THREE, 'f')}) SELECT node1, node2, weight AS sample, CAST(41 AS BIGINT) AS n, true AS within FROM e")
def bootstrap_replicates(spark, d):
    """The original's edges, the number of values of each, and whether all replicates lie near the original."""
    found = bootstrap.bootnet(customers(spark, d), n_boots=40, method="cor", statistics=["edge"], seed=1)
    near = F.max(F.abs("value")) <= 1
    counts = found.statistics.groupBy("node1", "node2").agg(F.count("value").alias("n"), near.alias("within"))
    return rounded(found.summary("edge").join(counts, ["node1", "node2"]).select("node1", "node2", "sample", "n", "within"), "sample")


@query(f"""WITH {_CUSTOMER}, n AS (SELECT count(*) AS n FROM f), k AS (SELECT unnest([0.75, 0.5, 0.25]) AS p), t AS (SELECT unnest(['closeness', 'betweenness', 'strength', 'expectedInfluence']) AS statistic)
    SELECT round(CAST(floor(n * p) AS BIGINT) / n::DOUBLE, 9) AS proportion, statistic, CAST(5 AS BIGINT) AS n FROM n, k, t""")
def case_dropping(spark, d):
    found = bootstrap.bootnet(customers(spark, d), boot_type="case", n_boots=5, case_n=3, method="cor", seed=1)
    return found.case_drop_correlations.groupBy(F.round("proportion", 9).alias("proportion"), "statistic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT \"group\", statistic, CAST(4 * k AS BIGINT) AS n, true AS original FROM (SELECT unnest(['A', 'N', 'R']) AS \"group\"), (VALUES ('edge', 6), ('strength', 4), ('closeness', 4), ('betweenness', 4), ('expectedInfluence', 4)) AS t(statistic, k)")
def group_bootstrap(spark, d):
    found = group.bootnet_group(c.lines(spark, d), group_col="group", n_boots=3, lambda1=20.0, lambda2=5.0, seed=1)
    return found.statistics.groupBy("group", "statistic").agg(F.count(F.lit(1)).alias("n"), F.max("is_original").alias("original"))


# Plots' tables ---------------------------------------------------------------------------------


@query(f"WITH {ORDER_SQL}, {c._both(ORDER)}, s AS (SELECT node, sum(abs(weight)) AS s FROM b GROUP BY node), m AS (SELECT min(s) AS low, max(s) AS high FROM s) SELECT node, round((s - low) / (high - low), 6) AS size FROM s, m")
def node_sizes(spark, d):
    nodes, _ = plotting.network_data(cor_network(spark, d), "circular")
    return rounded(rows_of(spark, [(x["label"], x["size"]) for x in nodes], "node string, size double"), "size")


@query(f"""WITH {ORDER_SQL}, {c._both(ORDER)}, s AS (SELECT node, sum(abs(weight)) AS s FROM b GROUP BY node), z AS (SELECT node, (s - avg(s) OVER ()) / (stddev_samp(s) OVER () + 1e-10) AS z FROM s)
    SELECT 'strength' AS measure, CAST(row_number() OVER (ORDER BY z) AS INTEGER) AS place, node, round(z, 6) AS value FROM z""")
def standardised_centrality(spark, d):
    found = plotting.centrality_data(cor_network(spark, d), ["strength"])
    return rounded(rows_of(spark, [(m, k + 1, x, v) for m, t in found.items() for k, (x, v) in enumerate(t.items())], "measure string, place int, node string, value double"), "value")


@query("SELECT node, round(cos(2 * pi() * k / 5), 6) + 0.0 AS x, round(sin(2 * pi() * k / 5), 6) + 0.0 AS y FROM (VALUES " + ", ".join(f"('{n}', {k})" for k, n in enumerate(ORDER)) + ") AS t(node, k)")
def circular_layout(spark, d):
    found = plotting.positions(Network(np.zeros((5, 5)), tuple(ORDER), "none", 0), "circular")
    return rows_of(spark, [(n, round(float(x), 6) + 0.0, round(float(y), 6) + 0.0) for n, (x, y) in zip(ORDER, found, strict=True)], "node string, x double, y double")


@query(values("k, says", "(0, 'light')", "(1, 'dark')", "(2, 'Unknown theme: ''blue''. Available: light, dark')", "(3, 'light')"))
def themes(spark, d):
    plotting.set_theme("light")
    said = [plotting.get_theme()]
    plotting.set_theme("dark")
    said.append(plotting.get_theme())
    said.append(message(lambda: plotting.set_theme("blue")))
    plotting.set_theme("light")
    return rows_of(spark, list(enumerate([*said, plotting.get_theme()])), "k int, says string")


@query(f"WITH {ORDER_SQL}, {c._both(ORDER)}, s AS (SELECT node, sum(abs(weight)) AS s FROM b GROUP BY node), m AS (SELECT min(s) AS low, max(s) AS high FROM s) SELECT node, round(330 * (s - low) / (high - low), 4) AS angle FROM s, m")
def aura_angles(spark, d):
    found = plotting.aura_angles(cor_network(spark, d))
    return rows_of(spark, [(n, round(float(a), 4)) for n, a in zip(ORDER, found, strict=True)], "node string, angle double")


# Series ----------------------------------------------------------------------------------------


@query(f"WITH {PANEL_SQL}, {_DAYS}, z AS (SELECT row_id, {c._LAG} FROM y WINDOW w AS (ORDER BY row_id)) SELECT row_id, {', '.join(f'round({v}, 6) AS {v}, round({v}_lag, 6) AS {v}_lag' for v in PANEL)} FROM z WHERE v0_lag IS NOT NULL")
def lag_series(spark, d):
    return rounded(lag.lag_pairs(days(spark, d), PANEL, order_by="row_id"), *c._lag_columns())


@query(f"""WITH {PANEL_SQL}, {_DAYS}, z AS (SELECT row_id, {c._LAG} FROM y WINDOW w AS (ORDER BY row_id)), q AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM z WHERE v0_lag IS NOT NULL)
    SELECT CAST(CASE WHEN k < (n % 4) * (n // 4 + 1) THEN k // (n // 4 + 1) ELSE (k - n % 4) // (n // 4) END AS INTEGER) AS fold, count(*) AS n, round(sum(v0 * v1_lag), 3) AS product FROM q GROUP BY 1""")
def fold_sums(spark, d):
    _, found = timeseries.fold_sums(lag.lag_pairs(days(spark, d), PANEL, order_by="row_id"), PANEL, "row_id", 4)
    return rows_of(spark, [(f, n, round(float(zz[3, 1]), 3)) for f, (n, _, zz) in found.items()], "fold int, n long, product double")


@query(f"""WITH {_PAIRS}, r AS (SELECT """ + ", ".join(f"v{j} - (0.1 * {j} + (subject % 3) + " + " + ".join(f"{0.05 * (j + 1) * (k + 1):.2f} * v{k}_lag" for k in range(3)) + f") AS v{j}" for j in range(3))
       + f" FROM x WHERE gap = 1) {pair_sql(PANEL, 'r')}")
def panel_residuals(spark, d):
    """Correlations of residuals from given effects: an intercept for each subject, the same slopes."""
    pairs = lag.lag_pairs(c.panel(spark, d), PANEL, order_by="beep", subject="subject", beep="beep")
    b = np.array([[0.1 * j, *(0.05 * (j + 1) * (k + 1) for k in range(3))] for j in range(3)])
    effects = {s: b + np.array([s % 3, 0, 0, 0]) for (s,) in c.panel(spark, d).select("subject").distinct().collect()}
    cor, _ = multilevel._residual_correlations(pairs, PANEL, "subject", effects, b, "long")
    return rounded(Network(cor, tuple(PANEL), "cor", 0).edges_df, "weight")


@query(f"""WITH {PANEL_SQL}, {_DAYS}, z AS (SELECT row_id, {c._LAG} FROM y WINDOW w AS (ORDER BY row_id)), r AS (SELECT """
       + ", ".join(f"v{j} - (" + " + ".join(f"{0.05 * (j + 1) * (k + 1):.2f} * v{k}_lag" for k in range(3)) + f") AS v{j}" for j in range(3)) + f" FROM z WHERE v0_lag IS NOT NULL) {pair_sql(PANEL, 'r')}")
def series_residuals(spark, d):
    pairs = lag.lag_pairs(days(spark, d), PANEL, order_by="row_id")
    b = np.array([[0.05 * (j + 1) * (k + 1) for k in range(3)] for j in range(3)])
    return rounded(degree.edges(degree.weights_of(moments.correlations(timeseries.residuals(pairs, PANEL, b), PANEL))), "weight")


# Graphs ----------------------------------------------------------------------------------------

_PATHS = f"""WITH RECURSIVE {ORDER_SQL}, {c._both(ORDER)}, s AS (SELECT node1 AS a, node2 AS b, 1 / abs(weight) AS d FROM e UNION ALL SELECT node2, node1, 1 / abs(weight) FROM e),
    w(a, b, d, p) AS (SELECT a, b, d, [a, b] FROM s UNION ALL SELECT w.a, s.b, w.d + s.d, list_append(w.p, s.b) FROM w JOIN s ON w.b = s.a WHERE NOT list_contains(w.p, s.b)),
    m AS (SELECT a, b, min(d) AS d, arg_min(p, d) AS p FROM w GROUP BY a, b), t AS (SELECT unnest(p[2:len(p) - 1]) AS node FROM m WHERE a < b),
    n AS (SELECT node, sum(abs(weight)) AS strength, sum(weight) AS influence FROM b GROUP BY node), k AS (SELECT node, count(*) AS k FROM t GROUP BY node), q AS (SELECT b AS node, sum(d) AS d FROM m GROUP BY b)"""


@query(f"{_PATHS} SELECT node, round(coalesce(k, 0) / 6.0, 6) AS betweenness FROM n LEFT JOIN k USING (node)")
def betweenness(spark, d):
    return rounded(centrality(cor_network(spark, d)).select("node", "betweenness"), "betweenness")


@query(f"{_PATHS} SELECT node, round(strength, 6) AS strength, round(4 / q.d, 6) AS closeness, round(coalesce(k, 0) / 6.0, 6) AS betweenness, round(influence, 6) AS \"expectedInfluence\" FROM n LEFT JOIN k USING (node) JOIN q USING (node)")
def centrality_table(spark, d):
    return rounded(cor_network(spark, d).centrality(), "strength", "closeness", "betweenness", "expectedInfluence")


@query(f"WITH {ORDER_SQL} {pair_sql(ORDER, 'f', 'abs(corr({a}, {b}))')}")
def graph_preparation(spark, d):
    """Communities see absolute weights without loops."""
    net = cor_network(spark, d)
    looped = Network(net.adjacency + np.eye(5), net.labels, "cor", 0)
    return rounded(Network(community._weights(looped, True), net.labels, "cor", 0).edges_df, "weight")


_NAME = "'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"


def nations(spark, d, across: float) -> Network:
    """Nations as nodes: strong edges within a region, weak ones across."""
    f = c.table(spark, d, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("node"), "n_nationkey", "n_regionkey").collect()  # 25 rows
    f = sorted(f, key=lambda r: r.node)
    w = np.array([[0.0 if a is b else 0.5 + (a.n_nationkey * b.n_nationkey % 7) / 20 if a.n_regionkey == b.n_regionkey else across for b in f] for a in f])
    return Network(w, tuple(r.node for r in f), "regions", 0)


_REGIONS = f"WITH m AS (SELECT {_NAME} AS node, n_regionkey AS c FROM nation), f AS (SELECT c, min(node) AS first FROM m GROUP BY c)"
_MEMBERS = f"{_REGIONS} SELECT node, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS community FROM m JOIN f USING (c)"


@query(f"{_REGIONS} SELECT node, first FROM m JOIN f USING (c)")
def connected_components(spark, d):
    net = nations(spark, d, 0.0)
    return rows_of(spark, [(x, net.labels[k]) for x, k in zip(net.labels, graph.connected(net.adjacency), strict=True)], "node string, first string")


@query(_MEMBERS)
def walktrap(spark, d):
    return community.walktrap(nations(spark, d, 0.01))


@query(_MEMBERS)
def walktrap_of_components(spark, d):
    return community.walktrap(nations(spark, d, 0.0))


@query(_MEMBERS)
def louvain(spark, d):
    return community.louvain(nations(spark, d, 0.01), seed=1)


@query(_MEMBERS)
def greedy(spark, d):
    return community.greedy_modularity(nations(spark, d, 0.01))


@query(_MEMBERS)
def network_communities(spark, d):
    return nations(spark, d, 0.01).communities("greedy_modularity")


# Estimators ------------------------------------------------------------------------------------


@query(values("method", "('cor')", "('ebicglasso')", "('pcor')"))
def available_methods(spark, d):
    return rows_of(spark, [(x,) for x in estimation.available_methods() if x in ("cor", "ebicglasso", "pcor")], "method string")


@query(values("asked, name, protocol", "('COR', 'cor', true)", "('PCor', 'pcor', true)", "('ebicGLASSO', 'EBICglasso', true)"))
def estimators(spark, d):
    found = [(x, estimation.get_estimator(x)) for x in ("COR", "PCor", "ebicGLASSO")]
    return rows_of(spark, [(x, e.name, isinstance(e, estimation.NetworkEstimator)) for x, e in found], "asked string, name string, protocol boolean")


def _partial_sql(names: list[str]) -> str:
    """Partial correlations given all other variables, one variable at a time."""
    wanted: list[dict[str, str]] = [{} for _ in names[1:]]
    name = lambda a, b, given: "_".join([*sorted((a, b)), "g", *given])

    def need(a: str, b: str, given: tuple[str, ...]) -> str:
        key = name(a, b, given)
        if not given:
            wanted[0][key] = f"corr({a}, {b})"
        elif key not in wanted[len(given)]:
            z, rest = given[-1], given[:-1]
            ab, az, bz = (need(x, y, rest) for x, y in ((a, b), (a, z), (b, z)))
            wanted[len(given)][key] = f"({ab} - {az} * {bz}) / sqrt((1 - {az} * {az}) * (1 - {bz} * {bz}))"
        return key

    out = [(a, b, need(a, b, tuple(x for x in names if x not in (a, b)))) for a, b in combinations(names, 2)]
    steps, source = [], "f"
    for k, level in enumerate(wanted):
        kept = "" if not k else "*, "
        steps.append(f"l{k} AS (SELECT {kept}{', '.join(f'{v} AS {n}' for n, v in level.items())} FROM {source})")
        source = f"l{k}"
    return ", ".join(steps) + " " + union(f"SELECT '{a}' AS node1, '{b}' AS node2, round({k}, 6) AS weight FROM {source}" for a, b, k in out)


@query(f"WITH {ORDER_SQL}, {_partial_sql(ORDER)}")
def pcor_general(spark, d):
    return rounded(estimation.estimate_network(c.orders(spark, d).select(*ORDER), method="pcor").edges_df, "weight")


@query(f"WITH {ORDER_SQL} {pair_sql(ORDER, 'f', 'sign(corr({a}, {b})) * greatest(abs(corr({a}, {b})) - 0.05, 0)')}")
def soft_threshold(spark, d):
    r = kernel.soft(cor_matrix(spark, d), 0.05)
    found = [(ORDER[i], ORDER[j], round(float(r[i, j]), 6)) for i, j in combinations(range(5), 2)]
    return rows_of(spark, found, "node1 string, node2 string, weight double")


# Two variables: the graphical lasso moves the covariance by the penalty, so that the path has a closed form.

_TWO = f"""{ORDER_SQL}, r AS (SELECT corr(qty, disc) AS r, count(*) AS n FROM f), k AS (SELECT unnest(range(0, 100)) AS k),
    g AS (SELECT k, r, n, pow(10, log10(abs(r)) + k * (log10(abs(r) * 0.01) - log10(abs(r))) / 99) AS l FROM r, k), w AS (SELECT *, sign(r) * (abs(r) - l) AS w FROM g),
    q AS (SELECT k, l, w, -n * (-ln(1 - w * w) - (2 - 2 * r * w) / (1 - w * w)) + CASE WHEN k > 0 THEN ln(n) + 2 * ln(2) ELSE 0 END AS ebic FROM w)"""


@query(f"WITH {_TWO} SELECT round(l, 9) AS lambda, round(ebic, 4) AS ebic FROM q WHERE k > 0")
def glasso_path_of_two(spark, d):
    info = estimation.estimate_network(c.orders(spark, d).select("qty", "disc")).estimation_info
    largest = max(x for x, _ in info.curve)
    return rows_of(spark, [(round(x, 9), round(v, 4)) for x, v in info.curve if x < largest], "lambda double, ebic double")


@query(f"WITH {_TWO}, s AS (SELECT arg_min(l, ebic) AS l, arg_min(w, ebic) AS w, min(ebic) AS ebic FROM q WHERE k > 0) SELECT round(w, 6) AS weight, round(l, 6) AS lambda, round(ebic, 4) AS ebic FROM s")
def ebicglasso_of_two(spark, d):
    """Of the penalties that leave the edge, the one of smallest EBIC, and its network."""
    cor = cor_matrix(spark, d, ["qty", "disc"])
    n = c.orders(spark, d).count()
    grid = kernel.descending_grid(abs(cor[0, 1]), 0.01, 100)[1:]
    fits = [(kernel.ebic(p, cor, n, 0.5), x, kernel.to_partial(p)[0, 1]) for x in grid for _, p in [kernel.graphical_lasso(cor, x)]]
    best = min(fits, key=lambda f: f[0])
    return rows_of(spark, [(round(float(best[2]), 6), round(float(best[1]), 6), round(float(best[0]), 4))], "weight double, lambda double, ebic double")


@query(true_for(ORDER))
def ebicglasso_optimum(spark, d):
    """Conditions of the optimum at the selected penalty: covariances differ from the data's by the penalty
    where there is an edge, by no more where there is none."""
    info = estimation.estimate_network(c.orders(spark, d).select(*ORDER)).estimation_info
    w, p = kernel.graphical_lasso(info.cor_matrix, info.selected_lambda, tol=1e-9)
    off = w - info.cor_matrix
    good = np.where(p == 0, np.abs(off) <= info.selected_lambda * (1 + 1e-6), np.abs(off - info.selected_lambda * np.sign(p)) < 1e-6)
    return rows_of(spark, [(ORDER[i], ORDER[j], bool(good[i, j])) for i, j in combinations(range(5), 2)], "node1 string, node2 string, optimal boolean")


@query(f"WITH {ORDER_SQL}, {c._both(ORDER)} SELECT node1, node2, sign(weight) AS side FROM e WHERE abs(weight) > 0.5")
def ebicglasso_strong_edges(spark, d):
    """Pairs that correlate strongly are edges of the network, of the same sign."""
    net = estimation.estimate_network(c.orders(spark, d).select(*ORDER))
    cor = net.estimation_info.cor_matrix
    found = [(ORDER[i], ORDER[j], float(np.sign(net.adjacency[i, j]))) for i, j in combinations(range(5), 2) if abs(cor[i, j]) > 0.5]
    return rows_of(spark, found, "node1 string, node2 string, side double")


# Joint graphical lasso ---------------------------------------------------------------------------

_TWO_GROUPS = f"WITH {LINE_SQL}, r AS (SELECT \"group\", corr(qty, rev) AS r, CASE WHEN \"group\" = 'A' THEN 40 ELSE 60 END AS n FROM g WHERE \"group\" <> 'N' GROUP BY 1)"


def _two_groups(spark, d) -> list[np.ndarray]:
    cors = moments.matrix(moments.correlations(c.lines(spark, d), ["qty", "rev"], by="group"), 2, "group")
    return [cors[g] for g in "AR"]


@query(f"{_TWO_GROUPS} SELECT \"group\", round(sign(r) * greatest(abs(r) - 4.0 / n, 0), 4) AS weight FROM r")
def jgl_without_similarity(spark, d):
    """Without a penalty on differences each group is a graphical lasso of its own."""
    fit = kernel.joint_graphical_lasso(_two_groups(spark, d), [40, 60], 4.0, 0.0, "group", max_iter=20_000, tol=1e-9)
    return rows_of(spark, [(g, round(float(kernel.to_partial(p)[0, 1]), 4)) for g, p in zip("AR", fit, strict=True)], "group string, weight double")


@query(f"{_TWO_GROUPS}, m AS (SELECT sum(n * r) / sum(n) AS r FROM r) SELECT \"group\", round(sign(m.r) * greatest(abs(m.r) - 8.0 / 100, 0), 4) AS weight FROM r, m")
def jgl_fused(spark, d):
    """Under a large penalty on differences the groups share the edge of their pooled correlation."""
    fit = kernel.joint_graphical_lasso(_two_groups(spark, d), [40, 60], 4.0, 500.0, "fused", max_iter=50_000, tol=1e-9)
    return rows_of(spark, [(g, round(float(kernel.to_partial(p)[0, 1]), 4)) for g, p in zip("AR", fit, strict=True)], "group string, weight double")


@query(union(f"SELECT '{g}' AS \"group\", '{a}' AS node1, '{b}' AS node2, true AS optimal" for g in "ANR" for a, b in combinations(LINE, 2)))
def jgl_group_optimum(spark, d):
    """Conditions of the optimum under the group penalty, where all groups have the edge or none has."""
    cors = moments.matrix(moments.correlations(c.lines(spark, d), LINE, by="group"), len(LINE), "group")
    s, n, one, two = np.stack([cors[g] for g in "ANR"]), np.array([50.0, 60.0, 70.0]), 2.0, 3.0
    z = np.stack(kernel.joint_graphical_lasso(list(s), list(n), one, two, "group", max_iter=50_000, tol=1e-9))
    slope = n[:, None, None] * (s - np.linalg.inv(z))
    norm = np.sqrt((z**2).sum(0))
    alone = np.maximum(np.abs(slope) - one, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        pull = -slope - one * np.sign(z) - two * z / norm
    good = np.where(norm > 1e-9, np.where(z != 0, np.abs(pull) < 1e-3, np.abs(slope) <= one + 1e-3), np.sqrt((alone**2).sum(0)) <= two + 1e-3)
    found = [(g, LINE[i], LINE[j], bool(good[k, i, j])) for k, g in enumerate("ANR") for i, j in combinations(range(len(LINE)), 2)]
    return rows_of(spark, found, "group string, node1 string, node2 string, optimal boolean")


@query(f"""WITH {LINE_SQL}, e AS ({pair_sql(LINE, 'g', head='"group", ', tail=' GROUP BY "group"').replace('round(', '(').replace(', 6)', ')')}),
    o AS (SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY weight) AS k FROM e), y AS (SELECT *, weight - 0.002 * (2 * k - 4) AS y FROM o),
    t AS (SELECT node1, node2, max(CASE WHEN k = 1 THEN y END) AS a, max(CASE WHEN k = 2 THEN y END) AS b, max(CASE WHEN k = 3 THEN y END) AS c FROM y GROUP BY 1, 2)
    SELECT "group", node1, node2, round(CASE k WHEN 1 THEN least(a, (a + b) / 2, (a + b + c) / 3) WHEN 2 THEN greatest(least(b, (b + c) / 2), least((a + b) / 2, (a + b + c) / 3))
      ELSE greatest(c, (b + c) / 2, (a + b + c) / 3) END, 6) AS weight FROM y JOIN t USING (node1, node2)""")
def fused_prox(spark, d):
    """Three groups under the pairwise fused penalty: ranks shift by it, and what then is out of order is pooled."""
    cors = moments.matrix(moments.correlations(c.lines(spark, d), LINE, by="group"), len(LINE), "group")
    v = kernel.fused_prox(np.stack([cors[g] for g in "ANR"]), 0.002)
    found = [(g, LINE[i], LINE[j], round(float(v[k, i, j]), 6)) for k, g in enumerate("ANR") for i, j in combinations(range(len(LINE)), 2)]
    return rows_of(spark, found, "group string, node1 string, node2 string, weight double")


@query(f"""{_TWO_GROUPS}, l AS (SELECT sum(-n * (-ln(1 - r * r) - 2)) AS fit, sum(2) AS aic, sum(ln(n)) AS bic, sum(ln(n) + 2 * ln(2)) AS ebic FROM r)
    SELECT criterion, round(fit + CASE criterion WHEN 'aic' THEN aic WHEN 'bic' THEN bic ELSE ebic END, 6) AS value FROM l, (SELECT unnest(['aic', 'bic', 'ebic']) AS criterion)""")
def group_criteria(spark, d):
    s = _two_groups(spark, d)
    found = [(x, round(float(kernel.group_criterion([np.linalg.inv(m) for m in s], s, [40, 60], 0.5, x)), 6)) for x in ("aic", "bic", "ebic")]
    return rows_of(spark, found, "criterion string, value double")


@query(values("search, first_of_least", "('sequential', true)", "('simultaneous', true)"))
def penalty_search(spark, d):
    """The chosen penalties score least of those searched, on executors as on the driver."""
    s, n = _two_groups(spark, d), [40, 60]
    cov, size = dict(zip("AR", s, strict=True)), dict(zip("AR", n, strict=True))
    score = lambda a, b: kernel.score_penalties(s, n, a, b, "fused", "ebic", 0.5, 500, 1e-4)
    grid = [float(x) for x in kernel.group_grid(s, 4, 0.01)]
    out = []
    for search in ("sequential", "simultaneous"):
        a, b = group.select_penalties(cov, size, "fused", "ebic", 0.5, search, 4, 4, 0.01, 0.01, 500, 1e-4)
        if search == "sequential":
            first = min(grid, key=lambda x: score(x, 0.0))
            want = (first, min(grid, key=lambda x: score(first, x)))
        else:
            want = min(((x, y) for x in grid for y in grid), key=lambda p: score(*p))
        out.append((search, (a, b) == want))
    return rows_of(spark, out, "search string, first_of_least boolean")


# Autoregressions ----------------------------------------------------------------------------------


@query(union(f"SELECT '{a}' AS outcome, '{b}' AS lag, true AS optimal" for a in PANEL for b in PANEL))
def lasso_optimum(spark, d):
    """Conditions of the lasso's optimum, for each outcome, at the penalty that cross-validation chose."""
    pairs = lag.lag_pairs(days(spark, d), PANEL, order_by="row_id")
    _, sums = timeseries.fold_sums(pairs, PANEL, "row_id", 5)
    folds, p = sorted(sums), 3
    out = []
    for j in range(p):
        f = regression.FoldSums(
            np.array([sums[k][0] for k in folds], float), np.stack([sums[k][1][:p] for k in folds]), np.array([sums[k][1][p + j] for k in folds]),
            np.stack([sums[k][2][:p, :p] for k in folds]), np.stack([sums[k][2][:p, p + j] for k in folds]), np.array([sums[k][2][p + j, p + j] for k in folds]),
        )
        b, alpha = regression.lasso_cv(f, n_alphas=30, tol=1e-12)
        _, _, _, gram, target = regression._centred(f.without(None))
        slope, near = target - gram @ b, 1e-6 * max(alpha, 1e-300) + 1e-9 * np.abs(target).max()
        good = np.where(b != 0, np.abs(slope - alpha * np.sign(b)) <= near, np.abs(slope) <= alpha + near)
        out += [(PANEL[j], PANEL[k], bool(good[k])) for k in range(p)]
    return rows_of(spark, out, "outcome string, lag string, optimal boolean")


@query("SELECT 'temporal' AS network, CAST(9 AS BIGINT) AS entries, true AS directed, count(*) - 1 AS n FROM (SELECT DISTINCT date_trunc('day', ts) FROM events) "
       "UNION ALL SELECT 'contemporaneous', CAST(3 AS BIGINT), false, count(*) - 1 FROM (SELECT DISTINCT date_trunc('day', ts) FROM events)")
def var_networks(spark, d):
    net = timeseries.estimate_var_network(days(spark, d))
    found = [("temporal", net.temporal), ("contemporaneous", net.contemporaneous)]
    return rows_of(spark, [(k, x.weights().count(), x.directed, x.n_observations) for k, x in found], "network string, entries long, directed boolean, n long")


@query(union(f"SELECT '{s}' AS structure, '{v}' AS outcome, true AS optimal, true AS balanced" for s in ("fixed", "orthogonal") for v in PANEL))
def mixed_model_optimum(spark, d):
    """No change of a variance raises the restricted likelihood, and weighted residuals are orthogonal to the regressors."""
    pairs = lag.lag_pairs(lag.within_subject_z(c.panel(spark, d).drop("week"), PANEL, "subject"), PANEL, order_by="beep", subject="subject", beep="beep")
    upper, out = np.triu_indices(4), []
    for j, v in enumerate(PANEL):
        sums = multilevel.subject_sums(pairs, PANEL, "subject", j).toPandas()
        a = np.zeros((len(sums), 4, 4))
        a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = np.stack(sums["xx"].to_list())
        cross, yy, n = np.stack(sums["xy"].to_list()), sums["yy"].to_numpy(float), sums["n"].to_numpy(float)
        for s in ("fixed", "orthogonal"):
            m = regression.mixed_model(a, cross, yy, n, s)
            k = 4 if s == "orthogonal" else 1
            score = lambda t: regression._profile(regression._covariance(np.array(t), 4, s), a, cross, yy, float(n.sum()))[0]  # noqa: B023, E731
            steps = [score(t) for i in range(k) for step in (0.9, 1.1) for t in [m.theta * np.where(np.arange(k) == i, step, 1.0)]]
            psi = regression._covariance(m.theta, 4, s)
            inner = np.linalg.solve(np.eye(4) + psi @ a, np.broadcast_to(psi, a.shape))
            left = cross - (a @ m.fixed[:, None])[..., 0]
            normal = (left - np.einsum("sij,sjk,sk->si", a, inner, left)).sum(0)
            out.append((s, v, bool(max(steps) <= m.loglik + 1e-4 * abs(m.loglik)), bool(np.abs(normal).max() < 1e-6 * np.abs(cross).sum())))
    return rows_of(spark, out, "structure string, outcome string, optimal boolean, balanced boolean")


@query(f"""WITH {_PAIRS}, n AS (SELECT subject, count(*) AS n FROM x WHERE gap = 1 GROUP BY subject), s AS (SELECT DISTINCT subject FROM p)
    SELECT s.subject, coalesce(n.n, 0) AS n FROM s LEFT JOIN n USING (subject)""")
def subject_networks(spark, d):
    """Every subject has a network, which counts that subject's pairs of days."""
    f = c.panel(spark, d).drop("week").withColumn("row_id", F.col("beep"))
    net = multilevel.estimate_multilevel_network(f, "subject", beep="beep", temporal="fixed", temporal_alpha=None, scale=True)
    return rows_of(spark, [(s, net.subject_network(s).n_observations) for s in net.subject_ids], "subject long, n long")


@query(values("structure, formula", "('correlated', 'a ~ a_lag + b_lag + (1 + a_lag + b_lag | who)')", "('orthogonal', 'a ~ a_lag + b_lag + (1 + a_lag + b_lag || who)')", "('fixed', 'a ~ a_lag + b_lag + (1 | who)')"))
def lmer_formulas(spark, d):
    return rows_of(spark, [(s, multilevel.lmer_formula("a", ["a_lag", "b_lag"], "who", s)) for s in regression.STRUCTURES], "structure string, formula string")


@query(values("p, wanted, used, warned", "(8, 'correlated', 'correlated', false)", "(9, 'correlated', 'orthogonal', true)", "(9, 'fixed', 'fixed', false)"))
def effect_structures(spark, d):
    out = []
    for p, wanted in ((8, "correlated"), (9, "correlated"), (9, "fixed")):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            out.append((p, wanted, multilevel.auto_structure(p, wanted), bool(seen)))
    return rows_of(spark, out, "p int, wanted string, used string, warned boolean")


@query(values("says", "('mixed models: simpler random effects for: a (correlated -> fixed); convergence trouble for: b; see fit_info[outcome][''warnings'']')", "('None')"))
def convergence_notes(spark, d):
    info = {"a": {"actual_re": "fixed", "warnings": []}, "b": {"actual_re": "correlated", "warnings": ["x"]}}
    fine = {"a": {"actual_re": "fixed", "warnings": []}}
    return rows_of(spark, [(str(multilevel.convergence_note(i, s)),) for i, s in ((info, "correlated"), (fine, "fixed"))], "says string")


@query(values("note, severe, severe_in_r", "('The random effects covariance matrix is Singular', true, true)", "('The MLE may be on the boundary of the parameter space', true, true)",
              "('Model failed to converge with 1 negative eigenvalue', false, true)", "('some other remark', false, false)"))
def severe_warnings(spark, d):
    notes = ("The random effects covariance matrix is Singular", "The MLE may be on the boundary of the parameter space", "Model failed to converge with 1 negative eigenvalue", "some other remark")
    return rows_of(spark, [(n, regression.is_severe([n]), regression.is_severe([n], regression.SEVERE_IN_R)) for n in notes], "note string, severe boolean, severe_in_r boolean")


@query(values("says", "('engine=''lme4'' needs R with lme4 and lmerTest, and the Python package rpy2, which are not part of this engine')"))
def lme4_engine(spark, d):
    f = c.panel(spark, d).drop("week")
    return rows_of(spark, [(message(lambda: multilevel.estimate_multilevel_network(f, "subject", beep="beep", order_by="beep", engine="lme4")),)], "says string")


@query(f"WITH {ORDER_SQL} SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS number, round(coalesce(sum(price) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before FROM f")
def running_order(spark, d):
    f = c.orders(spark, d).select("row_id", "price")
    out = order.running(order.numbered(f, "row_id", "number"), "row_id", F.col("price"), "before")
    return out.select("row_id", "number", F.round("before", 2).alias("before"))
