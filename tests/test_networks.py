"""Networks from end to end: invariants, hand-computed values, errors."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import meshwork as mw
from meshwork.functions.bootstrap import BootstrapResult, proportions
from meshwork.functions import estimation
from meshwork.operators import lag, moments
from meshwork.operators.moments import correlations, matrix

LABELS = ("A", "B", "C")


def net(rows, directed=False, labels=LABELS):
    return mw.Network(np.array(rows, float), labels, "test", 10, directed=directed)


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_degree_values(spark):
    undirected = net([[0, 0.5, -0.3], [0.5, 0, 0.2], [-0.3, 0.2, 0]])
    assert column(mw.strength(undirected), "node", "strength") == pytest.approx({"A": 0.8, "B": 0.7, "C": 0.5})
    assert column(mw.expected_influence(undirected), "node", "expectedInfluence") == pytest.approx({"A": 0.2, "B": 0.7, "C": -0.1})
    cycle = net([[0, 0.5, 0], [0, 0, 0.3], [0.2, 0, 0]], True)
    assert column(mw.strength(cycle), "node", "strength") == pytest.approx({"A": 0.7, "B": 0.8, "C": 0.5})
    directed = net([[0, 0.4, -0.2], [0.3, 0, 0], [0, 0.5, 0]], True)
    table = directed.centrality().toPandas().set_index("node")
    assert table["inStrength"].tolist() == pytest.approx([0.6, 0.3, 0.5])
    assert table["outStrength"].tolist() == pytest.approx([0.3, 0.9, 0.2])
    assert table["inExpectedInfluence"].tolist() == pytest.approx([0.2, 0.3, 0.5])
    assert table["outExpectedInfluence"].tolist() == pytest.approx([0.3, 0.9, -0.2])
    with pytest.raises(ValueError, match="only defined for directed"):
        mw.in_strength(undirected)


def test_edges_and_matrix(spark):
    a = net([[0, 0.5, 0], [0.5, 0, 0.2], [0, 0.2, 0]])
    assert [(r.node1, r.node2, r.weight) for r in a.edges_df.collect()] == [("A", "B", 0.5), ("B", "C", 0.2)]
    assert a.adjacency_df.toPandas()[list(LABELS)].to_numpy().tolist() == a.adjacency.tolist()
    none = net(np.zeros((3, 3)))
    assert none.edges_df.columns == ["node1", "node2", "weight"]
    assert none.edges_df.count() == 0
    loops = net([[0.9, 0, 0], [0.5, 0, 0], [0, 0, 0]], True)
    assert [(r.node1, r.node2) for r in loops.edges_df.collect()] == [("B", "A")]


def test_estimators(spark):
    data = mw.make_bfi25(spark, 300)
    table = data.toPandas().drop(columns="row_id")
    cor = mw.estimate_network(data, method="COR")
    want = table.corr().to_numpy() - np.eye(25)
    assert np.allclose(cor.adjacency, want, atol=1e-9)
    pcor = mw.estimate_network(data, method="pcor", threshold=0.05)
    p = np.linalg.inv(table.corr().to_numpy())
    want = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
    assert np.allclose(pcor.adjacency, np.where((np.abs(want) < 0.05) | np.eye(25, dtype=bool), 0, want), atol=1e-8)
    glasso = mw.estimate_network(data.select("row_id", *table.columns[:10]), n_lambda=40)
    assert np.allclose(glasso.adjacency, glasso.adjacency.T) and np.abs(glasso.adjacency).max() <= 1
    assert glasso.estimation_info.lambda_ebic_curve.columns == ["lambda", "ebic"]
    assert glasso.estimation_info.selected_lambda > 0
    assert mw.available_methods() == ["cor", "ebicglasso", "pcor"]
    with pytest.raises(ValueError, match="Unknown estimation method"):
        mw.estimate_network(data, method="nope")


def test_spearman_and_missing_values(spark):
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"a": rng.integers(0, 6, 400).astype(float), "b": rng.normal(size=400), "c": rng.normal(size=400)})
    table["c"] += table["a"]
    frame = spark.createDataFrame(table)
    ranks = table.rank()
    assert np.allclose(matrix(correlations(frame, ["a", "b", "c"], method="spearman"), 3), ranks.corr().to_numpy(), atol=1e-9)
    table.loc[::5, "a"] = np.nan
    table.loc[::7, "b"] = np.nan
    frame = spark.createDataFrame(table)
    pearson = matrix(correlations(frame, ["a", "b", "c"]), 3)
    assert np.allclose(pearson, table.corr().to_numpy(), atol=1e-9)
    both = table[["a", "b"]].dropna().rank().corr().iloc[0, 1]
    assert np.isclose(matrix(correlations(frame, ["a", "b", "c"], method="spearman"), 3)[0, 1], both)
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert correlations(constant, ["x", "y"]).first().r is None


def test_wide_and_grouped_correlations(spark):
    rng = np.random.default_rng(2)
    table = pd.DataFrame(rng.normal(5, 2, (300, 15)), columns=[f"x{k}" for k in range(15)])
    table.iloc[::9, 3] = np.nan
    table["g"] = np.where(np.arange(300) % 3 == 0, "u", "v")
    names = list(table.columns[:15])
    found = matrix(correlations(spark.createDataFrame(table).repartition(4), names, by="g"), 15, "g")
    for g, part in table.groupby("g"):
        assert np.allclose(found[g], part[names].corr().to_numpy(), atol=1e-9)


def test_validation(spark):
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    with pytest.raises(ValueError, match="numeric"):
        mw.estimate_network(one)
    with pytest.raises(ValueError, match="at least 2"):
        mw.estimate_network(one.select("a"))
    with pytest.raises(ValueError, match="not found"):
        mw.estimate_var_network(mw.make_var_data(spark, 30, 3), beep="beep")
    with pytest.raises(ValueError, match="NaN"):
        mw.estimate_var_network(spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double"))


def test_lag_counts(spark):
    single = spark.createDataFrame([(i, float(i), 1.0, b) for i, b in enumerate([1, 2, 5, 6, 7])], "row_id long, V1 double, V2 double, beep int")
    assert lag.lag_pairs(single, ["V1", "V2"], order_by="row_id", beep="beep").count() == 3
    days = spark.createDataFrame([(i, 0.0, b, d) for i, (b, d) in enumerate([(1, 1), (2, 1), (3, 1), (1, 2), (2, 2)])], "row_id long, V1 double, beep int, day int")
    assert lag.lag_pairs(days, ["V1"], order_by="row_id", beep="beep", day="day").count() == 3
    rows = [("S1", b) for b in (1, 2, 4, 5, 6)] + [("S2", b) for b in range(1, 6)]
    panel = spark.createDataFrame([(i, s, b, 1.0) for i, (s, b) in enumerate(rows)], "row_id long, subject string, beep int, V1 double")
    assert lag.lag_pairs(panel, ["V1"], order_by="row_id", subject="subject", beep="beep").count() == 7


def test_bootstrap(spark):
    data = mw.make_bfi25(spark, 150).select("row_id", "O1", "O2", "C1", "C2")
    first, again = (mw.bootnet(data, n_boots=20, method="cor", seed=3, statistics=["edge", "strength"]) for _ in range(2))
    key = ["boot_id", "statistic", "node1", "node2"]
    a, b = (x.boot_statistics.toPandas().sort_values(key).reset_index(drop=True) for x in (first, again))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 21 * (6 + 4)
    assert first.n_effective == 20
    summary = first.summary("edge").toPandas()
    assert set(summary.columns) == {"node1", "node2", "mean", "sd", "ci_lower", "ci_upper", "sample"}
    one = a[(a.statistic == "edge") & (a.node1 == "O1") & (a.node2 == "O2")]
    row = summary[(summary.node1 == "O1") & (summary.node2 == "O2")].iloc[0]
    assert np.isclose(row["mean"], one["value"].mean()) and np.isclose(row["sd"], one["value"].std())
    assert np.isclose(row["ci_lower"], np.quantile(one["value"], 0.025))
    assert np.isclose(row["sample"], one[one.boot_id == "original"]["value"].iloc[0])
    table = data.toPandas()
    rows = np.random.default_rng(np.random.default_rng(3).integers(0, 2**31, 20)[0]).choice(150, 150, replace=True)
    want = table.iloc[rows][["O1", "O2"]].corr().iloc[0, 1]
    assert np.isclose(one[one.boot_id == "0"]["value"].iloc[0], want)
    pairs = first.difference_test("strength").toPandas()
    wide = a[(a.statistic == "strength") & (a.boot_id != "original")].pivot(index="boot_id", columns="node1", values="value")
    share = (wide["C1"] > wide["C2"]).mean()
    from meshwork.operators import resampling

    square = resampling.difference_matrix(first.difference_test("strength")).toPandas().set_index("item")
    assert np.isclose(square.loc["C2", "C1"], 2 * min(share, 1 - share))
    replicates = resampling.replicate_matrix(first.statistics, "strength").toPandas()
    assert sorted(replicates["C1"]) == pytest.approx(sorted(wide["C1"]))
    assert np.isclose(pairs[(pairs.item1 == "C1") & (pairs.item2 == "C2")]["p"].iloc[0], 2 * min(share, 1 - share))


def test_case_dropping(spark):
    data = mw.make_bfi25(spark, 120).select("row_id", "O1", "O2", "O3", "C1", "C2")
    found = mw.bootnet(data, n_boots=6, boot_type="case", case_n=4, method="cor", seed=1)
    assert found.case_drop_correlations.count() == 24 * 4
    assert 0 <= found.cs_coefficient("strength") <= 0.75
    with pytest.raises(ValueError, match="nonparametric"):
        found.difference_test("strength")
    assert 0 <= found.cs_coefficient("closeness") <= 0.75
    table = data.toPandas()
    shares = proportions(120, 0.25, 0.75, 4)
    seed = np.random.default_rng(1).integers(0, 2**31, 6 * len(shares))[6]
    kept = np.random.default_rng(seed).choice(120, int(120 * shares[1]), replace=False)
    strength = lambda t: (lambda r: (np.abs(r) - np.eye(len(r))).sum(1))(t.drop(columns="row_id").corr().to_numpy())
    want = np.corrcoef(strength(table), strength(table.iloc[kept]))[0, 1]
    mine = found.case_drop_correlations.where(f"statistic = 'strength' AND boot_id = 0 AND abs(proportion - {shares[1]}) < 1e-9").first()
    assert np.isclose(mine["correlation"], want)
    with pytest.raises(ValueError):
        found.cs_coefficient("nope")
    assert proportions(100, 0.25, 0.75, 3) == [0.75, 0.5, 0.25]


def result_of(spark, rows):
    table = spark.createDataFrame(rows, "proportion double, statistic string, boot_id long, correlation double")
    return BootstrapResult(None, "case", 10, None, table)


def test_cs_values(spark):
    rows = [(0.75, "strength", k, 0.75) for k in range(10)] + [(0.5, "strength", k, 0.5 if k == 0 else 0.9) for k in range(10)]
    assert result_of(spark, rows).cs_coefficient() == pytest.approx(0.25)
    rows = [(0.75, "strength", k, 0.6 if k < 4 else 0.8) for k in range(10)] + [(0.5, "strength", k, 0.5) for k in range(10)]
    assert result_of(spark, rows).cs_coefficient() == 0
    assert result_of(spark, rows).cs_coefficient(quantile=0.5) == pytest.approx(0.25)


def test_inherited_arguments(spark):
    data = mw.make_bfi25(spark, 100).select("row_id", "O1", "O2", "C1")
    fitted = mw.estimate_network(data, method="cor", threshold=0.1)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        mw.bootnet(data, network=fitted, n_boots=2, threshold=0.2)
    assert any("overrides network's estimation_info" in str(w.message) for w in seen)


def test_bootstrap_over_many_blocks(spark, monkeypatch):
    """Blocks, slabs and chunks far smaller than the table, missing values, and ranks: the same replicates."""
    from meshwork.operators import draws

    table = mw.make_bfi25(spark, 300).select("row_id", "O1", "O2", "C1").toPandas().astype({"O1": float, "O2": float})
    table.loc[::7, "O1"] = np.nan
    data = spark.createDataFrame(table)
    data = data.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("O1", "O2")}).repartition(5)
    for name, size in (("BLOCK", 64), ("CHUNK", 37), ("SLAB", 128)):
        monkeypatch.setattr(draws, name, size)
    seeds = np.random.default_rng(2).integers(0, 2**31, 5)
    for method in ("pearson", "spearman"):
        found = mw.bootnet(data, n_boots=5, method="cor", cor_method=method, statistics=["edge"], seed=2).boot_statistics.toPandas()
        for k, s in enumerate(seeds):
            rows = table.drop(columns="row_id").iloc[np.random.default_rng(s).choice(300, 300, replace=True)]
            want = rows.corr(method).loc["O1", "O2"] if method == "pearson" else rows[["O1", "O2"]].dropna().rank().corr().iloc[0, 1]
            mine = found[(found.boot_id == str(k)) & (found.node1 == "O1") & (found.node2 == "O2")]["value"].iloc[0]
            assert np.isclose(mine, want)


def test_bootstrap_of_own_estimator(spark):
    @mw.register("first-two")
    class FirstTwo:
        name = ""

        def estimate(self, data, **kwargs):
            r = data.select(F.corr("O1", "O2")).first()[0]
            return mw.Network(np.array([[0.0, r], [r, 0.0]]), ("O1", "O2"), "first-two", data.count())

    data = mw.make_bfi25(spark, 60).select("row_id", "O1", "O2")
    found = mw.bootnet(data, method="first-two", n_boots=3, statistics=["edge"], seed=4).boot_statistics.toPandas()
    table = data.toPandas()
    seed = np.random.default_rng(4).integers(0, 2**31, 3)[1]
    want = table.iloc[np.random.default_rng(seed).choice(60, 60, replace=True)][["O1", "O2"]].corr().iloc[0, 1]
    assert np.isclose(found[found.boot_id == "1"]["value"].iloc[0], want)
    del estimation._known["first-two"]


def test_order_over_many_buckets(spark, monkeypatch):
    from meshwork.operators import order

    monkeypatch.setattr(order, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(0)
    table = pd.DataFrame({"t": rng.permutation(300), "a": rng.normal(size=300), "g": rng.integers(0, 3, 300), "v": rng.integers(0, 4, 300).astype(float)})
    data = spark.createDataFrame(table).repartition(4)
    assert len(order.bounds(data, "t")) > 20
    numbers = order.numbered(data, "t", "n").toPandas()
    assert (numbers.n == numbers.t).all()
    pairs = lag.lag_pairs(data, ["a"], order_by="t", beep="t").toPandas().sort_values("t")
    series = table.sort_values("t")["a"].to_numpy()
    assert np.array_equal(pairs["a_lag"], series[:-1]) and np.array_equal(pairs["a"], series[1:])
    within = order.numbered(data, "t", "n", ("g",)).toPandas()
    assert (within.n == within.groupby("g")["t"].rank().astype(int) - 1).all()
    ranks = moments.average_ranks(data.select("g", "t", "v", "a"), ["v", "a"], ["g"]).toPandas().set_index("t").sort_index()
    want = table.set_index("t").sort_index().groupby("g")[["v", "a"]].rank()
    assert np.allclose(ranks["v"], want["v"]) and np.allclose(ranks["a"], want["a"])


def test_groups(spark):
    data = mw.make_multigroup(spark, 100, 2, 5)
    found = mw.estimate_group_network(data, group_col="group", n_lambda1=5, n_lambda2=4)
    assert found.group_labels == ["Group1", "Group2"]
    assert found["Group1"].n_observations == 100
    assert set(found.compare_edges().columns) == {"group", "node1", "node2", "weight"}
    assert found.centrality().count() == 10
    frames = [data.where(f"group = 'Group{k}'").drop("group") for k in (1, 2)]
    other = mw.estimate_group_network(frames, lambda1=found.lambda1, lambda2=found.lambda2)
    assert np.allclose(other["Group2"].adjacency, found["Group2"].adjacency)
    with pytest.raises(ValueError, match="group_col"):
        mw.estimate_group_network(data, group_col="nope")
    with pytest.raises(ValueError, match="same variable names"):
        mw.estimate_group_network([frames[0], frames[1].withColumnRenamed("V1", "X")])
    with pytest.warns(UserWarning, match="only one of"):
        mw.estimate_group_network(data, group_col="group", lambda1=0.1, n_lambda1=3, n_lambda2=3)
    boots = mw.bootnet_group(data, group_col="group", n_boots=4, seed=2, lambda1=found.lambda1, lambda2=found.lambda2)
    assert boots.summary("edge", "Group1").count() == 10


def test_var_network(spark):
    data = mw.make_var_data(spark, 250, 4)
    found = mw.estimate_var_network(data, cv=5, n_alphas=30, n_lambda=40)
    assert found.temporal.directed and not found.contemporaneous.directed
    assert found.n_observations == 249 and found.n_timepoints == 250
    table = data.toPandas()[[f"V{k}" for k in range(1, 5)]].to_numpy()
    x, y = table[:-1] - table[:-1].mean(0), table[1:] - table[1:].mean(0)
    least_squares = np.linalg.lstsq(x, y, rcond=None)[0].T
    assert np.abs(found.temporal.adjacency - least_squares).max() < 0.15
    assert found.centrality().count() == 8
    with pytest.raises(ValueError, match="No valid consecutive"):
        mw.estimate_var_network(data.selectExpr("*", "row_id * 2 as b2"), beep="b2")


def test_multilevel_network(spark):
    data = mw.make_multilevel_data(spark, 12, 40, 3)
    found = mw.estimate_multilevel_network(data, "subject", beep="beep", temporal="orthogonal", n_lambda=30)
    assert found.temporal.directed and found.n_subjects == 12
    assert found.pvalues.shape == (3, 3)
    assert ((found.temporal.adjacency != 0) <= (found.pvalues <= 0.05)).all()
    assert (found.temporal_thresholded(1e-9).adjacency != 0).sum() <= (found.temporal.adjacency != 0).sum()
    assert found.subject_network("S3").adjacency.shape == (3, 3)
    assert found.subject_network("S3").n_observations == 39 and found.temporal.n_observations == 12 * 39
    assert found.unthresholded_temporal.directed
    whole = mw.estimate_multilevel_network(data, "subject", beep="beep", temporal="orthogonal", temporal_alpha=None, n_lambda=30)
    assert whole.unthresholded_temporal is None
    assert np.allclose(whole.temporal.adjacency, found.unthresholded_temporal.adjacency)
    assert set(found.fit_info["V1"]) == {"bic", "aic", "actual_re", "warnings"}
    with pytest.raises(KeyError):
        found.subject_network("nobody")
    with pytest.raises(ImportError, match="rpy2"):
        mw.estimate_multilevel_network(data, "subject", engine="lme4")
    with pytest.raises(ValueError, match="engine"):
        mw.estimate_multilevel_network(data, "subject", engine="x")
    few = spark.createDataFrame([(0, "S1", 1.0, 2.0), (1, "S1", 1.0, 2.0), (2, "S2", 1.0, 2.0), (3, "S2", 2.0, 2.0), (4, "S2", 1.0, 3.0)], "row_id long, subject string, a double, b double")
    with pytest.raises(ValueError, match="fewer than 3"):
        mw.estimate_multilevel_network(few, "subject")


def test_communities_and_plots(spark):
    rows = np.zeros((5, 5))
    for i, j, v in [(0, 1, 0.8), (0, 2, 0.7), (1, 2, 0.6), (3, 4, 0.9)]:
        rows[i, j] = rows[j, i] = v
    n = net(rows, labels=tuple("ABCDE"))
    for m in ("walktrap", "louvain", "greedy_modularity"):
        assert column(n.communities(m), "node", "community") == {"A": 0, "B": 0, "C": 0, "D": 1, "E": 1}
    with pytest.raises(ValueError, match="Unknown community detection method"):
        n.communities("nope")
    from meshwork import plotting

    nodes, edges = plotting.network_data(n)
    assert len(nodes) == 5 and len(edges) == 4 and max(e["share"] for e in edges) == 1
    for kind in ("spring", "circular", "kamada_kawai"):
        assert np.isfinite(plotting.positions(n, kind)).all()
    with pytest.raises(ValueError, match="Unknown theme"):
        plotting.set_theme("pink")
    plotting.set_theme("dark")
    assert plotting.get_theme() == "dark"
    plotting.set_theme("light")
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            n.plot()


def test_datasets_repeat(spark):
    for make, shape in [(mw.make_bfi25, (500, 26)), (mw.make_depression9, (300, 10)), (mw.make_var_data, (500, 7)), (mw.make_multigroup, (400, 11)), (mw.make_multilevel_data, (1000, 7))]:
        a, b = make(spark).toPandas(), make(spark).toPandas()
        assert a.shape == shape
        pd.testing.assert_frame_equal(a, b)


def test_stream_of_sums(spark, tmp_path):
    from meshwork.streaming.moments import correlations_of_sums, write_sums

    data = mw.make_bfi25(spark, 200).select("O1", "O2", "C1")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = write_sums(stream, ["O1", "O2", "C1"], str(tmp_path / "sums"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    sums = spark.read.parquet(str(tmp_path / "sums"))
    assert sums.select("batch").distinct().count() == 3
    assert np.allclose(matrix(correlations_of_sums(sums, ["O1", "O2", "C1"]), 3), data.toPandas().corr().to_numpy())
