"""The library's queries against SQL at the smallest scale, its invariants, and its errors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixspark.operators import binning, features, graph, metrics, qc, sketch, solver
from mixspark.plans import queries
from mixspark import Deconvolution, deconvolve, multiscale
from mixspark.sources import tables
from mixspark.sources.synthetic import SMALL, generate

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["ref_mean", "align_genes", "hvg_bins", "markers_diff", "knn_graph", "grid_graph", "laplacian_norm", "spearman", "jsd", "sig_corr", "strict_annotation", "bin_counts", "evaluate", "sweep", "objective", "gram", "informative_genes", "prepare_data", "prepare_signatures", "result_table", "marker_correlation", "spearman_overall"])
def test_against_sql(spark, duck, name):
    got, want = queries.Q[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def form(x):
        return x[cols].astype({c: "float64" for c in cols if x[c].dtype.kind in "if"}).sort_values(cols).reset_index(drop=True)

    assert form(got).equals(form(want))


def _problem(spark, n=60, k=4, g=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2, 2, (k, g)) + 8 * (np.arange(g) % k == np.arange(k)[:, None])
    side = 8
    beta = rng.dirichlet(np.ones(k) * 0.5, n)
    y = rng.poisson(beta @ x * 20)
    counts = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(n) for j in range(g) if y[i, j]], "spot_id bigint, gene_id bigint, value double")
    sig = spark.createDataFrame([(j, x[:, j].tolist()) for j in range(g)], "gene_id bigint, x array<double>")
    spots = spark.createDataFrame([(i, [float(i % side), float(i // side)]) for i in range(n)], "spot_id bigint, coords array<double>")
    return counts, sig, spots, beta


def test_fit_recovers_mixtures(spark):
    counts, sig, spots, beta = _problem(spark)
    model = Deconvolution(n_hvg=0, n_markers_per_type=10, sketch_dim=64, spatial_method="grid", max_iter=20).fit(counts, sig, spots, list("abcd"))
    p = model.get_cell_type_proportions().toPandas().pivot(index="spot_id", columns="cell_type", values="proportion").sort_index()
    assert np.allclose(p.sum(1), 1) and (p.to_numpy() >= 0).all()
    assert np.corrcoef(p.to_numpy().ravel(), beta.ravel())[0, 1] > 0.7
    assert model.summary()["n_spots"] == 60 and model.info_.n_iterations >= 1


@pytest.mark.parametrize("method", [{"spatial_method": "knn"}, {"spatial_method": "radius", "radius": 1.5}])
def test_synthetic_mixtures_are_recovered(spark, method):
    p = generate(spark, SMALL)
    fits = [Deconvolution(sketch_dim=64, n_hvg=100, n_markers_per_type=15, **method).fit(p.counts, p.signatures, p.spots, p.types) for _ in range(2)]
    got, again = (f.get_cell_type_proportions().toPandas().sort_values(["spot_id", "cell_type"]).proportion.to_numpy() for f in fits)
    assert np.allclose(got, again, atol=1e-9)
    r = {(x.scope, x.metric): x.value for x in metrics.evaluate(metrics.pairs(fits[0].get_cell_type_proportions(), p.truth)).collect()}
    # Signatures are noisy and mixtures even: the survey's bound for this problem is 0.3.
    assert r["overall", "pearson"] > 0.3 and r["overall", "rmse"] < 0.2


def test_labels_by_pattern(spark):
    cells = spark.createDataFrame([(0, "Unknown 2"), (1, "T"), (2, "Doublet"), (3, "UND")], "cell_id bigint, cell_type string")
    assert {r.cell_id for r in qc.filter_unknown(cells).collect()} == {0, 1}
    assert {r.cell_id for r in qc.filter_unknown(cells, "Unknown|UND").collect()} == {1, 2}


def test_update_matches_scalar_loop():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 8))
    gram, h, b, near, n = a @ a.T, rng.normal(size=(5, 3)), rng.random((5, 3)), rng.random((5, 3)), rng.integers(0, 4, 5).astype(float)
    got = solver.update(h, b, near, n, gram, 0.3, 0.05)
    for i in range(5):
        x = b[i].copy()
        for k in range(3):
            res = h[i, k] - gram[k] @ x + gram[k, k] * x[k] + 0.3 * near[i, k]
            x[k] = max(0, np.sign(res) * max(abs(res) - 0.05, 0) / (gram[k, k] + 0.3 * n[i]))
        assert np.allclose(got[i], x)


def test_zero_iterations_and_zero_rows(spark):
    h = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "spot_id bigint, h array<double>")
    none = spark.createDataFrame([], "i bigint, j bigint")
    state, info = solver.solve(h, none, np.eye(2), max_iter=0)
    assert [r.b for r in state.collect()] == [[0.5, 0.5]] * 2 and not info.converged and info.n_iterations == 0
    state, info = solver.solve(h, none, np.eye(2), 0.1, 0.0, 50)
    p = {r.spot_id: r.p for r in solver.proportions(state).collect()}
    assert info.converged and np.allclose(p[0], [1 / 3, 2 / 3]) and p[1] == [0.5, 0.5]


def test_radius_lattice_and_edge_cases(spark):
    lattice = spark.createDataFrame([(3 * i + j, [float(i), float(j)]) for i in range(3) for j in range(3)], "spot_id bigint, coords array<double>")
    for radius, want in ((1.5, 8), (1.1, 4)):
        deg = {r.spot_id: r.degree for r in graph.degrees(graph.radius_graph(lattice, radius), lattice).collect()}
        assert deg[4] == want
    one = lattice.where("spot_id = 0")
    assert graph.knn_graph(one, 3).count() == 0 and graph.knn_graph(one, 3, True).count() == 1
    assert graph.grid_graph(lattice).count() == 40
    same = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(4)], "spot_id bigint, coords array<double>")
    assert graph.nearest(same, 9).count() == 12
    rows = graph.laplacian(graph.knn_graph(lattice, 2), lattice).groupBy("i").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in rows)


def test_sketches():
    b, w = sketch.countsketch(50, 16, seed=3)
    b2, w2 = sketch.countsketch(50, 16, seed=3)
    assert (b == b2).all() and (w == w2).all()
    length = np.bincount(b, w**2, 16)
    assert np.allclose(length[length > 0], 50 / 16)
    m = sketch.rademacher(200, 32, seed=1)
    assert (np.abs(m).sum(0) > 0).all() and 0.05 < (m != 0).mean() < 0.3
    with pytest.raises(ValueError):
        sketch.random_state("x")


def test_leverage_equals_singular_values(spark):
    _, sig, _, _ = _problem(spark)
    got = {r.gene_id: r.leverage for r in features.leverage(sig).collect()}
    x = np.array([r.x for r in sig.orderBy("gene_id").collect()]).T
    u, s, _ = np.linalg.svd((x - x.mean(0)).T, full_matrices=False)
    want = (u**2 * (s**2 / (s**2 + 1e-6))).sum(1)
    assert np.allclose([got[i] for i in sorted(got)], want / (want.sum() + 1e-6), atol=1e-9)


def test_metrics_of_constants_and_nothing_rare(spark):
    df = spark.createDataFrame([(0, "a", 0.5, 0.2), (1, "a", 0.5, 0.4)], "spot_id bigint, cell_type string, pred double, true double")
    assert metrics.correlation(df).first()[0] == 0.0
    assert np.isnan(metrics.rare_detection(df).first()[0])


@pytest.mark.parametrize("bad", [{"sketch_dim": 0}, {"tol": 0}, {"lambda_spatial": -1.0}, {"spatial_method": "radius"}, {"radius": 0.0}, {"n_hvg": -1}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Deconvolution(**bad)


def test_unfitted_and_missing_inputs(spark):
    assert Deconvolution().summary() == {"fitted": False}
    with pytest.raises(RuntimeError):
        Deconvolution().get_abundances()
    with pytest.raises(ValueError):
        tables.load_spots(spark.range(1), "id")
    with pytest.raises(ValueError):
        tables.reference_signatures(spark.range(1), spark.range(1), "median")


def test_sink(spark, tmp_path):
    beta = spark.createDataFrame([(0, [0.2, 0.8]), (1, [0.5, 0.5])], "spot_id bigint, p array<double>")
    spots = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "spot_id bigint, coords array<double>")
    tables.write_results(beta, spots, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("spot_id").collect()
    assert [r.dominant for r in rows] == ["CellType_1", "CellType_0"] and (rows[1].x, rows[1].y) == (3.0, 4.0)
    tables.write_results(beta, spots, str(tmp_path / "csv"), ["Neuron", "Glia"], "csv")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("spot_id").collect()
    assert rows[0].Glia == "0.8" and rows[0].dominant == "Glia" and rows[0].y == "2.0"
    ragged = beta.where("spot_id = 0").unionByName(spark.createDataFrame([(1, [1.0])], beta.schema))
    for wrong in ((beta, spots, ["a"]), (beta, spots.where("spot_id = 0"), None), (beta.where("spot_id = 0"), spots, None), (ragged, spots, None)):
        with pytest.raises(ValueError):
            tables.result_table(*wrong)


def test_alignment_by_names(spark):
    """The one call on sides whose ids and orders of genes differ, with repeated and foreign names."""
    counts, sig, spots, _ = _problem(spark, n=24)
    ref = sig.select(F.col("gene_id"), F.posexplode("x").alias("cell_id", "value")).select(F.col("cell_id").cast("long").alias("cell_id"), "gene_id", "value")
    cells = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], "cell_id bigint, cell_type string")
    names = [f"g{i:02}" for i in range(40)]
    left = spark.createDataFrame([*enumerate(names), (90, "g03"), (91, "only here")], "gene_id bigint, gene string")
    right = spark.createDataFrame([*((39 - i, n) for i, n in enumerate(names)), (95, "only there")], "gene_id bigint, gene string")
    params = {"n_hvg": 0, "n_markers_per_type": 10, "sketch_dim": 64, "spatial_method": "grid", "max_iter": 3}
    got = deconvolve(counts, ref.withColumn("gene_id", 39 - F.col("gene_id")), cells, spots, left, right, **params)
    want = deconvolve(counts, ref, cells, spots, **params)
    key = ["spot_id", "cell_type"]
    p, q = (m.get_cell_type_proportions().toPandas().sort_values(key).proportion.to_numpy() for m in (got, want))
    assert np.allclose(p, q)
    assert set(got.parameters()) == {"sketch_dim", "lambda_spatial", "rho_sparsity", "n_hvg", "n_markers_per_type", "spatial_method", "k_neighbors", "radius", "preprocess", "n_genes_used", "n_cell_types", "cell_type_names", "random_state", "converged", "n_iterations"}
    assert got.parameters()["lambda_spatial"] == got.lambda_used_ and got.parameters()["cell_type_names"] == list("abcd")
    with pytest.raises(ValueError):
        deconvolve(counts, ref, cells, spots, left, right.where("gene = 'only there'"), **params)
    with pytest.raises(ValueError):
        deconvolve(counts, ref, cells, spots, left, **params)
    with pytest.raises(ValueError):
        deconvolve(counts, ref.withColumn("gene_id", F.col("gene_id") + 1000), cells, spots, **params)


def test_mixed_coordinates_are_refused(spark):
    for rows in ([(0, [1.0, 2.0]), (1, [1.0])], [(0, [1.0]), (1, None)], [(0, [])]):
        with pytest.raises(ValueError):
            graph.knn_graph(spark.createDataFrame(rows, "spot_id bigint, coords array<double>"), 1)


def test_neighbours_with_an_outlier_and_a_crowd(spark):
    """One point far out, a dense cluster, many points at one place: the neighbours are the right ones, and no cell holds most points."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.random((2500, 2)), 0.5 + 1e-4 * rng.random((1000, 2)), np.full((600, 2), 0.25), [[1e6, -1e6]]])
    spots = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(xy)], "spot_id bigint, coords array<double>").repartition(4)
    got = graph.nearest(spots, 4).toPandas().sort_values(["i", "r"])
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((np.arange(len(xy)), row))[:4] for row in d])
    assert (got.j.to_numpy().reshape(-1, 4) == want).all()
    near = graph.cut(spots.where("spot_id < 3500 OR spot_id = 4100"))
    radius = graph._first_radius(near, 4, 4101, 2)
    assert near.groupBy(*graph._cell(radius, 2)).count().agg(F.max("count")).first()[0] <= graph.MOST * 5


def test_gene_selection_by_the_rule(spark):
    """Libraries below 1 count as 1; without two different positive means there are no bins."""
    y = np.array([[0.2, 0.1, 0.0, 0.3], [0.0, 3.0, 2.0, 0.0], [0.1, 0.0, 0.0, 0.0]])
    counts = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(3) for j in range(4) if y[i, j]], "spot_id bigint, gene_id bigint, value double")
    genes = spark.range(4).withColumnRenamed("id", "gene_id")
    log = np.log1p(1e4 * y / np.maximum(y.sum(1, keepdims=True), 1))
    got = features.gene_moments(counts, genes, 3).orderBy("gene_id").toPandas()
    assert np.allclose(got["mean"], log.mean(0)) and np.allclose(got["var"], log.var(0, ddof=1))
    for means in ([(0, 0.0, 1.0), (1, 0.0, 2.0)], [(0, 0.0, 1.0), (1, 2.0, 2.0), (2, 0.0, 5.0)], [(0, 2.0, 1.0), (1, 2.0, 7.0)]):
        one = features.dispersions(spark.createDataFrame(means, "gene_id bigint, mean double, var double")).collect()
        assert {(r.bin, r.disp) for r in one} == {(0, 0.0)}
    with pytest.raises(ValueError):
        features.normalise_signatures(spark.createDataFrame([(0, [1.0])], "gene_id bigint, x array<double>"), "cpm")


@pytest.mark.parametrize(("per_tile", "depth"), [(1000, 8), (60, 2), (40, 8), (None, 3)])
def test_tiles_and_depth_leave_the_result(spark, per_tile, depth):
    rng = np.random.default_rng(2)
    n, k = 300, 3
    a, hh, xy = rng.normal(size=(k, 9)), rng.random((n, k)) * 4, rng.random((n, 2))
    gram = a @ a.T
    spots = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(xy)], "spot_id bigint, coords array<double>")
    h = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(hh)], "spot_id bigint, h array<double>")
    edges = graph.cut(graph.radius_graph(spots, 0.07))  # some points have no neighbours
    e = np.array([(r.i, r.j) for r in edges.collect()])
    adjacent = np.zeros((n, n))
    adjacent[e[:, 0], e[:, 1]] = 1
    b, done, change, rho = np.full((n, k), 1 / k), 0, 1.0, 0.01 * np.mean(np.diag(gram))
    while change >= 1e-4:
        new = solver.update(hh, b, adjacent @ b, adjacent.sum(1), gram, 0.5, rho)
        change, b, done = np.abs(new - b).max() / (np.abs(b).max() + 1e-10), new, done + 1
    tiles = solver.spatial_tiles(spots, per_tile) if per_tile else spots.select("spot_id", (F.col("spot_id") % 4).cast("int").alias("tile"))
    state, info = solver.solve(h, edges, gram, 0.5, 0.01, tiles=tiles, depth=depth, every=5, y2=50.0)
    assert np.allclose([r.b for r in state.orderBy("spot_id").collect()], b, atol=1e-12)
    assert info.converged and info.n_iterations == done and info.final_change == pytest.approx(change)
    whole = 0.5 * (50 - 2 * (b * hh).sum() + ((b.T @ b) * gram).sum()) + 0.25 * ((b[e[:, 0]] - b[e[:, 1]]) ** 2).sum() / 2 + rho * b.sum()
    assert info.final_objective == pytest.approx(whole, rel=1e-9) and len(info.objectives) == done // 5


def test_soft_threshold():
    assert [float(solver.soft_threshold(x, 2)) for x in (5, -5, 1)] == [3, -3, 0]


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "pred double").repartition(4)
    got = {r._v: r._r for r in metrics._mean_ranks(df, "pred").collect()}
    order = np.sort(v)
    assert all(got[x] == (np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2 for x in set(v.tolist()))


def test_multiscale_fits_the_sums_of_bins(spark):
    counts, sig, spots, _ = _problem(spark, n=24)
    params = {"n_hvg": 0, "n_markers_per_type": 10, "sketch_dim": 64, "spatial_method": "grid", "max_iter": 3}
    got = multiscale(counts, sig, spots, list("abcd"), [8, 16, 32], **params).toPandas()
    # Spots lie one apart: 8 to a row, 3 rows. Bins of 16 are two wide, of 32 four.
    assert {w: g.spot_id.nunique() for w, g in got.groupby("bin_size")} == {8: 24, 16: 8, 32: 2}
    assert np.allclose(got.groupby(["bin_size", "spot_id"]).proportion.sum(), 1)
    half = F.floor(F.col("spot_id") % 8 / 4)
    summed = counts.groupBy(half.alias("spot_id"), "gene_id").agg(F.sum("value").alias("value"))
    at = spark.createDataFrame([(0, [1.5, 1.0]), (1, [5.5, 1.0])], "spot_id bigint, coords array<double>")
    want = Deconvolution(**params).fit(summed, sig, at, list("abcd")).get_cell_type_proportions().toPandas()
    key = ["spot_id", "cell_type"]
    assert np.allclose(got[got.bin_size == 32].sort_values(key).proportion, want.sort_values(key).proportion)


def test_bins_have_different_numbers(spark):
    spots = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1_000_000.0]), (2, [1.0, 0.0]), (3, [0.4, 0.4]), (4, [1.0, 1_000_000.0])], "spot_id bigint, coords array<double>")
    for width, want in ((1.0, 4), (0.5, 4), (0.25, 5)):
        assert binning.numbered(binning.aggregate_bins(spots, width)).select("bin").distinct().count() == want
    with pytest.raises(ValueError):
        binning.numbered(binning.aggregate_bins(spots, 1e-13))
    assert binning.spacing(spots.where("spot_id = 0")) == 0.0


@pytest.mark.parametrize("name", ["deconvolve", "solver_sweep"])
def test_registered_fits_run_to_the_default_end(spark, monkeypatch, name):
    seen = {}

    def fit(*tables, **params):
        seen.update(params)
        model = Deconvolution(**params)
        model.cell_type_names_, model.fitted, model.info_ = ["a", "b"], True, solver.FitInfo(False, 100, 0.0, 0.1)
        model.beta_ = spark.createDataFrame([(0, [1.0, 3.0])], "spot_id bigint, b array<double>")
        model.proportions_ = solver.proportions(model.beta_)
        return model

    monkeypatch.setattr(queries, "fit_deconvolution", fit)
    rows = queries.Q[name](spark, DATA).collect()
    assert Deconvolution(**seen).max_iter == 100 and Deconvolution(**seen).tol == 1e-4
    assert all(r.converged is False for r in rows)


def test_marker_correlation_of_every_gene(spark):
    got = queries.Q["marker_correlation"](spark, DATA).toPandas().set_index(["cell_type", "gene_id"]).r
    counts = queries._counts(spark, DATA).toPandas().pivot(index="spot_id", columns="gene_id", values="value").fillna(0.0)
    shares = queries._prop(spark, DATA).toPandas()
    genes = [r[0] for r in queries._genes(spark, DATA).collect()]
    assert len(genes) > 20 and len(got) == 3 * len(genes)
    for t, g in shares.groupby("cell_type"):
        y = g.proportion.to_numpy()
        for gene in genes:
            x = counts[gene].reindex(g.spot_id).fillna(0.0).to_numpy() if gene in counts else np.zeros(len(y))
            want = 0.0 if np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]
            assert abs(got[t, gene] - want) < 2e-6


def test_gene_correlation_of_constants(spark):
    shares = spark.createDataFrame([(i, t, p) for i in range(3) for t, p in (("a", 0.2 * i), ("b", 0.5))], "spot_id bigint, cell_type string, proportion double")
    counts = spark.createDataFrame([(0, 1, 5.0), (1, 1, 5.0), (2, 1, 5.0), (2, 2, 5.0), (0, 3, 0.0)], "spot_id bigint, gene_id bigint, value double")
    genes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "gene_id bigint")
    r = {(x.cell_type, x.gene_id): round(x.r, 6) for x in qc.gene_correlation(counts, shares, genes).collect()}
    assert r == {("a", 1): 0, ("a", 2): 0.866025, ("a", 3): 0, ("a", 4): 0} | {("b", i): 0 for i in (1, 2, 3, 4)}


def test_language_mixture_takes_all_words_and_documents(spark, tmp_path):
    word = lambda p, i: p + "".join(chr(97 + int(x)) for x in str(i))
    common = " ".join(word("z", i) for i in range(5000))
    own = {t: " ".join(word(t, i) for i in range(60)) for t in ("x", "y")}
    docs = [(i, f"{common} {common} {own[t]}", t) for i, t in enumerate("xyxy")] + [(4000, own["y"], None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.spot_id: (r.dominant, r.lang) for r in queries.Q["language_mixture"](spark, str(tmp_path)).collect()}
    assert got == {0: ("x", "x"), 1: ("y", "y"), 2: ("x", "x"), 3: ("y", "y"), 4000: ("y", None)}


def test_language_mixture_moves_no_counts_of_documents(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda i: "".join(chr(97 + int(x)) for x in str(i))
    docs = [(i, " ".join(map(word, rng.permutation(5000))) + " " + t * 3, t) for i, t in enumerate("xy" * 75)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = sent()
    got = queries.Q["language_mixture"](spark, str(tmp_path)).collect()
    assert len(got) == 150 and all(r.dominant == r.lang for r in got)
    # A count of a word in a document has a hash of 8 bytes.
    assert sent() - before < 8 * 150 * 5000


def test_language_mixture_of_repeated_ids(spark, tmp_path, monkeypatch):
    docs = [(0, "a a b", "x"), (0, "c B", "y"), (0, "d", None), (1, "a e", "x"), (2, "f", "y"), (2, "f c", "y"), (3, "1 2", "x"), (4, None, "y"), (5, "g", None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}

    def fit(self, counts, signatures, spots, types, counted):
        seen.update(sig={r.gene_id: dict(zip(types, r.x, strict=True)) for r in signatures.collect()}, counts=counts.collect(), counted={r[0] for r in counted.collect()})
        self.fitted, self.cell_type_names_ = True, types
        self.proportions_ = spots.select("spot_id", F.array(F.lit(0.4), F.lit(0.6)).alias("p"))
        return self

    monkeypatch.setattr(Deconvolution, "fit", fit)
    queries.Q["language_mixture"](spark, str(tmp_path))
    counts = spark.createDataFrame(seen["counts"])
    cells = spark.createDataFrame([(i, t) for i, _, t in docs if t], "cell_id bigint, cell_type string")
    want = {}
    for r in tables.reference_signatures(counts.withColumnRenamed("spot_id", "cell_id"), cells).collect():
        want.setdefault(r.gene_id, {"x": 0.0, "y": 0.0})[r.cell_type] = r.value
    assert {g: v for g, v in seen["sig"].items() if any(v.values())} == want
    assert seen["counted"] == {r.spot_id for r in seen["counts"]}


def test_multiscale_measures_the_spacing_once(spark, monkeypatch):
    counts, sig, spots, _ = _problem(spark, n=24)
    times, spacing = [], binning.spacing
    monkeypatch.setattr(binning, "spacing", lambda s: times.append(1) or spacing(s))
    multiscale(counts, sig, spots, list("abcd"), [16, 32], n_hvg=0, n_markers_per_type=10, sketch_dim=64, spatial_method="grid", max_iter=1)
    assert len(times) == 1


def test_boards_are_opened_one_at_a_time():
    batch = pa.RecordBatch.from_pydict({"tile": pa.array([0, 1, 2], pa.int32())})
    rows = solver._rows(iter([batch]))
    assert next(rows) == {"tile": 0} and [r["tile"] for r in rows] == [1, 2]


def test_full_cells_are_dealt_to_groups(spark):
    spots = spark.createDataFrame([(i, [0.1 + i / 1000, 0.5 * (i % 3)]) for i in range(90)], "spot_id bigint, coords array<double>")
    one, many = (graph.within(spots, spots, 0.6, 2, n) for n in (None, 7))
    pairs = lambda x: sorted((r.i, r.j, r.d2) for r in x.collect())
    assert pairs(one) == pairs(many) and len(pairs(many)) > 90
    # Cells of 30 and 60 points in 5 and 9 groups.
    groups = many._jdf.queryExecution().optimizedPlan().toString()
    assert "group" in groups and pairs(graph.radius_graph(spots, 0.6).withColumn("d2", F.lit(0))) == [(i, j, 0) for i, j, _ in pairs(one)]


def test_marker_correlation_keeps_counts_as_they_are_dealt(spark):
    genes, counts, shares = queries._genes(spark, DATA), queries._counts(spark, DATA, 5), queries._prop(spark, DATA)
    got = qc.gene_correlation(counts, shares, genes, 5)
    # Counts and proportions meet in these parts.
    assert got._jdf.queryExecution().executedPlan().toString().count(", 5), REPARTITION_BY_NUM") == 2
    want = {(r.cell_type, r.gene_id): r.r for r in qc.gene_correlation(queries._counts(spark, DATA), shares, genes).collect()}
    assert {(r.cell_type, r.gene_id): r.r for r in got.collect()} == pytest.approx(want, abs=1e-9)
