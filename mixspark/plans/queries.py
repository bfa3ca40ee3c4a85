"""Queries over the given tables, one or more for each operator, with SQL for the same rows.

lineitem is a table of counts (supplier: spot, part: gene, summed quantity: value), suppliers lie on
a lattice of ten columns. embeddings is a labelled reference (vector: cell, component: gene) and, by
its first two components, a set of points. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.functions.columns import argmax
from mixspark.functions.lineage import cut
from mixspark.operators import binning, features, graph, metrics, qc, sketch, solver
from mixspark.plans.deconvolve import Deconvolution
from mixspark.plans.deconvolve import deconvolve as fit_deconvolution
from mixspark.plans.deconvolve import multiscale
from mixspark.sources import tables

SIDE = 0.12  # radius among the points of embeddings
ROWS_OF_A_TASK = 500_000  # counts that a task sums, about


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _r(c, digits: int = 6) -> Column:
    """Rounded, and without negative zero."""
    return (F.round(c, digits) + F.lit(0.0))


def _counts(s, d, parts: int | None = None):
    """parts: deals rows by spot into so many parts."""
    rows = _t(s, d, "lineitem")
    if parts is not None:
        rows = rows.select("l_suppkey", "l_partkey", "l_quantity").repartition(parts, "l_suppkey")
    return rows.groupBy(F.col("l_suppkey").alias("spot_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def _spots(s, d):
    k = F.col("s_suppkey")
    return _t(s, d, "supplier").select(k.alias("spot_id"), F.array((k % 10).cast("double"), F.floor(k / 10).cast("double")).alias("coords"))


def _points(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("spot_id"), F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("coords"))


def _genes(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").alias("gene_id"))


def _cells(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("type_"), F.col("label")).alias("cell_type"))


def _ref(s, d):
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("g", "v"))
    return e.select("cell_id", (F.col("g") + 1).cast("long").alias("gene_id"), F.greatest(F.lit(0.0), F.round((F.col("v").cast("double") + 0.6) * 1000)).alias("value"))


def _sig(s, d):
    types = [f"type_{i}" for i in range(10)]
    return tables.gene_major(tables.reference_signatures(_ref(s, d), _cells(s, d)), types)


def _by_type(signatures: DataFrame) -> DataFrame:
    """gene_id, cell_type, value of signatures in the order of types."""
    out = signatures.select("gene_id", F.posexplode("x").alias("t", "value"))
    return out.select("gene_id", F.concat(F.lit("type_"), F.col("t")).alias("cell_type"), _r("value").alias("value"))


def _shares(s, d):
    """pred and true: shares of a supplier's revenue and quantity by return flag."""
    g = _t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("spot_id"), F.col("l_returnflag").alias("cell_type")).agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"))
    t = g.groupBy("spot_id").agg(F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    return g.join(t, "spot_id").select("spot_id", "cell_type", (F.col("q") / F.col("tq")).alias("pred"), (F.col("n") / F.col("tn")).alias("true"))


def _prop(s, d):
    return _shares(s, d).select("spot_id", "cell_type", F.col("pred").alias("proportion"))


def _edges(s, d):
    return graph.grid_graph(_spots(s, d))


_C = "c AS (SELECT l_suppkey AS spot_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
_LOG = _C + ", lib AS (SELECT spot_id, sum(value) AS lib FROM c GROUP BY 1), lc AS (SELECT c.spot_id, gene_id, ln(1 + value * 1e4 / CASE WHEN lib = 0 THEN 1 ELSE lib END) AS value FROM c JOIN lib USING (spot_id))"


def _disp_sql(genes: str, spots: str) -> str:
    """Moments and dispersions of counts c(spot_id, gene_id, value), by the rule for variable genes: libraries below 1 count as 1, no bins without two different positive means."""
    return f"""hl AS (SELECT spot_id, greatest(sum(value), 1) AS lib FROM c GROUP BY 1),
 hv AS (SELECT gene_id, ln(1 + value * 1e4 / lib) AS value FROM c JOIN hl USING (spot_id)), n AS (SELECT count(*) AS n FROM {spots}),
 mom AS (SELECT g.gene_id, coalesce(s, 0) / n AS mean, greatest(0, (coalesce(q, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n)) * (n * 1.0 / (n - 1))) AS var
  FROM ({genes}) g LEFT JOIN (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM hv GROUP BY 1) x ON g.gene_id = x.gene_id, n),
 e AS (SELECT list_distinct(quantile_cont(mean, [i / 20.0 for i in range(21)])) AS e FROM mom WHERE mean > 0),
 b AS (SELECT gene_id, mean, var, coalesce(len(e), 0) >= 2 AS bins, CASE WHEN coalesce(len(e), 0) >= 2 THEN greatest(0, least(len(list_filter(e, lambda x: x <= mean)) - 1, len(e) - 2)) ELSE 0 END AS bin FROM mom, e),
 disp AS (SELECT gene_id, mean, bin, CASE WHEN bins AND count(*) OVER w > 1 THEN (var - avg(var) OVER w) / (stddev_pop(var) OVER w + 1e-10) ELSE 0 END AS disp FROM b WINDOW w AS (PARTITION BY bin))"""


_DISP = _C + ", " + _disp_sql("SELECT p_partkey AS gene_id FROM part", "supplier")
_HVG = "v AS (SELECT * FROM disp WHERE mean BETWEEN 0.0125 AND 3 AND disp >= 0.5), f AS (SELECT * FROM v WHERE (SELECT count(*) FROM v) >= {n} UNION ALL SELECT * FROM disp WHERE (SELECT count(*) FROM v) < {n}), hvg AS (SELECT gene_id FROM f ORDER BY disp DESC, gene_id DESC LIMIT {n})"
_REF = "rc AS (SELECT vec_id AS cell_id, i AS gene_id, greatest(0, round((CAST(embedding[i] AS DOUBLE) + 0.6) * 1000)) AS value, 'type_' || label AS cell_type FROM embeddings, range(1, 65) t(i))"
_SIG = _REF + ", sg AS (SELECT cell_type, gene_id, sum(value) / count(*) AS v FROM rc GROUP BY 1, 2)"
_SHARE = _SIG + ", p AS (SELECT cell_type, gene_id, v / (sum(v) OVER (PARTITION BY cell_type) + 1e-10) AS p FROM sg), a AS (SELECT gene_id, list(p ORDER BY cell_type) AS p FROM p GROUP BY 1)"
_MARK = _SHARE + """, sc AS (SELECT gene_id, list_position(p, list_max(p)) - 1 AS type_id, {score} AS score FROM a),
 r AS (SELECT gene_id, type_id, row_number() OVER (PARTITION BY type_id ORDER BY score DESC, gene_id DESC) AS r FROM sc)"""
# A type that owns no gene gets its most expressed ones.
_OWN = """ SELECT gene_id, CAST(type_id AS INTEGER) AS type_id FROM r WHERE r <= 5 UNION ALL
 SELECT gene_id, CAST(type_id AS INTEGER) FROM (SELECT gene_id, t AS type_id, row_number() OVER (PARTITION BY t ORDER BY v DESC, gene_id DESC) AS r
 FROM (SELECT gene_id, v, dense_rank() OVER (ORDER BY cell_type) - 1 AS t FROM sg) WHERE t NOT IN (SELECT type_id FROM sc)) WHERE r <= 5"""
_PTS = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_LAT = "sp AS (SELECT s_suppkey AS id, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier), ed AS (SELECT a.id AS i, b.id AS j FROM sp a JOIN sp b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25)"
_DEG = _LAT + ", dg AS (SELECT id AS spot_id, count(j) AS degree FROM sp LEFT JOIN ed ON i = id GROUP BY 1)"
_SH = """g AS (SELECT l_suppkey AS spot_id, l_returnflag AS cell_type, sum(l_quantity) AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
 d AS (SELECT spot_id, cell_type, q / sum(q) OVER (PARTITION BY spot_id) AS pred, n / sum(n) OVER (PARTITION BY spot_id) AS true_ FROM g)"""
_CORR = "CASE WHEN max({a}) = min({a}) OR max({b}) = min({b}) THEN 0 ELSE coalesce(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 0) END"

Q, SQL = {}, {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@_add("ref_mean", f"WITH {_REF} SELECT cell_type, gene_id, round(sum(value) / count(*), 6) AS value FROM rc GROUP BY 1, 2")
def ref_mean(s, d):
    return tables.reference_signatures(_ref(s, d), _cells(s, d)).withColumn("value", _r("value"))


@_add("ref_sum", f"WITH {_REF} SELECT cell_type, gene_id, sum(value) AS value FROM rc GROUP BY 1, 2")
def ref_sum(s, d):
    return tables.reference_signatures(_ref(s, d), _cells(s, d), "sum")


@_add("load_spots", "SELECT s_suppkey AS spot_id, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y FROM supplier")
def load_spots(s, d):
    k = F.col("s_suppkey")
    got = tables.load_spots(_t(s, d, "supplier").select(k, (k % 10).alias("array_row"), F.floor(k / 10).alias("array_col")), "s_suppkey")
    return got.select("spot_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@_add("align_genes", "WITH a AS (SELECT p_type AS gene, min(p_partkey) AS left_idx FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_type AS gene, min(p_partkey) AS right_idx FROM part WHERE p_size > 20 GROUP BY 1) SELECT gene, left_idx, right_idx, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_id FROM a JOIN b USING (gene)")
def align_genes(s, d):
    p = _t(s, d, "part").select(F.col("p_type").alias("gene"), F.col("p_partkey").alias("idx"), "p_size")
    return tables.align_genes(p.where("p_size <= 25"), p.where("p_size > 20"))


@_add("align_genes_left", "WITH a AS (SELECT p_type AS gene, min(p_partkey) AS left_idx FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_type AS gene, min(p_partkey) AS right_idx FROM part WHERE p_size > 20 GROUP BY 1) SELECT gene, left_idx, right_idx, CAST(row_number() OVER (ORDER BY left_idx) - 1 AS INTEGER) AS gene_id FROM a JOIN b USING (gene)")
def align_genes_left(s, d):
    p = _t(s, d, "part").select(F.col("p_type").alias("gene"), F.col("p_partkey").alias("idx"), "p_size")
    return tables.align_genes(p.where("p_size <= 25"), p.where("p_size > 20"), "left")


def _prepared(s, d) -> tables.Prepared:
    """Suppliers and orders by the types of parts: the sides' parts overlap in part, and types repeat."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("gene"), "p_size")
    cells = _t(s, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("cell_type"))
    ref = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    return tables.prepare_data(_counts(s, d), p.where("p_size <= 25"), ref, p.where("p_size > 20"), cells, _spots(s, d))


_ALIGNED = "ga AS (SELECT p_type AS gene, min(p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1), gb AS (SELECT p_type AS gene, min(p_partkey) AS k FROM part WHERE p_size > 20 GROUP BY 1), gx AS (SELECT ga.gene, ga.k AS a, gb.k AS b, row_number() OVER (ORDER BY ga.gene) - 1 AS gene_id FROM ga JOIN gb ON ga.gene = gb.gene)"


@_add("prepare_data", f"WITH {_C}, {_ALIGNED} SELECT spot_id, gx.gene_id, gene, value FROM c JOIN gx ON c.gene_id = a")
def prepare_data(s, d):
    got = _prepared(s, d)
    return got.counts.join(got.genes, "gene_id").select("spot_id", "gene_id", "gene", "value")


@_add("prepare_signatures", f"WITH {_ALIGNED}, n AS (SELECT o_orderpriority AS cell_type, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT o_orderpriority AS cell_type, l_partkey AS k, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT gx.gene_id, n.cell_type, round(coalesce(q, 0) / n, 6) AS value FROM gx CROSS JOIN n LEFT JOIN q ON q.k = gx.b AND q.cell_type = n.cell_type")
def prepare_signatures(s, d):
    got = _prepared(s, d)
    names = F.array(*[F.lit(t) for t in got.types])
    return got.signatures.select("gene_id", F.posexplode("x").alias("t", "value")).select("gene_id", F.get(names, F.col("t")).alias("cell_type"), _r("value").alias("value"))


@_add("load_binned", "SELECT c_custkey AS barcode, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def load_binned(s, d):
    places = _t(s, d, "customer").select(F.col("c_custkey").alias("barcode"), F.col("c_nationkey").alias("pxl_col_in_fullres"), (F.col("c_custkey") % 100).alias("pxl_row_in_fullres"))
    _, spots = tables.load_binned(places, _t(s, d, "orders").select(F.col("o_custkey").alias("barcode"), "o_totalprice"))
    return spots.select("barcode", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@_add("unique_names", "SELECT p_partkey AS gene_id, p_type || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS gene FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)")
def unique_names(s, d):
    return tables.unique_names(_t(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("gene")))


@_add("prepare_reference", "WITH p AS (SELECT o_custkey AS cell, max_by(o_orderpriority, o_orderkey) AS cell_type FROM orders GROUP BY 1) SELECT c_custkey AS cell, c_mktsegment AS segment, cell_type FROM customer JOIN p ON cell = c_custkey")
def prepare_reference(s, d):
    raw = _t(s, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"))
    return tables.prepare_reference(raw, _t(s, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("pos"), "o_orderpriority"), "o_orderpriority")


@_add("qc_totals", f"WITH {_C} SELECT s_suppkey AS spot_id, coalesce(sum(value), 0) AS total, count(CASE WHEN value > 0 THEN 1 END) AS n_genes FROM supplier LEFT JOIN c ON spot_id = s_suppkey GROUP BY 1")
def qc_totals(s, d):
    return features.qc_totals(_counts(s, d), _spots(s, d))


@_add("subset_genes", f"WITH {_C} SELECT spot_id, gene_id, value FROM c JOIN part ON p_partkey = gene_id WHERE p_type LIKE 'PROMO%'")
def subset_genes(s, d):
    """Counts of the parts whose type is a promotion, as a curated list of genes."""
    return features.subset_genes(_counts(s, d), _t(s, d, "part").where("p_type LIKE 'PROMO%'").select(F.col("p_partkey").alias("gene_id")))


@_add("log_cpm", f"WITH {_LOG} SELECT spot_id, gene_id, round(value, 6) AS value FROM lc")
def log_cpm(s, d):
    return features.normalise(_counts(s, d)).withColumn("value", _r("value"))


@_add("pearson_norm", f"WITH {_C}, m AS (SELECT gene_id, sum(value) / (SELECT count(*) FROM supplier) + 1e-6 AS mu FROM c GROUP BY 1) SELECT spot_id, gene_id, round(value / sqrt(mu + mu * mu / 100), 6) AS value FROM c JOIN m USING (gene_id)")
def pearson_norm(s, d):
    return features.normalise(_counts(s, d), "pearson", _t(s, d, "supplier").count()).withColumn("value", _r("value"))


def _moments(s, d):
    return features.gene_moments(_counts(s, d), _genes(s, d), _t(s, d, "supplier").count())


@_add("gene_moments", f"WITH {_DISP} SELECT gene_id, round(mean, 6) AS mean, round(var, 6) AS var FROM mom")
def gene_moments(s, d):
    return _moments(s, d).select("gene_id", _r("mean").alias("mean"), _r("var").alias("var"))


@_add("hvg_bins", f"WITH {_DISP} SELECT gene_id, CAST(bin AS INTEGER) AS bin, round(disp, 4) AS disp FROM disp")
def hvg_bins(s, d):
    return features.dispersions(_moments(s, d)).select("gene_id", "bin", _r("disp", 4).alias("disp"))


@_add("hvg_topk", f"WITH {_DISP}, {_HVG.format(n=50)} SELECT gene_id FROM hvg")
def hvg_topk(s, d):
    return features.select_hvg(features.dispersions(_moments(s, d)), 50)


_SCORES = {"diff": "list_max(p) - list_reverse_sort(p)[2]", "ratio": "list_max(p) / ((list_sum(p) - list_max(p)) / (len(p) - 1) + 1e-10)", "specificity": "list_sum([1 - x / (list_max(p) + 1e-10) for x in p]) / (len(p) - 1)"}


def _markers(method):
    return lambda s, d: features.select_markers(_sig(s, d), 5, method)


for _m, _s in _SCORES.items():
    _add(f"markers_{_m}", f"WITH {_MARK.format(score=_s)}{_OWN}")(_markers(_m))


@_add("informative_genes", f"WITH {_MARK.format(score=_SCORES['diff'])}, z AS ({_OWN}), c AS (SELECT cell_id AS spot_id, gene_id, value FROM rc), {_disp_sql('SELECT DISTINCT gene_id FROM rc', 'embeddings')}, {_HVG.format(n=8)} SELECT gene_id FROM z UNION SELECT gene_id FROM hvg")
def informative_genes(s, d):
    sig, counts = _sig(s, d), _ref(s, d).withColumnRenamed("cell_id", "spot_id")
    moments = features.gene_moments(counts, sig, _t(s, d, "embeddings").count())
    return features.informative_genes(features.dispersions(moments), sig, 8, 5)


@_add("log_cpm_signatures", f"WITH {_SIG}, l AS (SELECT cell_type, sum(v) AS l FROM sg GROUP BY 1) SELECT gene_id, cell_type, round(ln(1 + v * 1e4 / (l + 1e-10)), 6) AS value FROM sg JOIN l USING (cell_type)")
def log_cpm_signatures(s, d):
    return _by_type(features.normalise_signatures(_sig(s, d)))


@_add("pearson_signatures", f"WITH {_SIG}, m AS (SELECT gene_id, avg(v) + 1e-6 AS mu FROM sg GROUP BY 1) SELECT gene_id, cell_type, round(v / sqrt(mu + mu * mu / 100), 6) AS value FROM sg JOIN m USING (gene_id)")
def pearson_signatures(s, d):
    return _by_type(features.normalise_signatures(_sig(s, d), "pearson"))


# Of two types centred values are d and -d, and the leverage has a closed form.
@_add("leverage_two_types", f"WITH {_SIG}, g AS (SELECT gene_id, (max(CASE WHEN cell_type = 'type_0' THEN v END) - max(CASE WHEN cell_type = 'type_1' THEN v END)) / 2 AS d FROM sg GROUP BY 1), t AS (SELECT sum(d * d) AS s FROM g) SELECT gene_id, round(2 * d * d / (2 * s + 1e-6) / (2 * s / (2 * s + 1e-6) + 1e-6), 6) AS leverage FROM g, t")
def leverage_two_types(s, d):
    two = _sig(s, d).select("gene_id", F.slice("x", 1, 2).alias("x"))
    return features.leverage(two).withColumn("leverage", _r("leverage"))


@_add("leverage")
def leverage(s, d):
    return features.leverage(_sig(s, d)).withColumn("leverage", _r("leverage"))


@_add("sketch_project", f"WITH {_C} SELECT spot_id, CAST(gene_id * 7919 % 16 AS INTEGER) AS bucket, round(sum(value * CASE WHEN gene_id % 2 = 0 THEN 1 ELSE -1 END), 6) AS value FROM c GROUP BY 1, 2")
def sketch_project(s, d):
    m = _genes(s, d).select("gene_id", (F.col("gene_id") * 7919 % 16).cast("int").alias("bucket"), F.when(F.col("gene_id") % 2 == 0, 1.0).otherwise(-1.0).alias("weight"))
    return sketch.project(_counts(s, d), m).withColumn("value", _r("value"))


@_add("countsketch")
def countsketch(s, d):
    ids = [r[0] for r in _sig(s, d).select("gene_id").orderBy("gene_id").collect()]
    return sketch.sketch_map(s, ids, 16)


@_add("rademacher")
def rademacher(s, d):
    ids = [r[0] for r in _sig(s, d).select("gene_id").orderBy("gene_id").collect()]
    return sketch.sketch_map(s, ids, 16, "rademacher")


@_add("cross_products", f"WITH {_C} SELECT s_suppkey AS spot_id, coalesce(sum(value * (gene_id % 3)), 0) AS h0, coalesce(sum(value * (gene_id % 5)), 0) AS h1 FROM supplier LEFT JOIN c ON spot_id = s_suppkey GROUP BY 1")
def cross_products(s, d):
    m = _genes(s, d).select("gene_id", F.array((F.col("gene_id") % 3).cast("double"), (F.col("gene_id") % 5).cast("double")).alias("m"))
    return sketch.cross_products(_counts(s, d), m, _spots(s, d), 2).select("spot_id", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1"))


@_add("knn_graph", f"WITH {_PTS}, r AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS r FROM pt a JOIN pt b ON a.id <> b.id) SELECT i, j FROM r WHERE r <= 6 UNION SELECT j, i FROM r WHERE r <= 6")
def knn_graph(s, d):
    return graph.knn_graph(_points(s, d), 6)


@_add("radius_graph", f"WITH {_PTS} SELECT a.id AS i, b.id AS j FROM pt a JOIN pt b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {SIDE} * {SIDE}")
def radius_graph(s, d):
    return graph.radius_graph(_points(s, d), SIDE)


@_add("grid_graph", f"WITH {_LAT} SELECT i, j FROM ed")
def grid_graph(s, d):
    return _edges(s, d)


@_add("degree", f"WITH {_DEG} SELECT spot_id, CAST(degree AS INTEGER) AS degree FROM dg")
def degree(s, d):
    return graph.degrees(_edges(s, d), _spots(s, d))


@_add("laplacian", f"WITH {_DEG} SELECT spot_id AS i, spot_id AS j, CAST(degree AS DOUBLE) AS value FROM dg UNION ALL SELECT i, j, CAST(-1 AS DOUBLE) FROM ed")
def laplacian(s, d):
    return graph.laplacian(_edges(s, d), _spots(s, d))


@_add("laplacian_norm", f"WITH {_DEG} SELECT spot_id AS i, spot_id AS j, CAST(1 AS DOUBLE) AS value FROM dg UNION ALL SELECT i, j, round(-1 / sqrt(a.degree * b.degree), 6) FROM ed JOIN dg a ON a.spot_id = i JOIN dg b ON b.spot_id = j")
def laplacian_norm(s, d):
    return graph.laplacian(_edges(s, d), _spots(s, d), True).withColumn("value", _r("value"))


@_add("neighbors", f"WITH {_LAT} SELECT id AS spot_id, coalesce(string_agg(CAST(j AS VARCHAR), ',' ORDER BY j), '') AS neighbors FROM sp LEFT JOIN ed ON i = id GROUP BY 1")
def neighbors(s, d):
    return graph.neighbors(_edges(s, d), _spots(s, d)).select("spot_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@_add("lap_quadratic", f"WITH {_LAT}, {_SH} SELECT round(sum((a.pred - b.pred) * (a.pred - b.pred)) / 2, 6) AS value FROM ed JOIN d a ON a.spot_id = i JOIN d b ON b.spot_id = j AND a.cell_type = b.cell_type")
def lap_quadratic(s, d):
    beta = _prop(s, d).groupBy("spot_id").pivot("cell_type", ["A", "N", "R"]).agg(F.first("proportion")).select("spot_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("A", "N", "R")]).alias("b"))
    return graph.quadratic(beta, _edges(s, d)).withColumn("value", _r("value"))


@_add("auto_lambda", f"WITH {_DEG} SELECT round(0.005 * 7.5 / greatest(avg(degree), 1), 9) AS value FROM dg")
def auto_lambda(s, d):
    return s.createDataFrame([(round(graph.auto_lambda(7.5, _edges(s, d), _spots(s, d)), 9),)], "value double")


@_add("dominant", f"WITH {_SH}, r AS (SELECT spot_id, cell_type, row_number() OVER (PARTITION BY spot_id ORDER BY pred DESC, cell_type) AS r FROM d) SELECT spot_id, cell_type FROM r WHERE r = 1")
def dominant(s, d):
    wide = _prop(s, d).groupBy("spot_id").pivot("cell_type", ["A", "N", "R"]).agg(F.first("proportion"))
    p = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("A", "N", "R")])
    return wide.select("spot_id", F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), argmax(p)).alias("cell_type"))


@_add("proportions", f"WITH {_SH} SELECT spot_id, cell_type, round(q / sum(q) OVER (PARTITION BY spot_id), 6) AS proportion FROM g")
def proportions(s, d):
    g = _t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("spot_id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    beta = g.select("spot_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("A", "N", "R")]).alias("b"))
    return tables.long_proportions(solver.proportions(beta), ["A", "N", "R"]).where("proportion > 0").withColumn("proportion", _r("proportion"))


def _flags(s, d):
    """Per supplier an array of its quantity shares by return flag."""
    wide = _prop(s, d).groupBy("spot_id").pivot("cell_type", ["A", "N", "R"]).agg(F.first("proportion"))
    return wide.select("spot_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("A", "N", "R")]).alias("b"))


@_add("result_table", f"WITH {_LAT}, {_SH}, w AS (SELECT spot_id, round(coalesce(max(CASE WHEN cell_type = 'A' THEN pred END), 0), 6) AS A, round(coalesce(max(CASE WHEN cell_type = 'N' THEN pred END), 0), 6) AS N, round(coalesce(max(CASE WHEN cell_type = 'R' THEN pred END), 0), 6) AS R, min_by(cell_type, (-pred, cell_type)) AS dominant FROM d GROUP BY 1) SELECT spot_id, A, N, R, dominant, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM w JOIN sp ON id = spot_id")
def result_table(s, d):
    beta = _flags(s, d)
    got = tables.result_table(beta, _spots(s, d).join(beta, "spot_id", "left_semi"), ["A", "N", "R"], "b")
    return got.withColumns({c: _r(c) for c in "ANR"})


#: Gram matrix, smoothing and sparsity of the sweep and the objective that SQL computes as well.
_GRAM = np.array([[2.0, 0.5, 0.1], [0.5, 1.5, 0.2], [0.1, 0.2, 1.0]])
_LAMBDA, _RHO, _Y2 = 0.3, 0.05, 1000.0


def _state(s, d):
    """A state of the solver: h is the suppliers' shares of rows by return flag times 3, b those of quantity."""
    q = _shares(s, d).groupBy("spot_id").pivot("cell_type", ["A", "N", "R"]).agg(F.first("pred").alias("p"), F.first("true").alias("t"))
    arr = lambda x, f: F.array(*[F.coalesce(F.col(f"{c}_{x}"), F.lit(0.0)) * f for c in "ANR"])
    return q.select("spot_id", arr("t", 3.0).alias("h"), arr("p", 1.0).alias("b"))


_STATE = _LAT + ", " + _SH + ", st AS (SELECT spot_id, " + ", ".join(f"coalesce(max(CASE WHEN cell_type = '{c}' THEN {x} END), 0) * {f} AS {n}{k}" for n, x, f in (("h", "true_", 3.0), ("b", "pred", 1.0)) for k, c in enumerate("ANR")) + " FROM d GROUP BY 1), nb AS (SELECT i AS spot_id, count(*) AS n, sum(b0) AS n0, sum(b1) AS n1, sum(b2) AS n2 FROM ed JOIN st ON st.spot_id = j GROUP BY 1), sn AS (SELECT st.*, coalesce(n, 0) AS n, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM st LEFT JOIN nb USING (spot_id))"


def _sweep_sql() -> str:
    """A step for each type: later ones see the new values of those before."""
    parts, source, now = [], "sn", ["b0", "b1", "b2"]
    for k in range(3):
        rest = " - ".join(["", *[f"{_GRAM[k, j]} * {now[j]}" for j in range(3) if j != k]])
        res = f"(h{k}{rest} + {_LAMBDA} * n{k})"
        parts.append(f"u{k} AS (SELECT *, greatest(0, sign({res}) * greatest(abs({res}) - {_RHO}, 0) / ({_GRAM[k, k]} + {_LAMBDA} * n)) AS c{k} FROM {source})")
        source, now[k] = f"u{k}", f"c{k}"
    return ", ".join(parts)


@_add("sweep", f"WITH {_STATE}, {_sweep_sql()} SELECT spot_id, round(c0, 6) AS b0, round(c1, 6) AS b1, round(c2, 6) AS b2, round(greatest(abs(c0 - b0), abs(c1 - b1), abs(c2 - b2)), 6) AS change FROM u2")
def sweep(s, d):
    edges = _edges(s, d).join(_state(s, d).select(F.col("spot_id").alias("j")), "j", "left_semi")
    got = solver.sweep(_state(s, d), edges, _GRAM, _LAMBDA, _RHO)
    return got.select("spot_id", *[_r(F.get("b", F.lit(k))).alias(f"b{k}") for k in range(3)], _r("change").alias("change"))


_OWN_PRODUCTS = " + ".join(f"{_GRAM[i, j]} * b{i} * b{j}" for i in range(3) for j in range(3))


@_add("objective", f"WITH {_STATE}, a AS (SELECT sum(h0 * b0 + h1 * b1 + h2 * b2) AS products, sum({_OWN_PRODUCTS}) AS own, sum(b0 + b1 + b2) AS l1 FROM st), q AS (SELECT sum((x.b0 - y.b0) * (x.b0 - y.b0) + (x.b1 - y.b1) * (x.b1 - y.b1) + (x.b2 - y.b2) * (x.b2 - y.b2)) / 2 AS q FROM ed JOIN st x ON x.spot_id = i JOIN st y ON y.spot_id = j) SELECT round(0.5 * ({_Y2} - 2 * products + own) + 0.5 * {_LAMBDA} * q + {_RHO} * l1, 6) AS value FROM a, q")
def objective(s, d):
    return s.createDataFrame([(round(solver.objective(_state(s, d), _edges(s, d), _GRAM, _Y2, _LAMBDA, _RHO), 6),)], "value double")


@_add("gram", f"WITH {_SIG} SELECT a.cell_type AS type1, b.cell_type AS type2, round(sum(a.v * b.v), 4) AS value FROM sg a JOIN sg b USING (gene_id) GROUP BY 1, 2")
def gram(s, d):
    x = np.array([r.x for r in _sig(s, d).orderBy("gene_id").collect()])  # genes by types: one reference's signatures
    g = sketch.gram(x.T)
    k = range(len(g))
    return s.createDataFrame([(f"type_{i}", f"type_{j}", round(float(g[i, j]), 4)) for i in k for j in k], "type1 string, type2 string, value double")


@_add("rmse", f"WITH {_SH} SELECT cell_type, round(sqrt(avg((pred - true_) * (pred - true_))), 6) AS rmse FROM d GROUP BY 1")
def rmse(s, d):
    return metrics.rmse(_shares(s, d), True).withColumn("rmse", _r("rmse"))


@_add("mae", f"WITH {_SH} SELECT cell_type, round(avg(abs(pred - true_)), 6) AS mae FROM d GROUP BY 1")
def mae(s, d):
    return metrics.mae(_shares(s, d), True).withColumn("mae", _r("mae"))


@_add("pearson", f"WITH {_SH} SELECT cell_type, round({_CORR.format(a='pred', b='true_')}, 6) AS pearson FROM d GROUP BY 1")
def pearson(s, d):
    return metrics.correlation(_shares(s, d), True).withColumn("pearson", _r("pearson"))


_RANK = ", k AS (SELECT cell_type, {x}rank() OVER ({p}ORDER BY pred) + (count(*) OVER (PARTITION BY {y}pred) - 1) / 2.0 AS a, rank() OVER ({p}ORDER BY true_) + (count(*) OVER (PARTITION BY {y}true_) - 1) / 2.0 AS b FROM r)"
_SHR = _SH + ", r AS (SELECT cell_type, round(pred, 9) AS pred, round(true_, 9) AS true_ FROM d)"


def _rounded(s, d):
    return _shares(s, d).withColumns({c: _r(c, 9) for c in ("pred", "true")})


@_add("spearman", f"WITH {_SHR}{_RANK.format(x='', p='PARTITION BY cell_type ', y='cell_type, ')} SELECT cell_type, round({_CORR.format(a='a', b='b')}, 6) AS spearman FROM k GROUP BY 1")
def spearman(s, d):
    return metrics.correlation(_rounded(s, d), True, "spearman").withColumn("spearman", _r("spearman"))


@_add("spearman_overall", f"WITH {_SHR}{_RANK.format(x='', p='', y='')} SELECT round({_CORR.format(a='a', b='b')}, 6) AS spearman FROM k")
def spearman_overall(s, d):
    return metrics.correlation(_rounded(s, d), method="spearman").withColumn("spearman", _r("spearman"))


@_add("jsd", f"WITH {_SH}, c AS (SELECT spot_id, greatest(1e-10, least(1 - 1e-10, pred)) AS p, greatest(1e-10, least(1 - 1e-10, true_)) AS q FROM d), m AS (SELECT spot_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM c WINDOW w AS (PARTITION BY spot_id)) SELECT spot_id, round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 8) AS jsd FROM m GROUP BY 1")
def jsd(s, d):
    return metrics.jsd(_shares(s, d)).withColumn("jsd", _r("jsd", 8))


_EVALUATED = _SHR + f"""{_RANK.format(x='', p='', y='').replace('k AS (SELECT cell_type, ', 'ko AS (SELECT cell_type, pred, true_, ')}{_RANK.format(x='', p='PARTITION BY cell_type ', y='cell_type, ').replace('k AS (SELECT cell_type, ', 'kt AS (SELECT cell_type, pred, true_, ')},
 js AS (SELECT spot_id, greatest(1e-10, least(1 - 1e-10, round(pred, 9))) AS p, greatest(1e-10, least(1 - 1e-10, round(true_, 9))) AS q FROM d), jm AS (SELECT spot_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM js WINDOW w AS (PARTITION BY spot_id)),
 jd AS (SELECT sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS jsd FROM jm GROUP BY spot_id),
 m AS (SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS cell_type, sqrt(avg((pred - true_) * (pred - true_))) AS rmse, avg(abs(pred - true_)) AS mae, {_CORR.format(a='pred', b='true_')} AS pearson, {_CORR.format(a='a', b='b')} AS spearman, (SELECT avg(jsd) FROM jd) AS jsd, CAST(NULL AS DOUBLE) AS mean_true, CAST(NULL AS DOUBLE) AS mean_pred FROM ko
  UNION ALL SELECT 'per_cell_type', cell_type, sqrt(avg((pred - true_) * (pred - true_))), avg(abs(pred - true_)), {_CORR.format(a='pred', b='true_')}, {_CORR.format(a='a', b='b')}, NULL, avg(true_), avg(pred) FROM kt GROUP BY cell_type)
 SELECT scope, cell_type, metric, round(value, 6) AS value FROM m UNPIVOT (value FOR metric IN (rmse, mae, pearson, spearman, jsd, mean_true, mean_pred))"""


@_add("evaluate", f"WITH {_EVALUATED}")
def evaluate(s, d):
    return metrics.evaluate(_rounded(s, d)).withColumn("value", _r("value"))


@_add("rare_detection", f"WITH {_SH}, n AS (SELECT count(CASE WHEN true_ > 0 AND true_ < 0.26 AND pred > 0.13 THEN 1 END) AS tp, count(CASE WHEN true_ > 0 AND true_ < 0.26 AND NOT pred > 0.13 THEN 1 END) AS fn, count(CASE WHEN true_ = 0 AND pred > 0.13 THEN 1 END) AS fp FROM d), x AS (SELECT tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS r, tp + fn AS n FROM n) SELECT round(CASE WHEN n = 0 THEN -1 ELSE p END, 6) AS precision, round(CASE WHEN n = 0 THEN -1 ELSE r END, 6) AS recall, round(CASE WHEN n = 0 THEN -1 ELSE 2 * p * r / (p + r + 1e-10) END, 6) AS f1 FROM x")
def rare_detection(s, d):
    got = metrics.rare_detection(_shares(s, d), 0.26)
    return got.select(*[_r(F.when(F.isnan(c), -1.0).otherwise(F.col(c))).alias(c) for c in got.columns])


@_add("bin_aggregate", f"WITH {_C}, sp AS (SELECT s_suppkey AS id, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier), b AS (SELECT id, x, y, (x - (SELECT min(x) FROM sp)) // 2 || '_' || (y - (SELECT min(y) FROM sp)) // 2 AS bin_id FROM sp) SELECT bin_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n_spots FROM b GROUP BY 1")
def bin_aggregate(s, d):
    # Suppliers lie one apart: bins of 16 for spots of 8 are two wide.
    return binning.binned_spots(binning.bins_of_size(_spots(s, d), 16)).select("bin_id", _r("x").alias("x"), _r("y").alias("y"), "n_spots")


@_add("bin_counts", f"WITH {_C}, sp AS (SELECT s_suppkey AS id, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier), b AS (SELECT id, (x - (SELECT min(x) FROM sp)) // 2 || '_' || (y - (SELECT min(y) FROM sp)) // 2 AS bin_id FROM sp) SELECT bin_id, gene_id, sum(value) AS value FROM c JOIN b ON id = spot_id GROUP BY 1, 2")
def bin_counts(s, d):
    return binning.binned_counts(binning.aggregate_bins(_spots(s, d), 2.0), _counts(s, d))


def _scaled(s, d):
    """Shares of quantity by return flag for customers of a nation, as bins of two sizes."""
    g = _t(s, d, "lineitem").withColumn("bin_size", F.explode(F.array(F.lit(8), F.lit(16)))).groupBy("bin_size", F.floor(F.col("l_partkey") / F.col("bin_size")).alias("spot_id"), F.col("l_returnflag").alias("cell_type")).agg(F.sum("l_quantity").alias("q"))
    t = g.groupBy("bin_size", "spot_id").agg(F.sum("q").alias("t"))
    return g.join(t, ["bin_size", "spot_id"]).select("bin_size", "spot_id", "cell_type", (F.col("q") / F.col("t")).alias("proportion"))


_SCALED = "z AS (SELECT b AS bin_size, l_partkey // b AS spot_id, l_returnflag AS cell_type, sum(l_quantity) AS q FROM lineitem, (VALUES (8), (16)) v(b) GROUP BY 1, 2, 3), y AS (SELECT bin_size, spot_id, cell_type, q / sum(q) OVER (PARTITION BY bin_size, spot_id) AS p FROM z)"
_RES = _SCALED + ", x AS (SELECT bin_size, spot_id, p, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER (PARTITION BY bin_size, spot_id) AS c FROM y), w AS (SELECT bin_size, spot_id, max(p) AS top, -sum(c * ln(c)) AS h, count(*) AS k FROM x GROUP BY 1, 2), m AS (SELECT bin_size, avg(CASE WHEN top > 0.8 THEN 1.0 ELSE 0 END) AS purity, avg(CASE WHEN k = 1 THEN 0 ELSE h / ln(k) END) AS entropy, avg(exp(h)) AS effective_k, count(*) AS n_spots FROM w GROUP BY 1)"


@_add("resolution_metrics", f"WITH {_RES} SELECT bin_size, round(purity, 6) AS purity, round(entropy, 6) AS entropy, round(effective_k, 6) AS effective_k, n_spots FROM m")
def resolution_metrics(s, d):
    return metrics.resolution_metrics(_scaled(s, d)).select("bin_size", _r("purity").alias("purity"), _r("entropy").alias("entropy"), _r("effective_k").alias("effective_k"), "n_spots")


@_add("findings", f"WITH {_RES} SELECT min(CASE WHEN purity < 0.5 THEN bin_size END) AS horizon, round(coalesce((max(CASE WHEN bin_size = 8 THEN purity END) - max(CASE WHEN bin_size = 16 THEN purity END)) / nullif(max(CASE WHEN bin_size = 8 THEN purity END), 0) * 100, -1), 6) AS first_loss FROM m")
def findings(s, d):
    return metrics.findings(metrics.resolution_metrics(_scaled(s, d))).select("horizon", _r(F.coalesce("first_loss", F.lit(-1.0))).alias("first_loss"))


@_add("type_loss", f"WITH {_SCALED}, m AS (SELECT bin_size, cell_type, max(p) AS p FROM y GROUP BY 1, 2), e AS (SELECT cell_type, min_by(p, bin_size) AS a, max_by(p, bin_size) AS b FROM m GROUP BY 1) SELECT cell_type, round((a - b) / a * 100, 6) AS loss, (a - b) / a * 100 > 50 AS sensitive FROM e")
def type_loss(s, d):
    return metrics.type_loss(metrics.type_maxima(_scaled(s, d))).withColumn("loss", _r("loss"))


@_add("sig_corr", f"WITH {_SIG} SELECT a.cell_type AS type1, b.cell_type AS type2, round({_CORR.format(a='a.v', b='b.v')}, 6) AS r, {_CORR.format(a='a.v', b='b.v')} > 0.95 AS similar FROM sg a JOIN sg b ON a.gene_id = b.gene_id AND a.cell_type < b.cell_type GROUP BY 1, 2")
def sig_corr(s, d):
    sig = tables.reference_signatures(_ref(s, d), _cells(s, d))
    return qc.signature_correlation(sig, sig.select("gene_id").distinct()).withColumn("r", _r("r"))


@_add("marker_validation", f"WITH {_REF}, n AS (SELECT cell_type, count(*) AS n FROM (SELECT DISTINCT cell_id, cell_type FROM rc) GROUP BY 1), m AS (SELECT cell_type, gene_id, sum(value) AS s, count(CASE WHEN value > 0 THEN 1 END) AS k FROM rc GROUP BY 1, 2), t AS (SELECT gene_id, sum(s) AS a FROM m GROUP BY 1), z AS (SELECT m.cell_type, m.gene_id, k / n.n AS share, (s / n.n) / ((a - s) / ((SELECT sum(n) FROM n) - n.n) + 1e-6) AS fc FROM m JOIN t USING (gene_id) JOIN n ON n.cell_type = m.cell_type) SELECT cell_type, gene_id, round(share, 6) AS share, round(fc, 6) AS fold_change, share > 0.8 AND fc > 5 AS ok FROM z")
def marker_validation(s, d):
    markers = tables.reference_signatures(_ref(s, d), _cells(s, d), "sum").select("cell_type", "gene_id")
    return qc.marker_validation(_ref(s, d), _cells(s, d), markers).select("cell_type", "gene_id", _r("share").alias("share"), _r("fold_change").alias("fold_change"), "ok")


@_add("strict_annotation", "WITH x AS (SELECT user_id AS cell_id, event_type AS cell_type, avg(value) AS s FROM events GROUP BY 1, 2), y AS (SELECT cell_id, cell_type, round(s, 6) - 0.5 * round(s / 3, 6) AS s FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, cell_type) AS r FROM y) SELECT cell_id, CASE WHEN max(CASE WHEN r = 1 THEN s END) > 0 AND (max(CASE WHEN r = 2 THEN s END) IS NULL OR max(CASE WHEN r = 1 THEN s END) > max(CASE WHEN r = 2 THEN s END) + 0.5) THEN max(CASE WHEN r = 1 THEN cell_type END) ELSE 'Ambiguous' END AS cell_type FROM r GROUP BY 1")
def strict_annotation(s, d):
    e = _t(s, d, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("cell_type")).agg(F.avg("value").alias("s"))
    return qc.strict_annotation(e.select("cell_id", "cell_type", _r("s").alias("pos"), _r(F.col("s") / 3).alias("neg")))


_CUST = "SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Unknown' ELSE c_mktsegment END AS cell_type FROM customer"


def _customers(s, d):
    return _t(s, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "Unknown").otherwise(F.col("c_mktsegment")).alias("cell_type"))


@_add("filter_unknown", f"SELECT * FROM ({_CUST}) WHERE cell_type <> 'Unknown'")
def filter_unknown(s, d):
    return qc.filter_unknown(_customers(s, d))


@_add("min_cells", f"WITH x AS ({_CUST}) SELECT * FROM x WHERE cell_type IN (SELECT cell_type FROM x GROUP BY 1 HAVING count(*) >= 300)")
def min_cells(s, d):
    return qc.min_cells(_customers(s, d), 300)


@_add("merge_labels", f"SELECT cell_id, CASE WHEN cell_type = 'BUILDING' THEN 'HOUSEHOLD' ELSE cell_type END AS cell_type FROM ({_CUST})")
def merge_labels(s, d):
    return qc.merge_labels(_customers(s, d), {"BUILDING": "HOUSEHOLD"})


@_add("cell_bands", f"SELECT cell_type, count(*) AS n, CASE WHEN count(*) >= 2000 THEN 'excellent' WHEN count(*) >= 500 THEN 'good' WHEN count(*) >= 200 THEN 'usable' ELSE 'poor' END AS band FROM ({_CUST}) GROUP BY 1")
def cell_bands(s, d):
    return qc.cell_bands(_customers(s, d))


@_add("region_means", f"WITH {_SH} SELECT s_nationkey AS region, cell_type, round(avg(pred), 6) AS mean_proportion FROM d JOIN supplier ON s_suppkey = spot_id GROUP BY 1, 2")
def region_means(s, d):
    regions = _t(s, d, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("region"))
    return qc.region_means(_prop(s, d), regions).withColumn("mean_proportion", _r("mean_proportion"))


_MARKED = _C + ", " + _SH + """, n AS (SELECT cell_type, count(*) AS n, avg(pred) AS my, var_pop(pred) AS vy, max(pred) = min(pred) AS flat FROM d GROUP BY 1),
 z AS (SELECT d.cell_type, gene_id, count(*) AS k, sum(value) AS s, sum(value * value) AS q, sum(value * (pred - my)) AS c, max(value) = min(value) AS same, max(CASE WHEN value = 0 THEN 1 ELSE 0 END) = 1 AS zeros FROM c JOIN d USING (spot_id) JOIN n ON n.cell_type = d.cell_type GROUP BY 1, 2)"""


@_add("marker_correlation", f"WITH {_MARKED} SELECT n.cell_type, p_partkey AS gene_id, round(CASE WHEN k IS NULL OR flat OR (same AND (k = n OR zeros)) THEN 0 ELSE coalesce(c / n / nullif(sqrt(greatest(q / n - (s / n) * (s / n), 0) * vy), 0), 0) END, 6) AS r FROM part CROSS JOIN n LEFT JOIN z ON z.cell_type = n.cell_type AND z.gene_id = p_partkey")
def marker_correlation(s, d):
    """Every gene with every type."""
    every = _genes(s, d).select("gene_id", F.explode(F.array(*[F.lit(t) for t in "ANR"])).alias("cell_type"))
    parts = -(-_t(s, d, "lineitem").count() // ROWS_OF_A_TASK) or 1
    return qc.marker_correlation(_counts(s, d, parts), _prop(s, d), every, parts).withColumn("r", _r("r"))


@_add("coherence", f"WITH {_LAT}, {_SH} SELECT a.cell_type, round({_CORR.format(a='a.pred', b='b.pred')}, 6) AS coherence FROM ed JOIN d a ON a.spot_id = i JOIN d b ON b.spot_id = j AND a.cell_type = b.cell_type GROUP BY 1")
def coherence(s, d):
    return qc.coherence(_prop(s, d), _edges(s, d)).withColumn("coherence", _r("coherence"))


def _fit(s, d):
    return fit_deconvolution(_ref(s, d).withColumnRenamed("cell_id", "spot_id"), _ref(s, d), _cells(s, d), _points(s, d), n_hvg=0, n_markers_per_type=20, sketch_dim=64)


@_add("deconvolve")
def deconvolve(s, d):
    got = _fit(s, d)
    return got.get_cell_type_proportions().withColumn("proportion", _r("proportion", 4)).withColumn("converged", F.lit(got.info_.converged))


@_add("solver_sweep")
def solver_sweep(s, d):
    got = _fit(s, d)
    return got.get_abundances().select("spot_id", F.transform("b", lambda x: F.round(x, 4)).alias("b"), F.lit(got.info_.converged).alias("converged"), F.lit(got.info_.n_iterations).alias("n_iterations"))


@_add("multiscale")
def multiscale_bins(s, d):
    return multiscale(_ref(s, d).withColumnRenamed("cell_id", "spot_id"), _sig(s, d), _points(s, d), [f"type_{i}" for i in range(10)], n_hvg=0, n_markers_per_type=20, sketch_dim=64).withColumn("proportion", _r("proportion", 4))


@_add("language_mixture")
def language_mixture(s: SparkSession, d: str) -> DataFrame:
    """The mixture of languages of every document, from counts of its tokens; its neighbours are those on a lattice of ids."""
    docs = _t(s, d, "documents")
    words = lambda rows, c: rows.select(c, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w")).where("w <> ''").select(c, F.abs(F.xxhash64("w")).alias("gene_id"))
    counts = words(docs.withColumnRenamed("doc_id", "spot_id"), "spot_id").groupBy("spot_id", "gene_id").agg(F.count("*").cast("double").alias("value"))
    # Markers come from all words; documents without a language are spots, but no part of the reference.
    cells = docs.where("lang IS NOT NULL").select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("cell_type"))
    spots = docs.select(F.col("doc_id").alias("spot_id"), F.array((F.col("doc_id") % 1000).cast("double"), F.floor(F.col("doc_id") / 1000).cast("double")).alias("coords"))
    # A word counts for its own row's language, and no counts of documents move; only documents whose id repeats have words of other rows, and those are joined.
    repeated = cut(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    few = F.broadcast(repeated) if repeated.count() <= 20_000 else repeated
    alone = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", F.col("lang").alias("cell_type")).join(few, "doc_id", "left_anti")
    several = docs.select("doc_id", "text").join(few, "doc_id", "left_semi").join(cells.withColumnRenamed("cell_id", "doc_id"), "doc_id")
    labelled = words(alone, "cell_type").unionByName(words(several, "cell_type")).withColumn("value", F.lit(1.0))
    types = tables.cell_types(cells)
    signatures = tables.gene_major(tables.signatures_of(labelled, cells), types)
    counted = docs.where(F.lower("text").rlike("[a-z]")).select(F.col("doc_id").alias("spot_id"))
    got = Deconvolution(n_hvg=0, spatial_method="radius", radius=1.5).fit(counts, signatures, spots, types, counted)
    return got.get_dominant_cell_type().join(docs.select(F.col("doc_id").alias("spot_id"), "lang"), "spot_id").select("spot_id", F.col("cell_type").alias("dominant"), "lang")
