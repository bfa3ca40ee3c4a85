"""Comparing estimated with true proportions. Both long: spot_id, cell_type, proportion; here joined as pairs (pred, true)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixspark.functions.columns import clip, pearson
from mixspark.functions.lineage import cut


def pairs(pred: DataFrame, true: DataFrame) -> DataFrame:
    """spot_id, cell_type, pred, true."""
    return pred.select("spot_id", "cell_type", F.col("proportion").alias("pred")).join(true.select("spot_id", "cell_type", F.col("proportion").alias("true")), ["spot_id", "cell_type"])


def _by(df: DataFrame, per_type: bool):
    return df.groupBy("cell_type") if per_type else df.groupBy()


def rmse(df: DataFrame, per_type: bool = False) -> DataFrame:
    return _by(df, per_type).agg(F.sqrt(F.avg((F.col("pred") - F.col("true")) * (F.col("pred") - F.col("true")))).alias("rmse"))


def mae(df: DataFrame, per_type: bool = False) -> DataFrame:
    return _by(df, per_type).agg(F.avg(F.abs(F.col("pred") - F.col("true"))).alias("mae"))


def _mean_ranks(df: DataFrame, c: str) -> DataFrame:
    """_v, _r: the mean rank of each distinct value of a column, without an ordered partition of them all.

    Values are dealt by their ranges; what the ranges before hold, a number for each, is added to the ranks within one.
    """
    counts = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = cut(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.sum("_c")).orderBy("_p").collect()  # as many as partitions
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _o bigint")
    within = Window.partitionBy("_p").orderBy("_v")
    ends = dealt.withColumn("_e", F.sum("_c").over(within)).join(F.broadcast(offsets), "_p")
    return ends.select("_v", (F.col("_o") + F.col("_e") - (F.col("_c") - 1) / 2).alias("_r"))


def ranked(df: DataFrame, per_type: bool) -> DataFrame:
    """pred and true replaced by their ranks, ties sharing the mean rank."""
    if not per_type:
        for c in ("pred", "true"):
            ends = _mean_ranks(df, c)
            df = df.join(ends, df[c] == ends["_v"]).withColumn(c, F.col("_r")).drop("_v", "_r")
        return df
    for c in ("pred", "true"):
        w = Window.partitionBy("cell_type").orderBy(c)
        df = df.withColumn("_r", F.rank().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy("cell_type", c))).withColumn(f"_{c}", F.col("_r") + (F.col("_c") - 1) / 2).drop("_r", "_c")
    return df.withColumn("pred", F.col("_pred")).withColumn("true", F.col("_true")).drop("_pred", "_true")


def correlation(df: DataFrame, per_type: bool = False, method: str = "pearson") -> DataFrame:
    """Correlation, 0 where a side is constant; spearman: of mean ranks."""
    return _by(ranked(df, per_type) if method == "spearman" else df, per_type).agg(pearson(F.col("pred"), F.col("true")).alias(method))


def jsd(df: DataFrame, eps: float = 1e-10) -> DataFrame:
    """spot_id, jsd: the Jensen-Shannon divergence of each spot, natural logarithm."""
    w = Window.partitionBy("spot_id")
    c = df.select("spot_id", clip(F.col("pred"), eps, 1 - eps).alias("p"), clip(F.col("true"), eps, 1 - eps).alias("q"))
    c = c.select("spot_id", (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return c.groupBy("spot_id").agg((F.sum(F.col("p") * F.ln(F.col("p") / F.col("m"))) / 2 + F.sum(F.col("q") * F.ln(F.col("q") / F.col("m"))) / 2).alias("jsd"))


def evaluate(df: DataFrame) -> DataFrame:
    """scope, cell_type, metric, value: five metrics over all, six for each type, from one pass with grouping sets."""
    df = cut(df.select("spot_id", "cell_type", "pred", "true"))
    keep = [F.col(c).alias(f"{c}_") for c in ("pred", "true")]
    every = ranked(df.select("*", *keep), False).withColumnsRenamed({"pred": "pa", "true": "ta"}).withColumnsRenamed({"pred_": "pred", "true_": "true"})
    both = ranked(every.select("*", *keep), True).withColumnsRenamed({"pred": "pt", "true": "tt"}).withColumnsRenamed({"pred_": "pred", "true_": "true"})
    p, t = F.col("pred"), F.col("true")
    one = both.rollup("cell_type").agg(
        F.grouping("cell_type").alias("overall"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
        F.avg(F.abs(p - t)).alias("mae"),
        pearson(p, t).alias("pearson"),
        pearson(F.col("pa"), F.col("ta")).alias("over_all"),
        pearson(F.col("pt"), F.col("tt")).alias("in_type"),
        F.avg(t).alias("mean_true"),
        F.avg(p).alias("mean_pred"),
    )
    one = one.withColumn("spearman", F.when(F.col("overall") == 1, F.col("over_all")).otherwise(F.col("in_type"))).join(F.broadcast(jsd(df).agg(F.avg("jsd").alias("jsd"))))
    named = lambda names: F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    shared = ["rmse", "mae", "pearson", "spearman"]
    metrics = F.when(F.col("overall") == 1, named([*shared, "jsd"])).otherwise(named([*shared, "mean_true", "mean_pred"]))
    out = one.where("overall = 0 OR rmse IS NOT NULL")
    return out.select(F.when(F.col("overall") == 1, "overall").otherwise("per_cell_type").alias("scope"), "cell_type", F.inline(metrics))


def rare_detection(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """precision, recall, f1 of finding types that are rare (above 0 and below threshold); NaN where none is."""
    rare, found = (F.col("true") > 0) & (F.col("true") < threshold), F.col("pred") > threshold / 2
    n = df.agg(F.count_if(rare & found).alias("tp"), F.count_if(rare & ~found).alias("fn"), F.count_if((F.col("true") == 0) & found).alias("fp"), F.count_if(rare).alias("n"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-10), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-10)
    nan = F.lit(float("nan"))
    return n.select(*[F.when(F.col("n") == 0, nan).otherwise(x).alias(c) for c, x in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r + 1e-10)))])


def resolution_metrics(df: DataFrame, eps: float = 1e-10) -> DataFrame:
    """df: bin_size, spot_id, cell_type, proportion. For each bin size purity, entropy and effective_k."""
    w = Window.partitionBy("bin_size", "spot_id")
    p = df.select("bin_size", "spot_id", "proportion", F.greatest("proportion", F.lit(eps)).alias("c")).withColumn("c", F.col("c") / F.sum("c").over(w))
    spot = p.groupBy("bin_size", "spot_id").agg(F.max("proportion").alias("top"), (-F.sum(F.col("c") * F.ln("c"))).alias("h"), F.count("*").alias("k"))
    bits = F.coalesce(F.try_divide(F.col("h"), F.ln("k")), F.lit(0.0))
    return spot.groupBy("bin_size").agg(F.avg((F.col("top") > 0.8).cast("double")).alias("purity"), F.avg(bits).alias("entropy"), F.avg(F.exp("h")).alias("effective_k"), F.count("*").alias("n_spots"))


def type_maxima(df: DataFrame) -> DataFrame:
    """bin_size, cell_type, max_proportion."""
    return df.groupBy("bin_size", "cell_type").agg(F.max("proportion").alias("max_proportion"))


def findings(metrics: DataFrame) -> DataFrame:
    """horizon: the first bin size of a purity below a half; first_loss: percent of purity lost between the first two bin sizes."""
    w = Window.orderBy("bin_size")  # a row for each bin size
    step = metrics.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("purity").over(w))
    loss = F.try_divide(F.col("purity") - F.col("_next"), F.col("purity")) * 100
    return step.agg(F.min(F.when(F.col("purity") < 0.5, F.col("bin_size"))).alias("horizon"), F.max(F.when(F.col("_n") == 1, loss)).alias("first_loss"))


def type_loss(maxima: DataFrame) -> DataFrame:
    """cell_type, loss (percent from the first to the last bin size), sensitive (over 50)."""
    ends = maxima.groupBy("cell_type").agg(F.min_by("max_proportion", "bin_size").alias("a"), F.max_by("max_proportion", "bin_size").alias("b"))
    return ends.select("cell_type", F.coalesce(F.try_divide(F.col("a") - F.col("b"), F.col("a")) * 100, F.lit(0.0)).alias("loss")).withColumn("sensitive", F.col("loss") > 50)
