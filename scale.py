"""Times neighbours and a fixed number of sweeps for N and 10 N synthetic spots on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ["PYSPARK_PYTHON"] = sys.executable

TYPES, SWEEPS, NEIGHBOURS = 10, 24, 6


def main(sizes=(10_000, 100_000)) -> None:
    import numpy as np
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from mixspark.functions.lineage import cut
    from mixspark.operators import graph, solver

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="scale-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    a = np.random.default_rng(0).normal(size=(TYPES, 3 * TYPES))
    out = {}
    for n in (sizes[0], *sizes):  # the first run warms up
        spots = cut(spark.range(n).select(F.col("id").alias("spot_id"), F.array(F.rand(1), F.rand(2)).alias("coords")))
        h = cut(spark.range(n).select(F.col("id").alias("spot_id"), F.array(*[F.rand(10 + k) * 20 for k in range(TYPES)]).alias("h")))
        began = time.time()
        edges = cut(graph.knn_graph(spots, NEIGHBOURS))
        linked = time.time()
        _, info = solver.solve(h, edges, a @ a.T, 0.5, 0.01, max_iter=SWEEPS, tol=1e-30, tiles=solver.spatial_tiles(spots))
        solved = time.time()
        _, ended = solver.solve(h, edges, a @ a.T, 0.5, 0.01, tiles=solver.spatial_tiles(spots))
        out[n] = {"neighbours": round(linked - began, 2), "sweeps": info.n_iterations, "solve": round(solved - linked, 2), "sweeps_to_end": ended.n_iterations, "converged": ended.converged}
    print(json.dumps({"types": TYPES, "k": NEIGHBOURS, "cpus": cpus, "spots": out}))


if __name__ == "__main__":
    main()
