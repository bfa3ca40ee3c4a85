"""The spatially smoothed, sparse, non-negative mixture: sweeps over spots until nothing moves.

Within a sweep spots don't depend on one another, only on their neighbours' values of the last
one, so any partitioning gives the same result. Spots are dealt to tiles. A tile knows, beside
its own spots, those within `depth` steps along edges: it can then go that many sweeps by itself,
computing some of its surroundings too, before tiles exchange the values at their rims. So
there is a Spark job for every `depth` sweeps, and none but the rims' values move between
tiles; a graph of one tile needs a single job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.functions.columns import normalised
from mixspark.functions.lineage import cut
from mixspark.operators.graph import quadratic

#: Spots of a tile, about, and sweeps between exchanges, at most.
TILE, DEPTH = 20_000, 8


@dataclass(frozen=True)
class FitInfo:
    converged: bool
    n_iterations: int
    final_objective: float
    final_change: float
    objectives: tuple[float, ...] = ()


def soft_threshold(x, by: float):
    """x moved towards 0 by `by`, and 0 within that distance."""
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def update(h: np.ndarray, b: np.ndarray, near: np.ndarray, n: np.ndarray, gram: np.ndarray, lam: float, rho: float) -> np.ndarray:
    """New values of many spots at once; near: sums over neighbours, n: how many there are."""
    b, r = b.copy(), b @ gram
    for k in range(gram.shape[0]):
        res = h[:, k] - r[:, k] + gram[k, k] * b[:, k] + lam * near[:, k]
        den = gram[k, k] + lam * n
        value = np.where(den > 1e-10, np.maximum(0, soft_threshold(res, rho) / np.maximum(den, 1e-300)), 0.0)
        r += (value - b[:, k])[:, None] * gram[k]
        b[:, k] = value
    return b


def sweep(state: DataFrame, edges: DataFrame, gram: np.ndarray, lam: float, rho: float) -> DataFrame:
    """state: spot_id, h, b. The same with new b, and change and size: the largest move and the largest old value of each spot."""
    k = gram.shape[0]
    of = state.select(F.col("spot_id").alias("j"), *[F.get("b", F.lit(i)).alias(f"b{i}") for i in range(k)])
    near = edges.join(of, "j").groupBy(F.col("i").alias("spot_id")).agg(F.count("*").alias("n"), *[F.sum(f"b{i}").alias(f"n{i}") for i in range(k)])
    rows = state.select("spot_id", "h", "b").join(near, "spot_id", "left").select("spot_id", "h", "b", F.coalesce("n", F.lit(0)).alias("n"), F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) for i in range(k)]).alias("near"))

    def run(batches):
        for batch in batches:
            m = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), k) for c in ("h", "b", "near")}
            new = update(m["h"], m["b"], m["near"], batch.column("n").to_numpy().astype(float), gram, lam, rho)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * k), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("spot_id"), batch.column("h"), lists, pa.array(np.abs(new - m["b"]).max(1, initial=0)), pa.array(np.abs(m["b"]).max(1, initial=0))], ["spot_id", "h", "b", "change", "size"])

    return rows.mapInArrow(run, "spot_id bigint, h array<double>, b array<double>, change double, size double")


def objective(state: DataFrame, edges: DataFrame, gram: np.ndarray, y2: float, lam: float, rho: float) -> float:
    """Half the squared residual, plus half lam times the quadratic form, plus rho times the sum of absolute values."""
    k = gram.shape[0]
    b = [F.get("b", F.lit(i)) for i in range(k)]
    cross = sum((b[i] * F.get("h", F.lit(i)) for i in range(k)), F.lit(0.0))
    own = sum((b[i] * b[j] * float(gram[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    l1 = sum((F.abs(x) for x in b), F.lit(0.0))
    s = state.agg(F.sum(cross), F.sum(own), F.sum(l1)).first()
    c, o, a = (v or 0.0 for v in s)
    return 0.5 * (y2 - 2 * c + o) + 0.5 * lam * quadratic(state, edges).first()[0] + rho * a


def spatial_tiles(spots: DataFrame, per_tile: int = TILE) -> DataFrame:
    """spot_id, tile: tiles of about as many spots each, by slices of the first coordinate and, within these, of the second."""
    tiles = max(1, math.ceil(spots.count() / per_tile))
    if tiles == 1:
        return spots.select("spot_id", F.lit(0).alias("tile"))
    nx = max(2, math.ceil(math.sqrt(tiles)))
    ny = max(2, math.ceil(tiles / nx))
    xy = spots.select("spot_id", F.get("coords", F.lit(0)).alias("x"), F.coalesce(F.get("coords", F.lit(1)), F.lit(0.0)).alias("y"))

    def edges(df, c: str, n: int) -> DataFrame:
        return df.agg(F.percentile_approx(c, [i / max(n, 2) for i in range(1, max(n, 2))], 100 * n).alias("e"))

    ex = np.array(edges(xy, "x", nx).first()[0], float)

    def slices(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("spot_id"), pa.array(np.searchsorted(ex, b.column("x").to_numpy(), "right").astype(np.int32)), b.column("y")], ["spot_id", "slice", "y"])

    sliced = xy.mapInArrow(slices, f"spot_id {dict(spots.dtypes)['spot_id']}, slice int, y double")
    # As many numbers as there are tiles.
    ey = {r["slice"]: np.array(r.e, float) for r in edges(sliced.groupBy("slice"), "y", ny).collect()}

    def number(batches):
        for b in batches:
            at, y = b.column("slice").to_numpy(), b.column("y").to_numpy()
            tile = np.zeros(len(b), np.int32)
            for k in np.unique(at).tolist():
                tile[at == k] = k * ny + np.searchsorted(ey[k], y[at == k], "right")
            yield pa.RecordBatch.from_arrays([b.column("spot_id"), pa.array(tile)], ["spot_id", "tile"])

    return sliced.mapInArrow(number, f"spot_id {dict(spots.dtypes)['spot_id']}, tile int")


def _surroundings(tiles: DataFrame, edges: DataFrame, n: int, depth: int) -> tuple[DataFrame, int]:
    """tile, spot_id, hop of every spot within `depth` steps of a tile, or fewer where that would be more than twice all spots; and how many."""
    near = cut(tiles.select("tile", "spot_id", F.lit(0).alias("hop")))
    for hop in range(1, depth + 1):
        rim = near.where(F.col("hop") == hop - 1).join(edges, F.col("spot_id") == F.col("i")).select("tile", F.col("j").alias("spot_id"), F.lit(hop).alias("hop"))
        wider = cut(near.unionByName(rim).groupBy("tile", "spot_id").agg(F.min("hop").alias("hop")))
        if hop > 1 and wider.count() > 3 * n:
            return near, hop - 1
        near = wider
    return near, depth


_BOARD = "tile int, ids binary, hop binary, owner binary, h binary, starts binary, near binary, to binary"


def _numbers(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _boards(h: DataFrame, edges: DataFrame, near: DataFrame, tiles: DataFrame, k: int, depth: int) -> DataFrame:
    """A row for each tile: its spots and surroundings by hop and id, what they are made of, their neighbours, and which of its spots other tiles need."""
    lists = edges.groupBy(F.col("i").alias("spot_id")).agg(F.sort_array(F.collect_list("j")).alias("near"))
    whole = cut(near.join(h, "spot_id").join(lists, "spot_id", "left").join(tiles.withColumnRenamed("tile", "owner"), "spot_id"))
    rows = whole.select(F.col("tile").alias("at"), "tile", "spot_id", "hop", "owner", "h", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    needed = whole.where("tile <> owner").select(F.col("owner").alias("at"), F.col("tile").alias("needs"), F.col("spot_id").alias("whose"))

    def build(key, own, asked):
        own = own.sort_by([("hop", "ascending"), ("spot_id", "ascending")])
        ids, hop = own.column("spot_id").to_numpy(), own.column("hop").to_numpy()
        near = own.column("near").combine_chunks()
        # At `depth` steps nothing is computed, so no neighbours are needed there. A tile that reaches all there is in fewer steps computes its last ones too.
        inner = int(np.searchsorted(hop, depth))
        starts = near.offsets.to_numpy()[: inner + 1].astype(np.int64)
        starts -= starts[0]
        by = np.argsort(ids)
        wanted = near[:inner].flatten().to_numpy() if inner else np.zeros(0, np.int64)
        local = by[np.searchsorted(ids[by], wanted)]
        asked = asked.sort_by([("needs", "ascending"), ("whose", "ascending")])
        to, whose = asked.column("needs").to_numpy(), asked.column("whose").to_numpy()
        at = by[np.searchsorted(ids[by], whose)] if len(whose) else whose
        columns = [
            pa.array([key[0].as_py()], pa.int32()),
            *[pa.array([x], pa.binary()) for x in (_numbers(ids, "<i8"), _numbers(hop, "<i4"), _numbers(own.column("owner").to_numpy(), "<i4"), _numbers(own.column("h").combine_chunks().flatten(), "<f8"), _numbers(starts, "<i8"), _numbers(local, "<i4"), _numbers(np.stack([to, at]), "<i8"))],
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _BOARD.split(", ")])

    return cut(rows.groupBy("at").cogroup(needed.groupBy("at")).applyInArrow(build, _BOARD))


def _rows(batches) -> Iterator[dict]:
    """Rows of batches, one at a time: a batch has many tiles, and only one is copied."""
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


class _Board:
    """A tile's row, opened, and the values of all its spots."""

    def __init__(self, row: dict, k: int):
        self.tile = row["tile"]
        self.ids, self.hop, self.owner = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("hop", "<i4"), ("owner", "<i4")))
        self.h = np.frombuffer(row["h"], "<f8").reshape(-1, k)
        self.starts, self.near = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["near"], "<i4")
        self.to, self.at = np.frombuffer(row["to"], "<i8").reshape(2, -1)
        self.count = np.diff(self.starts).astype(float)
        self.b = np.full((len(self.ids), k), 1.0 / k)

    def take(self, messages: list[dict]) -> None:
        """Values that the tiles sent for their own spots, in the order of hops and ids."""
        by = np.lexsort((self.ids, self.owner))
        first = np.searchsorted(self.owner[by], [m["source"] for m in messages])
        last = np.searchsorted(self.owner[by], [m["source"] for m in messages], "right")
        for m, a, z in zip(messages, first, last, strict=True):
            self.b[by[a:z]] = np.frombuffer(m["values"], "<f8").reshape(z - a, -1)

    def sweeps(self, n: int, gram: np.ndarray, lam: float, rho: float, stop: float | None) -> tuple[list[float], list[float]]:
        """n sweeps; the largest move and the largest old value of the tile's own spots in each. stop: ends the sweeps where nothing moves more."""
        own, change, size = int(np.searchsorted(self.hop, 1)), [], []
        for t in range(1, n + 1):
            active = len(self.count) if not self.hop[-1] else int(np.searchsorted(self.hop, n - t, "right"))
            near, some = np.zeros((active, self.b.shape[1])), np.flatnonzero(self.count[:active])
            if len(some):
                near[some] = np.add.reduceat(self.b[self.near[: self.starts[active]]], self.starts[some], axis=0)
            new = update(self.h[:active], self.b[:active], near, self.count[:active], gram, lam, rho)
            change.append(float(np.abs(new - self.b[:active])[:own].max(initial=0)))
            size.append(float(np.abs(self.b[:own]).max(initial=0)))
            self.b[:active] = new
            if stop is not None and change[-1] / (size[-1] + 1e-10) < stop:
                break
        return change, size


_MESSAGE = "target int, source int, values binary, change array<double>, size array<double>"


def _exchange(boards: DataFrame, messages: DataFrame | None, n: int, gram: np.ndarray, lam: float, rho: float, stop: float | None) -> DataFrame:
    """What the tiles send to themselves and each other after n sweeps."""
    k = gram.shape[0]

    def moved(board: _Board) -> pa.Table:
        change, size = board.sweeps(n, gram, lam, rho, stop)
        own = int(np.searchsorted(board.hop, 1))
        rows = [(board.tile, board.tile, _numbers(board.b[:own], "<f8"), change, size)]
        for t in np.unique(board.to).tolist():
            rows.append((t, board.tile, _numbers(board.b[board.at[board.to == t]], "<f8"), None, None))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({c.split()[0]: pa.array(x, t) for c, x, t in zip(_MESSAGE.split(", "), zip(*rows, strict=True), kinds, strict=True)})

    def begin(batches):
        for row in _rows(batches):
            yield from moved(_Board(row, k)).to_batches()

    def go_on(key, row, got):
        board = _Board(row.to_pylist()[0], k)
        board.take(got.to_pylist())
        return moved(board)

    if messages is None:
        return cut(boards.mapInArrow(begin, _MESSAGE))
    return cut(boards.groupBy("tile").cogroup(messages.select("target", "source", "values").groupBy("target")).applyInArrow(go_on, _MESSAGE))


def _values(boards: DataFrame, messages: DataFrame | None, k: int) -> DataFrame:
    """spot_id, h, b of all spots."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).ravel()))

    def rows(board: _Board) -> pa.Table:
        own = int(np.searchsorted(board.hop, 1))
        return pa.table({"spot_id": pa.array(board.ids[:own]), "h": lists(board.h[:own]), "b": lists(board.b[:own])})

    def uniform(batches):
        for row in _rows(batches):
            yield from rows(_Board(row, k)).to_batches()

    def read(key, row, got):
        board = _Board(row.to_pylist()[0], k)
        board.take(got.to_pylist())
        return rows(board)

    schema = "spot_id bigint, h array<double>, b array<double>"
    if messages is None:
        return boards.mapInArrow(uniform, schema)
    own = messages.where("target = source").select("target", "source", "values")
    return boards.groupBy("tile").cogroup(own.groupBy("target")).applyInArrow(read, schema)


def solve(h: DataFrame, edges: DataFrame, gram: np.ndarray, lam: float = 0.1, rho: float = 0.01, max_iter: int = 100, tol: float = 1e-4, y2: float = 0.0, every: int = 0, tiles: DataFrame | None = None, depth: int = DEPTH) -> tuple[DataFrame, FitInfo]:
    """spot_id, h, b after sweeps from equal shares; rho is scaled by the mean of the Gram diagonal.

    tiles: spot_id, tile, any; without them spots are dealt by a hash. every: sweeps between
    objectives that are kept. The result is that of single sweeps, whatever tiles and depth are.
    """
    k = gram.shape[0]
    h = cut(h.select(F.col("spot_id").cast("long").alias("spot_id"), "h"))
    n = h.count()
    if not n:
        return h.withColumn("b", F.col("h")), FitInfo(True, 0, 0.0, 0.0)
    edges = cut(edges)
    if tiles is None:
        tiles = h.select("spot_id", F.pmod(F.xxhash64("spot_id"), F.lit(max(1, math.ceil(n / TILE)))).cast("int").alias("tile"))
    tiles = cut(tiles.select(F.col("spot_id").cast("long").alias("spot_id"), F.col("tile").cast("int").alias("tile")))
    alone = tiles.select("tile").distinct().count() == 1
    if alone:
        near, depth = tiles.select("tile", "spot_id", F.lit(0).alias("hop")), max(1, max_iter)
    else:
        near, depth = _surroundings(tiles, edges, n, depth)
    boards = _boards(h, edges, near, tiles, k, depth)
    scaled = rho * float(np.mean(np.diag(gram)))
    messages, converged, change, done, seen = None, False, 0.0, 0, []
    while done < max_iter and not converged:
        go = min(depth, max_iter - done, every - done % every if every else max_iter)
        after = _exchange(boards, messages, go, gram, lam, scaled, tol if alone else None)
        moves = after.where("target = source").select(F.posexplode(F.arrays_zip("change", "size")).alias("t", "x")).groupBy("t").agg(F.max("x.change"), F.max("x.size")).orderBy("t").collect()
        shares = [m / (z + 1e-10) for _, m, z in moves]
        stop = next((t for t, s in enumerate(shares, 1) if s < tol), None)
        if stop is not None and stop < len(shares):
            # It had ended within these sweeps: they are gone again, up to there.
            after = _exchange(boards, messages, stop, gram, lam, scaled, None)
        converged, went = stop is not None, stop or len(shares)
        messages, done, change = after, done + went, shares[went - 1]
        if every and done % every == 0:
            seen.append(objective(_values(boards, messages, k), edges, gram, y2, lam, scaled))
    state = cut(_values(boards, messages, k))
    return state, FitInfo(converged, done, objective(state, edges, gram, y2, lam, scaled), change, tuple(seen))


def proportions(beta: DataFrame) -> DataFrame:
    """spot_id, p: b divided by its sum; equal shares where all are zero."""
    return beta.select("spot_id", normalised(F.col("b")).alias("p"))
