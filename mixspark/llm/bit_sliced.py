"""Exact top-k search by inner product with a bit-sliced index.

Every component is quantised to floor(64 x). Rows are dealt into blocks; of each
component of a block, less its least value there, every binary digit is a bitmap over
the block's rows. A query adds the bitmaps its own digits select (complements for
negative weights), column by column of equal significance, with carry-save adders;
what results are the bitmaps of the score's digits. From the most significant one
downward rows are kept or put off until k are left, and rows that tie at the boundary
are resolved by their ids. The best k of all blocks are a query's answer.

Blocks and large chunks of queries meet in tiles; both travel as small integers, and a
block's bitmaps are built once for a tile. A query takes along a score that k rows of
a bounded sample reach: a block whose extremes can't give as much is passed over, and rows
below it aren't returned.

Defined results: vectors that are null or have a null or non-finite component, and rows
with a null id, take no part. Rows of one id are one vector (the one least in array
order). Queries meet vectors of their own length only. Empty vectors take no part.
Components so large that a score might not fit into 63 bits are an error. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixspark.llm.common import table

#: Rows of a block and queries of a chunk, about, and rows of the sample that gives scores to reach.
BLOCK, CHUNK, SAMPLE = 8192, 16_384, 1024


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


class Slices:
    """Bitmaps of a block's digits, and their complements."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, len(values)
        self.least = values.min(0)
        shifted = (values - self.least).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        words = -(-self.n // 64)
        self.all = self._pack(np.ones((1, self.n), bool), words)[0]
        maps = np.stack([self._pack(((shifted >> np.uint64(b)) & np.uint64(1)).astype(bool).T, words) for b in range(self.bits)], 1)
        self.maps = np.stack([maps, maps ^ self.all])  # sign, component, digit, word

    @staticmethod
    def _pack(rows: np.ndarray, words: int) -> np.ndarray:
        packed = np.packbits(rows, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, words * 8 - packed.shape[1])))).view(np.uint64)

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """What no row's score exceeds, for each query: from the extremes of every component."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.values.max(0) + down @ self.least

    def digits(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the digits of every row's score, up to a constant, least significant first."""
        size, negative = np.abs(query).astype(np.uint64), (query < 0).astype(np.int64)
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length()):
            which = np.flatnonzero((size >> np.uint64(j)) & np.uint64(1))
            for b in range(self.bits):
                if len(which):
                    columns.setdefault(b + j, []).append(self.maps[negative[which], which, b])
        out, s = [], 0
        while columns:
            x = np.concatenate(columns.pop(s)) if s in columns else np.zeros((1, len(self.all)), np.uint64)
            while len(x) > 1:
                t = len(x) // 3
                if t:
                    a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    carry, x = (a & b) | (ab & c), np.concatenate([ab ^ c, x[3 * t :]])
                else:
                    carry, x = (x[:1] & x[1:]), x[:1] ^ x[1:]
                columns.setdefault(s + 1, []).append(carry)
            out.append(x[0])
            s += 1
        return out

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best but the row with the id `own`; ties to smaller ids (ids ascend)."""
        maybe = self.all.copy()
        at = int(np.searchsorted(ids, own))
        if at < self.n and ids[at] == own:
            maybe[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure, n_sure = np.zeros_like(maybe), 0
        for digit in reversed(self.digits(query)):
            one = maybe & digit
            n = int(np.bitwise_count(one).sum())
            if n_sure + n > k:
                maybe = one
            else:
                sure, n_sure, maybe = sure | one, n_sure + n, maybe & ~digit
                if n_sure == k:
                    break
        rows = self._rows(sure)
        if n_sure < k:  # the boundary: all of these have one score
            rows = np.concatenate([rows, self._rows(maybe)[: k - n_sure]])
        return rows, self.values[rows] @ query

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v (floor(64 x) of each component) of the vectors that take part, one for each id."""
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(v).alias("_v"))
    return rows.select("_id", F.transform("_v", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("_v"))


def _small(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as all of them need, behind that number."""
    kind = np.result_type(np.min_scalar_type(values.min(initial=0)), np.min_scalar_type(-1 - values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(f"<i{kind.itemsize}").tobytes()


def _wide(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(-1, dim)


def _reached(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k others of the sample reach; the least of all where there are fewer."""
    least = np.full(len(queries), np.iinfo(np.int64).min)
    if len(ids) <= k:
        return least
    for at in range(0, len(queries), 1024):
        score = queries[at : at + 1024] @ sample.T
        score[own[at : at + 1024, None] == ids[None]] = np.iinfo(np.int64).min
        least[at : at + 1024] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
    return least


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of every query, a row for which is_query holds."""
    rows = quantised(vectors, id_col, vector_col)
    queries = quantised(vectors.where(is_query), id_col, vector_col)
    n, most, size = rows.agg(F.count("*"), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double"))))), F.max(F.size("_v"))).first()
    if n and float(most) ** 2 * size >= 2.0**62:
        raise ValueError("scores of such large components may not fit into 63 bits")
    blocks, chunks = max(1, math.ceil(n / block)), max(1, math.ceil(queries.count() / chunk))
    some = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()
    samples = {d: (np.array([r._v for r in some if len(r._v) == d], np.int64), np.array([r._id for r in some if len(r._v) == d], np.int64)) for d in {len(r._v) for r in some}}

    def grouped(df: DataFrame, name: str, parts: int, seed: int, asks: bool) -> DataFrame:
        def run(key, t):
            t, dim = t.sort_by("_id"), key[0].as_py()
            values, ids = np.array(t.column("_v").combine_chunks().flatten(), np.int64).reshape(-1, dim), t.column("_id").to_numpy().astype(np.int64)
            out = {"dim": pa.array([dim], pa.int32()), name: pa.array([key[1].as_py()], pa.int32()), f"{name}_ids": [ids.tobytes()], f"{name}_values": [_small(values)]}
            if asks:
                sample, known = samples.get(dim, (np.zeros((0, dim), np.int64), np.zeros(0, np.int64)))
                out["reach"] = [_reached(values, ids, sample, known, k).tobytes()]
            return pa.table(out)

        dealt = df.select(F.size("_v").alias("dim"), F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(parts)).cast("int").alias(name), "_id", "_v")
        return dealt.groupBy("dim", name).applyInArrow(run, f"dim int, {name} int, {name}_ids binary, {name}_values binary" + ", reach binary" * asks)

    left = grouped(rows, "b", blocks, 1, False).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = grouped(queries, "c", chunks, 2, True).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = left.join(right.hint("shuffle_merge"), ["dim", "b", "c"])

    def search(batches):
        last, slices, ids = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if (dim, r["b"]) != last:
                    last = dim, r["b"]
                    slices, ids = Slices(_wide(r["b_values"], dim)), np.frombuffer(r["b_ids"], np.int64)
                asking, own, reach = _wide(r["c_values"], dim), np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["reach"], np.int64)
                out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for q in np.flatnonzero(slices.bound(asking) >= reach).tolist():
                    found, score = slices.top(asking[q], k, ids, own[q])
                    use = score >= reach[q]
                    out[0].append(np.full(use.sum(), own[q]))
                    out[1].append(ids[found[use]])
                    out[2].append(score[use])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = tiles.sortWithinPartitions("dim", "b", "c").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest quantised inner products of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = {
    "op4_bit_sliced": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
QUERIES = {"op4_bit_sliced": op4_bit_sliced}
