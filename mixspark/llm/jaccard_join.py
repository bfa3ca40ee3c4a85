"""Exact Jaccard join of sets of word n-grams that uses relations between the sets.

1. Texts with one and the same set are one class; its least id stands for it.
2. Each class is compared with one similar class (the least of those with which it shares a
   minimum hash). Where they link, they are of one cluster, whose least id leads it. A
   set of a cluster is known by its differences from the lead's: the n-grams it lacks and
   those it has beside. The answers of its sets among each other are derived from these:
   - sets of sizes x, y that differ from a lead of n by few n-grams link for certain, if
     100 (lacking) + percent (beside) of both add up to no more than (100 - percent) n;
     how many such partners a set has is read off the counts of these numbers;
   - of the others the overlap is n less what either lacks, plus what both have beside.
   So no set of a cluster searches for another, and none is read again.
3. What is left are links between clusters. Every set posts its prefix: its rarest n-grams,
   by counts over all texts, so many that linked sets must share one. A list of the index is
   made of blocks, one for each cluster; within a list, blocks of one cluster are skipped,
   and so are pairs of blocks whose sizes or positions leave too small an overlap, before
   pairs of entries are looked at. The remaining pairs are compared whole.

similar() returns a row for each document, with its component, its class and the number of its
links; links() the links themselves, between representatives of classes, and who is in a class.

Nothing is capped: any link between different clusters is found, as an n-gram that both
prefixes share puts the pair in one list, and within a cluster every pair is decided.

Defined results: null and empty texts, and those of white space only, have an empty set and
are linked with nothing. Rows of one id are one document, linked with whatever any of its
texts is linked with; if these have several sets, n_links is that of the class with the least
id. Rows with a null id are returned with a null component and count for nobody's links. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import cut, small, table, text_bytes
from mixspark.llm.components import components
from mixspark.llm.text import mix, pieces, split

#: Bytes of text that make up one range of the index, and those that are posted together.
RANGE, POSTED = 16 << 20, 8 << 20
#: Ranges that are posted to at most, as a power of two; beyond it bundles of postings are cut into finer ones.
COARSE = 12
#: Sets of a lead's group that are compared with it in one task; sets of a chunk, whose pairs are decided together.
MEMBERS, CHUNK = 512, 1024
#: N-grams that are put in order by their frequency, the most frequent ones: a bound of what is broadcast.
HEAVY = 200_000
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_sets(texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-grams of all texts, and where each text's begin (and the end)."""
    words = split(texts)
    count = words.per_row()
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(grams)])
    first = np.repeat(np.cumsum(count) - count, grams) + np.arange(at[-1]) - np.repeat(at[:-1], grams)
    size = np.repeat(np.minimum(count, n), grams)
    total = size.astype(np.uint64)
    for k in range(n):
        # The factor depends on the place, so order counts.
        factor = _FACTORS[k % 5] + np.uint64(2 * (k // 5))
        total += np.where(k < size, words.hash[np.minimum(first + k, max(len(words.hash) - 1, 0))], np.uint64(0)) * factor if len(words.hash) else np.uint64(0)
    return sorted_sets(mix(total), at)


def sorted_sets(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted and without repetitions."""
    keys = keys.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            keys[a:b].sort()
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    keep[at[:-1][at[:-1] < len(keys)]] = True
    return keys[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _per_row(ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, np.uint64)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out


_STATS = "id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, token bigint, count bigint"


def _stats(n: int):
    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            for part in pieces(batch, "_text"):
                sets, at = shingle_sets(part.column("_text"), n)
                rows = len(at) - 1
                sums = [_per_row(np.add, mix(sets ^ s), at, 0).view(np.int64) for s in (_SEEDS[0], _SEEDS[1])]
                mins = np.stack([_per_row(np.minimum, mix(sets + s), at, 0).view(np.int64) for s in _SEEDS], 1)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 4), pa.array(mins.ravel())), none, none], _STATS_NAMES)
                waiting.append(sets)
                held += len(sets)
                if held > 6_000_000:
                    yield _frequent(waiting)
                    waiting, held = [], 0
        if waiting:
            yield _frequent(waiting)

    return run


_STATS_NAMES = [x.split()[0] for x in _STATS.split(", ")]


def _frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
    """N-grams that several of these sets have, with how many of them do."""
    keys, c = np.unique(np.concatenate(sets), return_counts=True)
    keys, c = keys[c >= 3], c[c >= 3]
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(keys), pa.list_(pa.int64())), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], _STATS_NAMES)


def _linked(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def _overlap_of_prefix(n, percent: int):
    """How many n-grams of a set of n a linked set must share at least."""
    return -(-percent * n // 100)


class Index:
    """Posting of prefixes, and the pairs of one range of the index."""

    def __init__(self, heavy: np.ndarray, percent: int, bits: int, coarse: int):
        # heavy: hashes from the least to the most frequent. An n-gram's place in the order: frequent ones last.
        self.percent, self.bits = percent, min(bits, coarse)
        self.fine = min(bits - self.bits, 16)
        self.order = np.argsort(heavy)
        self.heavy = heavy[self.order]

    def ordered(self, sets: np.ndarray) -> np.ndarray:
        out = sets >> np.uint64(1)
        if len(self.heavy):
            k = np.minimum(np.searchsorted(self.heavy, sets), len(self.heavy) - 1)
            hit = self.heavy[k] == sets
            out[hit] = np.uint64(1 << 63) + self.order[k[hit]].astype(np.uint64)
        return out

    def post(self, texts, ids: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Tokens, ids, labels, sizes and positions of the prefixes of these texts' sets."""
        sets, at = shingle_sets(texts, n)
        sets, at = sorted_sets(self.ordered(sets), at)
        size = np.diff(at)
        prefix = np.where(size > 0, size - _overlap_of_prefix(size, self.percent) + 1, 0)
        doc = np.repeat(np.arange(len(size)), prefix)
        position = np.arange(len(doc)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        return mix(sets[at[:-1][doc] + position]), ids[doc], labels[doc], size[doc], position

    def rows(self, waiting: list[tuple[np.ndarray, ...]], above: int, bits: int) -> list[tuple]:
        """Rows (range, planes) of postings, cut by `bits` bits of their tokens, below those `above`."""
        token, ids, labels, size, position = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.argsort(token, kind="stable")
        token, ids, labels, size, position = (x[order] for x in (token, ids, labels, size, position))
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - above - bits) if bits else np.zeros(0, np.uint64)
        own = (token << np.uint64(above)) >> np.uint64(above)
        edges = np.concatenate([[0], np.searchsorted(own, edges), [len(token)]])
        low = (token << np.uint64(above + bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
        out = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            p = slice(edges[k], edges[k + 1])
            out.append((k, low[p].tobytes(), _planes(ids[p]), _planes(labels[p] - ids[p]), size[p].astype(np.int32).tobytes(), position[p].astype(np.int32).tobytes()))
        return out

    @staticmethod
    def opened(raw: dict, above: int) -> tuple[np.ndarray, ...]:
        """Postings of rows of one range; what is left of their tokens stands below the first `above` bits."""
        token = np.frombuffer(b"".join(raw["token"]), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(token), 8), np.uint8)
        wide[:, :5] = token
        ids = np.concatenate([_unplanes(x) for x in raw["ids"]])
        labels = ids + np.concatenate([_unplanes(x) for x in raw["labels"]])
        size, position = (np.frombuffer(b"".join(raw[c]), np.int32).astype(np.int64) for c in ("size", "position"))
        return wide.view(">u8").ravel().astype(np.uint64) >> np.uint64(above), ids, labels, size, position

    def pairs(self, token: np.ndarray, ids: np.ndarray, labels: np.ndarray, size: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Distinct pairs of ids of different labels that share a token and may be linked."""
        order = np.lexsort((size, labels, token))
        token, ids, labels, size, position = (x[order] for x in (token, ids, labels, size, position))
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        block = new.copy()
        block[1:] |= labels[1:] != labels[:-1]
        lists = np.cumsum(new) - 1
        several = np.bincount(lists[block], minlength=lists[-1] + 1 if len(lists) else 0) > 1
        use = several[lists] if len(lists) else np.zeros(0, bool)
        ids, labels, size, position, lists, block = (x[use] for x in (ids, labels, size, position, lists, block))
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        starts = np.flatnonzero(block)
        ends = np.append(starts[1:], len(ids))
        of_list = lists[starts]
        least, most, first = size[starts], size[ends - 1], np.minimum.reduceat(position, starts)
        found = []
        # Blocks of a list meet the ones after them.
        last = np.searchsorted(of_list, of_list, "right")
        for i, j in _meet(np.arange(len(starts)) + 1, last):
            ok = self._may(least[i], most[i], first[i], least[j], most[j], first[j])
            i, j = i[ok], j[ok]
            n_i, n_j = ends[i] - starts[i], ends[j] - starts[j]
            for k, entry in _meet(np.zeros(len(i), np.int64), n_i * n_j):
                x, y = starts[i[k]] + entry // n_j[k], starts[j[k]] + entry % n_j[k]
                ok = self._may(size[x], size[x], position[x], size[y], size[y], position[y])
                a, b = ids[x[ok]], ids[y[ok]]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def _may(self, least_x, most_x, at_x, least_y, most_y, at_y) -> np.ndarray:
        """Whether sets of these sizes, with a shared token at these places or later, can be linked."""
        p = self.percent
        sizes = (100 * most_x >= p * least_y) & (100 * most_y >= p * least_x)
        # Overlap needed: p/(100+p) of both sizes; at most: what stands from the shared token on.
        need = -(-p * (np.maximum(least_x, -(-p * least_y // 100)) + np.maximum(least_y, -(-p * least_x // 100))) // (100 + p))
        return sizes & (np.minimum(most_x - at_x, most_y - at_y) >= need)


def _meet(begin: np.ndarray, end: np.ndarray, most: int = 1 << 20):
    """All (k, x) with begin[k] <= x < end[k], about `most` at a time."""
    counts = np.maximum(end - begin, 0)
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        c = counts[at:stop]
        if stop == at + 1 and c[0] > most:
            for lo in range(int(begin[at]), int(end[at]), most):
                x = np.arange(lo, min(lo + most, int(end[at])))
                yield np.full(len(x), at), x
        elif c.sum():
            k = np.repeat(np.arange(at, stop), c)
            yield k, np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c) + begin[k]
        at = stop


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the high bytes are alike, and so compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _bitmap(keys: np.ndarray) -> bytes:
    """Parity of the number of keys on each of so many bits that there are two for a key or more."""
    bits = max(64, 1 << (2 * len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ, the wider bitmap folded: no more than the sets have different members."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bitmaps(percent: int):
    """A set's size and parity bitmap, some thirty times smaller than the set, and a test that rules out nearly all pairs that aren't linked."""

    def few(x: bytes, y: bytes) -> bool:
        nx, ny = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
        need = -(-percent * (nx + ny) // (100 + percent))
        return _differ(np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)) <= nx + ny - 2 * need

    return lambda keys: len(keys).to_bytes(8, "little") + _bitmap(keys), few


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; texts: _id, _text. Bitmaps first bound the difference of each pair from below; whole sets decide the rest."""

    def equal(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if not len(x) or not len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return _linked(len(x), len(y), int((y[at] == x).sum()), percent)

    maybe = _compared(pairs, texts, n, *_bitmaps(percent))
    return _compared(maybe, texts, n, lambda keys: keys.tobytes(), equal).distinct()


def _compared(pairs: DataFrame, texts: DataFrame, n: int, form, test) -> DataFrame:
    """The pairs (a, b) that pass the test of what is formed of their sets."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct())

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                keys, at = shingle_sets(part.column("_text"), n)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([form(keys[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "set"])

    def compare(batches):
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = texts.join(small(ids, ids.count()), "_id").mapInArrow(sets, "id bigint, set binary")
    joined = pairs.join(found.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


_DIFFERENCES = "a bigint, lead bigint, n bigint, lead_n bigint, lacks binary, beside binary"


def _differences(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """For each pair (a, lead): the sizes of both sets, the n-grams of the lead's that a lacks, and those it has beside.

    What belongs to one lead is dealt to many groups, each of which gets the lead's set once.
    """
    pairs = cut(pairs)
    salts = cut(pairs.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("salts")))
    ids = cut(pairs.select(F.col("a").alias("_id")).unionByName(salts.select(F.col("lead").alias("_id"))).distinct())

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                keys, at = shingle_sets(part.column("_text"), n)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "set"])

    def compare(key, members, lead):
        out = []
        whole = [np.frombuffer(x, np.uint64) for x in lead.column("whole").to_pylist()]
        # Rows that repeat an id and its text say the same.
        for a, raw in dict(zip(members.column("a").to_pylist(), members.column("set").to_pylist(), strict=True)).items():
            own, of = np.frombuffer(raw, np.uint64), whole[0]
            out.append((a, key[0].as_py(), len(own), len(of), np.setdiff1d(of, own, True).tobytes(), np.setdiff1d(own, of, True).tobytes()))
        return pa.table({c.split()[0]: pa.array(x, k) for c, x, k in zip(_DIFFERENCES.split(", "), list(zip(*out, strict=True)) or [[]] * 6, [*[pa.int64()] * 4, *[pa.binary()] * 2], strict=True)})

    found = texts.join(small(ids, ids.count()), "_id").mapInArrow(sets, "id bigint, set binary")
    k = salts.count()
    dealt = pairs.join(small(salts, k), "lead").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
    members = dealt.join(found.withColumnRenamed("id", "a"), "a").select("lead", "salt", "a", "set")
    leads = salts.join(found.select(F.col("id").alias("lead"), F.col("set").alias("whole")), "lead").select(F.col("lead").alias("of"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), "whole")
    return members.groupBy("lead", "salt").cogroup(leads.groupBy("of", "part")).applyInArrow(compare, _DIFFERENCES)


def _far(percent: int):
    """How far a set is from its lead: of two that add up to no more than (100 - percent) * lead_n the sets link."""
    return 100 * F.octet_length("lacks") / 8 + percent * F.octet_length("beside") / 8


_PLAN = "lead bigint, far bigint, certain bigint, chunk int, parts int"


def _within(members: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """What is derived of the sets of one lead (members: a, lead, n, lead_n, lacks, beside, copies).

    a, links: how many rows a set's own links within its cluster are, in parts to be added; with
    `every` the pairs (a, b) that link instead, and no such numbers.
    """
    members = cut(members.withColumn("far", _far(percent).cast("long")))
    counts = cut(members.groupBy("lead", "lead_n", "far").agg(F.count("*").alias("sets"), F.sum("copies").alias("rows")))

    def chunks(t):
        t = t.sort_by("far")
        far, sets, rows = (t.column(c).to_numpy() for c in ("far", "sets", "rows"))
        bound = (100 - percent) * int(t.column("lead_n")[0].as_py())
        total = np.concatenate([[0], np.cumsum(rows)])
        certain = total[np.searchsorted(far, bound - far, "right")]
        # Small groups of sets that are equally far share a chunk, large ones are cut.
        parts = -(-sets // CHUNK)
        chunk, now, held = np.zeros(len(sets), np.int64), 0, 0
        for k, (c, p) in enumerate(zip(sets.tolist(), parts.tolist(), strict=True)):
            if held and held + c > CHUNK:
                now, held = now + 1, 0
            chunk[k], held = now, held + c
            if p > 1:
                now, held = now + p, 0
        return far, chunk, parts, certain, bound

    def plan(key, t):
        far, chunk, parts, certain, _ = chunks(t)
        lead = pa.array(np.full(len(far), key[0].as_py()))
        return pa.table({"lead": lead, "far": pa.array(far), "certain": pa.array(certain), "chunk": pa.array(chunk, pa.int32()), "parts": pa.array(parts, pa.int32())})

    def meetings(key, t):
        far, chunk, parts, _, bound = chunks(t)
        # The farthest of every chunk; chunks ascend.
        most = np.repeat(far, parts)
        number = np.repeat(chunk, parts) + np.arange(len(most)) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.append(number[1:] != number[:-1], True)
        most, number = most[last], number[last]
        first = np.maximum(np.searchsorted(most, bound - most, "right"), np.arange(len(most))) if not every else np.arange(len(most))
        x = np.repeat(np.arange(len(most)), len(most) - first)
        y = np.arange(len(x)) - np.repeat(np.cumsum(len(most) - first) - (len(most) - first), len(most) - first) + np.repeat(first, len(most) - first)
        return pa.table({"lead": pa.array(np.full(len(x), key[0].as_py())), "x": pa.array(number[x], pa.int32()), "y": pa.array(number[y], pa.int32())})

    planned = cut(counts.groupBy("lead").applyInArrow(plan, _PLAN))
    meet = cut(counts.groupBy("lead").applyInArrow(meetings, "lead bigint, x int, y int"))
    dealt = members.join(small(planned, planned.count()), ["lead", "far"]).withColumn("chunk", (F.col("chunk") + F.pmod(F.xxhash64("a"), "parts")).cast("int"))
    bound = F.lit(100 - percent) * F.col("lead_n")
    # What is certain counts the set itself where it is near enough.
    certain = dealt.select("a", (F.col("certain") - F.when(2 * F.col("far") <= bound, F.col("copies")).otherwise(0)).alias("links"))
    m = meet.count()
    sides = [dealt.join(small(meet.withColumnRenamed(c, "chunk"), m), ["lead", "chunk"]).select("lead", *[F.col("chunk").alias(c) if c == z else F.col(z) for z in "xy"], F.lit(k).alias("side"), "a", "n", "lead_n", "lacks", "beside", "copies", "far") for k, c in enumerate("xy")]
    together = sides[0].unionByName(sides[1].where("x <> y"))

    def exact(key, t):
        side = t.column("side").to_numpy()
        left = t.filter(pa.array(side == 0)).sort_by("a")
        right = left if key[1].as_py() == key[2].as_py() else t.filter(pa.array(side == 1)).sort_by("a")
        whole = int(t.column("lead_n")[0].as_py())
        number = [[s.column(c).to_numpy() for s in (left, right)] for c in ("a", "n", "copies", "far")]
        (a, b), (na, nb), (ca, cb), (fa, fb) = number
        both = _common(left.column("lacks").to_pylist(), right.column("lacks").to_pylist())
        lacking = np.array([len(x) // 8 for x in left.column("lacks").to_pylist()])[:, None] + np.array([len(x) // 8 for x in right.column("lacks").to_pylist()])[None]
        overlap = whole - (lacking - both) + _common(left.column("beside").to_pylist(), right.column("beside").to_pylist())
        linked = 100 * overlap >= percent * (na[:, None] + nb[None] - overlap)
        if left is right:
            np.fill_diagonal(linked, False)
        if every:
            i, j = np.nonzero(np.triu(linked) if left is right else linked)
            return pa.table({"a": pa.array(np.minimum(a[i], b[j])), "b": pa.array(np.maximum(a[i], b[j]))})
        linked &= fa[:, None] + fb[None] > (100 - percent) * whole
        out = [(a, linked @ cb)] + ([] if left is right else [(b, ca @ linked)])
        return pa.table({"a": pa.array(np.concatenate([x for x, _ in out])), "b": pa.array(np.concatenate([y for _, y in out]).astype(np.int64))})

    found = together.groupBy("lead", "x", "y").applyInArrow(exact, "a bigint, b bigint")
    if every:
        return found, None
    return None, certain.unionByName(found.withColumnRenamed("b", "links"))


def _common(x: list[bytes], y: list[bytes], most: int = 2048) -> np.ndarray:
    """How many numbers each set of x has in common with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    keys = [np.frombuffer(b"".join(z), np.uint64) for z in (x, y)]
    rows = [np.repeat(np.arange(len(z)), [len(v) // 8 for v in z]) for z in (x, y)]
    shared = np.intersect1d(np.unique(keys[0]), np.unique(keys[1]), True)
    at = [np.searchsorted(shared, k) for k in keys]
    hit = [np.flatnonzero((p < len(shared)) & (shared[np.minimum(p, max(len(shared) - 1, 0))] == k)) if len(shared) else np.zeros(0, np.int64) for p, k in zip(at, keys, strict=True)]
    for low in range(0, len(shared), most):
        width = min(most, len(shared) - low)
        marks = []
        for r, p, h, z in zip(rows, at, hit, (x, y), strict=True):
            use = h[(p[h] >= low) & (p[h] < low + width)]
            mark = np.zeros((len(z), width), np.float32)
            mark[r[use], p[use] - low] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out.astype(np.int64)


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, range_bytes: int, coarse: int):
    """texts, their sizes and sums, sets (a row for each class), shared (copies and their class's least id), an index."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bits = max(0, math.ceil(math.log2(max(1, text_bytes(docs, text_col) / range_bytes))))
    stats = cut(texts.mapInArrow(_stats(n), _STATS))
    rows = stats.where("token IS NULL")
    top = stats.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c")).where("c >= 6").orderBy(F.desc("c"), "token").limit(HEAVY).collect()
    heavy = np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)
    of_set = ["s1", "s2", "n"]
    sets = rows.where("n > 0 AND id IS NOT NULL").groupBy(*of_set).agg(F.min("id").alias("rep"), F.min("keys").alias("keys"), F.count("*").alias("copies"))
    sets = cut(sets)
    # Rows of one id with several texts have several classes: these count as linked.
    shared = rows.where("n > 0 AND id IS NOT NULL").join(sets.where("copies > 1").select(*of_set, "rep"), of_set).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    return texts, rows, sets, cut(shared), docs.sparkSession.sparkContext.broadcast(Index(heavy, percent, bits, coarse))


_ROWS = ["range", "token", "ids", "labels", "size", "position"]
_ROW_KINDS = [pa.int32(), *[pa.binary()] * 5]


def _met(posting: DataFrame, index, n: int) -> DataFrame:
    """Distinct pairs (a, b) of ids of different labels that may be linked; posting: _id, _text, _label."""
    first, second = index.value.bits, index.value.fine

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ROW_KINDS, strict=True)], _ROWS)

    def post(batches):
        waiting, held = [], 0
        for batch in batches:
            for part in pieces(batch, "_text"):
                waiting.append(index.value.post(part.column("_text"), part.column("_id").to_numpy(), part.column("_label").to_numpy(), n))
                held += part.column("_text").nbytes
                if held >= POSTED:
                    if any(len(x[0]) for x in waiting):
                        yield batch_of(index.value.rows(waiting, 0, first))
                    waiting, held = [], 0
        if any(len(x[0]) for x in waiting):
            yield batch_of(index.value.rows(waiting, 0, first))

    def refine(key, t):
        opened = index.value.opened({c: t.column(c).to_pylist() for c in _ROWS[1:]}, first)
        rows = batch_of(index.value.rows([opened], first, second))
        return pa.Table.from_batches([rows]).rename_columns(["fine", *_ROWS[1:]]).append_column("range", pa.array([key[0].as_py()] * len(rows), pa.int32()))

    def meet(key, t):
        found = index.value.pairs(*index.value.opened({c: t.column(c).to_pylist() for c in _ROWS[1:]}, first + second))
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    posted = posting.mapInArrow(post, "range int, token binary, ids binary, labels binary, size binary, position binary")
    by = ["range"]
    if second:
        # What a bundle has in a coarse range goes on to the fine ranges in fewer, longer rows.
        bundles = posted.withColumn("bundle", F.pmod(F.xxhash64("token"), F.lit(1 << second)))
        posted = bundles.groupBy("range", "bundle").applyInArrow(refine, "fine int, token binary, ids binary, labels binary, size binary, position binary, range int")
        by = ["range", "fine"]
    return posted.groupBy(*by).applyInArrow(meet, "a bigint, b bigint").where("a <> b").distinct()


def _clusters(texts: DataFrame, sets: DataFrame, shared: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """labels (id, component) of the classes that are in clusters, and members: these with their differences from their lead."""
    # A class whose least id has other texts too can't be told by it: it is in no cluster.
    several = cut(sets.groupBy("rep").count().where("count > 1").select("rep").unionByName(shared.select(F.col("a").alias("rep"))))
    alone = sets.join(small(several, several.count()), "rep", "left_anti")
    minima = alone.select("rep", "n", F.posexplode("keys").alias("k", "key"))
    lead = minima.groupBy("k", "key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    near = minima.join(lead, ["k", "key"]).where("rep <> lead.rep AND 100 * n >= {p} * lead.n AND 100 * lead.n >= {p} * n".format(p=percent))
    near = near.groupBy(F.col("rep").alias("a")).agg(F.min("lead.rep").alias("b"))
    maybe = _compared(near, texts, n, *_bitmaps(percent))
    first = cut(_differences(maybe.select("a", F.col("b").alias("lead")).distinct(), texts, n))
    overlap = F.col("lead_n") - F.octet_length("lacks") / 8
    linked = first.where(100 * overlap >= percent * (F.col("n") + F.col("lead_n") - overlap))
    labels = cut(components(linked.select("a", F.col("lead").alias("b"))))
    k = labels.count()
    # Those that were compared with their cluster's lead already, and the others.
    own = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("lead"))
    known = cut(linked.join(small(own, k), ["a", "lead"], "left_semi"))
    others = cut(own.join(small(known.select("a"), k), "a", "left_anti"))
    if not others.isEmpty():
        known = known.unionByName(_differences(others, texts, n))
    leads = known.groupBy("lead").agg(F.min("lead_n").alias("n"))
    none = F.lit(b"")
    members = known.unionByName(leads.select(F.col("lead").alias("a"), "lead", "n", F.col("n").alias("lead_n"), none.alias("lacks"), none.alias("beside")))
    copies = cut(sets.select(F.col("rep").alias("a"), "copies").join(small(labels.select(F.col("id").alias("a")), k), "a", "left_semi"))
    return labels, members.join(small(copies, k), "a")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, range_bytes: int = RANGE, coarse: int = COARSE) -> DataFrame:
    """a, b, same: every link (a < b) between representatives of classes; where same, b is the class's least id and a another id in it.

    A document is linked with its class and with all members of the classes that its own links
    to. The rows grow with the square of a group of different near copies, as the links do.
    """
    texts, _, sets, shared, index = _classes(docs, id_col, text_col, n, percent, range_bytes, coarse)
    labels, members = _clusters(texts, sets, shared, n, percent)
    inside, _ = _within(members, percent, True)
    stands = sets.select(F.col("rep").alias("_id")).distinct().join(labels.select(F.col("id").alias("_id"), F.col("component").alias("_label")), "_id", "left")
    posting = texts.where("_id IS NOT NULL").join(stands, "_id").select("_id", "_text", F.coalesce("_label", "_id").alias("_label"))
    across = verified(_met(posting, index, n), texts, n, percent)
    kind = docs.schema[id_col].dataType
    every = inside.unionByName(across.select("a", "b")).select("a", "b", F.lit(False).alias("same")).unionByName(shared.select("a", "b", F.lit(True).alias("same")))
    return every.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "same")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, range_bytes: int = RANGE, coarse: int = COARSE, counted: bool = True) -> DataFrame:
    """id_col, n_shingles, component_id, class_id (least id with the same set) and, where counted, n_links (rows it is linked with) of every row."""
    # 1. Classes of equal sets.
    texts, rows, sets, shared, index = _classes(docs, id_col, text_col, n, percent, range_bytes, coarse)

    # 2. Clusters of similar classes, and what is derived of their links.
    labels, members = _clusters(texts, sets, shared, n, percent)

    # 3. Links between clusters. Copies of a class don't post; the others post under their cluster's label.
    copies = shared.select(F.col("a").alias("_id"), F.lit(None).cast("long").alias("_label"), F.lit(True).alias("_copy"))
    known = cut(copies.unionByName(labels.select(F.col("id").alias("_id"), F.col("component").alias("_label"), F.lit(False).alias("_copy"))).groupBy("_id").agg(F.max("_label").alias("_label"), F.max("_copy").alias("_copy")))
    # An id that is a copy and also stands for a class (it has several texts) still posts.
    stands = sets.select(F.col("rep").alias("_id")).join(shared.select(F.col("a").alias("_id")), "_id", "left_semi")
    known = known.join(stands.withColumn("_stands", F.lit(True)), "_id", "left").withColumn("_copy", F.col("_copy") & F.col("_stands").isNull()).drop("_stands")
    posting = texts.where("_id IS NOT NULL").join(small(known, known.count()), "_id", "left").where("NOT coalesce(_copy, false)").select("_id", "_text", F.coalesce("_label", "_id").alias("_label"))
    found = cut(verified(_met(posting, index, n), texts, n, percent))
    label = labels.select("id", "component")
    ends = found
    for c in ("a", "b"):
        ends = ends.join(label.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")

    # Every id's class, its cluster, and what links of clusters and shared ids join that to.
    # Ids with several texts: they stand for a class as well, or are copies of more than one.
    more = shared.groupBy(F.col("a").alias("_id")).count().where("count > 1").select("_id").unionByName(stands)
    several = shared.join(more, shared.a == more._id, "left_semi")
    for c in ("a", "b"):
        several = several.join(label.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    joined = components(ends.select("a", "b").unionByName(several.select("a", "b")))
    final = known_component(shared, label, joined)

    out = rows.select("id", "n").join(small(final, final.count()), "id", "left").withColumn("_class", F.coalesce("class", "id"))
    kind = docs.schema[id_col].dataType
    columns = [F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"), F.col("_class").cast(kind).alias("class_id")]
    if not counted:
        return out.select(*columns)

    # Links of a class: its other rows, its cluster's, and the rows of the classes it was found to link with.
    _, inside = _within(members, percent, False)
    size = sets.groupBy(F.col("rep").alias("a")).agg(F.sum("copies").alias("copies"))
    partners = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(size.withColumnRenamed("a", "b"), "b")
    own = size.where("copies > 1").select("a", (F.col("copies") - 1).alias("links"))
    total = own.unionByName(inside).unionByName(partners.select("a", F.col("copies").alias("links"))).groupBy(F.col("a").alias("_class")).agg(F.sum("links").alias("_links")).where("_links > 0")
    total = cut(total)
    out = out.join(small(total, total.count()), "_class", "left")
    links_of = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("_links", F.lit(0))).otherwise(0).cast("long")
    return out.select(*columns, links_of.alias("n_links"))


def known_component(shared: DataFrame, label: DataFrame, joined: DataFrame) -> DataFrame:
    """id, class, component of the ids that aren't alone."""
    ids = shared.select(F.col("a").alias("id"), F.col("b").alias("class"))
    ids = ids.unionByName(shared.select(F.col("b").alias("id"), F.col("b").alias("class")))
    ids = ids.unionByName(label.select("id", F.col("id").alias("class"))).unionByName(joined.select("id", F.col("id").alias("class")))
    ids = ids.groupBy("id").agg(F.min("class").alias("class"))
    step = ids.join(label.select(F.col("id").alias("class"), F.col("component").alias("_l")), "class", "left").withColumn("_l", F.coalesce("_l", "class"))
    step = step.join(joined.select(F.col("id").alias("_l"), F.col("component").alias("_j")), "_l", "left")
    return cut(step.select("id", "class", F.coalesce("_j", "_l").alias("component")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-word shingles, the least id it is connected to by links of 0.75 or more, and how many links it has."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of 0.75 or more between different sets of 5-word shingles, and which documents have one and the same set."""
    return links(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)
), c(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id
), m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.r AS component_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
}
QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard, "op3_jaccard_links": op3_jaccard_links}
