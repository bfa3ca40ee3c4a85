"""Byte-level BPE encoding and decoding with ranks of a public vocabulary.

Every match of the pattern is encoded separately. The distinct matches of a batch
that are not known yet go, by length, into padded numpy matrices of token ids; in
each round every row merges its leftmost pair of the least rank, found in a hash
table of pairs, and rows that have no pair left are taken out.

Defined results: a null text is an empty one, and an empty text has no ids (the
digests are those of an empty string). Repeated rows give repeated rows. Columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import table
from mixspark.llm.text import PIECE, pieces, texts_of

#: Matches that a worker remembers at most; then it starts anew.
REMEMBERED = 300_000
#: Bytes of a match from which it is merged with a heap, as rounds would take too long.
LONG = 2048
_NONE = np.int64(1 << 40)


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = max(self.ranks.values()) + 1
        pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self._hash(pairs)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _hash(self, pairs: dict[int, int]) -> None:
        """An open-addressing table: a key lies at its hash or in the slots after it."""
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            want = left[free]
            _, first = np.unique(slot[want], return_index=True)
            won = want[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], ranks[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + (self.keys[slot[left]] != keys[left])) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or _NONE."""
        keys = left * self.width + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings: rows of near lengths share a padded matrix."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._merge_long(rows[i])
        bucket = np.where(sizes <= 16, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(bucket[(sizes > 0) & (sizes <= LONG)]):
            members = np.flatnonzero((bucket == width) & (sizes <= LONG))
            step = max(1, (1 << 20) // int(width))
            for k in range(0, len(members), step):
                self._merge_matrix(rows, members[k : k + step], sizes, int(width), out)
        return out

    def _merge_matrix(self, rows: list[bytes], members: np.ndarray, sizes: np.ndarray, width: int, out: list) -> None:
        padded = b"".join(rows[i].ljust(width, b"\0") for i in members)
        ids = self.byte[np.frombuffer(padded, np.uint8).reshape(len(members), width)]
        length = sizes[members].copy()
        ids[np.arange(width) >= length[:, None]] = -1
        while True:
            width = ids.shape[1]
            if width > 1:
                left, right = ids[:, :-1], ids[:, 1:]
                rank = np.where(right >= 0, self.rank_of(np.maximum(left, 0).ravel(), np.maximum(right, 0).ravel()).reshape(left.shape), _NONE)
                at = rank.argmin(1)
                best = rank[np.arange(len(at)), at]
                more = best < _NONE
            else:
                more = np.zeros(len(ids), bool)
            for i in np.flatnonzero(~more):
                out[members[i]] = ids[i, : length[i]]
            if not more.any():
                return
            ids, members, length, at, best = ids[more], members[more], length[more] - 1, at[more], best[more]
            ids[np.arange(len(at)), at] = best
            keep = np.ones(ids.shape, bool)
            keep[np.arange(len(at)), at + 1] = False
            ids = ids[keep].reshape(len(at), width - 1)[:, : max(1, int(length.max()))]

    def _merge_long(self, row: bytes) -> np.ndarray:
        """The same ids for one long match: the leftmost least pair from a heap, in n log n."""
        ids = self.byte[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        first = self.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, 0, 0) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r = int(self.rank_of(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r < _NONE:
                    heapq.heappush(heap, (r, i, version[i], version[j]))

        while heap:
            r, i, vi, vj = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or version[i] != vi or version[j] != vj:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            version[i] += 1
            version[j] += 1
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, matches: set[str]) -> None:
        """Encodes what is not known yet; keeps ids as text, their number, and the bytes they decode to."""
        new = [x for x in matches if x not in self.known]
        for x, ids in zip(new, self.merge([x.encode() for x in new]), strict=True):
            one = ids.tolist()
            self.known[x] = " ".join(map(str, one)), len(one), self.decode(one)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text."""
        return [[int(i) for i in line.split()] for line, _, _ in self.digests(texts)]

    def digests(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Of every text: ids in decimal joined by a space, their number, the decoded bytes."""
        found = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*found))
        known = self.known
        for one in found:
            got = [known[x] for x in one]
            yield " ".join([x[0] for x in got]), sum([x[1] for x in got]), b"".join([x[2] for x in got])


@lru_cache(1)
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def byte_bpe(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every row, and with_ids the ids themselves (ids array<int>)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import public_tokenizers

        bpe = _bpe(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                n, ids, back, lists = [], [], [], []
                for line, count, decoded in bpe.digests(texts_of(part.column(text_col))):
                    n.append(count)
                    ids.append(hashlib.sha256(line.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        lists.append([int(x) for x in line.split()])
                columns = [part.column(id_col), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and digests of its ids and of what they decode to."""
    return byte_bpe(table(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
