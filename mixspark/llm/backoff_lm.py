"""Language-model scoring with a weighted backoff automaton of words.

Counts of all n-grams of 1 to `order` words in the training texts are smoothed into a
weighted automaton. Its states are the histories of up to order - 1 words that training
saw; the root is the empty one. In the state h, a word w that training saw behind h has
an arc of the weight log10 p(w | h), where p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k)
and h' is h without its first word; the arc leads to the longest history that ends in
w. For other words the state has a failure arc to h', of the weight log10(k / (c(h) + k)).
The root has an arc for every word, p(w) = (c(w) + 1) / (N + V + 1). A text is read once from
left to right, from the state of a text's start through an end token, and carries its
state along: where a word has no arc, failure arcs are followed until there is one.

The automaton grows with the corpus and is never gathered in one place. Documents are dealt
to blocks of some megabytes by their places, not their ids, so that rows of one id or
none are spread. A block sends its distinct n-grams, as sorted hashes cut into ranges, with
their training counts; each range is summed over all blocks, and every block gets the totals
of what it asked for: the part of the automaton that its texts can reach. Beyond 4,096 ranges
bundles of blocks stand between: they sum what their blocks have in a coarse range, and
ask for it in fine ranges; so neither a frequent word's list nor the number of messages grows
with the square of the corpus.

Words are told apart by 64-bit hashes, longer n-grams by 42 bits and those of their range.

Defined results: a null text is an empty one: only the end token. Repeated rows count and
are scored as often as they occur. Without training texts every p is 1 and every score 0.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import held_out, table, text_bytes
from mixspark.llm.text import chain, pieces, split

#: Hashes that stand for the end token, and for what stands before a text's first word.
_END, _START = np.uint64(0x5EED0F7E57E4D001), np.uint64(0x5EED0F7E57E4D002)
ORDER = 3
#: k: how many observations the shorter history's probabilities are worth in a state.
PRIOR = 4.0
#: Bytes of text for a block and for a range.
BLOCK, RANGE = 6 << 20, 12 << 20
#: Ranges that a block sends to at most, as a power of two; beyond it bundles of some megabytes ask in finer ones.
COARSE = 12
BUNDLE = 16 << 20
#: Bits of a longer n-gram's hash that are sent, beside those of its range.
LOW = 42
#: Tokens that a lane reads; all lanes of a block are read at once.
LANE = 256


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token; each text ends with the end token."""
    words = split(texts)
    ends = np.cumsum(words.per_row())
    return np.insert(words.hash, ends, _END), np.insert(words.row, ends, np.arange(words.rows))


class Block:
    """Tokens of a block's texts and their distinct n-grams of each order.

    grams[m - 1]: sorted hashes of the distinct m-grams; at[m - 1]: for each token the number
    of the m-gram that it ends, -1 where its text hasn't begun so far before.
    """

    def __init__(self, rows: pa.Table, order: int):
        tokens, row, train, base = [], [], [], 0
        for part in pieces(rows, "_text"):
            t, r = _tokens(part.column("_text"))
            tokens.append(t)
            row.append(r + base)
            train.append(np.array(part.column("_train"), bool)[r])
            base += len(part)
        self.rows, self.row, self.train = base, np.concatenate(row), np.concatenate(train)
        hashes = np.concatenate(tokens)
        first = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
        self.offset = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
        self.grams, self.at, longer = [], [], hashes
        for m in range(1, order + 1):
            if m > 1:
                before = np.roll(longer, 1)
                before[first] = _START
                longer = chain(before, hashes)
            has = np.flatnonzero(self.offset >= m - 2)
            distinct, back = np.unique(longer[has], return_inverse=True)
            at = np.full(len(hashes), -1)
            at[has] = back
            self.grams.append(distinct)
            self.at.append(at)

    def counts(self) -> list[np.ndarray]:
        """How often the training texts of the block have each n-gram."""
        return [np.bincount(at[self.train & (at >= 0)], minlength=len(g)) for at, g in zip(self.at, self.grams, strict=True)]


def _pack_counts(c: np.ndarray) -> bytes:
    """A byte for each count; those that need more follow. Compressed, as most are alike."""
    return zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<u8").tobytes(), 1)


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    c = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(raw, "<u8", offset=n)
    return c


def _pack_steps(parts: list[np.ndarray]) -> bytes:
    """Sorted numbers as their differences, of four or six bytes each; those that need more follow."""
    steps = np.concatenate([np.diff(x, prepend=np.uint64(0)) for x in parts]) if parts else np.zeros(0, np.uint64)
    width = 4 if 8 * int((steps >= 0xFFFFFFFF).sum()) <= 2 * len(steps) else 6
    most = np.uint64((1 << 8 * width) - 1)
    short = np.minimum(steps, most).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + short.tobytes() + steps[steps >= most].astype("<u8").tobytes()


def _unpack_steps(raw: bytes, sizes: list[int]) -> list[np.ndarray]:
    n, width = sum(sizes), raw[0]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(n, width)
    steps = wide.view("<u8").ravel().astype(np.uint64)
    steps[steps == (1 << 8 * width) - 1] = np.frombuffer(raw[1 + n * width :], "<u8")
    total, ends = np.cumsum(steps), np.cumsum(sizes)
    # What stood before a part is taken off; the sums may wrap, their differences don't.
    return [total[e - k : e] - (total[e - k - 1] if e > k else np.uint64(0)) for k, e in zip(sizes, ends.tolist(), strict=True)]


_CELL = "sizes array<int>, words binary, longer binary, counts binary"
_CELL_KINDS = {"sizes": pa.list_(pa.int32()), "words": pa.binary(), "longer": pa.binary(), "counts": pa.binary()}


def _cell(keys: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """Keys and counts of each order, to be sent: words as they are, the others by their differences."""
    return {"sizes": [len(k) for k in keys], "words": keys[0].tobytes(), "longer": _pack_steps(keys[1:]), "counts": _pack_counts(np.concatenate(counts))}


def _opened(r: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sizes = r["sizes"]
    keys = [np.frombuffer(r["words"], np.uint64), *_unpack_steps(r["longer"], sizes[1:])]
    return keys, _split(_unpack_counts(r["counts"], sum(sizes)), sizes)


def _split(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def _table(rows: list[dict], kinds: dict) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], k) for n, k in kinds.items()})


def _edges(keys: np.ndarray, bits: int, of: int) -> np.ndarray:
    """Where each range of the sorted numbers of `of` bits begins by their first bits, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(of - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _low(keys: np.ndarray, first: int, second: int) -> np.ndarray:
    """LOW bits of each key below those of its fine range, and these."""
    return (keys << np.uint64(first)) >> np.uint64(64 - LOW - second)


def _ask(b: Block, block: int, bits: int, second: int, bundles: int) -> list[dict]:
    """A row for each range: what the block has and asks for in it."""
    edges, counts = [_edges(g, bits, 64) for g in b.grams], b.counts()
    out = []
    for k in range(1 << bits):
        own = [slice(e[k], e[k + 1]) for e in edges]
        keys = [g[s] if m == 0 else _low(g[s], bits, second) for m, (g, s) in enumerate(zip(b.grams, own, strict=True))]
        out.append({"range": k, "bundle": block % bundles, "block": block} | _cell(keys, [c[s] for c, s in zip(counts, own, strict=True)]))
    return out


_ASK_KINDS = {"range": pa.int32(), "bundle": pa.int32(), "block": pa.int64()} | _CELL_KINDS
_ASK = f"range int, bundle int, block bigint, {_CELL}"


def _summed(opened: list, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of all opened cells, and their total counts."""
    keys, totals = [], []
    for m in range(order):
        distinct, back = np.unique(np.concatenate([k[m] for k, _ in opened]), return_inverse=True)
        keys.append(distinct)
        totals.append(np.bincount(back, np.concatenate([c[m] for _, c in opened]), len(distinct)).astype(np.int64))
    return keys, totals


_ANSWER_KINDS = {"range": pa.int32(), "bundle": pa.int32(), "block": pa.int64(), "fine": pa.int32(), "totals": pa.binary(), "n": pa.int64(), "v": pa.int64()}
_ANSWER = "range int, bundle int, block bigint, fine int, totals binary, n bigint, v bigint"


def _answers(rows: list[dict], order: int, opened: list, keys: list, totals: list, n: int, v: int) -> pa.Table:
    """To each row the totals of what it asked for; n: training tokens of the range, v: how many distinct ones."""
    out = []
    for r, (own, _) in zip(rows, opened, strict=True):
        found = [totals[m][np.searchsorted(keys[m], own[m])] for m in range(order)]
        out.append({"range": r["range"], "bundle": r["bundle"], "block": r["block"], "fine": r.get("fine", 0), "totals": _pack_counts(np.concatenate(found)), "n": n, "v": v})
    return _table(out, _ANSWER_KINDS)


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach.

    totals: training counts of the block's n-grams of each order. State 0 is the root; arcs are
    sorted by state and word.
    """

    def __init__(self, b: Block, totals: list[np.ndarray], tokens: int, kinds: int, prior: float):
        order, self.words = len(totals), len(totals[0])
        end = int(np.searchsorted(b.grams[0], _END))
        self.root = np.log10((totals[0] + 1.0) / (tokens + kinds + 1.0))
        # Number of the state of each n-gram that is a history, and the root's for the others.
        state, states = [], 1
        for c in totals[: order - 1]:
            seen = c > 0
            state.append(np.where(seen, states + np.cumsum(seen) - 1, 0))
            states += int(seen.sum())
        texts = totals[0][end] if order > 1 else 0
        self.start = states if texts else 0
        self.fail, self.fail_weight = np.zeros(states + 1, np.int64), np.zeros(states + 1)
        self.fail_weight[self.start] = np.log10(prior / (texts + prior)) if texts else 0.0
        self.to_word = state[0] if order > 1 else np.zeros(self.words, np.int64)
        keys, weight, to, shorter = [], [], [], (totals[0] + 1.0) / (tokens + kinds + 1.0)
        for m in range(2, order + 1):
            # Of each m-gram: a token that ends it, the numbers of what it begins and ends with.
            where = np.zeros(len(totals[m - 1]), np.int64)
            has = np.flatnonzero(b.at[m - 1] >= 0)
            where[b.at[m - 1][has]] = has
            opening = b.offset[where] == 0  # what stands before is a text's start
            suffix, prefix, c = b.at[m - 2][where], b.at[m - 2][where - 1], totals[m - 1]
            history = np.where(opening, texts, totals[m - 2][prefix])
            p = np.where(history > 0, (c + prior * shorter[suffix]) / (history + prior), shorter[suffix])
            of = np.where(opening, self.start, state[m - 2][prefix])
            seen = c > 0
            keys.append((of * self.words + b.at[0][where])[seen])
            weight.append(np.log10(p[seen]))
            to.append((state[m - 1] if m < order else state[m - 2][suffix])[seen])
            if m < order:
                self.fail[state[m - 1][seen]] = state[m - 2][suffix[seen]]
                self.fail_weight[state[m - 1][seen]] = np.log10(prior / (c[seen] + prior))
            shorter = p
        if order > 1:
            seen = totals[0] > 0
            self.fail_weight[state[0][seen]] = np.log10(prior / (totals[0][seen] + prior))
        keys, weight, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, weight, to))
        by = np.argsort(keys)
        self.keys, self.weight, self.to = np.append(keys[by], np.iinfo(np.int64).max), weight[by], to[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each of many states: the states after it, and the log10 probabilities."""
        total, after, left = np.zeros(len(state)), np.empty(len(state), np.int64), np.arange(len(state))
        while len(left):
            now, w = state[left], word[left]
            arc = np.searchsorted(self.keys, now * self.words + w)
            hit = (self.keys[arc] == now * self.words + w) & (now > 0)
            found = left[hit]
            total[found] += self.weight[arc[hit]]
            after[found] = self.to[arc[hit]]
            ended = ~hit & (now == 0)
            found = left[ended]
            total[found] += self.root[w[ended]]
            after[found] = self.to_word[w[ended]]
            on = ~hit & (now > 0)
            left = left[on]
            total[left] += self.fail_weight[now[on]]
            state = state.copy()
            state[left] = self.fail[now[on]]
        return after, total

    def read(self, b: Block, order: int) -> np.ndarray:
        """Log10 probability of each token.

        The texts stand one after the other and are read in lanes of one length. A lane begins
        order - 1 tokens early, at the root: then its state is the one that was carried to there.
        """
        word, first, n = b.at[0], b.offset == 0, len(b.row)
        begin = np.arange(0, n, LANE)
        state, out = np.zeros(len(begin), np.int64), np.zeros(n)
        for k in range(1 - order, LANE):
            at = begin + k
            use = np.flatnonzero((at >= 0) & (at < n))
            at = at[use]
            before = np.where(first[at], self.start, state[use])
            state[use], p = self.step(before, word[at])
            if k >= 0:
                out[at] = p
        return out


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK, range_bytes: int = RANGE, coarse: int = COARSE, bundle_bytes: int = BUNDLE) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the rows where learn holds."""
    if order < 1:
        raise ValueError("the order must be at least 1")
    size = text_bytes(docs, text_col)
    blocks, bits = max(1, math.ceil(size / block_bytes)), max(0, math.ceil(math.log2(max(1, size / range_bytes))))
    first = min(bits, coarse)
    second = min(bits - first, 16)
    bundles = max(1, math.ceil(size / bundle_bytes / (1 << first))) if second else 1
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_train"))
    # In order, a row's place in its partition is the same whenever it is computed.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    rows = rows.sortWithinPartitions("_id", "_text", "_train").select(place.alias("_block"), "_id", "_text", "_train")

    def ask(key, t):
        return _table(_ask(Block(t, order), key[0].as_py(), first, second, bundles), _ASK_KINDS)

    def answer(key, t):
        got = t.to_pylist()
        opened = [_opened(r) for r in got]
        keys, totals = _summed(opened, order)
        return _answers(got, order, opened, keys, totals, int(totals[0].sum()), int((totals[0] > 0).sum()))

    def refine(key, t):
        # A bundle asks for what its blocks have, once, in the fine ranges of its coarse one.
        keys, totals = _summed([_opened(r) for r in t.to_pylist()], order)
        edges = [_edges(k << np.uint64(first) if m == 0 else k, second, 64 if m == 0 else LOW + second) for m, k in enumerate(keys)]
        out = []
        for f in range(1 << second):
            own = [slice(e[f], e[f + 1]) for e in edges]
            out.append({"range": key[0].as_py(), "bundle": key[1].as_py(), "block": -1, "fine": f} | _cell([k[s] for k, s in zip(keys, own, strict=True)], [c[s] for c, s in zip(totals, own, strict=True)]))
        return _table(out, _ASK_KINDS | {"fine": pa.int32()})

    def forward(key, t, answers):
        got = t.to_pylist()
        opened = [_opened(r) for r in got]
        keys, _ = _summed(opened, order)
        fine = sorted(answers.to_pylist(), key=lambda r: r["fine"])
        edges = [_edges(k << np.uint64(first) if m == 0 else k, second, 64 if m == 0 else LOW + second) for m, k in enumerate(keys)]
        totals = [[] for _ in range(order)]
        for f, r in enumerate(fine):
            sizes = [int(e[f + 1] - e[f]) for e in edges]
            for m, x in enumerate(_split(_unpack_counts(r["totals"], sum(sizes)), sizes)):
                totals[m].append(x)
        return _answers(got, order, opened, keys, [np.concatenate(x) for x in totals], sum(r["n"] for r in fine), sum(r["v"] for r in fine))

    def read(key, t, answers):
        b = Block(t, order)
        got = sorted(answers.to_pylist(), key=lambda r: r["range"])
        edges = [_edges(g, first, 64) for g in b.grams]
        totals = [[] for _ in range(order)]
        for k, r in enumerate(got):
            sizes = [int(e[k + 1] - e[k]) for e in edges]
            for m, x in enumerate(_split(_unpack_counts(r["totals"], sum(sizes)), sizes)):
                totals[m].append(x)
        totals, n, v = [np.concatenate(x) for x in totals], sum(r["n"] for r in got), sum(r["v"] for r in got)
        automaton = Automaton(b, totals, n, v, prior)
        total = np.bincount(b.row, automaton.read(b, order), b.rows)
        base = np.bincount(b.row, automaton.root[b.at[0]], b.rows)
        length, known = np.bincount(b.row, minlength=b.rows), np.bincount(b.row, totals[0][b.at[0]] > 0, b.rows).astype(np.int64)
        return pa.table({id_col: t.column("_id"), "n_tokens": pa.array(length), "n_known": pa.array(known), "train_tokens": pa.array(np.full(b.rows, n)), "base_score": pa.array(base), "score": pa.array(total)})

    asked = rows.groupBy("_block").applyInArrow(ask, _ASK)
    if second:
        fine = asked.groupBy("range", "bundle").applyInArrow(refine, f"{_ASK}, fine int").groupBy("range", "fine").applyInArrow(answer, _ANSWER)
        answers = asked.groupBy("range", "bundle").cogroup(fine.groupBy("range", "bundle")).applyInArrow(forward, _ANSWER)
    else:
        answers = asked.groupBy("range").applyInArrow(answer, _ANSWER)
    schema = f"{id_col} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("_block").cogroup(answers.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(read, schema)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, ~held_out("doc_id", 7, 2))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_backoff_lm": op9_backoff_lm}
