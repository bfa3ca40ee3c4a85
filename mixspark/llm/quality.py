"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees, boosted in turn over the
features, learn a table of additions for each feature; then trees over pairs of bins do
so for the pairs of features that explain most of what is left. A text's score is the
logistic function of a sum of table entries.

Fitted on a bounded sample of labelled documents (train_docs, train_bytes); every
document is scored, over its whole text. The tables have a few thousand entries.

Defined results: a null text is an empty one and is scored like it. Without labels of
both kinds every score is the share of label 1 (1 with no label at all). Repeated rows
give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import carried, held_out, table, training_sample
from mixspark.llm.text import PIECE, buffers, chain, pieces, split

#: Byte classes whose shares of a text are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" ",
    "break": b"\n\r",
    "stop": b".!?",
    "bang": b"!",
    "comma": b",;:",
    "hash": b"#$%&*@^~",
    "bar": b"|<>{}[]\\/=+_",
    "quote": b"\"'`()-",
    "high": bytes(range(128, 256)),
}
FEATURES = [*CLASSES, "log_bytes", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs", "caps_words", "sign_words", "line_words", "distinct_fives", "two_letter_words"]
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True


def _share(of: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return of / np.maximum(whole, 1)


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row and the largest count of one key."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(row)))
    top = np.zeros(n)
    np.maximum.at(top, row[at], counts)
    return np.bincount(row[at], minlength=n), top


def features(texts) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, offsets = buffers(texts)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    for k, members in enumerate(CLASSES.values()):
        mask = np.zeros(256, np.int64)
        mask[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(mask[raw])])
        out[:, k] = _share(total[offsets[1:]] - total[offsets[:-1]], size)
    words = split(texts)
    count = words.per_row().astype(float)
    length = words.ends - words.starts
    k = len(CLASSES)
    out[:, k] = np.log1p(size)

    def mean(x: np.ndarray) -> np.ndarray:
        return _share(np.bincount(words.row, x, n), count)

    distinct, top = _distinct(words.row, words.hash, n)
    edge = words.row[1:] == words.row[:-1]
    pairs, _ = _distinct(words.row[1:][edge], chain(words.hash[:-1], words.hash[1:])[edge], n)
    n_pairs = np.bincount(words.row[1:][edge], minlength=n)
    upper = (raw[words.starts] >= 65) & (raw[words.starts] <= 90) & (raw[words.ends - 1] < 97) & (length > 1)
    signs = ~_LETTER[raw[words.ends - 1]] & ~_LETTER[raw[np.maximum(words.ends - 2, words.starts)]]
    fives, _ = _distinct(words.row, words.prefix(5), n)
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    out[:, k + 1 :] = np.stack([mean(length.astype(float)), mean(length > 12), mean(length <= 3), _share(distinct, count), _share(top, count), 1 - _share(pairs, n_pairs), mean(upper), mean(signs), np.minimum(_share(count, lines), 1000), _share(fives, count), mean(length == 2)], 1)
    return out


class Model:
    """Cut points of every feature, its table, and tables of pairs of features."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], coarse: list[np.ndarray]):
        self.bias, self.cuts, self.tables, self.pairs, self.coarse = bias, cuts, tables, pairs, coarse

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.tables:
            bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
            for b, t in zip(bins, self.tables, strict=True):
                z += t[b]
            for f, g, t in self.pairs:
                z += t[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the best splits of sums of gradients, greedily."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    parts = [(0, len(grad))]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        k = np.arange(a + 1, b)
        gl, hl, gr, hr = g[k] - g[a], h[k] - h[a], g[b] - g[k], h[b] - h[k]
        v = gl * gl / (hl + 1) + gr * gr / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        v = np.where((hl < least) | (hr < least), 0, v)
        i = int(v.argmax())
        return float(v[i]), int(k[i])

    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        parts.remove(best[2:])
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray, least: float) -> np.ndarray:
    """A tree of one split along each axis over a grid of bins."""
    best, out = 0.0, np.zeros_like(grad)
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for cut in range(1, len(g)):
            value, total = np.zeros_like(g), 0.0
            for a, b in ((0, cut), (cut, len(g))):
                value[a:b] = _tree(g[a:b].sum(0), h[a:b].sum(0), 2, least)
                total += float((value[a:b] * g[a:b]).sum())
            if total > best:
                best, out = total, value if axis == 0 else value.T
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, bins: int = 48, pairs: int = 6, pair_rounds: int = 8) -> Model:
    """Boosts the tables of single features in turn, then those of the strongest pairs."""
    share = y.mean() if len(y) else 1.0
    if not 0 < share < 1:
        return Model(500.0 if share else -500.0, [], [], [], [])
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables, z = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), bias)
    least = max(0.5, 0.0005 * len(y) * share * (1 - share))
    for _ in range(rounds):
        for f, table_ in enumerate(tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(at[f], y - p, len(table_)), np.bincount(at[f], p * (1 - p), len(table_)), 4, least * 0.05)
            table_ += step
            z += step[at[f]]
    coarse = [(np.arange(len(t)) * min(8, len(t)) // len(t)).astype(np.int64) for t in tables]
    p = 1 / (1 + np.exp(-z))
    cell = [c[a] for c, a in zip(coarse, at, strict=True)]

    def grid(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = cell[f] * 8 + cell[g]
        return key, np.bincount(key, y - p, 64).reshape(8, 8), np.bincount(key, p * (1 - p), 64).reshape(8, 8)

    gains = sorted(((float((a * a / (h + 1)).sum()), f, g) for f in range(len(cuts)) for g in range(f) for _, a, h in [grid(f, g, p)]), reverse=True)
    chosen = [(f, g, np.zeros((8, 8))) for _, f, g in gains[:pairs]]
    for _ in range(pair_rounds):
        for f, g, t in chosen:
            p = 1 / (1 + np.exp(-z))
            key, a, h = grid(f, g, p)
            step = rate * _tree2(a, h, least * 0.05)
            t += step
            z += step.ravel()[key]
    return Model(bias, cuts, tables, chosen, coarse)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 8000, train_bytes: int = 200_000) -> Model:
    """A model from labels of 0 and 1 for documents; docs and labels share id_col."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, train_docs, train_bytes)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), part.column("_label").cast(pa.int32()), pa.array(list(features(part.column("_text"))), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = sample.mapInArrow(run, "id bigint, y int, x array<double>").toPandas().sort_values("id")
    x = np.stack(got.x.to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return train(x, (got.y.to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, score of every row, and the columns to carry along (their names must be others)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = carried(docs, (id_col, "score"), carry, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(shared.value.score(features(part.column(text_col)))), *(part.column(c) for c in carry)], names)

    return docs.select(*dict.fromkeys([id_col, text_col, *carry])).mapInArrow(run, schema)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op1_quality_gam": op1_quality_gam}
