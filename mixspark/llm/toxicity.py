"""Toxicity by multiple-instance learning: sentences are scored, labels exist for documents only.

A sentence's probability is the logistic function of a bias and the weights of its
words and word beginnings; a document is toxic if any of its sentences is (noisy-or):
1 - prod(1 - p). Weights are fitted to document labels by gradient descent on that
product, so the sentences that cause a label get the weight; those of at least half
are reported as offending.

Fitted on a bounded sample of labelled documents (train_docs, train_bytes), with at most
max_features weights; every document is scored, over its whole text.

Defined results: a null text is an empty one; an empty text has the score of a single
empty sentence. Without labels of both kinds every score is 0. Repeated rows give
repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import cut, held_out, table, training_sample
from mixspark.llm.text import NOT_LETTER, PIECE, Words, chain, pieces, split, unique_by_row

#: Lengths in bytes of the word beginnings that are features, besides whole words.
BEGINNINGS = (4, 6)
_STOP = np.zeros(256, np.int64)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = 1  # line feed ! . ?


def _sentences(words: Words) -> np.ndarray:
    """Number of each word's sentence within the piece; a text's end ends a sentence."""
    stops = np.cumsum(_STOP[words.data]) if len(words.data) else np.zeros(0, np.int64)
    return stops[words.starts] + words.row if len(words.starts) else words.starts


def _features(words: Words) -> np.ndarray:
    """Words and their beginnings, a row of hashes for each kind."""
    kinds = [words.hash, *(words.prefix(n) for n in BEGINNINGS)]
    return np.stack([chain(np.full(len(x), k, np.uint64), x) for k, x in enumerate(kinds)])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def score(self, texts) -> tuple[np.ndarray, list[list[dict]]]:
        """Score of each text; its offending sentences as byte offsets of their first and past their last word."""
        words = split(texts, NOT_LETTER)
        n = words.rows
        if not np.isfinite(self.bias):
            return np.zeros(n), [[] for _ in range(n)]
        # Each sentence without a known feature adds softplus(bias), the others what they exceed it by.
        sentence = _sentences(words)
        first = np.ones(len(sentence), bool)
        first[1:] = sentence[1:] != sentence[:-1]
        total = _softplus(np.array(self.bias)) * np.maximum(1, np.bincount(words.row[first], minlength=n))
        spans: list[list[dict]] = [[] for _ in range(n)]
        if len(self.keys) and len(sentence):
            hashes = _features(words)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            kind, word = np.nonzero(known)
            # A feature counts once in a sentence.
            pair = np.unique(sentence[word] * len(self.keys) + at[kind, word])
            hit, back = np.unique(pair // len(self.keys), return_inverse=True)
            z = self.bias + np.bincount(back, self.weights[pair % len(self.keys)], len(hit))
            begin = np.searchsorted(sentence, hit)
            row = words.row[begin]
            total += np.bincount(row, _softplus(z) - _softplus(np.array(self.bias)), n)
            end = np.searchsorted(sentence, hit, "right") - 1
            for k in np.flatnonzero(z >= 0):
                base = words.offsets[row[k]]
                spans[row[k]].append({"start": int(words.starts[begin[k]] - base), "end": int(words.ends[end[k]] - base), "score": float(1 / (1 + np.exp(-z[k])))})
        return -np.expm1(-np.maximum(total, 0)), spans


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 8000, train_bytes: int = 20_000, max_features: int = 2048, rounds: int = 300) -> Model:
    """A model from labels of 0 and 1 for documents; docs and labels share id_col."""
    sample = cut(training_sample(docs, labels, id_col, text_col, label_col, train_docs, train_bytes).select("_id", F.col("_label").cast("int").alias("_label"), "_text"))
    n_docs, positives = sample.agg(F.count("*"), F.count_if(F.col("_label") > 0)).first()
    if not 0 < positives < n_docs:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)

    def frequencies(batches):
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                words = split(part.column("_text"), NOT_LETTER)
                row, key = unique_by_row(np.tile(words.row, 1 + len(BEGINNINGS)), _features(words).ravel())
                keys, back = np.unique(key, return_inverse=True)
                toxic = part.column("_label").to_numpy() > 0
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, minlength=len(keys))), pa.array(np.bincount(back[toxic[row]], minlength=len(keys)))], ["key", "df", "pos"])

    # The features with the largest log-likelihood ratio for toxic documents, in three documents at least.
    found = sample.mapInArrow(frequencies, "key bigint, df bigint, pos bigint").groupBy("key").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).where("df >= 3")
    ratio = F.ln(((F.col("pos") + 0.5) / (positives + 1)) / ((F.col("df") - F.col("pos") + 0.5) / (n_docs - positives + 1)))
    best = found.withColumn("gain", F.col("pos") * ratio).where("gain > 12").orderBy(F.desc("gain"), "key").limit(max_features)
    keys = np.sort(np.array([r.key for r in best.collect()], np.int64).view(np.uint64))

    def bags(batches):
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                words = split(part.column("_text"), NOT_LETTER)
                sentence = _sentences(words)
                new = np.ones(len(sentence), bool)
                new[1:] = sentence[1:] != sentence[:-1]
                n = np.bincount(words.row[new], minlength=words.rows)
                first = sentence[np.minimum(np.searchsorted(words.row, np.arange(words.rows)), max(len(sentence) - 1, 0))] if len(sentence) else np.zeros(words.rows, np.int64)
                hashes = _features(words)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                kind, word = np.nonzero(keys[at] == hashes) if len(keys) else (np.zeros(0, np.int64),) * 2
                pair = np.unique(sentence[word] * max(len(keys), 1) + at[kind, word]) if len(word) else np.zeros(0, np.int64)
                of, feature = pair // max(len(keys), 1), pair % max(len(keys), 1)
                row = words.row[np.searchsorted(sentence, of)] if len(of) else of
                edge = np.searchsorted(row, np.arange(words.rows + 1))
                rows = [((of[a:b] - first[k]).astype(np.int32).tobytes(), feature[a:b].astype(np.int32).tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), part.column("_label"), pa.array(n), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["id", "y", "n", "s", "f"])

    # Repeatable: the sums below run in the order of the ids.
    got = sample.mapInArrow(bags, "id bigint, y int, n bigint, s binary, f binary").toPandas().sort_values("id")
    y = (got.y.to_numpy() > 0).astype(float)
    inner, feature = [np.frombuffer(x, np.int32) for x in got.s], [np.frombuffer(x, np.int32) for x in got.f]
    doc = np.repeat(np.arange(len(y)), np.fromiter(map(len, inner), np.int64, len(y)))
    wide = int(got.n.max()) + 1
    sentences, sentence = np.unique(doc * wide + np.concatenate(inner), return_inverse=True)
    weights, bias = _train(np.concatenate(feature), sentence, sentences // wide, got.n.to_numpy(float), y, len(keys), rounds)
    return Model(keys, weights, bias)


def _train(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, n: np.ndarray, y: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood with a small quadratic penalty; sentence: of each entry, doc: of each sentence."""
    rest = np.maximum(n, 1) - np.bincount(doc, minlength=len(y))
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = -6.0
    for step in range(1, rounds + 1):
        z = theta[k] + np.bincount(sentence, theta[feature], len(doc))
        s = np.bincount(doc, _softplus(z), len(y)) + rest * _softplus(theta[k])
        # d(-log likelihood)/ds: 1 for clean documents, -1/(e^s - 1) for toxic ones.
        slope = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-6, 500)), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence], k), dz.sum() + (slope * rest).sum() / (1 + np.exp(-theta[k])))
        grad = grad / len(y) + np.append(1e-6 * theta[:k], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:k], float(theta[k])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, spans (offending sentences: start, end in bytes of the text, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                value, spans = shared.value.score(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(value), pa.array(spans, span)], [id_col, "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, spans array<struct<start:bigint,end:bigint,score:double>>")


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its offending sentences; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


QUERIES = {"op5_toxicity_mil": op5_toxicity_mil}
