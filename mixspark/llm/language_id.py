"""Language identification: words first, shorter and shorter character n-grams for unseen words.

A word that was seen in training adds its log frequency in each language. Of an
unseen word every position adds the log frequencies of the longest known n-gram
that starts there, from four characters down to one. The language of the largest
sum is predicted.

The model is fitted on a bounded sample of labelled documents (train_docs, train_bytes)
and keeps at most max_words words and max_grams n-grams, so its size has a bound and it
can be broadcast; every document is scored, over its whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; with no
labelled row at all every text is. Ties go to the language that sorts first. Repeated
rows give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import carried, held_out, table, training_sample
from mixspark.llm.text import _powers, mix, pieces, texts_of

#: Longest n-gram that stands in for an unseen word.
ORDER = 4
#: A text's evidence counts as that of so many words at most, so that the score stays below certainty.
EVIDENCE = 20.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts; start, end, text number and hash of each run of letters."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    inside = _letters()[points]
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(points))]
    begins[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    if not len(starts):
        return points, starts, ends, starts, np.zeros(0, np.uint64)
    p, q = _powers(len(points))
    value = (points.astype(np.uint64) + np.uint64(1)) * p[: len(points)]
    value[~inside] = 0
    return points, starts, ends, np.searchsorted(offsets, starts, "right") - 1, mix(np.add.reduceat(value, starts) * q[starts])


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at every letter of these words, and whether it lies within its word."""
    at = _spread(starts, ends)
    stop = np.repeat(ends, ends - starts)
    p, _ = _powers(ORDER + 1)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += (points[np.minimum(at + k, len(points) - 1)].astype(np.uint64) + np.uint64(1)) * p[k]
    return mix(total ^ np.uint64(n << 40)), at + n <= stop


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class Model:
    """Sorted feature hashes with a log frequency for each language."""

    def __init__(self, counts: pd.DataFrame, max_words: int, max_grams: int):
        self.languages = sorted(counts.lang.unique())
        self.tables = {}
        for n in range(ORDER + 1):  # 0: words
            part = counts[counts.n == n]
            wide = part.pivot_table(index="feature", columns="lang", values="c", aggfunc="sum", fill_value=0).reindex(columns=self.languages, fill_value=0)
            keys, c = wide.index.to_numpy(np.int64).view(np.uint64), wide.to_numpy(float)
            total = c.sum(0)
            kept = np.lexsort((keys, -c.sum(1)))[: max_grams if n else max_words]
            kept = kept[np.argsort(keys[kept])]
            weight = np.log((c[kept] + 0.5) / (total + 0.5 * max(1, len(c))))
            self.tables[n] = keys[kept], weight.astype(np.float32)

    def look_up(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[n]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        points, starts, ends, row, hashes = _words(texts)
        n_lang, n = len(self.languages), len(texts)
        if not n_lang:
            return ["und"] * n, np.zeros(n)
        sums, words = np.zeros((n, n_lang)), np.bincount(row, minlength=n).astype(float)
        at, known = self.look_up(0, hashes)
        self._add(sums, row[known], self.tables[0][1][at[known]])
        starts, ends, row = starts[~known], ends[~known], row[~known]
        if len(starts):
            sizes = ends - starts
            open_, each = np.ones(sizes.sum(), bool), np.repeat(1.0 / sizes, sizes)
            rows = np.repeat(row, sizes)
            for k in range(ORDER, 0, -1):
                gram, whole = _grams(points, starts, ends, k)
                at, known = self.look_up(k, gram)
                hit = open_ & whole & known
                self._add(sums, rows[hit], self.tables[k][1][at[hit]] * each[hit, None])
                open_ &= ~hit
        mean = sums / np.maximum(words, 1)[:, None] * np.minimum(words, EVIDENCE)[:, None]
        best = sums.argmax(1)
        weight = np.exp(mean - mean.max(1, keepdims=True))
        score = weight[np.arange(n), best] / weight.sum(1)
        return [self.languages[b] if w else "und" for b, w in zip(best, words, strict=True)], np.where(words > 0, score, 0.0)

    @staticmethod
    def _add(sums: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(row, weight[:, k], len(sums))


def fit(docs: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 6000, train_bytes: int = 30_000, max_words: int = 200_000, max_grams: int = 50_000) -> Model:
    """A model of the languages of the rows where the column `learnable` holds; lang_col null: not labelled."""
    sample = training_sample(docs, docs.where(learnable).select(id_col, lang_col), id_col, text_col, lang_col, train_docs, train_bytes)

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                langs = np.array(part.column("_label").to_pylist(), object)
                points, starts, ends, row, hashes = _words(texts_of(part.column("_text")))
                for lang in sorted(set(langs)):
                    own = (langs == lang)[row]
                    for n in range(ORDER + 1):
                        if n:
                            found, whole = _grams(points, starts[own], ends[own], n)
                            found = found[whole]
                        else:
                            found = hashes[own]
                        keys, c = np.unique(found, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "feature", "c"])

    counts = sample.select("_text", "_label").mapInArrow(count, "lang string, n int, feature bigint, c bigint").groupBy("lang", "n", "feature").agg(F.sum("c").alias("c")).where("c > 1 OR n > 0")
    # The sample bounds the rows; the most frequent features suffice, and ties fall by hash.
    kept = counts.orderBy(F.col("n") > 0, F.desc("c"), "feature", "lang").where("n = 0").limit(4 * max_words).unionByName(counts.where("n > 0").orderBy(F.desc("c"), "feature", "lang").limit(16 * max_grams))
    return Model(kept.toPandas(), max_words, max_grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score of every row, and the columns to carry along (their names must be others)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = carried(docs, (id_col, "lang_pred", "score"), carry, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                lang, score = shared.value.predict(texts_of(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(lang, pa.string()), pa.array(score), *(part.column(c) for c in carry)], names)

    return docs.select(*dict.fromkeys([id_col, text_col, *carry])).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id", 4, 2))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
