"""License scans with DataFrame functions only: a positional index of rare words.

Words are maximal runs of digits, lower-cased ASCII letters and non-ASCII characters. The
rarest words of every licence text, by their inverse document frequency among all licence
texts, are its postings: word and places. A file is looked up by its own words: of those it
shares with a text's postings, the `RARE` of the highest IDF. Each place of such a word in
the file, less a place of it in the text, says where in the file the text would have to
begin; where enough of them agree, to within `SLACK` words (a name may have been put in), the
text's mandatory phrases are verified in the words from there on, and the share of its rare
words found there, weighted by IDF, is the score. Below `LEAST` it is no find.

All of it happens within a row, in one pass: no text is shuffled, and a file's labels
depend on nothing but the file. Work grows with a file's length times its logarithm.

Defined results: a null text is an empty one and has no labels (an empty string) and
score 0. Repeated rows give repeated rows; other columns are ignored, whatever their names.
A file with two licences has both labels, and one that repeats a licence has a find for each
time. A label's texts are looked up each by itself; the score is the best of all finds, 1
where there is a base phrase.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import table
from mixspark.llm.license_texts import TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are labels wherever their words stand consecutively. Fixed by the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words by whose places the base phrases are found; each phrase has one of them.
_BASE_WORDS = ("license", "nc")
#: Posted words of a text; of those that a file has, the rarest that are looked up; how far places may be apart that agree.
POSTED, RARE, SLACK = 24, 6, 8
#: Share of the words looked up that must agree, and the least score.
AGREE, LEAST = 0.6, 0.5


@dataclass(frozen=True)
class Template:
    """A licence text: its words, and of its posted words, rarest first, their IDF and their places."""

    label: str
    words: tuple[str, ...]
    mandatory: tuple[str, ...]
    postings: tuple[tuple[str, float, tuple[int, ...]], ...]

    @property
    def total(self) -> float:
        return sum(w for _, w, _ in self.postings)


def templates(texts: Sequence[tuple[str, str, tuple[str, ...]]] = TEXTS) -> tuple[Template, ...]:
    """The positional index of (label, text, mandatory phrases)."""
    split = [tuple(re.findall(WORD, t.lower())) for _, t, _ in texts]
    df = Counter(w for words in split for w in set(words))
    out = []
    for (label, _, mandatory), words in zip(texts, split, strict=True):
        idf = {w: math.log((len(texts) + 1) / df[w]) for w in words}
        rare = sorted(idf, key=lambda w: (-idf[w], words.index(w)))[:POSTED]
        out.append(Template(label, words, mandatory, tuple((w, idf[w], tuple(k for k, x in enumerate(words) if x == w)) for w in rare)))
    return tuple(out)


TEMPLATES = templates()


def words_of(text_col: str) -> Column:
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))


def _array(words) -> Column:
    # Licence words have no quotes; as text, a long list is one expression to build.
    return F.expr(f"array({', '.join(repr(w) for w in words)})")


def _phrase_starts(words: Column, spots: Column, phrase: list[str]) -> Column:
    """Places (from 0) where the phrase's words stand consecutively, from the spots of one of them."""
    at = next(k for k, w in enumerate(phrase) if w in _BASE_WORDS)

    def fits(i: Column) -> Column:
        return reduce(and_, [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)], i >= 0)

    return F.filter(F.transform(F.filter(spots, lambda x: x.w == phrase[at]), lambda x: x.i - at), fits)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever body uses it: also in a lambda, which would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _finds(words: Column, spots: Column, t: Template) -> Column:
    """Where the template is found: struct(label, start, score)."""
    n_posted, posted = len(t.postings), _array([w for w, _, _ in t.postings])
    places = F.expr(f"map({', '.join(f'{w!r}, array({', '.join(map(str, p))})' for w, _, p in t.postings)})")
    weights = F.expr(f"map({', '.join(f'{w!r}, {idf!r}D' for w, idf, _ in t.postings)})")

    def begins(own: Column, rare: Column) -> Column:
        looked = F.filter(own, lambda x: F.array_contains(rare, x.w))
        return F.array_sort(F.flatten(F.transform(looked, lambda x: F.transform(F.element_at(places, x.w), lambda p: x.i - p))))

    def agreed(b: Column, least: Column) -> Column:
        # Sorted begins: the one `least - 1` places on is near enough. Of those that agree one after the other, the first.
        def agree(j: Column) -> Column:
            return F.coalesce(F.get(b, j + least - 1) - F.get(b, j) <= SLACK, F.lit(False))

        return F.filter(F.transform(b, lambda x, j: F.when(agree(j) & ~F.coalesce((j > 0) & agree(j - 1) & (x - F.get(b, j - 1) <= SLACK), F.lit(False)), x)), lambda x: x.isNotNull())

    def verified(at: Column) -> Column:
        def judged(window: Column) -> Column:
            joined = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
            ok = _let(joined, lambda j: reduce(and_, [j.contains(f" {phrase} ") for phrase in t.mandatory]))
            share = F.aggregate(F.array_intersect(posted, window), F.lit(0.0), lambda a, w: a + F.element_at(weights, w)) / F.lit(t.total)
            return F.when(ok, _let(F.least(F.round(share, 9), F.lit(1.0)), lambda s: F.when(s >= LEAST, F.struct(F.lit(t.label).alias("label"), F.greatest(at, F.lit(0)).alias("start"), s.alias("score")))))

        return _let(F.slice(words, F.greatest(at, F.lit(0)) + 1, len(t.words) + 3 * SLACK), judged)

    def looked_up(own: Column, rare: Column) -> Column:
        least = F.greatest(F.lit(2), F.ceil(F.size(rare) * AGREE).cast("int"))
        found = _let(begins(own, rare), lambda b: _let(least, lambda n: F.filter(F.transform(agreed(b, n), verified), lambda x: x.isNotNull())))
        return F.when(F.size(rare) >= min(2, n_posted), found)

    def from_spots(own: Column) -> Column:
        # The file's rarest words of this text: in the order of the postings.
        has = F.array_distinct(F.transform(own, lambda x: x.w))
        return _let(F.slice(F.array_intersect(posted, has), 1, RARE), lambda rare: looked_up(own, rare))

    return _let(F.filter(spots, lambda x: F.array_contains(posted, x.w)), from_spots)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, and found: struct(label, start, score) of every find."""
    anchors = sorted({w for t in licences for w, _, _ in t.postings} | set(_BASE_WORDS))
    words, spots = F.col("_words"), F.col("_spots")
    empty = F.array().cast("array<int>")
    rows = docs.select(F.col(id_col), words_of(text_col).alias("_words"))
    # Only texts with a word that isn't in half of all licences are looked into; the others end here.
    spotted = F.expr(f"filter(transform(_words, (w, i) -> IF(w IN ({', '.join(map(repr, anchors))}), struct(w AS w, i AS i), NULL)), x -> x IS NOT NULL)")
    rows = rows.withColumn("_spots", F.when(F.arrays_overlap(words, _array(_telling(licences))), spotted))
    rows = rows.withColumns({f"_b{k}": F.when(spots.isNotNull(), _phrase_starts(words, spots, p.split())) for k, p in enumerate(BASE)})
    rows = rows.withColumn("found", F.when(spots.isNotNull(), F.flatten(F.filter(F.array(*[_finds(words, spots, t) for t in licences]), lambda x: x.isNotNull()))))
    starts = F.concat(*[F.coalesce(F.col(f"_b{k}"), empty) for k in range(len(BASE))])
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(F.coalesce(F.col(f"_b{k}"), empty)) > 0, F.lit(label)) for k, label in enumerate(BASE.values())]), lambda x: x.isNotNull())))
    more = F.coalesce(F.transform("found", lambda x: x.label), F.array().cast("array<string>"))
    return rows.select(
        id_col,
        F.size(words).cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.score)), F.lit(0.0))).alias("score"),
        "found",
    )


def _telling(licences: tuple[Template, ...]) -> list[str]:
    """Words of which every verified find and every base phrase has one: one of each mandatory phrase, the one that fewest texts have."""
    df = Counter(w for t in licences for w in set(t.words))
    return sorted({min(t.mandatory[0].split(), key=lambda w: (df[w], w)) for t in licences} | set(_BASE_WORDS))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {"op8_license_scan": op8_license_scan}
