"""Scores of the trained operators against plain versions of their definitions, and texts of more than a piece."""

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixspark.llm import backoff_lm, byte_bpe, jaccard_join, language_id, license_scan, packing, quality, toxicity
from mixspark.llm.common import training_sample
from mixspark.llm.text import NOT_LETTER, PIECE, split

from .test_operators import UP, backed_off, words

DATA = "/root/testdata/sf0.01"
ODD = [None, "", "  \n ", "Hello", "!!! ... 123", "\u00e9 \u00fc \u65e5\u672c \u00df", "ONE Two THREE. one two three! 5 5 5", "a " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    got = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    own = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate([*ODD, long_text(0)])], got.schema)
    return got.unionByName(own).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def long_text(k):
    """Over a piece of text, whose words recur but not their order."""
    w = [f"Wort{(i * i + k * (i == 99)) % 997}" + "." * (i % 11 == 0) for i in range(180_000)]
    text = " ".join(w)
    assert len(text) > PIECE
    return text


def letter(b):
    return b >= 128 or chr(b).isalpha()


def plain_features(text):
    raw = (text or "").encode()
    out = [sum(raw.count(bytes([b])) for b in members) / max(len(raw), 1) for members in quality.CLASSES.values()] + [math.log1p(len(raw))]
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    low = [raw[a:b].lower() for a, b in spans]
    n = max(len(low), 1)
    pairs = list(zip(low, low[1:], strict=False))
    upper = sum(b - a > 1 and 65 <= raw[a] <= 90 and raw[b - 1] < 97 for a, b in spans)
    signs = sum(not letter(raw[b - 1]) and not letter(raw[max(b - 2, a)]) for a, b in spans)
    return [
        *out,
        sum(map(len, low)) / n,
        sum(len(w) > 12 for w in low) / n,
        sum(len(w) <= 3 for w in low) / n,
        len(set(low)) / n,
        max(Counter(low).values(), default=0) / n,
        1 - len(set(pairs)) / max(len(pairs), 1),
        upper / n,
        signs / n,
        min(len(low) / (raw.count(b"\n") + 1), 1000),
        len({w[:5] for w in low}) / n,
        sum(len(w) == 2 for w in low) / n,
    ]


def test_quality_score_is_a_sum_of_table_entries(docs, labels):
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        bins = [bisect_right(c.tolist(), x) for c, x in zip(model.cuts, plain_features(r.text), strict=True)]
        z = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[f][bins[f]], model.coarse[g][bins[g]]] for f, g, t in model.pairs)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9, abs=1e-12)


def test_toxicity_score_is_a_noisy_or(docs, labels):
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert weight
    got = {r.doc_id: (r.score, [(s.start, s.end) for s in r.spans]) for r in toxicity.score(docs, model).collect()}
    known = {}

    def keys(word):
        if word not in known:
            known[word] = {k for k in toxicity._features(split(pa.array([word.decode()]), NOT_LETTER))[:, 0].tolist() if k in weight}
        return known[word]

    for r in docs.collect():
        raw = (r.text or "").encode().lower()
        sentences, stops, at = {}, 0, 0
        for m in re.finditer(rb"[a-z\x80-\xff]+", raw):
            stops += len(re.findall(rb"[\n!.?]", raw[at : m.start()]))
            at = m.start()
            sentences.setdefault(stops, []).append(m)
        total, spans = 0.0, []
        for own in sentences.values():
            z = model.bias + sum(weight[k] for k in set().union(*(keys(m.group()) for m in own)))
            total += np.logaddexp(0, z)
            if z >= 0:
                spans.append((own[0].start(), own[-1].end()))
        score, found = got[r.doc_id]
        assert score == pytest.approx(-math.expm1(-(total if sentences else np.logaddexp(0, model.bias))), rel=1e-6, abs=1e-9)
        assert found == spans


def test_language_score_backs_off_from_words(docs):
    model = language_id.fit(docs, F.col("doc_id") % 4 != 0)
    tables = {n: dict(zip(k.tolist(), w.astype(float), strict=True)) for n, (k, w) in model.tables.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    whole = {}

    def one(word):
        points, starts, ends, _, h = language_id._words([word])
        if int(h[0]) in tables[0]:
            return tables[0][int(h[0])]
        grams = {n: language_id._grams(points, starts, ends, n) for n in range(1, language_id.ORDER + 1)}
        out = np.zeros(len(model.languages))
        for k in range(len(word)):
            for n in range(language_id.ORDER, 0, -1):
                h, fits = grams[n]
                if fits[k] and int(h[k]) in tables[n]:
                    out += tables[n][int(h[k])] / len(word)
                    break
        return out

    for r in docs.collect():
        found = "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()
        if not found:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        for w in set(found) - set(whole):
            whole[w] = one(w)
        mean = sum(c * whole[w] for w, c in Counter(found).items()) / len(found) * min(len(found), language_id.EVIDENCE)
        p = np.exp(mean - mean.max())
        lang, score = got[r.doc_id]
        assert lang == model.languages[int(p.argmax())] or math.isclose(p.max(), sorted(p)[-2], rel_tol=1e-4)
        assert score == pytest.approx(p.max() / p.sum(), rel=1e-4)


def test_empty_texts_score_alike_in_any_company(spark, docs, labels):
    model = quality.fit(docs, labels)
    assert len({float(model.score(quality.features(pa.array(t)))[0]) for t in ([""], ["", "some words here"], ["", ""])}) == 1


def test_repeated_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (3, "x" * 50), (4, "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 1), (None, 1), (9, 1)], "doc_id bigint, quality int")
    for _ in range(2):
        got = training_sample(docs, labels, "doc_id", "text", "quality", 100, 20).collect()
        assert sorted((r._id, r._text, r._label) for r in got) == [(1, "a", 1), (2, "c", 0)]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(0, long_text(0)), (1, long_text(1)), (2, "Released under the MIT License. " + long_text(0)), (3, "short one")], "doc_id bigint, text string")


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_long_texts_are_linked(long):
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) for i, t in texts(long) for w in [words(t)]}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.similar(long).collect()}
    assert got == {i: (len(sets[i]), 3 if i == 3 else 0, 0 if i == 3 else 2) for i in range(4)}


def test_long_texts_are_scored_by_the_language_model(long):
    got = sorted([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] for r in backoff_lm.score(long, F.col("doc_id") != 1).collect())
    want = sorted(map(list, backed_off([(i, [*words(t), None]) for i, t in texts(long)], lambda i: i != 1, backoff_lm.ORDER, backoff_lm.PRIOR)))
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_long_texts_are_encoded_and_packed(long):
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in byte_bpe.byte_bpe(long).collect()}
    assert got == {i: (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()) for i, t in texts(long) for e in [plain.encode_ordinary(t)]}
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.pack(long, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    for i, t in texts(long):
        own = pieces[pieces.doc_id == i]
        assert [x for a in own.ids for x in a] == [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]


def test_long_texts_are_scanned_for_licences(long):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = {r.doc_id: (r.n_words, r.n_base, r.labels) for r in license_scan.scan(long).collect()}
    assert got == {i: (len(word.findall(t.translate(UP))), int(i == 2), "mit" if i == 2 else "") for i, t in texts(long)}
