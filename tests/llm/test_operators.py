"""Each operator against a plain version, on the smallest tables and on odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from mixspark.llm import backoff_lm, bit_sliced, byte_bpe, jaccard_join, language_id, license_scan, nn_descent, packing, quality, toxicity
from mixspark.llm.components import components
from mixspark.llm.text import split

DATA = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, set binary, id string, score string, _id string, found int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns of clashing names."""
    copy = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [None, "", "   \n\t", "Hello", "under the MIT-license, CC BY NC; apache license, version 2.0", "a b c", "a b c", copy, copy, copy + " end", "é ü 日本 ß \x1c\x01 z", "x" * 9000, "go on. " * 4000, "!!! ... 123"]
    rows = [(i, t, [None, "en", "de"][i % 3], None, None, b"1", "a", "b", "c", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, copy, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t.translate(UP))


def test_split_agrees_with_regex(odd):
    import pyarrow as pa

    t = [x for _, x in texts(odd)]
    got = split(pa.array(t))
    assert got.per_row().tolist() == [len(words(x)) for x in t]
    assert [bytes(got.data[a:b]).decode() for a, b in zip(got.starts, got.ends, strict=True)] == [w for x in t for w in words(x)]


def test_bpe_equals_tiktoken(spark, docs, odd, none):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        want = sorted((str(i), len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(df) for e in [plain.encode_ordinary(t)])
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.byte_bpe(df).collect())
        assert got == want
    assert byte_bpe.byte_bpe(none).count() == 0
    bpe = byte_bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    long = "".join(random.Random(1).choice("abcde") for _ in range(5000))
    assert bpe.encode([long])[0] == plain.encode_ordinary(long)


def test_packing_round_trip(docs, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    for df in (docs, odd):
        got = packing.pack(df, shard_bytes=200_000, with_ids=True).toPandas()
        want = Counter((str(i), *plain.encode(t, add_special_tokens=False).ids, 2) for i, t in texts(df))
        # A document's pieces follow each other: in its sequence, and then at the beginning of the next one.
        found, open_ = Counter(), []
        for r in got.sort_values(["sequence_id", "offset"]).itertuples():
            assert r.start == len(open_) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            open_ += list(r.ids)
            if len(open_) == r.doc_tokens:
                found[str(None if r.doc_id != r.doc_id else int(r.doc_id)), *open_] += 1
                open_ = []
        assert found == want and not open_
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert packing.pack(none).count() == 0


def test_packing_pads_little_whatever_the_plan(spark):
    """Rows of a join, rows without an id, and rows of one id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    same = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.lit("Some words, and then some more. " * 9).alias("text"))
    for df in (docs, docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"), same):
        got = packing.pack(df, shard_bytes=1 << 20).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
        assert sum(4096 - n for n in got if n & (n - 1)) < 0.01 * got.sum()
    assert packing.pack(same).where("start = 0").count() == 20_000


def test_cheapest_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        size = 128
        pos = [0]
        while len(pos) < 18:
            pos.append(pos[-1] + rng.randint(1, 50))
        pen = [0, *[rng.choice([0, 2, 9]) for _ in pos[1:]]]
        best = [0] + [math.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= size:
                    best[j] = min(best[j], best[i] + pen[j] + (0 if n >= 64 and n & (n - 1) == 0 else size - n))
        assert packing.cheapest_cuts(np.array(pos), np.array(pen), size)[1] == best[-1]


def test_license_scan(docs, odd, none):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for df in (docs, odd):
        got = license_scan.scan(df).toPandas()
        want = []
        for i, t in texts(df):
            w, starts, labels = word.findall(t.translate(UP)), [], set()
            for p, label in license_scan.BASE.items():
                p = p.split()
                at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
                starts += at
                labels |= {label} if at else set()
            want.append((str(i), len(w), len(starts), str(min(starts, default=None)), str(max(starts, default=None)), ",".join(sorted(labels))))
        none_or = lambda x: "None" if x != x or x is None else str(int(x))
        assert sorted((none_or(r.doc_id), r.n_words, r.n_base, none_or(r.first_word), none_or(r.last_word), r.base_labels) for r in got.itertuples()) == sorted(want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got.itertuples())
    assert license_scan.scan(none).count() == 0


def plain_finds(w):
    """Label, begin and score of every licence text in the words w, by the definition."""
    out = []
    for t in license_scan.TEMPLATES:
        posted = [x for x, _, _ in t.postings]
        rare = [x for x in posted if x in set(w)][: license_scan.RARE]
        if len(rare) < min(2, len(posted)):
            continue
        begins = sorted(i - k for i, x in enumerate(w) if x in rare for k, y in enumerate(t.words) if x == y)
        need = max(2, math.ceil(len(rare) * license_scan.AGREE))
        agree = [j + need <= len(begins) and begins[j + need - 1] - begins[j] <= license_scan.SLACK for j in range(len(begins))]
        for j, at in enumerate(begins):
            if not agree[j] or j and agree[j - 1] and at - begins[j - 1] <= license_scan.SLACK:
                continue
            window = w[max(at, 0) : max(at, 0) + len(t.words) + 3 * license_scan.SLACK]
            score = sum(idf for x, idf, _ in t.postings if x in window) / t.total
            if all(f" {p} " in f" {' '.join(window)} " for p in t.mandatory) and score >= license_scan.LEAST:
                out.append((t.label, max(at, 0), round(score, 6)))
    return sorted(out)


def test_license_texts_are_found(spark, docs, odd):
    """Every licence's texts, whole, cut, with words changed or put in, twice, and mixed, against a plain version."""
    from mixspark.llm.license_texts import TEXTS

    rng, rows = random.Random(3), []
    for label, text, _ in TEXTS:
        w = text.split()
        rows.append((label, text))
        rows.append((None, "Copyright some one.\n" + text.upper() + " And so on."))
        rows.append((None, " ".join(x if rng.random() > 0.15 else "other" for x in w)))
        rows.append((None, " ".join(y for x in w for y in ([x] if rng.random() > 0.03 else [x, "put", "in"]))))
        rows.append((None, " ".join(w[: len(w) // 2])))
        rows.append((None, text + " x y z " * 30 + rng.choice(TEXTS)[1]))
    rows += [(None, "license license general public " * 500), (None, "permission software the of to license " * 400)]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for df in (spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string"), docs, odd):
        got = sorted((str(r.doc_id), r.n_words, sorted((f.label, f.start, round(f.score, 6)) for f in r.found or [])) for r in license_scan.scan(df).collect())
        assert got == sorted((str(i), len(w), plain_finds(w)) for i, t in texts(df) for w in [word.findall(t.translate(UP))])
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()}
    for i, (label, _) in enumerate(rows):
        if label:
            assert label in got[i].labels.split(",") and got[i].score == 1
    assert got[len(rows) - 2].labels == ""


def backed_off(tokens, train, order, k):
    """For each text: its tokens, how many are known, all training tokens, the sum of single words' and of the model's log10 probabilities."""
    count, texts = Counter(), 0
    for i, w in tokens:
        if train(i):
            texts += 1
            for m in range(1, order + 1):
                own = w if m == 1 else [0, *w]
                count.update(tuple(own[j : j + m]) for j in range(len(own) - m + 1))
    one = {g: c for g, c in count.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)

    def p(h, x):
        if not h:
            return (count[x,] + 1) / (n + v + 1)
        of = texts if h == (0,) else count[h]
        return (count[*h, x] + k * p(h[1:], x)) / (of + k)

    for i, w in tokens:
        own = [0, *w]
        whole = [p(tuple(own[max(0, j - order + 1) : j]), own[j]) for j in range(1, len(own))]
        yield i, len(w), sum(count[x,] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), sum(map(math.log10, whole))


@pytest.mark.parametrize(("order", "coarse"), [(1, 12), (2, 12), (3, 12), (3, 1), (4, 2)])
def test_backoff_lm(docs, odd, none, order, coarse):
    for df in (docs, odd):
        got = sorted(([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] for r in backoff_lm.score(df, F.col("doc_id") % 3 != 0, order=order, block_bytes=50_000, range_bytes=20_000, coarse=coarse, bundle_bytes=60_000).collect()), key=str)
        want = sorted(map(list, backed_off([(i, [*words(t), None]) for i, t in texts(df)], lambda i: i is not None and i % 3 != 0, order, backoff_lm.PRIOR)), key=str)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert backoff_lm.score(none, F.lit(True), order=order).count() == 0
    assert {r.score for r in backoff_lm.score(odd, F.lit(False), order=order).collect()} == {0.0}


def test_backoff_lm_spreads_repeated_ids(spark):
    # 10,000 rows without an id and 10,000 of one id, and rows of a join: the same results, and no block holds them all.
    text = "a b c d e f g h i j " * 20
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.lit(text).alias("text"))
    got = backoff_lm.score(df, F.col("doc_id").isNull(), block_bytes=200_000).groupBy("doc_id", "n_tokens", "n_known", "train_tokens").agg(F.count("*").alias("n"), F.countDistinct(F.round("score", 6)).alias("scores")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.n, r.scores) for r in got) == [("7", 201, 201, 2_010_000, 10_000, 1), ("None", 201, 201, 2_010_000, 10_000, 1)]


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent, degree = {i: i for i, _ in sets}, [0] * len(sets)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
                degree[a] += 1
                degree[b] += 1
    return sorted((i, len(s), root(i), d) for (i, s), d in zip(sets, degree, strict=True))


def test_jaccard_join(spark, docs, odd, none):
    rng = random.Random(4)
    base = [f"w{rng.randrange(60)}" for _ in range(80)]
    near = []
    for i in range(60):  # near copies around the threshold, and a passage that all share
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"v{rng.randrange(30)}"
        near.append((i, " ".join(w) if i % 2 else " ".join(base[:30] + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 10, 60]))])))
    for df in (docs, odd.where("doc_id IS NOT NULL"), spark.createDataFrame(near, "doc_id bigint, text string")):
        for coarse in (12, 1) if df is docs else (12,):
            got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.similar(df, range_bytes=20_000, coarse=coarse).collect())
            assert got == brute_components(texts(df))
    assert jaccard_join.similar(none).count() == 0
    alone = jaccard_join.similar(odd).where("doc_id IS NULL").collect()
    assert len(alone) == 1 and alone[0].component_id is None


def test_links_within_a_cluster_are_derived(spark, monkeypatch):
    """A crowd of sets at all distances from their lead, in several chunks, with copies: the same links and numbers as all pairs give."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 7)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 5)
    rng, base = random.Random(7), [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(8)):
            w[k] = rng.choice([f"v{rng.randrange(4)}", f"own{i}"])
        rows.append((i, " ".join(w[rng.randrange(6) :] + [f"end{rng.randrange(5)}"] * rng.randrange(4))))
    rows += [(70 + i, rows[5 * i][1]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(texts(df))
    assert len({d for *_, d in want}) > 15  # links are many, and not all alike
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.similar(df).collect()) == want
    pairs = jaccard_join.links(df).collect()
    rep = {r.a: r.b for r in pairs if r.same}
    linked = {(r.a, r.b) for r in pairs if not r.same}
    assert len(linked) == sum(not r.same for r in pairs)
    degree = Counter()
    for i, _ in rows:
        for j, _ in rows:
            a, b = sorted((rep.get(i, i), rep.get(j, j)))
            degree[i] += i != j and (a == b or (a, b) in linked)
    assert all(degree[i] == d for i, _, _, d in want)


def test_repeated_id_links_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (3, b), (9, "c")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar(df).collect()}
    assert got == {(5, 1), (1, 1), (3, 1), (9, 9)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, 31), (31, 30), (7, 7), (40, 41), (50, 41)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40, 41: 40, 50: 40}


def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (900, None, 0), (901, [1.0, None] * 4, 0), (902, [float("nan")] * 8, 0), (903, [0.0] * 8, 0), (None, [1.0] * 8, 0), (0, rows[0][1], 1)], "vec_id bigint, embedding array<double>, score int"), x


def test_bit_sliced_is_exact(spark):
    df, x = vectors(spark)
    q = np.floor(64 * np.vstack([x, np.zeros((1, 8))])).astype(int)
    ids = np.array([*range(400), 903])
    got = {}
    for r in bit_sliced.top_k(df, F.col("vec_id") % 20 == 0, 7, block=128, chunk=6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for i, mine in got.items():
        s = q @ q[np.searchsorted(ids, i)]
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:7]
        assert [mine[r + 1] for r in range(7)] == [(ids[keep][o], s[keep][o]) for o in order]
    # Vectors of other lengths meet their like; empty ones take no part; what might not fit is refused.
    mixed = spark.createDataFrame([(i, [float(i % 7), -0.5, 0.25][: 1 + i % 3], 0) for i in range(1000, 1090)] + [(2000, [], 0)], df.schema)
    short = {i: [math.floor(64 * x) for x in [float(i % 7), -0.5, 0.25][: 1 + i % 3]] for i in range(1000, 1090)}
    both = bit_sliced.top_k(df.unionByName(mixed), F.col("vec_id") % 20 == 0, 7, block=128, chunk=6).where("query_id >= 1000").collect()
    for i in range(1000, 1090, 20):
        want = sorted((-sum(a * b for a, b in zip(short[i], v, strict=True)), j) for j, v in short.items() if j != i and len(v) == len(short[i]))[:7]
        assert [(-r.score, r.vec_id) for r in sorted(both, key=lambda r: r["rank"]) if r.query_id == i] == want
    assert {r.query_id for r in both} == set(range(1000, 1090, 20))
    # Clusters far apart: blocks that can't reach the sample's scores are passed over, and the result stays.
    rng = np.random.default_rng(6)
    far = np.repeat(np.eye(4) * 8, 300, 0) + rng.normal(size=(1200, 4)) * 0.2
    got = bit_sliced.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5, block=100).toPandas()
    whole = np.floor(64 * far).astype(int)
    for i, g in got.groupby("query_id"):
        s = whole @ whole[i]
        s[i] = -(10**9)
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(1200), -s))[:5].tolist()
    with pytest.raises(ValueError):
        bit_sliced.top_k(spark.createDataFrame([(0, [1e9, 1.0]), (20, [1.0, 1.0])], "vec_id bigint, embedding array<double>"), F.lit(True))
    few = bit_sliced.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0, 7)
    assert few.count() == 2 and bit_sliced.top_k(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_nn_descent_recall(spark):
    df, x = vectors(spark)
    odd = spark.createDataFrame([(950, [1.0] * 3, 0), (951, [], 0), (960, [2.0] * 3, 0)], df.schema)
    got = nn_descent.nearest(df.unionByName(odd), F.col("vec_id") % 10 == 0, 5, degree=8, beam=32).toPandas()
    hit = 0
    for i, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((np.arange(400), d))[:5]
        assert np.allclose(g.sort_values("rank").score, d[g.sort_values("rank").vec_id], rtol=1e-12)
        hit += len(set(want) & set(g.vec_id))
    assert set(got.query_id) == set(range(0, 400, 10)) and hit >= 0.95 * 5 * 40
    equal = got[got.query_id == 60].sort_values("rank").vec_id.tolist()
    assert equal == [50, 51, 52, 53, 54]
    assert nn_descent.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("neighbours_")]


def test_descent_makes_the_graph(spark):
    """Random first neighbours are hardly any of the nearest; rounds of descent find these, until few edges change."""
    n, k = 6000, 10
    x = np.random.default_rng(8).normal(size=(n, 8))
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id bigint, v binary")
    d = ((x[:200, None] - x[None]) ** 2).sum(2)
    d[np.arange(200), np.arange(200)] = np.inf
    want = np.argsort(d, 1)[:, :k]
    shares = []

    def recall(rounds):
        got = nn_descent.neighbours(nodes, n, 16, rounds=rounds, report=lambda r, s: shares.append((r, s))).where("u < 200").toPandas()
        assert np.allclose(got.d, ((x[got.u] - x[got.w]) ** 2).sum(1), rtol=0.05, atol=0.01)
        return sum(len(set(g.w) & set(want[u])) for u, g in got.groupby("u")) / (200 * k)

    assert recall(0) < 0.2
    assert recall(None) > 0.95
    assert [r for r, _ in shares] == [*range(1, len(shares) + 1)] and len(shares) > 2
    assert shares[-1][1] <= nn_descent.DELTA < shares[-2][1]


def test_landmarks_of_many_parts(spark):
    """What the parts send to the driver doesn't grow with their number."""
    index = spark.range(0, 200_000, 1, 100).select("id", F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 256), 16)).alias("v"), F.array("id").alias("near"))
    queries = spark.createDataFrame([], "query_id bigint, v binary, start bigint")
    context = spark.sparkContext
    context.setJobGroup("landmarks", "")
    try:
        assert nn_descent.search(index, queries).count() == 0
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = {i for j in context.statusTracker().getJobIdsForGroup("landmarks") for i in context.statusTracker().getJobInfo(j).stageIds}
    assert 0 < sum(context._jsc.sc().statusStore().lastStageAttempt(i).resultSize() for i in stages) < 4_000_000
    # They are the ones of least hash, also where the hashes looked at are too few at first, and all of a small table.
    want = [r.id for r in index.orderBy(F.xxhash64("id"), "id").select("id").limit(nn_descent.LANDMARKS).collect()]
    assert [r.id for r in nn_descent.landmarks(index, 200_000)] == [r.id for r in nn_descent.landmarks(index, 10**9)] == want
    assert len(nn_descent.landmarks(index.where("id < 7"), 7)) == 7


def test_repeated_short_vectors(spark, monkeypatch):
    """Many repeated vectors aren't broadcast, however short they are."""
    monkeypatch.setattr("mixspark.llm.common.BROADCAST_ROWS", 100)
    twice = spark.range(200).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 100 + 1).cast("float")).alias("embedding"))
    _, members, n, _ = nn_descent.nodes_of(twice, "vec_id", "embedding")
    assert "strategy=broadcast" not in members._jdf.queryExecution().analyzed().toString()
    assert n == 100 and {(r.vec_id, r.id) for r in members.collect()} == {(i, i % 100) for i in range(200)}


def test_language_id(spark, docs, odd, none):
    model = language_id.fit(docs, F.col("doc_id") % 4 != 0)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 0").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9 and got.score.between(0, 1).all()
    und = {str(r.doc_id): r for r in language_id.identify(odd, model).collect()}
    assert und["0"].lang_pred == und["2"].lang_pred == und["13"].lang_pred == "und" and und["3"].lang_pred in model.languages
    empty = language_id.fit(none, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def auc(score, label):
    order = np.argsort(np.argsort(score))
    p = label.sum()
    return (order[label].sum() - p * (p - 1) / 2) / (p * (~label).sum())


def test_quality_and_toxicity_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = quality.fit(docs, train)
    got = quality.score(docs, model).join(held, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy() == 1) > 0.95
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    model = toxicity.fit(docs, train)
    got = toxicity.score(docs, model).join(held, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy() == 1) > 0.75
    assert all(x.score is not None and 0 <= x.score <= 1 for x in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, toxicity.fit(docs, labels.where("doc_id < 0"))).agg(F.max("score")).first()[0] == 0
    assert quality.score(odd, quality.fit(docs, labels.where("doc_id < 0"))).agg(F.min("score")).first()[0] > 0.99


def test_toxic_sentences_are_located(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        s = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(50)}x" for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            s[2] += " grobian"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        assert [("grobian" in r.text.encode()[s.start : s.end].decode()) for s in r.spans] == [True] * (r.doc_id % 4 == 0)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == corpus_pipeline.COLUMNS
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        assert after.select("doc_id").subtract(kept.select("doc_id")).count() == 0
        before, kept = kept, after
    want = {i for i, _, c, _ in brute_components(texts(before)) if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline as c

    def ids(df):
        assert df.columns == c.COLUMNS
        return sorted((r.doc_id for r in df.collect()), key=str)

    some = [*range(14)]
    assert ids(c.distinct(spark, odd, DATA)) == sorted([None, *(set(some) - {6, 8, 9})], key=str)
    kept = ids(c.language(spark, odd, DATA))
    assert not {0, 1, 2, 13} & set(kept) and kept.count(7) in (0, 2)
    assert ids(c.good(spark, odd, DATA)) == sorted([*some, 7, None], key=str)  # all labels among them are 1
    for _, stage in c.STAGES[:-1]:
        assert ids(stage(spark, none, DATA)) == []
    with pytest.raises(ValueError):
        language_id.identify(odd, language_id.fit(none, F.lit(True)), carry=("score",))


def test_jaccard_links_within_clusters(spark):
    # A cluster whose texts differ in a few words each: links between others than its lead count as well.
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(9):
        own = list(words)
        own[7 * i + 3] = f"own{i}"
        if i % 2:
            own[90] = "odd"
        texts.append(" ".join(own))
    texts += [texts[2], " ".join(f"x{i}" for i in range(60)), None, ""]
    got = jaccard_join.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def grams(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [grams(t) for t in texts]
    want = {(a, b) for a in range(9) for b in range(a + 1, 9) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 8  # more than links with one lead
    assert sorted((r.a, r.b) for r in got if not r.same) == sorted(want)
    assert [(r.a, r.b) for r in got if r.same] == [(9, 2)]


def test_requests_are_not_sent_to_the_driver(spark):
    index = spark.range(1000)
    plan = lambda rows: index.join(nn_descent._sided(spark.range(50).withColumnRenamed("id", "of").withColumn("id", F.col("of")), rows), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(1000)
    # Neither for their number nor because they turn out to take few bytes.
    for rows in (100_000, 2_000_000):
        assert "Broadcast" not in plan(rows)
