"""Whitening and the hidden Markov model against plain Python."""
import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, markov, queries, whitening

KIND = "vec_id long, embedding array<double>, label int, x string, n long, component int"


def brute_whitening(rows, components):
    """(n, deviations by row, whitened by row, explained), from fractions; rows are vectors or None."""
    dim = max(len(r) for r in rows)
    xs = [[min(max(math.floor(64 * c), -(1 << 62)), 1 << 62) + 1_000_000 for c in r] + [1_000_000] * (dim - len(r)) for r in rows]
    fit = [list(t) for t in {tuple(x) for x in xs}]
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(dim)]
    mean = [Fraction(v, n) for v in s]
    far = np.array([[n * x[d] - s[d] for d in range(dim)] for x in fit], object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in far.T @ far])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    away = np.array([[float(x[d] - mean[d]) for d in range(dim)] for x in xs])
    k = min(components, dim)
    return n, [sum((n * x[d] - s[d]) ** 2 for d in range(dim)) for x in xs], away @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)), e[:k] / np.trace(v)


def check_whitening(df, rows, components=16):
    n, deviations, white, explained = brute_whitening([r for _, r in rows], components)
    got = collections.defaultdict(list)
    for r in whitening.whiten(df, components).collect():
        got[r.vec_id].append(r)
        assert r.n == n and r.identity_error < 1e-6 and abs(r.explained - explained[r.component - 1]) < 1e-9
    ids = [i for i, _ in rows]
    for k, i in enumerate(ids):
        if ids.count(i) > 1:
            continue
        for r in got[i]:
            assert int(r.deviation) == deviations[k]
            assert abs(abs(r.whitened) - abs(white[k, r.component - 1])) < 1e-6 * max(1, abs(white[k, r.component - 1]))
    k = min(components, max(len(r) for _, r in rows))
    assert sum(map(len, got.values())) == k * len(rows)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 9]]) for k in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (None, rows[4][1]), (7, rows[5][1]), (102, [0.5, 0.25]), (103, [])]
    bad = [(200, None), (201, [1.0, None]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows + bad], KIND).repartition(4)
    check_whitening(df, rows)
    check_whitening(df, rows, 2)


def test_whitening_large_entries(spark):
    # Beyond doubles' whole numbers: digits, and Python integers in the projection.
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=3) * [1e13, 1e9, 3]]) for k in range(40)]
    check_whitening(spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], KIND).repartition(3), rows, 2)
    far = spark.createDataFrame([(1, [1e307, 1.0], 1, "x", 2, 3), (2, [-1e307, 0.0], 1, "x", 2, 3), (3, [0.0, 5.0], 1, "x", 2, 3)], KIND)
    assert whitening.whiten(far).count() == 6


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, "x", 2, 3) for k in range(9)], KIND)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 18 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in rows)
    flat = spark.createDataFrame([(k, [float(k), 2.0], 1, "x", 2, 3) for k in range(9)], KIND)
    assert {(r.component, r.whitened is None) for r in whitening.whiten(flat).collect()} == {(1, False), (2, True)}
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0


def test_scatter_exact():
    rng = np.random.default_rng(5)
    for most in (9, 1 << 20, 1 << 33, 1 << 62):
        y = rng.integers(-most, most, (3000, 3))
        s, c = whitening.scatter(y)
        big = y.astype(object)
        assert (s == big.sum(0)).all() and (c == big.T @ big).all()


def test_op12(spark):
    r = queries.op12_whiten(spark, "/root/testdata/sf0.001")
    e = common.read(spark, "/root/testdata/sf0.001", "embeddings").collect()
    n, deviations, white, explained = brute_whitening([x.embedding for x in e], 16)
    at = {x.vec_id: k for k, x in enumerate(e)}
    rows = r.collect()
    assert len(rows) == 16 * len(e) and dict(r.dtypes)["deviation"] == "bigint"
    for x in rows:
        k = at[x.vec_id]
        assert x.n == n and x.deviation == deviations[k] and abs(abs(x.whitened) - abs(white[k, x.component - 1])) < 1e-6 and abs(x.explained - explained[x.component - 1]) < 1e-9


# ---- hidden Markov model ------------------------------------------------------------------------
DOCS = "doc_id long, text string, row string, k int, token long, c int, n long"
LONG = " ".join(f"w{k % 37} the" for k in range(3000))
TEXTS = ["", None, "one", "The cat THE dog the end", "the cat sat on the mat " * 9, LONG, "été 日本  x", "z" * 70_000 + " the", "  lead\n\nand trail\t", "der Hund und die Katze " * 8]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, TEXTS[k % len(TEXTS)] if k < 20 else f"word{k % 5} the word{k % 3} und k{k}") for k in range(80)]
    rows += [(None, "the cat"), (3, TEXTS[3]), (3, TEXTS[4])]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], DOCS).repartition(3).cache()


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def plain_base(rows):
    of = collections.Counter()
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    for (_, t), h in zip(rows, held):
        if not h:
            of.update(plain_words(t))
    total, distinct = sum(of.values()), len(of)
    return [(i, h, len(w), sum(of[x] > 0 for x in w), total, sum(math.log10((of[x] + 1) / (total + distinct + 1)) for x in w)) for (i, t), h in zip(rows, held) for w in [plain_words(t)]], of


def plain_likelihood(m, ids):
    a = [m.start[s] * m.emit[ids[0], s] for s in range(len(m.start))]
    total = 0.0
    for t in range(len(ids)):
        if t:
            a = [sum(a[r] * m.step[r, s] for r in range(len(a))) * m.emit[ids[t], s] for s in range(len(a))]
        total += math.log10(sum(a))
        a = [x / sum(a) for x in a]
    return total


def compare(rows, got, m, vocab, of):
    base, _ = plain_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = []
    for (i, t), b in zip(rows, base):
        words = plain_words(t)
        kinds, rest = [], 0.0
        for w in words:
            raw = markov.tokens(w)[0] if w is not None else markov.END
            k = vocab.words[: markov.CLASSES].index(raw) if raw in vocab.words[: markov.CLASSES] else None
            if k is None:
                k = markov.CLASSES + min(len(raw), markov.SHORT) - 1
                rest += math.log10((of[w] + 1) / (sum(vocab.rest[k - markov.CLASSES]) + 1))
            kinds.append(k)
        want.append((*b, plain_likelihood(m, kinds) + rest))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_scores(spark, texts):
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    _, of = plain_base(rows)
    vocab = markov.vocabulary(common.materialize(markov.counts(texts), "counts"))
    m = markov.train(common.materialize(markov.encoded(texts, vocab), "encoded"), vocab)
    compare(rows, markov.language_scores(texts).collect(), m, vocab, of)


@pytest.mark.parametrize("classes, listed", [(6, 12), (3, 3)])
def test_small_tables(spark, texts, monkeypatch, classes, listed):
    monkeypatch.setattr(markov, "CLASSES", classes)
    monkeypatch.setattr(markov, "LISTED", listed)
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    _, of = plain_base(rows)
    vocab = markov.vocabulary(common.materialize(markov.counts(texts), "counts"))
    assert len(vocab.words) <= listed and sorted(vocab.counts, reverse=True) == vocab.counts == sorted(of.values(), reverse=True)[: len(vocab.counts)]
    assert vocab.total == sum(of.values()) and vocab.distinct == len(of)
    assert sum(n for n, _ in vocab.rest) + sum(vocab.counts[:classes]) == vocab.total
    assert sum(k for _, k in vocab.rest) + len(vocab.words[:classes]) == vocab.distinct


def test_unlisted_words_join(spark, texts):
    """Two listed words only: nearly all words meet their counts in the join."""
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    base, of = plain_base(rows)
    counted = common.materialize(markov.counts(texts), "counts")
    full = markov.vocabulary(counted)
    few = markov.Vocabulary(full.total, full.distinct, full.words[:2], full.counts[:2], full.rest)
    enc = common.materialize(markov.encoded(texts, few), "encoded")
    each = enc.select("row", F.explode("rare").alias("x")).join(counted, F.col("x.token") == F.col("token"), "left")
    known = each.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("x.k")).otherwise(0)).alias("k"))
    got = enc.join(known, "row", "left").select("doc_id", "n", (F.col("known") + F.coalesce("k", F.lit(0))).alias("known")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((b[0], b[2], b[3]) for b in base)


def test_recursions():
    rng = np.random.default_rng(6)
    emit = rng.random((20, 3))
    step = rng.random((3, 3))
    m = markov.Model(np.array([0.2, 0.3, 0.5]), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    n = np.array([1, 7, 30, 7, 2])
    ids = rng.integers(0, 20, n.sum()).astype(np.uint16)
    starts = np.cumsum(n) - n
    plain = [plain_likelihood(m, ids[a : a + k]) for a, k in zip(starts, n)]
    assert markov.forward(m, ids, starts, n) == pytest.approx(plain)
    for k in (1, 2, 255, 256, 257, 1000):
        long = rng.integers(0, 20, k).astype(np.uint16)
        assert markov.long_forward(m, long) == pytest.approx(plain_likelihood(m, long))
    old, markov.SLICE = markov.SLICE, 300
    try:
        assert markov.long_forward(m, long) == pytest.approx(plain_likelihood(m, long))
    finally:
        markov.SLICE = old
    # Expected counts from the sum over all paths of one short sequence.
    x = ids[1:8]
    weight, s, t, e = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
    for path in np.ndindex(*[3] * len(x)):
        p = m.start[path[0]] * math.prod(m.emit[w, k] for w, k in zip(x, path)) * math.prod(m.step[a, b] for a, b in zip(path, path[1:]))
        weight += p
        s[path[0]] += p
        for a, b in zip(path, path[1:]):
            t[a, b] += p
        for w, k in zip(x, path):
            e[w, k] += p
    got = markov.expected(m, x, np.array([0]), np.array([len(x)]))
    for a, b in zip(got, (s / weight, t / weight, e / weight, math.log10(weight))):
        assert np.allclose(a, b)


def test_training_raises_likelihood_and_beats_base(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    vocab = markov.vocabulary(common.materialize(markov.counts(docs), "counts"))
    ids = common.materialize(markov.encoded(docs, vocab), "encoded").where("not held_out").select("ids")
    m, seen = markov.first_model(vocab, 4), []
    for _ in range(4):
        m, found = markov.baum_welch(ids, m, vocab)
        seen.append(found)
    assert all(b > a for a, b in zip(seen, seen[1:]))
    s = queries.op13_markov_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1] + 0.02 * abs(s[1])


def test_language_scores_empty(spark, texts):
    assert markov.language_scores(texts.where("doc_id < 0")).count() == 0
    only = texts.where("doc_id is not null and " + "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    rows = markov.language_scores(only).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
