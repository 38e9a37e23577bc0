"""Lexical search and whitening against plain computations."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from shelfmark.llm import lexical, whitening

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_search(items, docs, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for id, c in counts:
            n = c.total()
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // n_terms)))
                        for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, id is None, id or 0))
        out += [(item, rank, None if without else id, -score)
                for rank, (score, without, id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, items, docs, k, **options):
    found = lexical.search(spark.createDataFrame(items, "item_id long, text string"),
                           spark.createDataFrame(docs, "doc_id long, text string, score string, rank int, item string"), k, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_terms():
    for text in ["", None, "A-b_c9É東京🙂x", "ÀÉ İ", "a\x00b\x7fc\x80d", "  ", "x" * 100_000 + "!Y"]:
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_search_of_odd_rows(spark, monkeypatch):
    base = ["alpha beta gamma", "Alpha ALPHA delta.", "beta", "ümlaut Ümlaut 東京 9", None, "", "--", "alpha " * 4000 + "beta",
            "alpha beta gamma", "epsilon zeta"]
    docs = [(n, t, "clash", 1, "x") for n, t in enumerate(base)] + [(None, "alpha beta", "", 0, ""), (2, "beta", "", 0, "")]
    docs += [(100 + n, "gamma beta", "", 0, "") for n in range(40)]  # ties across the cut
    items = [(1, "alpha, beta!"), (1, "gamma"), (2, None), (3, ""), (None, "Ümlaut 東京"), (4, "alpha alpha"), (4, "alpha alpha"),
             (5, "absent words"), (6, "beta gamma delta epsilon zeta 9")]
    plain = plain_search(items, [d[:2] for d in docs], 7)
    assert ranked(spark, items, docs, 7) == plain and len(plain) > 20
    assert ranked(spark, items, docs, 7, group_items=2, block_items=1) == plain
    monkeypatch.setattr(lexical, "MERGE_FAN_IN", 1)
    assert ranked(spark, items, docs, 7) == plain
    assert ranked(spark, [], docs, 7) == [] and ranked(spark, items, [], 7) == []


def test_vocabulary_tiles_keep_sums_exact(monkeypatch):
    r = np.random.default_rng(1)
    weights = r.integers(0, 28_000, 50)
    rows = [(n, sorted(r.choice(50, 20, replace=False).tolist())) for n in range(9)]
    doc, term = np.divmod(np.flatnonzero(r.random(12 * 50) < 0.5), 50)
    impact = r.integers(0, lexical.MOST_IMPACT, len(doc))
    want = np.zeros((9, 12), np.int64)
    for n, some in rows:
        for d, t, i in zip(doc, term, impact):
            want[n, d] += weights[t] * i * (t in some)
    whole = lexical.Block(rows, weights)
    assert len(whole.edges()) == 2 and (whole.scores(doc, term, impact, 12, 50) == want).all()
    monkeypatch.setattr(lexical, "EXACT", 10 ** 11)
    assert len(whole.edges()) > 4 and (whole.scores(doc, term, impact, 12, 50) == want).all()


def test_impacts_beyond_64_bits():
    tf, n = np.array([3, 1]), np.array([10 ** 9, 7])
    plain = [10 ** 9 * t // (1000 * t + 20 * (50 + 50 * int(m) * 10 ** 10 // 10 ** 13)) for t, m in zip(tf.tolist(), n)]
    assert lexical.impacts(tf, n, 10 ** 10, 10 ** 13).tolist() == plain


@pytest.mark.parametrize("widths", [[3, 0, 5], [40, 41, 2]])
def test_cross_products(widths):
    r = np.random.default_rng(2)
    y = np.stack([r.integers(0, 1 << w, 300) for w in widths], axis=1)
    plain = y.astype(object).T.dot(y.astype(object))
    assert (whitening.cross_products(y, widths) == plain).all()


def plain_whitening(vectors):
    """Exact sums by fractions; components by numpy from the exactly centred covariance."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, dim = len(fit), len(fit[0])
    s = [sum(col) for col in zip(*fit)]
    centred = [[Fraction(v) - Fraction(t, n) for v, t in zip(row, s)] for row in fit]
    v = np.array([[float(sum(row[i] * row[j] for row in centred) / n) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    return x, n, s, values[::-1], vectors[:, ::-1], v


def test_whitening_matches_fractions(spark):
    r = np.random.default_rng(5)
    some = (r.normal(size=(60, 5)) * [1, 2, 0.5, 3, 1.5]).astype(np.float32)
    vectors = [row.tolist() for row in some] + [some[0].tolist()] * 30
    rows = [Row(vec_id=n, embedding=v, n="clash", component=1.0) for n, v in enumerate(vectors)]
    rows += [Row(vec_id=1000 + n, embedding=v, n="", component=0.0)
             for n, v in enumerate([None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5])]
    df = spark.createDataFrame(rows + [Row(vec_id=None, embedding=vectors[3], n="", component=0.0)],
                               "vec_id long, embedding array<float>, n string, component double")
    found = whitening.whiten(df, 16).collect()
    x, n, s, values, e, v = plain_whitening(vectors)
    assert len(found) == 5 * (len(vectors) + 1) and {q.n for q in found} == {n}
    mine = {(q.vec_id, q.component): q for q in found}
    for c in range(5):
        sign = None
        for at, row in enumerate(x):
            q = mine[at, c + 1]
            assert int(q.deviation) == sum((n * a - b) ** 2 for a, b in zip(row, s))
            assert q.explained == pytest.approx(values[c] / np.trace(v), rel=1e-12) and q.identity_error < 1e-9
            want = float(np.dot([float(Fraction(a) - Fraction(b, n)) for a, b in zip(row, s)], e[:, c]) / np.sqrt(values[c]))
            sign = sign or (1 if want * q.whitened > 0 else -1)
            assert q.whitened == pytest.approx(sign * want, rel=1e-8, abs=1e-8)
        assert mine[None, c + 1].whitened == mine[3, c + 1].whitened


def test_degenerate_and_wide_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [7.0]), (4, [1e9, -1e9, 0.0]), (5, [0.0, 5e9, 1.0]),
                                (6, [1e30, 1.0, 1.0]), (7, [3.0, 1.0, 2.0])], "vec_id long, embedding array<double>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(df, 16).collect()}
    assert len(found) == 2 * 2 + 1 + 4 * 3
    assert found[1, 1].whitened is not None and found[1, 2].whitened is None and found[3, 1].whitened is None
    x = [[floor(64 * c) + 1_000_000 for c in v] for v in ([1e9, -1e9, 0.0], [0.0, 5e9, 1.0], [2.0 ** 34, 1.0, 1.0], [3.0, 1.0, 2.0])]
    s = [sum(c) for c in zip(*x)]
    for id, row in zip((4, 5, 6, 7), x):
        assert int(found[id, 1].deviation) == sum((4 * a - b) ** 2 for a, b in zip(row, s))
    assert whitening.whiten(df.limit(0), 16).count() == 0


def test_sampled_rows_of_the_table(spark):
    from shelfmark.llm import queries
    found = queries.op12_whiten(spark, FOLDER).where(F.col("component") <= 2).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x, n, s, values, e, v = plain_whitening([r[1] for r in rows])
    at = {r[0]: k for k, r in enumerate(rows)}
    assert len(found) == 2 * len(rows)
    for q in found:
        row = x[at[q.vec_id]]
        assert q.n == n and q.deviation == sum((n * a - b) ** 2 for a, b in zip(row, s)) and q.identity_error < 1e-4
        want = np.dot([float(Fraction(n * a - b, n)) for a, b in zip(row, s)], e[:, q.component - 1]) / np.sqrt(values[q.component - 1])
        assert abs(q.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)
