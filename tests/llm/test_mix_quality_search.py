"""Mixing, quality, lookup sketches and top-k search."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import Row, functions as F

from shelfmark.llm import iblt, mixing, quality, topk


def brute_seats(votes, seats):
    won = {p: 0 for p in votes}
    for _ in range(seats):
        best = max(votes, key=lambda p: (votes[p] / (2 * won[p] + 1), -p))
        won[best] += 1
    return won


def test_apportion_against_one_seat_at_a_time(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(25):
        votes = {p: r.choice([0, 1, 7, r.randint(1, 100), r.randint(1, 10 ** 6)]) for p in range(r.randint(1, 9))}
        seats = r.choice([0, 1, 3, 50, 400]) if sum(votes.values()) else 0
        rows += [(g, p, float(v), seats) for p, v in votes.items()]
        want.update({(g, p): n for p, n in brute_seats(votes, seats).items()})
    df = spark.createDataFrame(rows, "g int, p int, v double, seats long")
    found = {(x.g, x.p): x.blocks for x in mixing.apportion(df, "g", "p", "v", "seats").collect()}
    assert found == want


def mix_rows():
    r = random.Random(9)
    rows = [Row(doc_id=n, text=" ".join("w" * r.randint(0, 300)), source=r.choice(["a", "b", "b", "b", "É", None]), size="clash", k=1)
            for n in range(300)]
    return rows + [Row(doc_id=None, text="no id here", source="a", size="", k=0), Row(doc_id=5, text=None, source="z", size="", k=0),
                   rows[0], rows[0], Row(doc_id=900, text="one " * 9000, source="b", size="", k=0)]


def test_mix_equals_sql_and_keeps_its_limits(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string, size string, k int").repartition(3)
    got = mixing.mix(df, [3, 1, 2], shard_docs=20)
    found = sorted(map(tuple, got.collect()), key=str)
    con = duckdb.connect()
    docs = df.select("doc_id", "text", "source").toArrow()  # noqa: F841  (read by name)
    con.register("documents", docs)
    assert found == sorted(con.execute(mixing.mix_sql([3, 1, 2], shard_docs=20)).fetchall(), key=str)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in found)
    assert found == sorted(map(tuple, mixing.mix(df.repartition(7), [3, 1, 2], shard_docs=20).collect()), key=str)
    per = {}
    for _, _, total, target, taken in found:
        per.setdefault((total, target), []).append(taken)
    for (total, target), taken in per.items():
        assert target <= 2 * total and abs(sum(taken) - target) <= 2 * mixing.BLOCK
    assert mixing.mix(df.limit(0), [3, 1, 2]).count() == 0


def test_targets_by_sharing_excess_again_and_again(spark):
    for sizes in ([1000, 10, 10, 500], [0, 5], [100], [3, 3, 3, 3, 90]):
        df = spark.createDataFrame([(chr(97 + n), s) for n, s in enumerate(sizes)], "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(df, [3, 1, 2], 1.5, 2).collect()}
        left, target, free = 1.5 * sum(sizes), {}, {chr(97 + n): (2.0 * s, [3, 1, 2][n % 3]) for n, s in enumerate(sizes)}
        while free:
            level = left / sum(w for _, w in free.values())
            full = [s for s, (limit, w) in free.items() if limit <= level * w]
            for s in full or free:
                target[s] = free[s][0] if full else level * free[s][1]
            left -= sum(free[s][0] for s in full)
            free = {s: x for s, x in free.items() if full and s not in full}
        assert all(abs(found[s] - target[s]) < 1e-6 for s in target)


def test_mixed_documents(spark):
    df = spark.createDataFrame([(n, "word " * 100, "b" if n < 60 else "a", n) for n in range(80)] + [(500, None, "a", 7)],
                               "doc_id long, text string, source string, times int")
    out = mixing.mixed_documents(df, [3, 1, 2])
    assert out.columns == df.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2 and times[500] == 1
    assert all(times.get(n) == 2 for n in range(60, 80))  # source a stops at twice its size
    assert abs(sum(times.get(n, 0) for n in range(60)) - 80) <= 2


def test_quality(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))
    good = [". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(6)) + "." for _ in range(150)]
    bad = [" ".join([word()] * 60) if n % 2 else " ".join(word() + "%%%" for _ in range(60)) for n in range(150)]
    rows = [(n, t, r.choice(["x", "y", None]), r.choice(["en", None]), "clash") for n, t in enumerate(good + bad)]
    rows += [(9000, None, None, None, ""), (9001, "", "new", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence string")
    labels = spark.createDataFrame([(n, int(n < 150)) for n in range(0, 300, 2)] + [(3, None), (None, 1), (10 ** 9, 0)], "doc_id long, quality int")
    model = quality.train(df, labels)
    found = {x.doc_id: x for x in quality.judge(df, model).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[n].keep == (n < 150) for n in range(1, 300, 2)]) > 0.97
    assert all(0 <= x.posterior <= 1 for x in found.values())
    kept = quality.good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(x.keep for x in found.values())
    assert quality.judge(df, {}).where("not keep").count() == 0
    assert quality.judge(df.limit(0), model).count() == 0
    assert quality.train(df, labels.limit(0)) == {} and quality.train(df, labels.where("quality = 1")) == {}


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("big", "p", 1.0)] * 400 + [("big", "q", 1.0)] * 2 + [("poor", "p", -4.0)] * 400 + [("tiny", "p", -4.0)]
    judged = spark.createDataFrame(rows, "h string, p string, e double")
    found = {(r.host, r.path): 1 / (1 + np.exp(-r.prior)) for r in quality.group_posteriors(judged, {}, host="h", path="p", evidence="e").collect()}
    own = {"big": 1 / (1 + np.exp(-1)), "poor": 1 / (1 + np.exp(4)), "tiny": 1 / (1 + np.exp(4))}
    assert abs(found["big", "p"] - own["big"]) < 0.02 and abs(found["poor", "p"] - own["poor"]) < 0.02
    assert found["tiny", "p"] > found["poor", "p"] + 0.02


def test_sketch_recovers_differences(spark):
    r = random.Random(1)
    pairs = []
    for n in (0, 1, 5, 30, 120):
        base = [r.getrandbits(63) for _ in range(n)]
        pairs += [(base, base), (base, base[:n // 2] + [r.getrandbits(63) for _ in range(n // 3)]), (base, [r.getrandbits(63) for _ in range(n)])]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a array<long>, b array<long>")
    for ladder in (iblt.CELLS, (6,)):  # six cells fail for most pairs, which then are compared directly
        found = {x.n: x.d for x in df.select("n", iblt.differing(F.col("a"), F.col("b"), ladder).alias("d")).collect()}
        for n, (a, b) in enumerate(pairs):
            assert sorted((x.n, x.k) for x in found[n]) == sorted([(1, k) for k in set(a) - set(b)] + [(-1, k) for k in set(b) - set(a)])
    alone = df.select("n", iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), 96), iblt.sketch(F.col("b"), 96)), 96).alias("d"))
    assert {x.n for x in alone.collect() if x.d is not None} >= {0, 1, 2, 3, 4, 5, 6, 7, 8, 9}


def test_edits_and_neighbours(spark):
    texts = {3: "First line here.\nSecond line there. Third one.\n" * 20, 1: "Ünë zwö drei. " * 40, 7: None, 9: "", 12: "x" * 5000, 5: "short"}
    rows = [Row(doc_id=i, text=t, next="clash", range=1) for i, t in texts.items()] + [Row(doc_id=1, text=texts[1], next="", range=0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, next string, range int").repartition(3)
    found = sorted(iblt.compare_with_edits(df).collect(), key=lambda r: r.doc_id)
    ordered = sorted((r.doc_id, r.text or "") for r in rows)
    assert [r.doc_id for r in found] == [i for i, _ in ordered]
    prints = {}
    for n, (row, (i, text)) in enumerate(zip(found, ordered)):
        after = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert row.n_chars == len(text)
        if i != 1:  # of the twin rows either may be the first
            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
    assert found[-2].near_next < 0.1
    many = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    pairs = {r.id: r.next for r in iblt.with_next(many).collect()}
    assert pairs == {n * 7: f"text {(n + 1) % 3000}" for n in range(3000)}
    single = iblt.compare_with_edits(df.where("doc_id = 5")).first()
    assert single.near_next == 1.0
    assert iblt.compare_with_edits(df.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    r = random.Random(2)
    vectors = [(n, [r.choice([-0.5, 0.0, 0.25, 1 / 3]) for _ in range(3)], 1) for n in range(0, 240)]
    vectors += [(500, None, 1), (600, [1.0, None, 0.0], 1), (700, [float("nan"), 0.0, 1.0], 1), (800, [float("inf"), 0.0, 0.0], 1),
                (900, [1.0, 2.0], 1), (1000, [2.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (7, vectors[7][1], 2), (1100, [], 1), (1200, [], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int").repartition(4)
    clean = [(i, tuple(np.floor(1024 * np.array(v, float)).astype(int).tolist())) for i, v, _ in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in clean:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i and len(v) == len(q))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:10])]
    for sizes in ({}, {"shard_values": 60, "block_values": 6}):
        found = topk.top_k(df, F.col("vec_id") % 100 == 0, 10, **sizes)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_scores_past_double_precision():
    q, s = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 30, 3.0], [2.0 ** 50, 0.0]])
    assert topk.scores(q, s).tolist() == [[2 ** 63 - 1, 2 ** 63 - 1]]
    assert topk.scores(np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 30, 3.0]])).tolist() == [[2 ** 60 + 3]]


def test_copies_share_what_the_mix_takes(spark):
    rows = [(None, "word " * 100, "a", n) for n in range(60)] + [(None, "word " * 100, "b", n) for n in range(30)] + [
        (n, "other " * 100, "c", n) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").repartition(4)
    for volume in (0.4, 0.9, 1.3):
        out = mixing.mixed_documents(df, [3, 1, 2], volume=volume)
        assert out.columns == df.columns
        found = {x.source: x["count"] for x in out.groupBy("source").count().collect()}
        targets = {x.source: x.target / 100 for x in mixing.source_targets(
            df.groupBy("source").agg((F.count("*") * 100).alias("size")), [3, 1, 2], volume, 2).collect()}
        assert all(abs(found.get(s, 0) - t) <= 2 for s, t in targets.items()), (volume, found, targets)
        times = [x["count"] for x in out.groupBy("source", "mark").count().collect()]
        assert max(times) <= 2


def test_likeness_counts_phrases_at_every_length(spark):
    r = random.Random(6)
    rows = []
    for n, (words, step) in enumerate(((300, 100), (8000, 500), (8000, 100), (20000, 200), (9000, 10))):
        text = [f"w{r.randint(0, 3000)}" for _ in range(words)]
        edited = [w if at % step else "changed" for at, w in enumerate(text)]
        rows.append((n, " ".join(text), " ".join(edited)))
    rows.append((9, "one two.\nthree four.\n" * 500, "one two.\nthree four.\n" * 500 + "five."))
    df = spark.createDataFrame(rows, "n int, a string, b string").select(
        "n", iblt.phrases(F.col("a")).alias("a"), iblt.phrases(F.col("b")).alias("b"))
    for x in df.select("n", "a", "b", iblt.likeness(F.col("a"), F.col("b")).alias("like")).collect():
        a, b = set(x.a), set(x.b)
        assert abs(x.like - 2 * len(a & b) / (len(a) + len(b))) < 1e-12


def test_few_sketches_are_built_again(spark):
    """Sketches of the intended number of digests peel at the first size but for a few in a hundred."""
    keys = F.transform(F.sequence(F.lit(1), F.lit(iblt.BUCKET)), lambda n: F.xxhash64(F.col("id"), n))
    peeled = spark.range(4000).select(iblt.peel(iblt.sketch(keys, iblt.CELLS[0]), iblt.CELLS[0]).alias("found"))
    sizes = {r["n"]: r["count"] for r in peeled.groupBy(F.size("found").alias("n")).count().collect()}
    again = sizes.pop(None, 0) + sizes.pop(-1, 0)
    assert set(sizes) == {iblt.BUCKET} and again < 0.045 * 4000
