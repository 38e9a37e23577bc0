"""SimHash classes and near copies, substring repeats: against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import Row

from shelfmark.llm import repeats, simhash
from shelfmark.llm.components import components


def brute_fingerprint(text, shingle):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(r, n):
    return [f"w{r.randint(0, 400)}" for _ in range(n)]


def corpus(seed=5):
    r = random.Random(seed)
    texts = [None, "", " \t ", "One", "ONE", "one two", "Ünë ÜNË"]
    for _ in range(40):
        base = prose(r, r.randint(30, 200))
        texts += [" ".join(base)] * r.choice([1, 1, 2, 5])
        for _ in range(r.choice([0, 1, 6])):
            copy = list(base)
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 99)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def test_pivot_search_is_exact(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2 ** 64, 300, dtype=np.uint64, endpoint=False)
    flips = [int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 7), replace=False)) for b in base for _ in range(4)]
    fps = sorted({int(x) for x in [*base, *flips]})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for tile in (simhash.TILE, 3):
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, tile=tile).collect()
        for a, b in links:
            assert bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4
        want = brute_components([(a, b) for k, a in enumerate(signed) for b in signed[:k]
                                 if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4], signed)
        assert brute_components([tuple(x) for x in links], signed) == want


def test_near_duplicates_by_fingerprint(spark):
    texts = corpus()
    rows = [Row(doc_id=n * 3, text=t, fp="clash", id=0) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, fp string, id long").repartition(5)
    found = simhash.near_duplicates(simhash.fingerprints(df, shingle=4), 4).collect()
    assert len(found) == len(rows) + 2
    marks = {r.doc_id: brute_fingerprint(r.text, 4) for r in rows}
    ids = list(marks)
    want = brute_components([(a, b) for k, a in enumerate(ids) for b in ids[:k] if bin(marks[a] ^ marks[b]).count("1") <= 4], ids)
    for row in found:
        assert row.fp & (2 ** 64 - 1) == marks[row.id] and row.component_id == want[row.id]
    assert simhash.near_duplicates(simhash.fingerprints(df.limit(0), shingle=4), 4).count() == 0


def test_representatives(spark):
    r = random.Random(8)
    base = prose(r, 300)
    near = [*base[:-1], "changed"]
    far = [*prose(r, 150), *base[:150]]
    rows = [(4, " ".join(base), "a"), (2, " ".join(near), "b"), (9, " ".join(base), "c"), (7, " ".join(far), "d"),
            (None, " ".join(base), "e"), (7, " ".join(far), "d"), (1, None, "f"), (3, "", "g"), (5, "short", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, member string")
    left = simhash.representatives(df)
    assert left.columns == df.columns
    assert sorted((x.doc_id or -1, x.member) for x in left.collect()) == [(1, "f"), (2, "b"), (5, "h"), (7, "d")]
    assert simhash.representatives(df.limit(0)).count() == 0


def test_copies_without_ids_keep_one_row(spark):
    r = random.Random(9)
    base = prose(r, 200)
    near = base[:190] + ["other"] * 3 + base[193:]
    rows = [(None, " ".join(base), "a"), (None, " ".join(base), "a"), (None, " ".join(near), "b"), (None, " ".join(prose(r, 50)), "c")]
    left = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, member string")).collect()
    assert len(left) == 2 and {x.member for x in left} in ({"a", "c"}, {"b", "c"})


def test_overlaps_of_sets():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, top, n).astype(np.uint64)) for n, top in [(0, 9), (5, 9), (40, 60), (40, 60), (300, 9000), (300, 500), *[(30, 90)] * 12]]
    found = simhash.overlaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(np.intersect1d(a, b))


def test_texts_alike_below_the_limit_write_few_pairs(spark, monkeypatch):
    """300 texts of similarity about 0.7 to each other, in one large bucket, and a pair of real copies among them."""
    r = random.Random(3)
    base = prose(r, 400)
    texts = []
    for n in range(300):
        words = list(base)
        for at in range(n % 17, 400, 47):
            words[at] = f"own{n}x{at}"
        texts.append(" ".join(words))
    texts.append(texts[7].replace("own7x7", "again"))
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    written, seen = simhash.written, {}

    def noted(frame, label):
        out = written(frame, label)
        seen[label] = seen.get(label, 0) + out.count()
        return out
    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "SET_TILE", 100)
    found = {x.id: x.component_id for x in simhash.similar_texts(df).collect()}
    sets = [simhash.shingle_set(t, 5) for t in texts]
    want = list(range(301))
    for a in range(301):
        for b in range(a):
            if simhash.jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert found == dict(enumerate(want)) and found[300] == found[7]
    assert sum(seen[k] for k in ("open-pairs", "first-links")) < 20 * 301


def test_components_of_a_long_path_and_a_star(spark):
    path = [(n, n + 1) for n in range(1, 40)]
    star = [(1000, n) for n in range(1001, 1200)] + [(1000, 1000), (None, 5), (5, None)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert found == {**{n: 1 for n in range(2, 41)}, **{n: 1000 for n in range(1001, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    """rows: (key, words) in order; rows with equal keys stand at one place."""
    first = {}
    for key, words in rows:
        for p in range(len(words) - length + 1):
            w = tuple(words[p:p + length])
            first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for key, words in rows:
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            if first[tuple(words[p:p + length])] < (key, p):
                gone[p:p + length] = [True] * length
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def repeat_corpus(seed):
    r = random.Random(seed)
    passages = [[f"p{r.randint(0, 30)}" for _ in range(r.randint(15, 60))] for _ in range(8)]
    texts = [None, "", "few words", "same " * 70, "same " * 70, "ab " * 33 + "  x" + " ab" * 30]
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 5)):
            words += [f"w{r.randint(0, 50)}" for _ in range(r.randint(0, 40))]
            passage = r.choice(passages)
            a = r.randint(0, len(passage) - 5)
            words += passage[a:a + r.randint(5, 60)]
        texts.append(r.choice(["  ", "\n", " "]).join(words))
    return texts


def test_repeats_against_brute_force(spark):
    for seed, bits in ((1, repeats.TABLE_BITS), (2, 8)):  # a full table lets everything pass and changes nothing
        texts = repeat_corpus(seed)
        rows = [Row(doc_id=None if n == 9 else 2 * n, text=t, mark=1, first="clash") for n, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, mark long, first string").repartition(4)
        found = {r.doc_id: tuple(r)[1:] for r in repeats.kept_words(df, bits=bits).collect()}
        want = brute_repeats([(-1 if r.doc_id is None else r.doc_id, [w.decode() for w in (r.text or "").encode().split()]) for r in rows], 20)
        for key, *rest in want:
            assert found[None if key == -1 else key] == tuple(rest)


def test_rows_with_one_id(spark):
    text = " ".join(f"w{n}" for n in range(50))
    other = " ".join(f"v{n}" for n in range(30)) + " " + text
    df = spark.createDataFrame([(1, text), (1, text), (1, other), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeats.kept_words(df).collect())
    # equal rows stand at one place; of the two texts with id 1 one repeats the other
    assert found in ([(1, 50, 0), (1, 50, 0), (1, 80, 50), (2, 50, 50)], [(1, 50, 50), (1, 50, 50), (1, 80, 0), (2, 50, 50)])
    assert repeats.kept_words(df.limit(0)).count() == 0


def test_cut_keeps_columns_and_white_space(spark):
    passage = " ".join(f"p{n}" for n in range(30))
    df = spark.createDataFrame([("x", 1, passage + "\n\nown  words here"), ("y", 2, "start\t" + passage + "\nend  now"),
                                ("z", 3, passage), ("n", 4, None), ("e", 5, "")], "repeats string, doc_id long, text string")
    found = {r.doc_id: (r.repeats, r.text) for r in repeats.cut_repeats(df).collect()}
    assert found == {1: ("x", passage + "\n\nown  words here"), 2: ("y", "start\tend  now"), 4: ("n", None), 5: ("e", "")}


def test_similar_texts_against_brute_force(spark):
    """Appended, truncated and word-edited copies around 0.8, whatever their fingerprints."""
    r = random.Random(12)
    texts = []
    for n in range(60):
        base = [f"v{r.randint(0, 5000)}" for _ in range(r.randint(60, 400))]
        more = [f"v{r.randint(0, 5000)}" for _ in range(len(base))]
        texts.append(base)
        for share in (0.78, 0.8, 0.81, 0.83, 0.85):  # similarity of the copy, about
            kind, cut = r.randrange(3), round(len(base) * share)
            if kind == 0:
                texts.append(base + more[:round(len(base) / share) - len(base)])
            elif kind == 1:
                texts.append(base[:cut])
            else:
                copy = list(base)
                for at in range(0, len(base), round(5 * (1 + share) / (1 - share))):
                    copy[at] = "changed"
                texts.append(copy)
    passage = prose(r, 60)  # common to unlike texts
    texts += [passage + prose(r, 40) for _ in range(40)]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a)
             if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(links) > 100
    want = brute_components(links, range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for tile in (simhash.TILE, 8):
        assert {x.id: x.component_id for x in simhash.similar_texts(df, tile=tile).collect()} == want


def test_a_large_group_of_copies_is_linked_whole(spark):
    r = random.Random(3)
    base = prose(r, 200)
    texts = []
    for n in range(120):
        copy = list(base)
        copy[r.randrange(200)] = f"x{n}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in simhash.representatives(df, tile=50).collect()] == [0]


def test_links_are_decided_by_exact_similarity(spark):
    rows, want = [], {}
    for n in range(60):
        base = [f"f{n}x{k}" for k in range(304)]  # 300 shingles; 240 of them are 0.8, 239 are less
        cut = base[:244 - n % 2]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(cut))]
        want |= {2 * n: 2 * n, 2 * n + 1: 2 * n + n % 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.id: x.component_id for x in simhash.similar_texts(df).collect()} == want
