import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import ngram_join as J
from quillspark.llm.components import components

from .helpers import ODD, frame, lower, prose, space_words


def sets(texts, n=3):
    out = []
    for t in texts:
        w = space_words(lower(t or ""))
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(ids, texts, percent=90):
    s, root = sets(texts), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = s[a], s[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in zip(ids, s, strict=True)}


def near(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def cases():
    r, base, passage = random.Random(2), [prose(k, 200, 5000) for k in range(6)], prose(77, 60, 5000)
    texts = list(ODD)
    for k, b in enumerate(base):
        texts += [near(b, 10 * k + j, r.choice([0, 1, 2, 3, 4, 6])) for j in range(12)]
    texts += [passage + " " + prose(500 + k, r.choice([3, 10, 100]), 5000) for k in range(15)]
    chain = prose(9, 300, 5000).split()
    texts += [" ".join(chain[k : k + 250]) for k in range(0, 50, 5)]
    r.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    texts = cases()
    ids = random.Random(3).sample(range(-50, 1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("mark", F.lit(0))
    for percent in (90, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.groups(docs, percent=percent).collect()}
        assert got == brute(ids, texts, percent)


def test_trees_match_sets():
    r = random.Random(1)
    for percent in (90, 80, 60):
        found = sorted({frozenset(s) for s in sets(cases()) if s}, key=sorted)
        number = {g: r.getrandbits(64) for s in found for g in s}
        as_array = [np.array(sorted(number[g] for g in s), np.uint64) for s in found]
        want = list(range(len(found)))
        for a in range(len(found)):
            for b in range(a):
                if want[a] != want[b] and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b]):
                    least, most = sorted((want[a], want[b]))
                    want = [least if x == most else x for x in want]
        sizes = np.array([len(s) for s in found])
        for hub in (np.empty(0, np.uint64), as_array[3], as_array[-1]):
            paths = [np.setxor1d(s, hub, assume_unique=True) for s in as_array]
            assert J.joined(sizes, paths, percent).tolist() == want


def test_many_near_copies_are_divided(spark, monkeypatch):
    """Links are as few as sets however large the group; parts of parts still find every link."""
    monkeypatch.setattr(J, "TILES", 2)
    r = random.Random(8)
    base = prose(41, 120, 5000)
    texts = [near(base, k, r.choice([1, 2, 2, 3, 3, 4, 5])) for k in range(150)] + cases()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.groups(frame(spark, texts), many=6, part=15, room=6000).collect()}
    assert got == brute(range(len(texts)), texts)


def test_large_group_is_linear(spark):
    """2,000 near copies: as many links as sets at most, and parts in proportion."""
    r = random.Random(9)
    base = prose(43, 120, 5000)
    texts = [near(base, k, r.choice([1, 2, 3, 4])) for k in range(2000)]
    s = [x for x in dict.fromkeys(frozenset(x) for x in sets(texts))]
    got = [(x.n_shingles, x.component_id) for x in J.groups(frame(spark, texts)).orderBy("doc_id").collect()]
    number: dict = {}
    arrays = [np.array(sorted(number.setdefault(g, r.getrandbits(64)) for g in x), np.uint64) for x in s]
    root = J.joined(np.array([len(x) for x in s]), arrays, 90)  # held against brute force above
    place, first = {x: k for k, x in enumerate(s)}, {}
    want = [(len(x), first.setdefault(root[place[frozenset(x)]], i)) for i, x in enumerate(sets(texts))]
    assert got == want


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (7, "A b C d"), (8, None)]
    joins = [("b", "one two three"), ("b", "four five six"), ("c", "one two three"), ("a", "four five six"), ("d", "x")]
    found = J.groups(spark.createDataFrame(joins, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [("a", "a"), ("b", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, 4), (None, 0, None), (4, 2, 4), (4, 2, 4), (7, 2, 4), (8, 0, 8)], key=repr)
    assert J.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if x in got} and {x for x, y in root.items() if x != y} <= set(got)


def test_stage(spark):
    texts = ["one two three four", "one two three four", "else here now", None, ""]
    docs = frame(spark, texts)
    out = J.ngram_join_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]


def test_sizes_that_may_be_similar():
    r, some = random.Random(4), 0
    for _ in range(3000):
        percent, n = r.choice([90, 80, 60]), r.randrange(1, 120)
        x = r.sample(range(400), n)
        y = r.sample(x, n - min(n - 1, r.randrange(0, 1 + n // 5))) + r.sample(range(400, 500), r.randrange(0, 1 + n // 5))
        x, y = sorted(x), sorted(y)
        both = set(x) & set(y)
        if 100 * len(both) < percent * len(set(x) | set(y)):
            continue
        some += 1
        fronts = [s[: J.prefix_length(len(s), percent)] for s in (x, y)]
        last = max(set(fronts[0]) & set(fronts[1]))
        for s, front, m in ((x, fronts[0], len(y)), (y, fronts[1], len(x))):
            upto = [g for g in front if g <= last]
            for others in ((), set(upto) - both):  # what only one set has may be in no other prefix, or in another's
                before = sum(g in both or g in others for g in upto)
                lo, hi = J.sizes_met(*(np.array([k]) for k in (len(s), before, len(upto) - before)), percent)
                assert lo[0] <= m <= hi[0]
    assert some > 500


def test_chance_meetings_make_no_blocks(spark, monkeypatch):
    r, seen, written = random.Random(6), {}, J.written
    texts = [prose(1000 + k, r.randrange(100, 125), 50) for k in range(600)]
    texts += [near(texts[k], k, 1) for k in range(20)]
    monkeypatch.setattr(J, "written", lambda df, name: seen.setdefault(f"{name} {len(seen)}", written(df, name)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.groups(frame(spark, texts)).collect()}
    assert got == brute(range(len(texts)), texts)
    assert next(df.count() for name, df in seen.items() if name.startswith("members")) < 200  # about four in ten of the n-grams are met elsewhere
