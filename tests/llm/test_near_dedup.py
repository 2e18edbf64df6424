import random
import re

import numpy as np
import pytest

from stratum.llm.components import components, forest
from stratum.llm.near_dedup import Plan, _confirm, alike_sets, in_pieces, keep_first, main_mask, near_duplicates, settled

MEDIUM = "/root/testdata/sf0.01"


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent=80):
    """rows: (id, text) -> {id: (n_shingles, component)}"""
    have = [(i, sets(t, width)) for i, t in rows]
    parent = {i: i for i, _ in have}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(have):
        for g in s:
            where.setdefault(g, []).append(k)
    seen = set()
    for ks in where.values():
        for x in range(len(ks)):
            for y in range(x):
                if (ks[y], ks[x]) in seen:
                    continue
                seen.add((ks[y], ks[x]))
                (i, a), (j, b) = have[ks[y]], have[ks[x]]
                if 100 * len(a & b) >= percent * len(a | b):
                    ri, rj = find(i), find(j)
                    parent[max(ri, rj)] = min(ri, rj)
    return {i: (len(s), find(i)) for i, s in have}


@pytest.fixture(scope="module")
def planted():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(40)]
    base = [word() for _ in range(60)]
    for i in range(300):  # a hub, its copies (far from each other), unrelated texts sharing a passage
        if i < 120:
            w = list(base)
            for p in ([r.randrange(60)] if i != 77 else []):
                w[p] = word()
        else:
            w = [word() for _ in range(r.randrange(3, 90))] + passage
        rows.append((i * 3 + 1, " ".join(w).title() if i % 2 else "\n".join(w)))
    rows += [(2, rows[5][1]), (3, rows[5][1]), (5, ""), (6, None), (8, "One two"), (9, "one  TWO"), (11, "one")]
    return rows


@pytest.mark.parametrize("plan", [Plan(width=4), Plan(width=4, bucket=40, block=16), Plan(width=4, bucket=7, block=5), Plan(width=4, hot_sample=3, hot_least=4)])
def test_against_brute_force(spark, planted, plan):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, plan).collect()}
    assert got == brute(planted, 4)


def test_whole_table(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = near_duplicates(df, Plan(width=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (4, "a b c d e f", 3), (4, "a b c d e f", 3), (7, "A b c d e f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (0, None, True), (4, 4, True), (4, 4, True), (7, 4, False)]
    assert sorted(r.doc_id or 0 for r in keep_first(df).collect()) == [0, 0, 4, 4]


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    want = {}
    for a, b in edges:
        if b is not None:
            want.setdefault(a, {a}).add(b)
            want.setdefault(b, {b}).add(a)
    parent = {x: x for x in want}
    for _ in range(500):
        for x, near in want.items():
            parent[x] = min([parent[x], *(parent[y] for y in near)])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), small).collect()}
    assert got == {x: p for x, p in parent.items() if want[x] != {x}}


def test_a_large_group_whose_least_member_is_unlike_it(spark):
    """Few are left for the comparison in blocks, and the links are those of all pairs."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    sets = []
    for _ in range(400):  # near copies, of which the first two lie far out
        v = list(base)
        for k in r.sample(range(60), 8 if len(sets) < 2 else r.randrange(0, 2)):
            v[k] = f"x{r.random()}"
        sets.append(sorted({hash(tuple(v[k : k + 3])) % 2**63 for k in range(58)}))
    sets += [sorted(r.sample(range(10**9), 50)) for _ in range(30)]  # unlike all others
    rows = [(5, k, np.array(s, np.uint64).tobytes()) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "grp long, node long, data binary").repartition(4)
    edges, marks = settled(members, alike_sets(80), share=100)
    edges = {tuple(e) for e in edges.collect()}
    like = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    assert all(a != b and like(a, b) for a, b in edges)
    parent = forest(iter(edges))
    marks = {m.node: m.near for m in marks.collect()}
    assert len(marks) == 430 and len({parent[k] for k, near in marks.items() if near}) == 1
    want = forest((a, b) for a in range(430) for b in range(a) if like(a, b))
    assert sum(not near for near in marks.values()) <= 60
    plan = Plan(block=32)
    rest = in_pieces(members, spark.createDataFrame(list(marks.items()), "node long, near boolean").selectExpr("5L grp", "node", "near"), plan.block)
    found = rest.groupBy("grp", "x", "y").applyInArrow(_confirm(plan), "a long, b long").collect()
    assert forest(iter(edges | {tuple(e) for e in found})) == want
    assert main_mask([(1, 1), (2, 1), (6, 1), (12, 1), (0, 9)]) == 14 and main_mask([(3, 1), (6, 1), (12, 1), (0, 9), (16, 2)]) == 15 and main_mask([(0, 5)]) == 0


def test_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text, "a", "b", "c"), (None, text, "a", "b", "c")], "doc_id long, text string, `a.b` string, __gone string, gone string")
    done = keep_first(d)
    assert done.columns == d.columns and sorted(map(tuple, done.collect()), key=str) == [(1, text, "a", "b", "c"), (None, text, "a", "b", "c")]


def test_a_very_long_text(spark):
    r = random.Random(13)
    v = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    x = list(v)
    x[1000:1100] = ["other"] * 100
    d = spark.createDataFrame([(1, " ".join(v)), (2, " ".join(x)), (3, " ".join(v[:150_000]))], "doc_id long, text string")
    assert {(g.doc_id, g.component_id) for g in near_duplicates(d).collect()} == {(1, 1), (2, 1), (3, 3)}
