import random

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import kernels as K
from stratum.llm import substring_dedup
from stratum.llm.components import forest
from stratum.llm.sieve import passes, sieve
from stratum.llm.storage import saved
from stratum.llm.substring_dedup import Plan, cut, cuts, repeats

MEDIUM = "/root/testdata/sf0.01"


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def prose(r, n):
    w = words(r, n)
    for i in range(0, n, 9):
        w[i] = w[i].title()
        if i:
            w[i - 1] += "."
    return w


def test_cuts_depend_on_near_words_only():
    r = random.Random(1)
    passage = prose(r, 120)
    inner = []
    for _ in range(20):
        text = " ".join([*prose(r, r.randrange(3, 50)), *passage, *prose(r, r.randrange(3, 50))]).encode()
        at = text.index(" ".join(passage).encode())
        w = K.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True)
        lead = int(np.searchsorted(w.start, at))
        c = cuts(w, 6) - lead
        assert np.diff(c).min() > 6 or len(c) < 2
        inner.append([int(x) for x in c if 7 <= x < 113])
    assert all(x == inner[0] for x in inner) and len(inner[0]) >= 4


def test_cuts_against_plain(spark):
    r = random.Random(2)
    texts = [" ".join(prose(r, r.randrange(0, 60))) for _ in range(50)]
    # texts that begin in lower case after ones that end a sentence, a line or neither
    texts += [" ".join(words(r, r.randrange(1, 30))) + r.choice(["", ".", "\n", "!\n\n"]) for _ in range(200)]
    one = []
    for _, _, buf, off in K.chunks(pa.array(texts)):
        w = K.Words(buf, off, lower=True)
        c = cuts(w, 6)
        for d in range(len(texts)):
            one.append([int(x) - int(w.first[d]) for x in c if w.first[d] <= x < w.first[d + 1]])
    for d, t in enumerate(texts):  # a text alone is cut as it is among others
        b = t.encode()
        alone = [int(x) for x in cuts(K.Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), lower=True), 6)]
        assert alone == one[d]


@pytest.mark.parametrize("piece", [128, 2])
def test_planted_passages(spark, piece):
    r = random.Random(3)
    rows, at = [], {}
    passages = [prose(r, n) for n in (55, 70, 120, 200)]
    for i in range(120):
        w, p = prose(r, 80), passages[i % 4] if i < 40 else []
        if i in (36, 37):  # near copies: one word differs
            p = list(p)
            p[30] = "changed"
        k = r.randrange(80)
        rows.append((i, " ".join(w[:k] + p + w[k:])))
        if p:
            at[i] = (len(" ".join(w[:k])) + (k > 0), len(" ".join(w[:k] + p)), len(p))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = repeats(df, Plan(piece=piece)).collect()
    assert all(s.doc_id in at and s.keep_doc_id in at and s.keep_doc_id % 4 == s.doc_id % 4 for s in spans)
    found = {s.doc_id: 0 for s in spans}
    for s in spans:
        assert s.start >= at[s.doc_id][0] and s.end <= at[s.doc_id][1]
        found[s.doc_id] += s.n_words
    # all go but the first of each, whole, to the exact borders; of the near copies, one word may stay
    assert set(found) == set(range(4, 40)), sorted(set(range(4, 40)) ^ set(found))
    for s in spans:
        if s.doc_id not in (36, 37):
            assert (s.start, s.end, s.n_words) == at[s.doc_id], (s, at[s.doc_id])
    assert all(found[i] >= at[i][2] - 1 for i in (36, 37))
    done = {x.doc_id: x.text for x in cut(df).collect()}
    text = dict(rows)
    for i, t in text.items():
        gone = sum(s.end - s.start for s in spans if s.doc_id == i)
        assert len(done[i]) == len(t) - gone


def test_edges(spark):
    assert repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = random.Random(4)
    p = " ".join(prose(r, 90))
    rows = [(1, p, 1), (1, p, 1), (2, None, 2), (3, "", 3), (None, p, 4), (5, p, 5), (6, "a b", 6), (7, "a b", 7), (5, "x y z", 5), (9, "word " * 30_000, 9), (10, "word " * 30_000, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit int")
    got = {(s.doc_id, s.start, s.n_words, s.keep_doc_id) for s in repeats(df).collect()}
    assert got == {(5, 0, 90, 1), (10, 0, 30_000, 9)}
    done = cut(df)
    assert done.columns == df.columns and done.count() == len(rows)
    assert {x.text for x in done.where("doc_id is null").collect()} == {p}


@pytest.mark.parametrize(("piece", "hot"), [(128, 8), (3, 8), (128, 1)])
def test_near_copies_of_paragraphs_by_brute_force(spark, piece, hot):
    """Removed paragraphs are those of a brute-force comparison of all pairs, up to the stated recall."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        w = words(r, 60)
        x = list(w)
        x[r.randrange(60)] = "other"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
    w = words(r, 60)
    for i in range(200, 225):  # one large group
        x = list(w)
        x[r.randrange(60)] = f"other{i}"
        rows.append((i, " ".join(x)))
    plan = Plan(reach=15, min_words=1, piece=piece, hot_sample=2, hot_least=hot, extend=False)
    units = []
    for d, t in rows:
        b = t.encode()
        c = [*(int(x) for x in cuts(K.Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), lower=True), plan.reach)), 60]
        v = t.split()
        units += [(d, {tuple(v[i : i + 5]) for i in range(s, max(s + 1, e - 4))} if e - s >= 5 else {tuple(v[s:e])}, e - s) for s, e in zip(c, c[1:], strict=False)]
    want = {}
    for k, (d, s, n) in enumerate(units):
        if any(100 * len(s & z) >= 80 * len(s | z) for _, z, _ in units[:k]):
            want[d] = want.get(d, 0) + n
    got = {}
    for s in repeats(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect():
        got[s.doc_id] = got.get(s.doc_id, 0) + s.n_words
    assert all(got[d] <= want.get(d, 0) for d in got)
    assert sum(got.values()) >= 0.97 * sum(want.values()) and len(want) > 50


def test_near_copies_of_whole_paragraphs(spark):
    """Production settings: lines that are near copies go whole, edit and all, as a brute-force comparison of lines says."""
    r = random.Random(7)
    rows = []
    for i in range(40):
        w = words(r, 60)
        x = list(w)
        x[r.randrange(5, 55)] = "other"
        rows += [(2 * i, "\n".join(" ".join(v) for v in (words(r, 30), w))), (2 * i + 1, "\n".join(" ".join(v) for v in (x, words(r, 30))))]
    shingles = lambda v: {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
    units, want = [], {}
    for d, t in rows:
        for line in t.split("\n"):
            s = shingles(line.split())
            if any(100 * len(s & z) >= 80 * len(s | z) for z in units):
                want[d] = (t.index(line), t.index(line) + len(line))
            units.append(s)
    assert set(want) == set(range(1, 80, 2))
    got = {s.doc_id: (s.start, s.end) for s in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[d][0] <= a and z <= want[d][1] for d, (a, z) in got.items())
    assert sum(got[d] == want[d] for d in got) >= 0.95 * len(want), {d: (got.get(d), want[d]) for d in want if got.get(d) != want[d]}


def test_a_passage_of_a_removed_paragraph_stays_elsewhere(spark):
    """A near copy takes its edit with it; another document that has the edited passage must keep it."""
    r = random.Random(8)
    w, own = words(r, 400), words(r, 30)
    x = [*w[:200], *own, *w[200:]]
    rows = [(1, " ".join(w)), (2, " ".join(x)), (3, " ".join([*words(r, 40), *own, *words(r, 40)]))]
    done = {d.doc_id: d.text for d in cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done[1] == rows[0][1] and done[2] == "" and done[3] == rows[2][1]


def test_passages_of_little_over_fifty_words(spark):
    """Inside longer lines, in varied places: all go but for a word or two at a border, most to the exact border."""
    r = random.Random(9)
    rows, want = [], {}
    for n, size in enumerate((51, 52, 55, 60, 80) * 20):
        p = words(r, size)
        for k in range(2):
            a, z = words(r, r.randrange(0, 40)), words(r, r.randrange(0, 40))
            if k:
                want[2 * n + 1] = (len(" ".join([*a, ""])), len(" ".join([*a, *p])), size)
            rows.append((2 * n + k, " ".join([*a, *p, *z])))
    got = {s.doc_id: (s.start, s.end, s.n_words) for s in repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) <= set(want)
    exact = sum(got.get(d) == w for d, w in want.items())
    near = sum(d in got and abs(got[d][2] - w[2]) <= 4 for d, w in want.items())
    assert exact >= 0.85 * len(want) and near >= 0.98 * len(want), (exact, near, len(want), [(got.get(d), w) for d, w in want.items() if got.get(d) != w][:5])


def test_every_word_removed_stays_somewhere(spark):
    """On the table: each five-word shingle of the removed text is still there in some text, or its paragraph has a kept near copy."""
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    before = {x.doc_id: x.text or "" for x in df.collect()}
    after = {x.doc_id: x.text or "" for x in cut(df).collect()}
    spans = repeats(df).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
    grams = lambda v: {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
    left = set().union(*(grams(low(t)) for t in after.values()))
    lost = total = 0
    for s in spans:
        g = grams(low(before[s.doc_id][s.start : s.end]))
        total += len(g)
        lost += len(g - left)
    assert total > 10_000 and lost < 0.1 * total, (lost, total)
    for d, t in before.items():
        gone = sorted((s.start, s.end) for s in spans if s.doc_id == d)
        assert after[d] == "".join(t[a:b] for a, b in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(t)], strict=True))


def test_recall_of_exact_repeats_on_the_table(spark):
    """Words inside 50-word windows that stay in two texts after the cut, against those before."""
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")

    def windows(rows):
        seen, again = {}, 0
        for x in sorted(rows, key=lambda x: x.doc_id):
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in x.text or "").split()
            hit = np.zeros(len(v), bool)
            for k in range(len(v) - 49):
                w = tuple(v[k : k + 50])
                if len(set(w)) < 10:
                    continue  # runs of one word
                if seen.setdefault(w, x.doc_id) != x.doc_id:
                    hit[k : k + 50] = True
            again += int(hit.sum())
        return again

    before, after = windows(df.collect()), windows(cut(df).collect())
    assert before > 10_000 and after <= 0.02 * before, (before, after)


def test_results_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    one, two = (sorted(map(tuple, repeats(df.repartition(n)).collect())) for n in (2, 7))
    assert one == two and len(one) > 50


def test_texts_of_one_id_are_documents_of_their_own(spark):
    r = random.Random(10)
    p, other, alone = words(r, 90), words(r, 80), words(r, 80)
    rows = [(1, " ".join(p)), (2, " ".join(p)), (2, " ".join(other)), (2, " ".join(other)), (3, " ".join(alone)), (3, None), (None, " ".join(p))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = sorted(map(tuple, cut(df).collect()), key=str)
    assert done == sorted([(1, rows[0][1]), (2, ""), rows[2], rows[3], rows[4], rows[5], rows[6]], key=str)
    assert [(s.doc_id, s.n_words, s.keep_doc_id) for s in repeats(df).collect()] == [(2, 90, 1)]


def test_columns_of_any_name(spark):
    r = random.Random(11)
    p = " ".join(words(r, 90))
    rows = [(k, p, "a", "b", "c", "d", "e", len(p)) for k in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __spans string, copy string, spans string, c1 string, n_chars int")
    done = cut(df)
    assert done.columns == df.columns and [f.dataType for f in done.schema.fields] == [f.dataType for f in df.schema.fields]
    assert sorted(map(tuple, done.collect())) == [rows[0], (2, "", "a", "b", "c", "d", "e", 0)]


def test_units_are_neither_sorted_nor_all_placed(spark, monkeypatch):
    """Classes are grouped by hash, texts and placed units joined by hash; ids that do not fit into one long with a place give the same."""
    r = random.Random(12)
    shared = [prose(r, 40) for _ in range(4)]
    rows = [(k, "\n".join(" ".join(x) for x in (prose(r, 30), shared[k % 4], prose(r, 25) + shared[(k + 1) % 4] + prose(r, 20)))) for k in range(24)]
    plans = {}

    def seen(df, name, *args, **kwargs):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return saved(df, name, *args, **kwargs)

    monkeypatch.setattr(substring_dedup, "saved", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(map(tuple, repeats(df).collect()))
    assert all("SortAggregate" not in p for p in plans["paragraphs"]) and len(plans["paragraphs"]) == 2
    assert all("SortMergeJoin" not in p for name in ("sets", "collided") for p in plans[name])
    far = 2**62
    two = sorted(map(tuple, repeats(df.withColumn("doc_id", df.doc_id - far)).collect()))
    strip = lambda spans, by: [(s[0] + by, *s[1:4], s[4] + by) for s in spans]
    assert strip(two, far) == strip(one, 0) and len(one) > 20


def test_sieve(spark):
    r = np.random.default_rng(13)
    keys = r.integers(-(2**63), 2**63 - 1, 30_000, dtype=np.int64)
    filled = sieve(saved(spark.createDataFrame([(int(k),) for k in keys], "k long"), "keys")).value
    assert passes(filled, keys).all()
    assert passes(filled, r.integers(-(2**63), 2**63 - 1, 30_000, dtype=np.int64)).mean() < 0.02
    assert not passes(sieve(saved(spark.createDataFrame([], "k long"), "keys")).value, keys).any()


def test_verified_pairs_by_brute_force():
    """Groups of any size: the pairs connect what all linked pairs connect."""
    r = random.Random(14)
    lists, node = [], 0
    for _ in range(60):
        base, members = r.sample(range(1, 2**40), 12), []
        for _ in range(r.randrange(1, 14)):
            s = {x if r.random() < 0.93 else r.randrange(2**40) for x in base[: r.randrange(10, 13)]}
            members.append({"node": node, "shingles": np.array(sorted(s), np.uint64).tobytes(), "set": s})
            node += 1
        lists.append(members)
    wanted = [(a["node"], b["node"]) for g in lists for a in g for b in g if a["node"] < b["node"] and 100 * len(a["set"] & b["set"]) >= 80 * len(a["set"] | b["set"])]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("shingles", pa.binary())]))
    plain = [[{k: m[k] for k in ("node", "shingles")} for m in g] for g in lists]
    batch = pa.RecordBatch.from_arrays([pa.array([[], *plain], kind).slice(1)], names=["members"])
    found = [tuple(sorted(x.values())) for b in substring_dedup._verify(Plan())(iter([batch])) for x in b.to_pylist()]
    assert set(found) <= set(wanted) and forest(iter(found)) == forest(iter(wanted)) and len(wanted) > 50


def test_unlike_sets_are_not_read_in_full(monkeypatch):
    """Pairs of any size are judged as by sets, and of a pair that shares nothing few values are read."""
    r, sets, read = random.Random(15), [], []
    for _ in range(120):
        base = r.sample(range(1, 2**50), r.choice((1, 2, 9, 10, 40)))
        sets += [set(base), {x if r.random() < 0.9 else r.randrange(2**50) for x in base}, set(base[: len(base) * 4 // 5]) or {1}]
    flat, ends = np.array([x for s in sets for x in sorted(s)], np.uint64), np.r_[0, np.cumsum([len(s) for s in sets])]
    a, b = (np.array([r.randrange(len(sets)) for _ in range(3000)]) for _ in range(2))
    a[:1000], b[:1000] = (at := np.arange(1000) % 120 * 3), at + 1 + np.arange(1000) // 120 % 2
    within = substring_dedup._within
    monkeypatch.setattr(substring_dedup, "_within", lambda *x: read.append(len(x[3])) or within(*x))
    wanted = [100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for x, y in zip(a, b, strict=True)]
    assert substring_dedup._alike(flat, ends, a, b, 80).tolist() == wanted and 300 < sum(wanted) < 1500
    del read[:]
    x = np.arange(0, 2000, dtype=np.uint64)
    assert not substring_dedup._alike(x, np.array([0, 1000, 2000]), np.array([0]), np.array([1]), 80)[0] and sum(read) < 200
    monkeypatch.setattr(substring_dedup, "_DENSE", 64)  # several tables
    some = sets[:30]
    counts = substring_dedup._shared(flat[: ends[30]], np.diff(ends[:31]))
    assert counts.tolist() == [[len(x & y) for y in some] for x in some]


def test_classes_are_not_looked_up_by_number(spark, monkeypatch):
    """Where ids and places fit into one long, the units to compare are found without a join with all classes."""
    r, plans = random.Random(16), {}
    line = prose(r, 30)
    rows = [(k, 0, "\n".join(" ".join(x) for x in (prose(r, 12), [*line[:-1], f"word{k}"], line))) for k in range(6)]

    def seen(df, name, *args, **kwargs):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return saved(df, name, *args, **kwargs)

    monkeypatch.setattr(substring_dedup, "saved", seen)
    src = spark.createDataFrame(rows, "doc_id long, copy long, text string")
    gone = substring_dedup._gone(src, substring_dedup.WHOLE, True, True)
    assert sorted((g["doc_id"], g["begin"], g["stop"], g["keep"]["doc_id"]) for g in gone.collect()) == sorted([(0, 42, 72, 0), *((k, at, at + 30, 0) for k in range(1, 6) for at in (12, 42))])
    assert all("f1#" not in p for p in plans["collided"])  # the table of all classes is not read


@pytest.mark.parametrize(("piece", "rare"), [(128, 16), (16, 2)])
def test_a_phrase_in_many_unlike_units(spark, monkeypatch, piece, rare):
    """Of a large group under one key all linked pairs are found, and units that only have its phrase in common are not put into blocks."""
    r, sets, phrase = random.Random(17), [], random.Random(18).sample(range(2**62), 2)
    whole = r.sample(range(2**62), 40)
    for k in range(400):  # unlike but for the phrase, some with a copy that lacks one value
        own = [*phrase, *r.sample(range(2**62), r.choice((4, 8, 30)))]
        sets += [set(own), *([set(own[:-1])] if k % 5 == 0 else [])]
    sets += [{*phrase, *(x if r.random() < 0.95 else r.randrange(2**62) for x in whole)} for _ in range(60)]  # near copies
    groups = [(1, range(len(sets))), (2, range(0, len(sets), 2))]
    wanted = {(a, b) for _, g in groups for a in g for b in g if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    placed, in_pieces = [], substring_dedup.in_pieces

    def seen(members, *args):
        placed.append(in_pieces(members, *args))
        return placed[-1]

    monkeypatch.setattr(substring_dedup, "in_pieces", seen)
    monkeypatch.setattr(substring_dedup, "_RARE", rare, raising=False)
    many = spark.createDataFrame([(key, n) for key, g in groups for n in g], "key long, node long")
    data = spark.createDataFrame([(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in enumerate(sets)], "node long, shingles binary")
    found = [(min(e), max(e)) for e in substring_dedup._hot_keys(many, data, Plan(piece=piece)).collect()]
    assert set(found) <= wanted and forest(iter(found)) == forest(iter(wanted)) and len(wanted) > 200
    nodes = {x.node for p in placed for x in p.select("node").distinct().collect()}
    assert len([n for n in nodes if n < len(sets) - 60]) <= 20
