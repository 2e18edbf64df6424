import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratum.llm import kernels as K
from stratum.llm.ordinal import SHAPES, Settings, features, fit, score, train

DATA = "/root/testdata/sf0.1"


def graded(labels):
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 0).otherwise(F.col("quality") + 1).alias("grade"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    grades = graded(spark.read.parquet(f"{DATA}/labels.parquet"))
    train_part, test_part = grades.where("doc_id % 3 <> 0"), grades.where("doc_id % 3 = 0")
    model = fit(docs, train_part)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = score(docs.join(test_part, "doc_id"), model).join(test_part, "doc_id").collect()
    share = lambda g: np.mean([r.kept for r in rows if r.grade == g])
    assert share(2) > 0.98 and share(0) < 0.12 and share(1) < 0.12
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_gradient_finds_ordered_grades():
    r = np.random.default_rng(1)
    n = 600
    hot = r.integers(0, 3, n)
    s = Settings(bits=4, least_texts=1, rounds=400, penalty=1e-6)
    m = train(hot, np.arange(n), hot + 3, np.ones(n), s)
    z = m.weight[hot + 3]
    p = m.chances(z)
    assert (np.round(p.sum(axis=1)) == hot).all()


def test_features_do_not_depend_on_the_chunk():
    texts = ["The cat, the CAT!", "", "a b c " * 50, "é" * 300]
    together = [(t, f, v) for _, _, b, o in K.chunks(pa.array(texts)) for t, f, v in zip(*features(b, o, 10), strict=True)]
    for k, x in enumerate(texts):
        b = x.encode()
        alone = [(f, v) for _, f, v in zip(*features(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 10), strict=True)]
        assert sorted(alone) == sorted((f, v) for t, f, v in together if t == k)
        assert len(alone) >= SHAPES


def test_edges(spark):
    schema = "doc_id long, text string, grade int, kept int"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(1, "good text", 2, 0), (1, "good text", 2, 0), (None, None, None, 0), (3, "", 0, 0), (4, "x " * 50_000, 1, 0)], schema)
    model = fit(empty, empty.select("doc_id", "grade"))
    assert score(empty, model).count() == 0
    assert score(rows, model).count() == 5
    model = fit(rows.select("doc_id", "text", "grade"), rows.select("doc_id", "grade"), Settings(rounds=5))
    got = score(rows, model).collect()
    assert len(got) == 5 and all(0 <= g.tail_probability <= 1 and 0 <= g.expected_grade <= 2 for g in got)


def test_a_grade_that_was_not_seen_has_no_chance(spark):
    rows = spark.createDataFrame([(k, ("bad " if k % 2 else "fine ") * 5, k % 2) for k in range(40)], "doc_id long, text string, grade int")
    model = fit(rows.select("doc_id", "text"), rows.select("doc_id", "grade"), Settings(rounds=50))
    assert all(g.tail_probability == 0 and not g.kept for g in score(rows, model).collect())
    assert any(g.kept for g in score(rows, model, tail=1).collect())


def test_the_sample_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k % 7, f"text {k} of many", k % 3) for k in range(60)], "doc_id long, text string, grade int")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(7)], "doc_id long, grade int")
    one, two = (fit(rows.select("doc_id", "text").repartition(n), ratings, Settings(sample=20, rounds=5, least_texts=1)) for n in (1, 5))
    assert np.allclose(one.weight, two.weight) and np.allclose(one.thresholds, two.thresholds)


def test_likelihood_by_brute_force():
    """The fit ends where the penalised likelihood, written out text by text, has no slope in weights or thresholds."""
    r = np.random.default_rng(5)
    n, s = 90, Settings(bits=4, least_texts=1, rounds=4000, penalty=0.05)
    x = r.integers(0, 2, (n, 3))
    grade = np.clip(x[:, 0] + x[:, 1] + r.integers(-1, 2, n), 0, 2)
    text, feature = np.nonzero(x)
    m = train(grade, text, feature, np.ones(len(text)), s)

    def loss(w, t):
        total = 0.0
        for i in range(n):
            tail = [1.0, *(1 / (1 + np.exp(k - float(w @ x[i]))) for k in t), 0.0]
            total -= np.log(tail[grade[i]] - tail[grade[i] + 1]) / n
        return total + s.penalty / 2 * float(w @ w)

    w, t = m.weight[:3].astype(float), m.thresholds.copy()
    assert np.abs(w).max() > 0.1 and t[0] < t[1]
    for v, k in [(w, k) for k in range(3)] + [(t, k) for k in range(2)]:
        v[k] += 1e-3
        up = loss(w, t)
        v[k] -= 2e-3
        down = loss(w, t)
        v[k] += 1e-3
        assert abs(up - down) / 2e-3 < 2e-3, (k, (up - down) / 2e-3)
