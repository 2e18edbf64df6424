import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from stratum.llm.sharding import BITS, Dimension, cell, hilbert, quantiles, scale, shards, write

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{j} int" for j in range(n))).select(F.struct(*(f"c{j}" for j in range(n))).alias("__cell"))
    got = df.select("__cell.*", hilbert([F.col("__cell")] * n, bits).alias("h")).collect()
    path = [tuple(r)[:n] for r in sorted(got, key=lambda r: r.h)]
    assert sorted(r.h for r in got) == list(range(1 << bits * n))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(path))


def verify(rows, got, n):
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.size, g.text_crc32) for g in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g.slot)
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    order = [g.curve for g in sorted(got, key=lambda g: (g.shard, g.slot))]
    assert order == sorted(order)
    assert {g.law for g in got} <= {"rows"} and all(g.grown_shard is None for g in got)


def test_whole_table(spark, tmp_path):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    verify([(r.doc_id, r.text) for r in df.collect()], shards(df.repartition(7)).collect(), 8)
    plan = shards(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    write(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 8
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, df.collect()))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, curve int"
    assert shards(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a", None, "s", 1, "x", 0), (None, "a", None, "s", 1, "x", 0), (3, None, "en", None, None, "x", 0), (3, "é" * 50_000, "en", "s", -5, "y", 1), (4, "", "de", "t", 10**15, "y", 1)]
    df = spark.createDataFrame(rows, schema)
    verify([(r[0], r[1]) for r in rows], shards(df).collect(), 8)
    verify([(r[0], r[1]) for r in rows], shards(df, 2, (Dimension("lang"), Dimension("n_chars", "number"))).collect(), 2)


def test_cells_keep_the_order(spark):
    rows = [(None, None)] + [("en" if k % 3 else f"n{k % 40:02}", float(k % 700)) for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, n double")
    dims = (Dimension("lang"), Dimension("n", "number"))
    q = quantiles(df, dims)
    assert [len(x) for x in q] == [254, 254] and all(x == sorted(x) for x in q)
    got = df.select("lang", "n", *(cell(scale(F.col(d.column), d.kind), b).alias(f"c{k}") for k, (d, b) in enumerate(zip(dims, q, strict=True)))).collect()
    for v, c in (("lang", "c0"), ("n", "c1")):
        pairs = sorted({(r[v], r[c]) for r in got if r[v] is not None})
        assert [c for _, c in pairs] == sorted(c for _, c in pairs) and len({c for _, c in pairs}) > 30
        assert all(1 <= c < 1 << BITS for _, c in pairs) and {r[c] for r in got if r[v] is None} == {0}
    assert quantiles(df.where("false"), dims) == [None, None]


def test_shards_prune_by_each_dimension(spark):
    """Share of shards whose minimum and maximum admit a filter, against an order by a hash and by single dimensions."""
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    many = 64
    place = shards(df, many).select("doc_id", "shard")
    rows = df.select("doc_id", "lang", "source", "n_chars").join(place, "doc_id").collect()
    order = {
        "curve": {r.doc_id: r.shard for r in rows},
        "hash": {r.doc_id: r.doc_id * 7919 % 1009 % many for r in rows},
        "lang": {r.doc_id: k * many // len(rows) for k, r in enumerate(sorted(rows, key=lambda r: (r.lang, r.doc_id * 7919 % 1009)))},
        "n_chars": {r.doc_id: k * many // len(rows) for k, r in enumerate(sorted(rows, key=lambda r: (r.n_chars, r.doc_id)))},
    }

    def read(name, column):
        low, high = {}, {}
        for r in rows:
            s = order[name][r.doc_id]
            low[s], high[s] = min(low.get(s, r[column]), r[column]), max(high.get(s, r[column]), r[column])
        values = sorted(r[column] for r in rows)
        cuts = sorted({values[k * len(values) // 10] for k in range(10)})
        return sum(low[s] <= x <= high[s] for x in cuts for s in low) / len(cuts) / len(low)

    share = {n: {c: read(n, c) for c in ("lang", "source", "n_chars")} for n in order}
    assert all(share["curve"][c] < 0.45 and share["curve"][c] < 0.6 * share["hash"][c] for c in ("lang", "source", "n_chars")), share
    worst = {n: max(x.values()) for n, x in share.items()}
    assert worst["curve"] < 0.6 * min(worst["lang"], worst["n_chars"], worst["hash"]), share


def test_rows_of_any_kind_are_written(spark, tmp_path):
    rows = [(None, "a", "en", "s", 1, "x", "y"), (None, "a", "en", "s", 1, "x", "y"), (3, None, None, None, None, "p", "q"), (3, "b", "de", "t", 5, "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __slot string")
    write(df, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect()), key=str) == sorted(rows, key=str) and back.columns == [*df.columns, "shard"]
    with pytest.raises(ValueError, match="already"):
        write(df.withColumnRenamed("__slot", "shard"), str(tmp_path / "no"), 2)
