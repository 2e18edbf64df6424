import re
from collections import Counter

import corpus_pipeline as P
from stratum.llm import pii

from .test_near_dedup import brute

MEDIUM = "/root/testdata/sf0.01"


def shared_windows(texts):
    """Windows of 50 words, not all of a few, that a text shares with one before."""
    seen, n = {}, 0
    for d in sorted(texts):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), texts[d]).split()
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            n += len(set(x)) >= 10 and seen.setdefault(x, d) != d
    return n


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "pii", "packing"]
    columns = docs.columns
    # quality: all that fail the base rule go
    docs = P.quality(spark, docs, MEDIUM).cache()
    left = {r.doc_id for r in docs.collect()}
    for i in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", text[i])
        assert len(w) >= 50 and Counter(w).most_common(1)[0][1] < len(w)
    # near duplicates: one of each group
    groups = brute([(i, text[i]) for i in sorted(left)], 5)
    docs = P.near_duplicates(spark, docs, MEDIUM).cache()
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {i for i, (_, c) in groups.items() if i == c}
    # substrings: texts only get shorter, next to no window of 50 words is left in two of them
    before = {r.doc_id: r.text for r in docs.collect()}
    docs = P.substrings(spark, docs, MEDIUM).cache()
    rows = docs.collect()
    assert {r.doc_id for r in rows} == kept and all(r.n_chars == len(r.text) <= len(text[r.doc_id]) for r in rows)
    assert shared_windows({r.doc_id: r.text for r in rows}) <= 0.02 * shared_windows(before) > 0
    # personal data: nothing that a plain pattern finds is left
    docs = P.personal_data(spark, docs, MEDIUM).cache()
    rows = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in rows} == kept
    assert not any(pii.protected(r.text) for r in rows)
    pieces = P.sequences(spark, docs, MEDIUM).collect()
    assert {r.doc_id for r in pieces} == kept
    whole = P.run(spark, MEDIUM).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty texts, repeated ids and rows, an empty table."""
    words = [" ".join(f"w{(k * 7919 + i * i * 31) % 5003}" for i in range(80)) for k in range(6)]
    rows = [(1, words[0]), (1, words[0]), (1, words[1]), (None, words[2]), (3, None), (4, ""), (5, words[0]), (6, words[3] + " write to a@b.cd"), (7, words[4] + "\n" + words[5])]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    got = P.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} == {1, None, 6, 7} and all(r.length > 0 for r in got)
    assert P.run(spark, str(tmp_path / "b")).count() == 0
