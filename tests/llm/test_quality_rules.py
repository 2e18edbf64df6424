import random
import re
from collections import Counter

import pyarrow as pa

from stratum.llm.quality_rules import Rules, assess, keep_good, measured

MEDIUM = "/root/testdata/sf0.01"


def plain(text, rules=Rules()):
    """Figures of one text by the definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {x for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for x in range(k, k + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dups, chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dups += 1
            chars += len(re.sub(r"[\x20\x09-\x0D]", "", x))
        seen.add(x)
    grams = [sum(len(w[x]) for x in covered(n)) for n, _ in rules.gram_share]
    total, repeat = max(1, sum(map(len, w))), len(covered(3))
    failed = len(w) < rules.min_words or 100 * repeat > rules.max_repeat_words * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    bad = failed or 100 * chars > rules.line_share * total or 100 * dups > rules.dup_line_share * max(1, len(lines)) or 100 * symbols > rules.symbols_per_word * len(w) or any(100 * g > most * total for g, (_, most) in zip(grams, rules.gram_share, strict=True))
    return len(w), sum(map(len, w)), symbols, dups, repeat, chars, grams, failed, not bad


def rows(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_line_chars, list(r.dup_gram_chars), r.base_failed, r.kept)) for r in df.collect()]


def test_random_texts():
    r = random.Random(1)
    texts = ["".join(r.choice(["a ", "b ", "é", "#", "\n", "c d e\n", "\x0b", " ", "x y "]) for _ in range(r.randrange(60))) for _ in range(400)]
    m = measured(pa.array(texts), Rules())
    for i, t in enumerate(texts):
        got = (*(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")), [int(g[i]) for g in m["dup_gram_chars"]], bool(m["base_failed"][i]), bool(m["kept"][i]))
        assert got == plain(t), repr(t)


def test_whole_table(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    got = dict(rows(assess(df)))
    assert got == {i: plain(t) for i, t in text.items()}
    assert {r.doc_id for r in keep_good(df).collect()} == {i for i, g in got.items() if g[-1]}


def test_clean_texts_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [(labels[i], g) for i, g in rows(assess(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))) if i in labels]
    good = [g for q, g in got if q and not g[-2]]
    assert sum(g[-1] for g in good) >= 0.995 * len(good)
    assert not any(g[-1] for q, g in got if not q)


def test_edges(spark):
    schema = "doc_id long, text string, kept string, n_words int"
    assert assess(spark.createDataFrame([], schema)).count() == 0 and keep_good(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(300_000))
    data = [(1, None, "x", 1), (1, None, "x", 1), (None, "a b", "x", 1), (2, "", "x", 1), (3, long, "x", 1), (4, "a " * 200_000, "x", 1)]
    df = spark.createDataFrame(data, schema)
    got = rows(assess(df))
    assert sorted(map(str, got)) == sorted(str((i, plain(t))) for i, t, *_ in data)
    kept = keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3]
