import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratum.llm.packing import fill, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def best(lengths, room):
    """Fullest sum of a multiset within room, by plain search."""
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_minimum_bin_slack(seed):
    r = random.Random(seed)
    cap = r.choice([10, 37, 64])
    left = Counter(r.randint(1, cap) for _ in range(r.randrange(1, 60)))
    for items, times in fill(dict(left), cap):
        for _ in range(times):
            top = max(left)
            assert items[0][0] == top
            others = list((left - Counter([top])).elements())
            assert sum(x * n for x, n in items) == top + best(others, cap - top)
            for x, n in items:
                left[x] -= n
                assert left[x] >= 0
            left = +left
    assert not left


def test_fill_bound():
    r = random.Random(9)
    counts = {x: r.randrange(1, 10**9) for x in range(1, 4097)}
    plan = fill(counts)
    assert len(plan) < 37_000
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in plan) <= -(-total // 4096) * 1.03


def check(rows, got, cap, end=1):
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")
        for p in range(-(-len(ids) // cap)):
            part = ids[p * cap : (p + 1) * cap]
            want[i].append((p, p * cap, len(part), zlib.crc32(part.tobytes())))
    have = defaultdict(list)
    bins = defaultdict(list)
    for g in got:
        have[g.doc_id].append((g.piece, g.start, g.length, g.ids_crc32))
        bins[g.sequence_id].append((g.offset, g.length))
    assert {i: sorted(x) for i, x in have.items()} == {i: sorted(x) for i, x in want.items()}
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    return len(bins)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for cap in (4096, 100):
        n = check(rows, pack(df.repartition(5), PATH, cap).collect(), cap)
        total = sum(r.length for r in pack(df, PATH, cap).select("length").collect())
        assert n <= -(-total // cap) * 1.005 + 1


def test_edges(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    r = random.Random(1)
    odd = ["<|endoftext|> a<|startoftext|>b", "á ́b", " x y \u0085z", "ΑΣ ΣΑΣ İstanbul ǅ", "it's we'll 'S", "x" * 5000, "1234 5 " * 3000, "\x1c a\x0bb\x0cc", " \n\t ", "<|ENDOFTEXT|> The<|endoftext|>.", "The the THE. the, ThE***", "é. ×. É!! ÷, 9. ,.", "don't. X's! '. a'."]
    chars = "aZ9 \t\n'.é́ ß中👍‍퟿#"
    odd += ["".join(r.choice(chars) for _ in range(80)) for _ in range(150)]
    rows = [*enumerate(odd), (1000, None), (1001, ""), (1001, ""), (5, odd[5])]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    check(rows, pack(df, PATH).collect(), 4096)
    one = pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH, with_ids=True).collect()
    assert len(one) == 1 and one[0].doc_id is None and zlib.crc32(one[0].ids) == one[0].ids_crc32
