import hashlib
import math
import random
import re

from stratum.llm.pii import KIND_ENTITIES, Limits, base_spans, entities, entity, joined, luhn, personal_data, protected, sanitise, secrets

MEDIUM = "/root/testdata/sf0.01"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_luhn():
    assert luhn("4532015112830366") and not luhn("4532015112830367") and luhn("0")


def test_base_against_plain_patterns():
    r = random.Random(1)
    bits = ["a", "B.", "@", "x-1", ".", "1", "255", "256", "012", " ", "-", "+", "(", ")", "é", "\n", "4532015112830366", "4111 1111 1111 1111", "+1 (499) 555-6503", "me.x@mail.example.com", "10.0.0.1"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        assert base_spans(t) == plain(t), t


def test_whole_table_and_method(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in personal_data(df).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        s = plain(t)
        g = got[i]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == n for _, k, _ in s) for n in range(4))
        assert g.base_sha256 == hashlib.sha256(joined(s).encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and x.split(":")[0] in ("email", "ip", "card", "phone")] == [x for x in joined(s).split(",") if x]


def disclosing_plainly(texts, lim=Limits()):
    """Terms that disclose, word by word: a plain version of the method."""
    near, n_e, n_t, held = {}, {}, {}, {}
    for d, text in enumerate(texts):
        spans = protected(text or "")
        who = {x for a, k, z in spans for x in entities(k, text[a:z])}
        for e in who:
            n_e[e] = n_e.get(e, 0) + 1
        words = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            s, e = m.span()
            for _ in range(2):
                s += e - s > 1 and text[s] in ".,;:!?()[]\"'"
                e -= e - s > 1 and text[e - 1] in ".,;:!?()[]\"'"
            words.append((s, e, re.sub("[A-Z]", lambda x: x[0].lower(), text[s:e])))
        for t in {w for _, _, w in words}:
            n_t[t] = n_t.get(t, 0) + 1
            for e in who:
                held[e, t] = held.get((e, t), 0) + 1
        seen = {}
        for a, k, z in spans:
            at = [i for i, (s, e, _) in enumerate(words) if e > a and s < z] or [next((i for i, (s, _, _) in enumerate(words) if s >= z), len(words))]
            some = [i for i in range(at[0] - lim.reach, at[-1] + 1 + lim.reach) if 0 <= i < len(words) and not any(words[i][1] > p and words[i][0] < q for p, _, q in spans)]
            context = tuple(words[i][2] for i in some)
            for e in entities(k, text[a:z]):
                for i in some:
                    if words[i][1] - words[i][0] >= lim.least_letters:
                        seen.setdefault((e, words[i][2]), set()).add(context)
        for k, c in seen.items():
            near.setdefault(k, []).append(c)
    bad = set()
    for (e, t), docs in near.items():
        least = set().union(*docs)  # which of a text's contexts stands for it does not matter where each has one
        ic = math.log2(len(texts) / n_e[e])
        both = len(docs) if e in KIND_ENTITIES else held[e, t]
        if min(len(docs), len(least)) >= lim.support and ic > 0 and math.log2(both * len(texts) / (n_e[e] * n_t[t])) >= lim.share * ic:
            bad.add(t)
    return bad


def test_terms_of_the_table_by_brute_force(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in df.collect()}
    bad = disclosing_plainly(list(docs.values()))
    assert bad == {"token"}  # the word that stands before secrets
    found = 0
    for g in personal_data(df).collect():
        t = docs[g.doc_id]
        got = [tuple(map(int, x.split(":")[1:])) for x in g.spans.split(",") if x.startswith("term")]
        assert got == [m.span() for m in re.finditer(r"(?<![^\s.,;:!?()\[\]\"'])token(?![^\s.,;:!?()\[\]\"'])", t)]
        assert g.n_term == len(got) and g.personal == bool(g.spans) and g.n_secret == len(secrets(t, base_spans(t)))
        found += bool(got)
    assert found >= 10


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert secrets(f'token = "{key}" x', []) == [(9, 4, 49)] and secrets(key, [(0, 0, 3)]) == []
    assert [e - s for s, _, e in secrets("Zm9vYmFy1QiOjE2MDk0NTkyMDB9== 550e8400-e29b-41d4-a716-446655440000", [])] == [29, 36]
    for clean in ("internationalisation-of-the-2020-report", "4532015112830366453201511283", "aaaaaaaaaaaaaaaaaaaaaaaa", "https://example.com/articles/2020/10/15/how-to-read-books", "1a1a1a1a1a1a1a1a1a1a1a1a"):
        assert secrets(clean, []) == [], clean


def test_disclosing_terms_by_brute_force(spark):
    """Values, shared parts and kinds, with the terms near, far, and in texts without the entity."""
    r = random.Random(2)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rows = []
    for i in range(400):
        w = [r.choice(common) for _ in range(30)]
        if i % 10 == 0:
            w[14:16] = ["nickname,", f"person{i // 100}@mail.example.com", f"Codeword{i // 100}"]
        if i % 20 == 5:
            w[9:10] = ["Server", f"10.20.{i // 100}.{i % 100}", "rack"]  # each address once, the networks often
        if i % 20 == 15:
            w[20:21] = ["reachable", f"+49 30 {1000000 + i * 7919}"]  # all numbers differ
        if i % 40 == 7:
            w[3] = "rack"  # also elsewhere
        rows.append((i, " ".join(w)))
    rows += [(300, None), (300, ""), (None, "nickname person1@mail.example.com Codeword")]
    bad = disclosing_plainly([t for _, t in rows])
    assert {"codeword0", "codeword3", "nickname", "server", "reachable"} <= bad and "rack" not in bad and not bad & set(common)
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, e string").repartition(4)
    got = personal_data(d).collect()
    assert len(got) == len(rows)
    want = sorted((i or -1, m.start(), m.end()) for i, t in rows for m in re.finditer(r"[A-Za-z]\w*", t or "") if m[0].lower() in bad and not any(a <= m.start() < z for a, _, z in protected(t)))
    assert sorted((g.doc_id or -1, int(x.split(":")[1]), int(x.split(":")[2])) for g in got for x in g.spans.split(",") if x.startswith("term")) == want
    clean = sanitise(d)
    assert clean.columns == d.columns
    text = {x.doc_id: x.text for x in clean.collect()}
    assert len(text) == len({i for i, _ in rows}) and text[300] in (None, "")
    assert "example.com" not in "".join(t or "" for t in text.values()) and "[TERM], [EMAIL] [TERM]" in text[0]
    assert text[1] == rows[1][1]


def test_empty_and_long(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "1" * 200_000 + " " + "a" * 200_000 + "@b.c " + "." * 1000 + "9." * 50_000
    assert base_spans(t)[0] == (200_001, 0, 400_005) and [k for _, k, _ in base_spans(t)] == [0] + [1] * 12_500
    assert secrets("a1b2c3d4" * 50_000, []) == [(0, 4, 400_000)]
    assert entity(2, "4532 0151 1283 0366") == entity(2, "4532015112830366")
    got = personal_data(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert got.n_email == 1


def test_disclosing_terms_go_wherever_they_stand(spark):
    r = random.Random(3)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rows = []
    for i in range(400):
        w = [r.choice(common) for _ in range(60)]
        if i < 12:
            w[20] = "hidden@mail.example.com"
            w[21 if i < 6 else 50] = "Codeword"  # near in half of the documents, far in the others
            w[55] = "codeword,"
        elif i == 12:
            w[5] = "codeword"  # without the entity
        rows.append((None if i == 12 else i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {g.doc_id: g.spans for g in personal_data(d).collect()}
    for i, t in rows:
        want = [(m.start(), m.end()) for m in re.finditer("(?i)codeword", t)]
        assert [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("term")] == want, i
    assert not any("codeword" in x.text.lower() for x in sanitise(d).collect())


def test_sanitise_rows_that_repeat_an_id_or_have_none(spark):
    r = random.Random(4)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rows = []
    for i in range(200):
        w = [r.choice(common) for _ in range(30)]
        if i < 10:
            w[14:16] = ["hidden@mail.example.com", "Codeword"]
        if i == 1:
            w[2] = "10.0.0.1"  # other base spans than the row with the same id
        rows.append((None if i in (2, 3) else 7 if i < 2 else i + 10, " ".join(w)))
    done = [x.text for x in sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len(done) == len(rows) and not any("Codeword" in t for t in done)
    assert sum("[EMAIL] [TERM]" in t for t in done) == 10


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, `a.b` string, extra string, text_ string, c0 string, __extra string, __text string, n_chars long"
    rows = [(1, "write to a@b.cd now", "p", "q", "r", "s", "t", "u", 19), (None, None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, schema)
    done = sanitise(d)
    assert done.columns == d.columns and [f.dataType for f in done.schema.fields] == [f.dataType for f in d.schema.fields]
    assert sorted(map(tuple, done.collect()), key=str) == sorted([(1, "write to [EMAIL] now", "p", "q", "r", "s", "t", "u", 20), rows[1]], key=str)
    assert personal_data(d).where("doc_id = 1").first().spans == "email:9:15"


def test_an_unrelated_text_of_the_same_id_is_left_alone(spark):
    r = random.Random(8)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rows = [(0, " ".join([r.choice(common) for _ in range(20)] + ["hidden@mail.example.com", "Codeword"])) for _ in range(10)]
    rows += [(k, " ".join(r.choice(common) for _ in range(30))) for k in range(100)]
    done = sorted(x.text for x in sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert [t for t in done if "[" not in t] == sorted(t for _, t in rows[10:])
    assert all(t.endswith("[EMAIL] [TERM]") for t in done if "[" in t) and len(done) == len(rows)
