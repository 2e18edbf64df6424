"""Personal data: base patterns, secrets, and terms that reveal the entities they protect.

Base spans (email, ip, card, phone) come from fixed patterns on each whole text.
The method adds two kinds of spans.

`secret`: runs of letters and digits that mix as they do not in words, names or
numbers (`secrets`): keys, tokens, digests. They are protected as base spans are.

`term`: information-theoretic sanitisation. The protected entities are the values
of these spans, the parts that several values share (domains, networks, issuers,
number blocks), and each kind as a whole. For an entity e and a term t that
stands within `reach` words of it, with counts of documents over the whole corpus,

    PMI(e; t) = log2(p(e, t) / (p(e) p(t))),   IC(e) = -log2 p(e),

t discloses the share PMI / IC of what e tells. For values and parts, documents
count as joint wherever t stands in them; for kinds, which many documents have, only if t
stands near. Terms that disclose `share` or more, seen near e in documents of at least `support` different contexts, become spans
wherever they stand outside of other spans, in every text of the corpus, and are
generalised in `sanitise`.

Pairs with an entity arise only near spans, so they are linear in those, and
nothing is gathered per entity: counts are pre-aggregated. Terms of the corpus are
counted only if they are candidates, by passes over the texts with at most
`portion` candidates (some 24 bytes each) sent to the tasks for each pass.

Defined results: a null text is empty; very long texts are read whole; every row
has its own result, repeated rows and null ids included; an empty table gives an
empty result; extra columns, whatever their names, are not read and kept by
`sanitise`. Overlapping spans of different kinds are all reported; in `sanitise`
the one that begins first (then the first kind listed) is replaced. A term that
discloses exactly the threshold counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from . import kernels as K
from .columns import fields, plain, with_text
from .storage import saved

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5
LABEL = {k: f"[{k.upper()}]" for k in KINDS}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits: had the run's start failed, so would every later digit of it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_SWITCH = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")


@dataclass(frozen=True)
class Limits:
    reach: int = 8
    share: float = 0.95
    support: int = 3
    least_letters: int = 3
    portion: int = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            done = m.end()
            out.append((s, 0, done))
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def secrets(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of secrets outside of `taken` (sorted): runs of 20 characters or more whose letters and digits change places often, with three bits or more a character."""
    out, k, reached = [], 0, 0
    for m in _RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reached = max(reached, taken[k][2])
            k += 1
        if reached > m.start():
            continue
        run = m[0]
        n = len(run)
        if len(_SWITCH.findall(run)) < max(3, n / 12):
            continue
        share = [x / n for x in Counter(run).values()]
        if -sum(p * math.log2(p) for p in share) >= 3:
            out.append((m.start(), SECRET, m.end()))
    return out


def protected(text: str) -> list[tuple[int, int, int]]:
    """Base spans and secrets, sorted."""
    base = base_spans(text)
    return sorted(base + secrets(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def entity(kind: int, value: str) -> int:
    """A 64-bit number of the protected value; cards and phones by their digits."""
    return _number(f"{kind}:{_digits(value) if kind in (2, 3) else value if kind == SECRET else value.lower()}")


KIND_ENTITIES = [_number(f"kind {k}") for k in range(TERM)]


def entities(kind: int, value: str) -> list[int]:
    """The protected entities of a span: its value, the part it shares with others, and its kind."""
    value = value.lower() if kind < 2 else value if kind == SECRET else _digits(value)
    part = [value[value.find("@") :], value.rpartition(".")[0], value[:6], value[:-4], ""][kind]
    return [entity(kind, value), *([_number(f"part {kind}:{part}")] if part else ()), KIND_ENTITIES[kind]]


_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?()[]\"'")] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words without up to two punctuation marks at either edge: the words, starts, ends and hashes."""
    w = K.Words(buf, off, lower=True, hashes=False)
    s, e = w.start.copy(), w.end.copy()
    for _ in range(2):
        s += (e - s > 1) & _EDGE[buf[s]] if len(s) else 0
        e -= (e - s > 1) & _EDGE[buf[e - 1]] if len(s) else 0
    return w, s, e, K.span_hash(K.prefix(buf, K.BYTE_VALUE_LOWER), s, e).view(np.int64)


def contexts(text: str, spans: list[tuple[int, int, int]], limits: Limits) -> list[tuple[int, int, int]]:
    """(entity, term, context) once for each pair of the text: terms near each span, outside of all spans."""
    raw = text.encode("utf-8", "replace")
    buf = np.frombuffer(raw, np.uint8)
    _, s, e, h = terms(buf, np.array([0, len(buf)]))
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    s, e = points[s], points[e]
    free = np.ones(len(s), bool)
    for a, _, b in spans:
        free[np.searchsorted(e, a, "right") : np.searchsorted(s, b)] = False
    out: dict[tuple[int, int], int] = {}
    for a, kind, b in spans:
        lo, hi = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b))
        near = [i for i in range(max(0, lo - limits.reach), min(len(s), hi + limits.reach)) if free[i]]
        context = hash(tuple(h[near].tolist()))
        for who in entities(kind, text[a:b]):
            for i in near:
                if e[i] - s[i] >= limits.least_letters:
                    k = (who, int(h[i]))
                    out[k] = min(out.get(k, context), context)
    return [(who, t, c) for (who, t), c in out.items()]


_HINT = np.zeros(256, bool)
_HINT[list(b"@0123456789")] = True
_NEAR = pa.list_(pa.struct([(k, pa.int64()) for k in "etc"]))


def _with_spans(arr: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(row, text, base spans and secrets) of the texts that have some."""
    for i, _, buf, off in K.chunks(arr):
        for d in np.flatnonzero(K.per_doc(_HINT[buf], off)):
            t = buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
            if spans := protected(t):
                yield i + int(d), t, spans


def _near(limits: Limits):
    """The entities of each text and the terms near them."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            who, near = [None] * n, [None] * n
            for i, t, spans in _with_spans(b.column(0)):
                who[i] = list({x for a, k, z in spans for x in entities(k, t[a:z])})
                near[i] = [{"e": e, "t": x, "c": c} for e, x, c in contexts(t, spans, limits)] or None
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.list_(pa.int64())), pa.array(near, _NEAR)], names=["who", "near"])

    return run


def _hits(wanted: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term number (of the sorted `wanted`), start and end of the wanted terms."""
    w, s, e, h = terms(buf, off)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == h)
    return w.doc()[hit], at[hit], s[hit], e[hit]


def _places(wanted: np.ndarray, arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, starts, ends) of the wanted terms outside of base spans and secrets."""
    for i, _, buf, off in K.chunks(arr):
        doc, _, s, e = _hits(wanted, buf, off)
        if not len(doc):
            continue
        points = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
        begin = np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)]
        for x, y in zip(begin, begin[1:], strict=False):
            d = doc[x]
            spans = protected(buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
            a, z = points[s[x:y]] - points[off[d]], points[e[x:y]] - points[off[d]]
            free = np.ones(y - x, bool)
            for p, _, q in spans:  # both are in order
                free[np.searchsorted(z, p, "right") : np.searchsorted(a, q)] = False
            if free.any():
                yield i + int(d), a[free], z[free]


def _counted(wanted: np.ndarray):
    """Documents of each wanted term, summed within the task."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for _, _, buf, off in K.chunks(b.column(0)):
                doc, at, _, _ = _hits(wanted, buf, off)
                if len(doc):
                    np.add.at(total, np.unique(doc * np.int64(len(wanted)) + at) % len(wanted), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], names=["t", "n"])

    return run


def _together(e: np.ndarray, t: np.ndarray):
    """Documents that hold both the entity and the term of each pair (sorted by term), summed within the task."""
    wanted, begin = np.unique(t, return_index=True)
    begin = np.r_[begin, len(t)]

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(e), np.int64)
        for b in batches:
            for _, _, buf, off in K.chunks(b.column(0)):
                doc, at, _, _ = _hits(wanted, buf, off)
                hinted = K.per_doc(_HINT[buf], off) > 0
                for d in np.unique(doc[hinted[doc]]) if len(doc) else ():
                    text = buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
                    who = np.array(sorted({x for a, k, z in protected(text) for x in entities(k, text[a:z])}), np.int64)
                    if len(who):
                        for x in np.unique(at[doc == d]):
                            mine = slice(begin[x], begin[x + 1])
                            total[mine] += np.isin(e[mine], who, assume_unique=True)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(e[some]), pa.array(t[some]), pa.array(total[some])], names=["e", "t", "n"])

    return run


def _marked(wanted: np.ndarray):
    """(text, extra, ...) with the places of wanted terms added to extra."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            extra = b.column(1).to_pylist()
            for i, a, z in _places(wanted, b.column(0)):
                extra[i] = [*(extra[i] or ()), *({"s": int(x), "z": int(y)} for x, y in zip(a, z, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(extra, _PLACES), *b.columns[2:]], names=b.schema.names)

    return run


_PLACES = pa.list_(pa.struct([("s", pa.int64()), ("z", pa.int64())]))
_EXTRA = "array<struct<s:long,z:long>>"


def _portions(rows: DataFrame, most: int, *columns: str) -> Iterator[list[np.ndarray]]:
    """Columns of the distinct rows, sorted by the last one, t, in portions of about `most` with all rows of a term together."""
    parts = -(-rows.count() // most)
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).select(*columns).toArrow()
        if some.num_rows:
            got = [c.to_numpy() for c in some.columns]
            order = np.lexsort(got)
            yield [c[order] for c in got]


def _summed(src: DataFrame, tasks: list, schema: str, *keys: str) -> DataFrame | None:
    """Counts of several passes over the texts."""
    found = None
    for task in tasks:
        some = src.select("text").mapInArrow(task, schema)
        found = some if found is None else found.union(some)
    return None if found is None else found.groupBy(*keys).agg(F.sum("n").alias("n"))


def disclosing(src: DataFrame, limits: Limits) -> DataFrame:
    """(e, t): the pairs whose term discloses too much."""
    base = saved(src.select("text").mapInArrow(_near(limits), "who array<long>, near array<struct<e:long,t:long,c:long>>"), "personal")
    near = base.where("near is not null").select(F.explode("near").alias("x")).select("x.e", "x.t", "x.c")
    pairs = near.groupBy("e", "t").agg(F.countDistinct("c").alias("contexts"), F.count("*").alias("n_near")).where(F.col("contexts") >= limits.support)
    has = base.select(F.explode("who").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = saved(pairs.select("e", "t", "n_near").join(has, "e").withColumn("total", F.lit(base.count())), "candidates")
    n_t = _summed(src, [_counted(t) for (t,) in _portions(pairs.select("t").distinct(), limits.portion, "t")], "t long, n long", "t")
    if n_t is None:
        return pairs.select("e", "t")
    ic = F.log2(F.col("total") / F.col("n_e"))

    def enough(both):
        return (ic > 0) & (F.log2(both * F.col("total") / (F.col("n_e") * F.col("n_t"))) >= limits.share * ic)

    kind = F.col("e").isin(KIND_ENTITIES)
    # no pair can be in more documents than either of its sides
    found = pairs.join(n_t.withColumnRenamed("n", "n_t"), "t").where(enough(F.when(kind, F.col("n_near")).otherwise(F.least("n_e", "n_t"))))
    found = saved(found, "pairs")
    kinds = found.where(kind).select("e", "t")
    both = _summed(src, [_together(e, t) for e, t in _portions(found.where(~kind), limits.portion, "e", "t")], "e long, t long, n long", "e", "t")
    if both is None:
        return kinds
    return kinds.union(found.join(both, ["e", "t"]).where(enough(F.col("n"))).select("e", "t"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _with_terms(rows: DataFrame, src: DataFrame, limits: Limits) -> DataFrame:
    """`rows` (the text, then plain names) with the places of all disclosing terms as the second column."""
    text, *rest = rows.columns
    out = rows.select(text, F.lit(None).cast(_EXTRA).alias("extra"), *rest)
    terms_ = saved(disclosing(src, limits).select("t").distinct(), "terms")
    schema = out.schema
    for k, (wanted,) in enumerate(_portions(terms_, limits.portion, "t")):
        if k:
            out = saved(out, "marked")
        out = out.mapInArrow(_marked(wanted), schema)
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_term long, personal boolean"


@K.tidied
def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for b in batches:
        n = b.num_rows
        counts = np.zeros((len(KINDS), n), np.int64)
        sha, found = [empty] * n, [[] for _ in range(n)]
        for i, _, spans in _with_spans(b.column(0)):
            sha[i] = hashlib.sha256(joined([x for x in spans if x[1] < SECRET]).encode()).hexdigest()
            found[i] = spans
        for i, extra in enumerate(b.column(1).to_pylist()):
            found[i] = sorted({*found[i], *((y["s"], TERM, y["z"]) for y in extra or ())})
            for _, k, _ in found[i]:
                counts[k, i] += 1
        out = [b.column(2), *(pa.array(c) for c in counts[:SECRET]), pa.array(sha, pa.string()), pa.array([joined(x) for x in found], pa.string()), pa.array(counts[SECRET]), pa.array(counts[TERM]), pa.array(counts.sum(axis=0) > 0)]
        yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in RESULT.split(", ")])


def personal_data(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts of each base kind, base_sha256, all spans, counts of the added kinds, and whether there is any span."""
    src = _source(docs, id_col, text_col)
    return _with_terms(src.select("text", "doc_id"), src, limits).mapInArrow(_result, RESULT)


def generalise(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], LABEL[KINDS[k]]]
            at = e
    return "".join([*parts, text[at:]])


@K.tidied
def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        out = []
        for text, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text is not None:
                spans = sorted({*protected(text), *((x["s"], TERM, x["z"]) for x in extra or ())})
                if spans:
                    text = generalise(text, spans)
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], names=["text", *b.schema.names[2:]])


def sanitise(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data generalised to its kind (and n_chars, where there is one, made to fit)."""
    rows, (t,) = plain(docs, text_col)
    src = rows.select(F.col(t).cast("string").alias("text"))
    done = _with_terms(rows.select(F.col(t).cast("string").alias("text"), *rows.columns), src, limits)
    done = done.mapInArrow(_sanitise, fields(rows, StructField("text", StringType())))
    return with_text(done, docs, text_col)
