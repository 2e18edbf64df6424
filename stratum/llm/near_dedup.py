"""MinHash near-duplicates by a multi-index Hamming join.

1. Each text becomes the set of its distinct word shingles; equal sets are one
   class, found by a pre-aggregated grouping, so exact copies cost nothing more.
2. A class has a signature of `chunks * chunk` MinHash symbols of 16 bits. By
   the pigeonhole principle, two signatures that differ in fewer than
   `(errors + 1) * chunks` symbols agree in some chunk but for `errors` symbols.
   Every way of leaving out that many symbols of a chunk is a key, so all pairs
   under that distance share a key.
3. Within a key, signatures are compared (breadth first, so a tight group costs
   little more than its size; keys beyond one piece first with their leader, then
   what is left in blocks); pairs up to `loose` differing symbols join the
   classes into coarse components. These hold every link, and nothing is emitted
   but a spanning forest.
4. Within a coarse component, links are confirmed on the full sets: first each
   member against the least one and, where that does not do, against a few more,
   which settles groups of near copies in linear time; then what is left against
   the others in blocks of bounded size. Again only a spanning forest is emitted,
   whose components are the result.

MinHash is random: a pair of similarity exactly 0.8 shares no key with
probability 2e-6, and is beyond the loose distance with less than 1e-6.

Defined results: null or wordless texts have no shingles and are linked with
nothing; very long texts are read whole; rows without an id take no part
(component_id null, kept); rows that repeat an id are one document: links of any of
its texts count; equal texts are one class, of which the least id stays; empty
tables give empty results; extra columns, whatever their names, are not read and
are kept by `keep_first`. Sets are of 64-bit hashes of words and shingles, which are
not cryptographic: texts made for the purpose could collide.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .columns import plain
from .components import components
from .storage import mark, saved


@dataclass(frozen=True)
class Plan:
    """width: words in a shingle. percent: a link has 100 * |A and B| >= percent * |A or B|.

    bucket, block: most members compared in one piece; larger groups are handled
    in pairs of such pieces.
    hot_sample, hot_least: keys with so many members among one in hot_sample nodes
    are never gathered by key (see split_hot); the results are the same either way.
    """

    width: int = 5
    percent: int = 80
    chunks: int = 10
    chunk: int = 5
    errors: int = 1
    loose: int = 25
    bucket: int = 8192
    block: int = 128
    hot_sample: int = 1024
    hot_least: int = 8

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk


_U = np.uint64


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1), r.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n MinHash symbols of 16 bits for each non-empty set of a concatenation."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, n), np.uint16)
    if len(full):
        starts = at[:-1][full]
        for k, (a, b) in enumerate(zip(*_coefficients(n), strict=True)):
            x = sets * a + b
            x ^= x >> _U(32)
            least = np.minimum.reduceat(x, starts)
            out[full, k] = (K.mix(least) & _U(0xFFFF)).astype(np.uint16)
    return out


def keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys of each signature: for each chunk, its symbols but for each choice of `errors` of them."""
    out = []
    for c in range(plan.chunks):
        part = sig[:, c * plan.chunk : (c + 1) * plan.chunk].astype(np.uint64)
        for j, left in enumerate(combinations(range(plan.chunk), plan.chunk - plan.errors)):
            h = np.full(len(sig), _U(c * 1009 + j + 1))
            for i in left:
                h = K.mix(h * _U(0x9E3779B97F4A7C15) + part[:, i])
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _sketch(plan: Plan):
    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(1)):
                sets, at = K.shingle_sets(buf, off, plan.width)
                n = np.diff(at)
                two = []
                for seed in (0x51, 0x1F3):
                    total = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(K.mix(sets + _U(seed)), out=total[1:])
                    two.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                sig = signatures(sets, at, plan.symbols)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(plan.symbols * 2), j - i, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(two[0]), pa.array(two[1]), data], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return run


def _matrix(arr: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(arr.to_pylist()), np.uint16).reshape(-1, n)


def _keyed(plan: Plan):
    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = keys(_matrix(b.column(1), plan.symbols), plan)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), k.shape[1]))], names=["key", "node"])

    return run


def _runs(limit: int):
    """Sorted (key, node) rows to lists of up to `limit` nodes of one key; a key with one node is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, np.zeros(0, np.int64), 0
        for b in batches:
            k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(k)]
            out: list[tuple[int, int, np.ndarray]] = []

            def close() -> None:
                if len(held) > 1 or part:
                    out.append((key, part, np.unique(held)))

            if k[0] == key:
                held, begin = np.r_[held, v[: ends[0]]], 1
            else:
                close()
                begin = 0
                key, held, part = int(k[0]), v[:0], 0
            while len(held) >= limit:
                out.append((key, part, np.unique(held[:limit])))
                held, part = held[limit:], part + 1
            if begin < len(starts):
                if begin == 1:
                    close()
                size = ends - starts
                for i in np.flatnonzero(size[begin:-1] > 1) + begin if len(starts) - begin > 1 else ():
                    x = v[starts[i] : ends[i]]
                    for p in range(0, len(x), limit):
                        out.append((int(k[starts[i]]), p // limit, np.unique(x[p : p + limit])))
                key, held, part = int(k[starts[-1]]), v[starts[-1] :], 0
                while len(held) >= limit:
                    out.append((key, part, np.unique(held[:limit])))
                    held, part = held[limit:], part + 1
            if out:
                yield _lists(out)
        out = []
        if key is not None:
            if len(held) > 1 or (part and len(held)):
                yield _lists([(key, part, np.unique(held))])

    return run


def _lists(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for *_, x in rows], out=at[1:])
    return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in rows], pa.int64()), pa.array([p for _, p, _ in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x for *_, x in rows])))], names=["key", "part", "nodes"])


def spread(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1; near(i, rest) gives the mask of `rest` that is linked with i."""
    rest, out = np.arange(n), []
    queue: deque[int] = deque()
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        i = queue.popleft()
        if len(rest):
            hit = near(i, rest)
            for j in rest[hit]:
                out.append((i, int(j)))
                queue.append(int(j))
            rest = rest[~hit]
    return out


def _coarse(plan: Plan):
    """(nodes, signatures) lists to the forest of pairs within the loose distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for members in b.column(0).to_pylist():
                node = [m["node"] for m in members]
                sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(-1, plan.symbols)
                for i, j in spread(len(node), lambda i, rest, sig=sig: (sig[rest] != sig[i]).sum(axis=1) <= plan.loose):
                    a.append(node[i])
                    c.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def _set_rows(plan: Plan):
    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(2)):
                sets, at = K.shingle_sets(buf, off, plan.width)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(sets.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), data], names=["node", "grp", "data"])

    return run


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * inter >= percent * (a + b - inter)


Alike = Callable[[bytes, list[bytes]], np.ndarray]


def alike_sets(percent: int) -> Alike:
    """Which of some shingle sets are linked with one."""

    def run(one: bytes, others: list[bytes]) -> np.ndarray:
        p = np.frombuffer(one, np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in others]
        size = np.array([len(q) for q in sets])
        at = np.searchsorted(p, np.concatenate(sets))
        same = (p[np.minimum(at, len(p) - 1)] == np.concatenate(sets)) if len(p) else np.zeros(size.sum(), bool)
        total = np.r_[0, np.cumsum(same)]
        end = np.cumsum(size)
        return linked(total[end] - total[end - size], size, len(p), percent)

    return run


def alike_signatures(plan: Plan) -> Alike:
    """Which of some signatures are within the loose distance of one."""

    def run(one: bytes, others: list[bytes]) -> np.ndarray:
        return (np.frombuffer(b"".join(others), np.uint16).reshape(len(others), -1) != np.frombuffer(one, np.uint16)).sum(axis=1) <= plan.loose

    return run


def _beside_leader(alike: Alike):
    """(grp, node, data, lead) with whether the two are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [bool(alike(x, [y])[0]) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], names=["grp", "node", "near"])

    return run


def _beside_pivots(alike: Alike):
    """Rows (grp, salt, bit, node, data), sorted: the pivots of a group (bit >= 0), then members (bit -1), to (grp, node, mask of linked pivots, these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits, nodes, data = None, [], [], []
        for b in K.slices(batches):
            out = []
            for group, salt, bit, node, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (group, salt) != key:
                    key, bits, nodes, data = (group, salt), [], [], []
                if bit >= 0:
                    bits.append(bit)
                    nodes.append(node)
                    data.append(x)
                else:
                    hit = np.flatnonzero(alike(x, data))
                    out.append((group, node, sum(1 << bits[k] for k in hit), [nodes[k] for k in hit if nodes[k] != node]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["grp", "node", "mask", "to"])

    return run


def main_mask(counts: list[tuple[int, int]]) -> int:
    """Of the pivots that are connected through members linked with several, those with the most members; counts: (mask, members)."""
    parts: list[tuple[int, int]] = []
    for mask, n in sorted(counts):
        if mask:
            apart = [p for p in parts if not p[0] & mask]
            for m, k in parts:
                if m & mask:
                    mask, n = mask | m, n + k
            parts = [*apart, (mask, n)]
    return max(parts, key=lambda p: (p[1], -p[0]), default=(0, 0))[0]


def _mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([main_mask([(m["mask"], m["count"]) for m in x]) for x in b.column(1).to_pylist()], pa.int32())], names=["grp", "main"])


def settled(members: DataFrame, alike: Alike, pivots: int = 8, share: int = 512) -> tuple[DataFrame, DataFrame]:
    """Links of members (grp, node, data) with a few of their group, and marks (grp, node, near): which are thereby known to be in one component.

    All are compared with the least one; where some are not linked with it, all are
    compared with up to `pivots` of those, too (one of each hash class, so that the
    choice is pre-aggregated), in tasks of about `share` members. A group of near
    copies is thereby settled but for a few, whichever is its least member. Groups
    without marks, or whose marks are all near, are settled.
    """
    lead = saved(members.groupBy("grp").agg(F.min(F.struct("node", "data")).alias("lead")), "leaders")
    others = members.join(lead.hint("merge"), "grp").where("node <> lead.node")
    star = saved(others.select("grp", "node", "data", "lead.data").toDF("grp", "node", "data", "lead").mapInArrow(_beside_leader(alike), "grp long, node long, near boolean"), "star")
    edges = star.where("near").join(lead.select("grp", F.col("lead.node").alias("b")).hint("merge"), "grp").select(F.col("node").alias("a"), "b")
    star = star.groupBy("grp", "node").agg(F.max("near").alias("near"))
    counts = star.groupBy("grp").agg((F.count("*") + 1).alias("n"), F.count_if(~F.col("near")).alias("open")).where("n > 2 and open > 0")
    counts = saved(counts.select("grp", F.ceil(F.col("n") / share).cast("int").alias("salts")), "counts")
    if not counts.count():
        return edges, star.where("near")
    chosen = star.where("not near").groupBy("grp", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("class")).agg(F.min(F.struct(F.xxhash64("node", F.lit(1)), "node")).alias("x"))
    chosen = chosen.select("grp", (F.col("class") + 1).cast("int").alias("bit"), "x.node").hint("merge")
    picked = members.join(chosen, ["grp", "node"]).groupBy("grp", "bit").agg(F.first("node").alias("node"), F.first("data").alias("data"))
    picked = picked.unionByName(lead.select("grp", F.lit(0).alias("bit"), "lead.node", "lead.data")).join(counts.hint("merge"), "grp")
    picked = picked.select("grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "bit", "node", "data")
    dealt = members.join(counts.hint("merge"), "grp").select("grp", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(-1).alias("bit"), "node", "data")
    rows = picked.unionByName(dealt).repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.col("bit").desc())
    rows = saved(rows.mapInArrow(_beside_pivots(alike), "grp long, node long, mask int, to array<long>"), "pivots")
    mains = rows.groupBy("grp", "mask").count().groupBy("grp").agg(F.collect_list(F.struct("mask", "count")).alias("masks")).mapInArrow(_mains, "grp long, main int")  # at most 2 ** (pivots + 1) masks
    marks = rows.join(mains.hint("merge"), "grp").groupBy("grp", "node").agg(F.max(F.col("mask").bitwiseAND(F.col("main")) != 0).alias("near"))
    return edges.union(rows.select(F.col("node").alias("a"), F.explode("to").alias("b"))), saved(marks, "marks")


def _confirm(plan: Plan):
    """Forest of the confirmed links among the members of one piece."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, data = [], []
        for b in batches:
            node += K.column(b, "node").to_pylist()
            data += K.column(b, "data").to_pylist()
        size = np.array([len(x) // 8 for x in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint64)
        at = np.r_[0, np.cumsum(size)]
        values, code = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(values), bool)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            mine = code[at[i] : at[i + 1]]
            mark[mine] = True
            total = np.r_[0, np.cumsum(mark[code])]
            mark[mine] = False
            return linked(total[at[rest + 1]] - total[at[rest]], size[rest], size[i], plan.percent)

        pairs = spread(len(node), near)
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in pairs], pa.int64()), pa.array([node[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    return run


def split_hot(nodes: DataFrame, keyed: Callable[[DataFrame], DataFrame], sample: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, node) rows of ordinary keys, and of keys that a sample of nodes shows to be hot (None: no key is).

    The sample only routes: hot keys are worked on without a gathering by key, all others
    are gathered, and either way gives the same links.
    """
    some = keyed(nodes.where(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0))
    hot = saved(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key"), "hot")
    found, rows = hot.count(), keyed(nodes)
    if not found:
        return rows, None
    if found <= 1_000_000:  # 8 MB
        hot = F.broadcast(hot)
    return rows.join(hot, "key", "left_anti"), rows.join(hot, "key", "left_semi")


def in_pieces(members: DataFrame, marks: DataFrame, block: int) -> DataFrame:
    """Members of the groups with work left, placed in pieces (grp, x, y) of at most about two blocks.

    `marks` says of each member whether it is known to be in one component with the
    others so marked (near). Pairs of those need no look, so pieces pair each block of
    open members with every block: linear for a tight group, whatever its size.
    """
    counts = marks.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("open")).where("open > 0")
    counts = saved(counts, "counts")  # Spark splits large groups only in a join of two exchanges
    rest = marks.where("not near").select("grp", "node", F.lit(True).alias("is_open")).distinct()
    # by member first: the join by group is then the last one, which Spark may split where a group is large
    placed = members.join(rest.hint("merge"), ["grp", "node"], "left").withColumn("is_open", F.coalesce("is_open", F.lit(False)))
    placed = placed.join(counts.hint("merge"), "grp")
    placed = placed.withColumns({"no": F.ceil(F.col("open") / block).cast("int"), "nc": F.ceil((F.col("n") - F.col("open")) / block).cast("int")})
    spot = F.pmod(F.xxhash64("node"), F.when(F.col("is_open"), F.col("no")).otherwise(F.col("nc"))).cast("int")
    placed = placed.withColumn("mine", F.when(F.col("is_open"), spot).otherwise(spot + F.col("no")))
    # a piece is (open block x, any block y) with x <= y; open members are in all pieces of their block
    opened = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("x"), F.greatest(x, F.col("mine")).alias("y")))
    linked_ = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda y: F.struct(F.col("mine").alias("x"), (y + F.col("no")).alias("y")))
    keep = [c for c in members.columns if c != "grp"]
    # dealt by piece: the partitioning by group would do for Spark, and put all pieces of a group into one task
    return placed.withColumn("p", F.explode(F.when(F.col("is_open"), F.concat(opened, linked_)).otherwise(opened))).select("grp", "p.x", "p.y", *keep).repartition("grp", "x", "y")


def _hot_keys(many: DataFrame, sigs: DataFrame, plan: Plan) -> DataFrame:
    """Coarse links within keys of more members than one piece holds."""
    members = saved(many.join(sigs, "node").select(F.col("key").alias("grp"), "node", F.col("sig").alias("data")), "hot")
    edges, marks = settled(members, alike_signatures(plan))
    lists = in_pieces(members, marks, plan.bucket).groupBy("grp", "x", "y").agg(F.collect_list(F.struct("node", F.col("data").alias("sig"))).alias("members"))
    return edges.union(lists.select("members").mapInArrow(_coarse(plan), "a long, b long"))


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the group of linked documents) and kept, for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = saved(src.mapInArrow(_sketch(plan), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"), "sketch")
    known = sketch.where("doc_id is not null and n_shingles > 0")
    classes = saved(known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "classes")

    begun = mark(docs.sparkSession)
    keyed = lambda df: df.select("node", "sig").mapInArrow(_keyed(plan), "key long, node long")
    rows, hot = split_hot(classes, keyed, plan.hot_sample, plan.hot_least)
    lists = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(plan.bucket), "key long, part int, nodes array<long>")
    lists = saved(lists, "buckets")
    large = lists.where("part > 0").select("key").distinct()  # keys beyond one piece
    small = lists.join(large, "key", "left_anti").select("nodes")
    many = lists.join(large, "key", "left_semi").select("key", F.explode("nodes").alias("node"))
    many = (many if hot is None else many.union(hot)).distinct()
    hot = _hot_keys(many, classes.select("node", "sig"), plan)
    members = small.where("size(nodes) > 1").distinct().select(F.monotonically_increasing_id().alias("piece"), "nodes")
    members = saved(members, "pieces").select("piece", F.explode("nodes").alias("node"))
    grouped = members.join(classes.select("node", "sig"), "node").groupBy("piece").agg(F.collect_list(F.struct("node", "sig")).alias("members"))
    found = grouped.select("members").mapInArrow(_coarse(plan), "a long, b long")
    coarse = components(found.union(hot))

    coarse = saved(coarse.select("node", F.col("component").alias("coarse")), "coarse")
    texts = src.join(coarse.hint("merge"), src["doc_id"] == coarse["node"]).select("node", "coarse", "text")
    sets = saved(texts.mapInArrow(_set_rows(plan), "node long, grp long, data binary"), "sets")
    links, marks = settled(sets, alike_sets(plan.percent))
    pieces = in_pieces(sets, marks, plan.block)
    links = links.union(pieces.groupBy("grp", "x", "y").applyInArrow(_confirm(plan), "a long, b long"))
    final = saved(components(links), "links", since=begun)

    ids = classes.join(final, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component"))
    slim = sketch.select("doc_id", "n_shingles", "f1", "f2")
    with_set = slim.where("n_shingles > 0").join(ids, ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the least id of each group, all columns unchanged; rows without an id stay."""
    rows, (i, t) = plain(docs, id_col, text_col)
    gone = near_duplicates(rows, plan, i, t).where("not kept").select(F.col("doc_id").alias("gone"))
    return rows.join(gone, F.col(i).cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)
