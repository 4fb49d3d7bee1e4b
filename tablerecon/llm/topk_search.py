"""Exact top-k by inner product with dual trees.

Vectors are dealt to the nearest of a few pivots; a cell that is still much larger than a block is
dealt again, to pivots of its own, until every cell is a block (one that no pivots part, as of
equal vectors, is cut by hash). A cell's name is its path, a digit a level. Each block is indexed by
a cover tree: every node has a point, a radius that covers all below it, and up to CHILDREN
children around points of their own, each the farthest from those before, until all is within
``1 / BASE`` of the radius. Over the roots of the blocks the paths are a tree too: neighbours have
a common ball, up to the first level.
Queries lie in the same cells, in blocks of as much of a path as holds few enough of them. For two nodes the inner product of any query below one and
any vector below the other is at most <q, r> + radius_q |r| + radius_r |q| + radius_q radius_r;
a pair of nodes is pruned when that is under the worst k-th score of the query node's group.

1. Every query block searches one data block of its own pivot, which gives each query a k-th
   score to beat.
2. The balls over the other blocks are held against the worst of these, from the top down to the
   blocks' roots; only pairs of blocks that may hold something better are searched, with the k-th
   scores as floors.
3. A window keeps the k best of all.

Where vectors have no structure (directions spread evenly over many dimensions), no bound of
this kind prunes, and all pairs of queries and vectors are scored, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 64
#: queries that descend together
GROUP = 16
BASE = 1.3
#: children of a node, at most; in many dimensions no few of them cover it that well
CHILDREN = 16
#: vectors that stand for parts of the space, at most; of a cell that is dealt again, at most
PIVOTS, FAN = 256, 16
#: vectors of the sample for each pivot
SAMPLE = 16
#: a digit of a path
DIGITS = "0123456789abcdef"
#: balls that one row holds, and that are compared with a query block at once
CHUNK = 64
#: bytes of vectors that are dealt to their cell's pivots at once
DEAL_BYTES = 16 << 20
_TREE = ["ids", "vectors", "centre", "radius", "first", "last", "child", "children"]


def cover_tree(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """The tree over the rows of ``x`` as flat arrays: rows in tree order and, per node, its
    point, radius, range of rows and range of children (none for a leaf)."""
    order: list[int] = []
    centre, radius, first, last, child, children = [], [], [], [], [], []
    f = x.astype(np.float64)
    norms = (f**2).sum(1)

    def distances(rows: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(norms[rows] + norms[c] - 2 * (f[rows] @ f[c]), 0))

    queue = [(np.arange(len(x)), 0)] if len(x) else []
    spans: list[np.ndarray] = []
    while queue:  # breadth first, so that children of a node are neighbours
        nxt = []
        for rows, c in queue:
            d = distances(rows, c)
            centre.append(c)
            radius.append(float(d.max()))
            spans.append(rows)
            child.append(-1)
            children.append(0)
            if len(rows) > leaf and radius[-1] > 1e-6:
                nxt.append((len(centre) - 1, rows, c, d))
        queue, base = [], len(centre)
        for node, rows, c, d in nxt:
            heads, near = [c], [d]
            while len(heads) < CHILDREN and (far := np.minimum.reduce(near)).max() > radius[node] / BASE:
                heads.append(int(rows[far.argmax()]))
                near.append(distances(rows, heads[-1]))
            of = np.argmin(near, 0)
            own = [(rows[of == i], h) for i, h in enumerate(heads) if (of == i).any()]
            child[node], children[node] = base + len(queue), len(own)
            queue += own
    # a depth-first walk gives every node a run of rows
    first, last = [0] * len(centre), [0] * len(centre)
    stack = [(0, False)] if len(x) else []
    while stack:
        node, done = stack.pop()
        if done:
            last[node] = len(order)
            continue
        first[node] = len(order)
        if children[node]:
            stack.append((node, True))
            stack += [(child[node] + k, False) for k in reversed(range(children[node]))]
        else:
            order += spans[node].tolist()
            last[node] = len(order)
    at = np.array(order, np.int64)
    return {
        "ids": ids[at], "vectors": x[at], "centre": x[np.array(centre, np.int64)] if centre else x[:0], "radius": np.array(radius) * (1 + 1e-9) + 1e-6,
        "first": np.array(first, np.int64), "last": np.array(last, np.int64), "child": np.array(child, np.int64), "children": np.array(children, np.int64),
    }


#: score of an empty place; ids may have any sign
EMPTY = np.iinfo(np.int64).min


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _bound(q: np.ndarray, qn: float, q_radius: float, r: np.ndarray, rn: np.ndarray, r_radius: np.ndarray) -> np.ndarray:
    """The most that a vector of one ball and one of each other ball may score, rounding included."""
    return r @ q + q_radius * rn + r_radius * (qn + q_radius) + 1e-12 * (qn + q_radius) * (rn + r_radius) + 1e-3


def dual_search(q: dict[str, np.ndarray], r: dict[str, np.ndarray], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (queries in tree order x k, best first, ties to smaller ids) of the best
    vectors with another id and, per query, a score of at least ``floor``; missing places have
    the score EMPTY. Then how many pairs were scored."""
    exact = np.abs(q["vectors"]).max(initial=0).astype(float) * np.abs(r["vectors"]).max(initial=0) * q["vectors"].shape[1] < 2**52
    qv, rv = (x["vectors"].astype(np.float64 if exact else np.int64) for x in (q, r))
    score, found = np.full((len(qv), k), EMPTY), np.full((len(qv), k), -1)
    floor = np.full(len(qv), EMPTY) if floor is None else floor
    qc, rc = q["centre"].astype(float), r["centre"].astype(float)
    qn, rn = np.linalg.norm(qc, axis=1), np.linalg.norm(rc, axis=1)
    scored = 0

    def bounds(a: int, b: np.ndarray) -> np.ndarray:
        return _bound(qc[a], qn[a], q["radius"][a], rc[b], rn[b], r["radius"][b])

    def worst(a: int) -> float:
        own = slice(q["first"][a], q["last"][a])
        return float(np.maximum(score[own, -1], floor[own]).min())

    def below(nodes: np.ndarray) -> np.ndarray:
        return _ranges(r["child"][nodes], r["child"][nodes] + r["children"][nodes])

    def take(a: int, leaves: np.ndarray) -> int:
        lo, hi = q["first"][a], q["last"][a]
        rows = _ranges(r["first"][leaves], r["last"][leaves])
        s = np.rint(qv[lo:hi] @ rv[rows].T).astype(np.int64)
        s[(s < floor[lo:hi, None]) | (r["ids"][rows] == q["ids"][lo:hi, None])] = EMPTY
        all_ = np.concatenate((score[lo:hi], s), 1)
        kth = np.partition(all_, all_.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero((all_ >= kth[:, None]) & (all_ > EMPTY))
        ids = np.where(j < k, found[lo + i, np.minimum(j, k - 1)], r["ids"][rows[np.maximum(j - k, 0)]])
        got = all_[i, j]
        order = np.lexsort((ids, -got, i))
        i, ids, got = i[order], ids[order], got[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        score[lo + i[keep], nth[keep]], found[lo + i[keep], nth[keep]] = got[keep], ids[keep]
        return s.size

    stack = [(0, np.array([0]))] if len(qv) and len(rv) else []
    while stack:
        a, b = stack.pop()
        b = b[bounds(a, b) >= worst(a)]
        if not len(b):
            continue
        if q["children"][a]:
            inner = r["children"][b] > 0
            wide = np.concatenate((b[~inner], below(b[inner]))) if inner.any() else b
            stack += [(q["child"][a] + j, wide) for j in range(q["children"][a])]
            continue
        leaves = []  # a group of queries: descend the data tree, then best bounds first
        while len(b):
            inner = r["children"][b] > 0
            leaves.append(b[~inner])
            b = below(b[inner]) if inner.any() else b[:0]
            if len(b):
                b = b[bounds(a, b) >= worst(a)]
        leaves = np.concatenate(leaves)
        up = bounds(a, leaves)
        order = np.argsort(-up, kind="stable")
        leaves, up = leaves[order], up[order]
        size = np.cumsum(r["last"][leaves] - r["first"][leaves])
        at, most = 0, 4 * LEAF
        while at < len(leaves) and up[at] >= (low := worst(a)):
            to = max(at + 1, min(int(np.searchsorted(size, (size[at - 1] if at else 0) + most)), int(np.searchsorted(-up, -low, "right"))))
            scored += take(a, leaves[at:to])
            at, most = to, min(2 * most, 4096)
    return score, found, scored


def _packed(tree: dict[str, np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(tree[c]).tobytes() for c in _TREE]


def _unpacked(row: dict, dim: int) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(row[c], np.float64 if c == "radius" else np.int32 if c in ("vectors", "centre") and row["narrow"] else np.int64) for c in _TREE}
    return out | {c: out[c].reshape(-1, dim).astype(np.int64) for c in ("vectors", "centre")}


def chosen_pivots(rows: DataFrame, n: int) -> list[list[int]]:
    """Up to ``n`` vectors far from each other: each next one is drawn from a sample of SAMPLE times
    as many, by its squared distance to the nearest of those before, so that few clusters of the
    sample are left without one. The sample only decides how well bounds prune."""
    some = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE * n).select("v").collect()]
    made = np.random.default_rng(1)
    out: list[list[int]] = []
    for dim in sorted({len(v) for v in some}):
        x = np.array([v for v in some if len(v) == dim], np.float64)
        far, want = np.full(len(x), np.inf), -(-n * len(x) // len(some))
        at = 0
        for _ in range(min(want, n - len(out))):
            out.append(x[at].astype(np.int64).tolist())
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
            if not far.sum():
                break
            at = int(made.choice(len(x), p=far / far.sum()))
    return out


def _near_pivots(rows: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """``dim, cell, vec_id, v``: each vector with the two digits of its nearest pivot of its own
    dimension (of 0 if there is none)."""
    by_dim = {d: (np.array([i for i, p in enumerate(pivots) if len(p) == d]), np.array([p for p in pivots if len(p) == d], np.float64)) for d in {len(p) for p in pivots}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d)) if len(np.unique(dims)) > 1 else b
                cell = np.zeros(len(part), np.int32)
                if d in by_dim and d:
                    names, p = by_dim[d]
                    x = np.asarray(part.column("v").flatten()).reshape(-1, d).astype(np.float64)
                    cell = names[((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)].astype(np.int32)
                names = pa.array([DIGITS[c // 16] + DIGITS[c % 16] for c in cell])
                yield pa.record_batch([part.column("dim"), names, part.column("vec_id"), part.column("v")], ["dim", "cell", "vec_id", "v"])

    return rows.select("dim", "vec_id", "v").mapInArrow(run, "dim int, cell string, vec_id long, v array<long>")


def _dealt_again(rows: DataFrame, big: DataFrame, block: int) -> DataFrame:
    """The rows of the cells ``big`` (``dim, cell, n``), a digit longer where their cell has
    pivots: some of its vectors, chosen by hash. A cell's rows are dealt in parts of DEAL_BYTES."""

    def run(_: tuple, t: pa.Table, near: pa.Table) -> pa.Table:
        if not len(t) or not len(near):
            return t.select(["dim", "cell", "vec_id", "v"])
        p, x = (np.asarray(y["v"].combine_chunks().flatten()).reshape(len(y), -1).astype(np.float64) for y in (near, t))
        of = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
        cell = t["cell"][0].as_py()
        return pa.table([t["dim"], pa.array([cell + DIGITS[i] for i in of]), t["vec_id"], t["v"]], names=["dim", "cell", "vec_id", "v"])

    big = big.withColumn("parts", F.ceil(F.col("n") * F.col("dim") * 8 / F.lit(DEAL_BYTES)).cast("int"))
    h = F.pmod(F.xxhash64("vec_id", "v", "cell"), F.lit(1 << 30))
    rows = rows.join(big, ["dim", "cell"]).withColumn("h", h)
    want = F.least(F.lit(FAN), F.floor(F.col("n") / block) + 1)
    some = rows.where(F.col("h") < F.lit(4.0 * (1 << 30)) * want / F.col("n"))  # about four times as many as wanted
    nth = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("h", "vec_id"))
    pivots = some.withColumn("nth", nth).where(F.col("nth") <= want)
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pivots = cut(pivots.select("dim", "cell", "v", part.alias("part")))
    rows = rows.select("dim", "cell", F.pmod(F.col("h"), "parts").cast("int").alias("part"), "vec_id", "v")
    key = ["dim", "cell", "part"]
    return rows.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInArrow(run, "dim int, cell string, vec_id long, v array<long>")


def cells(rows: DataFrame, pivots: list[list[int]], block: int) -> DataFrame:
    """``dim, cell, vec_id, v``: the rows with the path of their cell, dealt until a cell holds at
    most two blocks or a level leaves it whole."""
    now = cut(_near_pivots(rows, pivots))
    done, was = None, None
    while True:
        sizes = now.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        big = sizes.where(F.col("n") > 2 * block)
        if was is not None:  # cells that the last level did not part are left as they are
            parent = F.expr("substring(cell, 1, length(cell) - 1)")
            big = big.withColumn("up", parent).join(was.select("dim", F.col("cell").alias("up"), F.col("n").alias("before")), ["dim", "up"]).where("n < before").select("dim", "cell", "n")
        big = cut(big)
        if not big.take(1):
            return now if done is None else done.unionByName(now)
        small = now.join(big, ["dim", "cell"], "left_anti")
        done = small if done is None else done.unionByName(small)
        now, was = cut(_dealt_again(now, big, block)), big


def _query_cells(rows: DataFrame, size: int) -> DataFrame:
    """The rows under as short a part of their path as holds at most ``size`` of them (all of the
    path, if none does)."""
    sizes = cut(rows.groupBy("dim", "cell").agg(F.count("*").alias("n")))
    parts = sizes.select("dim", "cell", "n", F.explode(F.expr("transform(sequence(2, length(cell)), l -> substring(cell, 1, l))")).alias("part"))
    held = parts.groupBy("dim", "part").agg(F.sum("n").alias("m"))
    short = parts.join(held, ["dim", "part"]).groupBy("dim", "cell").agg(F.min(F.struct(F.col("m") > size, F.when(F.col("m") > size, -F.length("part")).otherwise(F.length("part")), "part")).alias("best"))
    return rows.join(short.select("dim", "cell", "best.part"), ["dim", "cell"]).select("dim", F.col("part").alias("cell"), "vec_id", "v")


def _trees(cells: DataFrame, size: int, copies: int, leaf: int = LEAF) -> DataFrame:
    """``dim, cell, block`` and the block's tree; about ``size`` vectors of a cell make a block, a
    cell of up to twice as many is one. Of equal vectors in a block only the ``copies`` smallest
    ids stay."""

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        ids = np.asarray(t["vec_id"])
        x = np.asarray(t["v"].combine_chunks().flatten()).reshape(len(ids), dim)
        order = np.lexsort((ids, *x.T[::-1])) if dim else np.argsort(ids)
        ids, x = ids[order], x[order]
        fresh = np.concatenate(([True], (x[1:] != x[:-1]).any(1) if dim else np.zeros(len(x) - 1, bool)))
        nth = np.arange(len(x)) - np.maximum.accumulate(np.where(fresh, np.arange(len(x)), 0))
        ids, x = ids[nth < copies], x[nth < copies]
        narrow = bool(np.abs(x).max(initial=0) < 2**31 - 1)
        tree = cover_tree(x, ids, leaf)
        if narrow:
            tree |= {c: tree[c].astype(np.int32) for c in ("vectors", "centre")}
        return pa.table([t["dim"][:1], t["cell"][:1], t["block"][:1], pa.array([narrow]), *(pa.array([b], pa.binary()) for b in _packed(tree))], names=["dim", "cell", "block", "narrow", *_TREE])

    n = F.count("*")
    parts = cells.groupBy("dim", "cell").agg(F.when(n <= 2 * size, F.lit(1)).otherwise(F.ceil(n / size)).alias("parts"))
    block = F.concat("cell", F.lit("-"), F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    dealt = cells.join(parts, ["dim", "cell"]).select("dim", "cell", block.alias("block"), "vec_id", "v")
    return cut(dealt.groupBy("dim", "block").applyInArrow(run, "dim int, cell string, block string, narrow boolean, " + ", ".join(f"{c} binary" for c in _TREE)))


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, dim, v``: floor(scale * x) of every component as a long. Vectors that are
    null, have no component or hold a null or non-finite one are left out; repeated rows count
    once."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = (F.size("embedding") > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("v")).distinct()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _first_search(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Step 1: per query block, packed, the scores and ids found in one block of its pivot, and
    the worst k-th score. Every query is a data vector, so each query block meets a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            q, r = _unpacked(row["q"], row["dim"]), _unpacked(row["r"], row["dim"])
            score, found, _ = dual_search(q, r, k)
            cols = [[row["dim"]], [row["qb"]], [row["db"]], [int(score[:, -1].min(initial=np.iinfo(np.int64).max))], [score.tobytes()], [found.tobytes()], [q["ids"].tobytes()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["dim", "qb", "db", "worst", "score", "found", "ids"])

    parts = data.select("dim", "block", F.explode(F.expr("transform(sequence(2, length(cell)), l -> substring(cell, 1, l))")).alias("cell"))
    first = parts.groupBy("dim", "cell").agg(F.min("block").alias("block"))
    left = queries.select("dim", "cell", F.col("block").alias("qb"), F.struct("narrow", *_TREE).alias("q"))
    right = data.select("dim", F.col("block").alias("db"), F.struct("narrow", *_TREE).alias("r"))
    left = left.join(first.withColumnRenamed("block", "db"), ["dim", "cell"])
    return cut(left.join(right.hint("merge"), ["dim", "db"]).mapInArrow(run, "dim int, qb string, db string, worst long, score binary, found binary, ids binary"))


_BALL = "key string, centre binary, radius double"


def _roots(trees: DataFrame) -> DataFrame:
    """``dim, path, key, centre, radius``: the balls of the blocks, centres as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centres = [np.frombuffer(c, np.int32 if n else np.int64).astype(np.float64).tobytes() for c, n in zip(b.column("centre").to_pylist(), b.column("narrow").to_pylist(), strict=True)]
            radii = [float(np.frombuffer(r)[0]) for r in b.column("radius").to_pylist()]
            yield pa.record_batch([b.column("dim"), b.column("cell"), b.column("block"), pa.array(centres, pa.binary()), pa.array(radii, pa.float64())], ["dim", "path", "key", "centre", "radius"])

    wide = F.when(F.col("narrow"), F.col("dim") * 4).otherwise(F.col("dim") * 8)
    root = trees.select("dim", "cell", "block", "narrow", F.substring("centre", F.lit(1), wide).alias("centre"), F.substring("radius", 1, 8).alias("radius"))
    return root.mapInArrow(run, f"dim int, path string, {_BALL}")


def _over(balls: DataFrame) -> DataFrame:
    """A level up: up to about CHUNK balls under a common path become a row, ``keys, centres,
    radii``, with a ball that covers them under the path without its last digit."""

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        centres = np.frombuffer(b"".join(t["centre"].to_pylist())).reshape(len(t), dim)
        radii = np.asarray(t["radius"])
        centre = centres.mean(0)
        radius = float((np.linalg.norm(centres - centre, axis=1) * (1 + 1e-9) + radii).max()) + 1e-6
        return pa.table([t["dim"][:1], t["up"][:1], t["name"][:1], pa.array([centre.tobytes()], pa.binary()), pa.array([radius]), pa.array([t["key"].to_pylist()]), pa.array([centres.tobytes()], pa.binary()), pa.array([radii.tobytes()], pa.binary())], names=["dim", "path", "key", "centre", "radius", "keys", "centres", "radii"])

    up = balls.withColumn("up", F.expr("substring(path, 1, length(path) - 1)"))
    parts = up.groupBy("dim", "up").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    named = up.join(parts, ["dim", "up"]).withColumn("name", F.concat("up", F.lit("/"), F.pmod(F.xxhash64("key"), "parts")))
    return cut(named.groupBy("dim", "name").applyInArrow(run, f"dim int, path string, {_BALL}, keys array<string>, centres binary, radii binary"))


def block_pairs(queries: DataFrame, data: DataFrame, first: DataFrame) -> DataFrame:
    """Step 2: ``dim, qb, db`` of the pairs of blocks whose roots leave something to find."""
    levels = [_over(_roots(data))]
    while levels[-1].where("path <> ''").take(1):
        levels.append(_over(levels[-1].select("dim", "path", "key", "centre", "radius")))
    asked = _roots(queries).select("dim", F.col("key").alias("qb"), "centre", "radius").join(first.select("dim", "qb", F.col("db").alias("done"), "worst"), ["dim", "qb"])
    asked = cut(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            q, c, radii = np.frombuffer(row["centre"]), np.frombuffer(row["centres"]), np.frombuffer(row["radii"])
            c = c.reshape(len(radii), -1)
            up = _bound(q, np.linalg.norm(q), row["radius"], c, np.linalg.norm(c, axis=1), radii)
            keys = [row["keys"][i] for i in np.flatnonzero(up >= row["worst"]) if row["keys"][i] != row["done"]]
            yield pa.record_batch([pa.array([row["dim"]] * len(keys), pa.int32()), pa.array([row["qb"]] * len(keys), pa.string()), pa.array(keys, pa.string())], ["dim", "qb", "key"])

    # the top level has a row, or few, for each dimension
    pairs = asked.select("dim", "qb").join(F.broadcast(levels[-1].select("dim", "key")), "dim")
    for level in reversed(levels):
        rows = pairs.join(asked, ["dim", "qb"]).join(level.select("dim", "key", "keys", "centres", "radii"), ["dim", "key"])
        pairs = cut(rows.drop("key").mapInArrow(run, "dim int, qb string, key string"))
    return pairs.withColumnRenamed("key", "db")


def search(vectors: DataFrame, query_test: str, k: int = 5, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector that meets ``query_test`` (SQL over
    ``vec_id``) its ``k`` best by integer inner product among all vectors with another id,
    ties to the smaller id; fewer if there are fewer.

    Vectors of another dimension than the query's are not compared with it; rows with a null
    id are left out. An id with several different vectors is that many candidates, and as a
    query it has its k best over all of its vectors. Other columns are ignored; an empty table
    gives an empty result. Vectors whose scores may not fit 64 bits raise an error.
    """
    rows = cut(integer_vectors(vectors))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most = rows.agg(F.count("*"), F.max(square)).first()
    if n and most >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("a score of these vectors may not fit 64 bits")
    rows = cells(rows, chosen_pivots(rows, min(PIVOTS, n // block + 1)), block)
    data = _trees(rows, block, k + 1)
    queries = _trees(_query_cells(rows.where(query_test), query_block), query_block, 1 << 62, GROUP)
    first = _first_search(queries, data, k)

    def results(score: np.ndarray, found: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ok = score > EMPTY
        return pa.record_batch([pa.array(np.repeat(ids, k).reshape(found.shape)[ok]), pa.array(found[ok]), pa.array(score[ok])], ["query_id", "vec_id", "score"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            score, found, ids = (np.frombuffer(row[c], np.int64) for c in ("score", "found", "ids"))
            yield results(score.reshape(-1, k), found.reshape(-1, k), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            q, r = _unpacked(row["q"], row["dim"]), _unpacked(row["r"], row["dim"])
            score, found, _ = dual_search(q, r, k, np.frombuffer(row["score"], np.int64).reshape(-1, k)[:, -1])
            yield results(score, found, q["ids"])

    left = queries.select("dim", F.col("block").alias("qb"), F.struct("narrow", *_TREE).alias("q")).join(first.select("dim", "qb", "score"), ["dim", "qb"])
    right = data.select("dim", F.col("block").alias("db"), F.struct("narrow", *_TREE).alias("r"))
    tiles = block_pairs(queries, data, first).join(left.hint("merge"), ["dim", "qb"]).join(right.hint("merge"), ["dim", "db"])
    kind = "query_id long, vec_id long, score long"
    best = tiles.select("dim", "q", "r", "score").mapInArrow(run, kind).unionByName(first.select("score", "found", "ids").mapInArrow(unpack, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
