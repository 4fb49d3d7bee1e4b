"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a vector's cell is its pair of
codewords. Rows are put in the order of their cells and cut into shards of a bounded size. A
shard keeps its rows by cell, and for every codeword the greatest distance of its halves.

For an anchor (a, b) no row of cell (i, j) scores over a . c_i + |a| r_i + b . d_j + |b| s_j, the
sum of a score for either half. A heap visits the cells of a shard by falling sums (the
multi-sequence order), so that when the next sum is under what is sought, all is found:

1. Positives: the k best of the anchor's label; a shard is left when the next sum is under the
   k-th found there or in the anchor's nearest shard.
2. A positive's score p sets a window of negative scores, from the share ``least`` of p up to p.
   A shard is left when, for every window, the next sum is under its lower end or under the k-th
   score found in it.

Pairs of an anchor block and a shard in which no cell's sum reaches what is sought are not read
at all. Results are exact: the sums bound every score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: rows and components that the codebooks are fit on, at most, and rounds of fitting
FIT, FIT_COMPONENTS, ROUNDS = 16384, 1 << 20, 8
#: codewords of a half, at most; about CELL rows a cell below that
CODES, CELL = 64, 64
SHARD, ANCHORS = 16384, 512
#: rows that are scored at once
AT_ONCE = 2048
#: shards whose cells one task compares with an anchor block's at once
CHUNK = 64
NONE = np.iinfo(np.int64).min
_ARRAYS = {"ids": np.int64, "labels": np.int64, "codes": np.int32, "ends": np.int64, "radii": np.float64, "vectors": np.int64}
_BLOCK = "dim int, block long, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_FOUND = "dim int, qb long, pos int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, v``: floor(256 x) of every component as a long; labels of ids
    divisible by 7 moved on by one. Left out: null ids, null labels, and vectors that are null,
    have no component or hold a null or non-finite one. Equal rows count once."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = (F.size("embedding") > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null").where(F.coalesce(good, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.size("embedding").alias("dim"), F.transform(x, lambda e: F.floor(e * 256.0).cast("long")).alias("v")).distinct()


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` means of the rows, from evenly spaced ones on."""
    means = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = _nearest(x, means)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(means)
        np.add.at(sums, of, x)
        means[n > 0] = sums[n > 0] / n[n > 0, None]
    return means


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(1) - 2 * (x @ means.T)).argmin(1)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def fitted(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves by dimension, from up to FIT rows (and FIT_COMPONENTS) chosen by
    hash. A dimension that the sample lacks has one codeword, zero."""
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    most = max(1, min(FIT, FIT_COMPONENTS // (dim or 1)))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).select("v").collect()]
    k = int(max(1, min(CODES, (n / CELL) ** 0.5)))
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        out[dim] = tuple(codebook(half, min(k, len(x))) for half in _halves(x))
    return out


def _books(books: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return books.get(dim) or tuple(np.zeros((1, d)) for d in (dim // 2, dim - dim // 2))


def _coded(rows: DataFrame, books: dict) -> DataFrame:
    """The rows with their codes, ``i`` and ``j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = np.asarray(part.column("v").flatten()).reshape(-1, d).astype(np.float64)
                codes = [pa.array(_nearest(h, m).astype(np.int32)) for h, m in zip(_halves(x), _books(books, d), strict=True)]
                yield pa.record_batch([*part.columns, *codes], [*part.schema.names, "i", "j"])

    return rows.select("vec_id", "label", "dim", "v").mapInArrow(run, "vec_id long, label long, dim int, v array<long>, i int, j int")


def _radii(x: np.ndarray, codes: np.ndarray, ends: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per half and codeword, the greatest distance of a row of the block; -1 if it has none."""
    out = np.full(len(books[0]) + len(books[1]), -1.0)
    n = np.diff(ends, prepend=0)
    for half, means, code, base in zip(_halves(x.astype(np.float64)), books, codes, (0, len(books[0])), strict=True):
        of = np.repeat(code, n)
        np.maximum.at(out, base + of, np.sqrt(((half - means[of]) ** 2).sum(1)))
    return out


def _blocks(coded: DataFrame, size: int, books: dict) -> DataFrame:
    """Rows in the order of their cells, in blocks of about ``size``, one packed row a block: the
    rows by cell, the cells and their ends, and both halves' radii. A cell of many rows is
    spread over blocks by hash."""
    cells = coded.groupBy("dim", "i", "j").agg(F.count("*").alias("n"))  # CODES squared a dimension, at most
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("i", "j")) - F.col("n")
    dealt = coded.join(F.broadcast(cells.withColumn("before", before)), ["dim", "i", "j"])
    place = F.col("before") + F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("n"))
    rows = dealt.select("dim", F.floor(place / size).alias("block"), "i", "j", "vec_id", "label", "v")

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        i, j, ids = (np.asarray(t[c]).astype(np.int64) for c in ("i", "j", "vec_id"))
        order = np.lexsort((ids, j, i))
        x = np.asarray(t["v"].combine_chunks().flatten()).reshape(len(ids), dim)[order]
        code = (i << 32 | j)[order]
        ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
        codes = np.stack((code[ends - 1] >> 32, code[ends - 1] & 0xFFFFFFFF))
        got = {"ids": ids[order], "labels": np.asarray(t["label"])[order], "codes": codes, "ends": ends, "radii": _radii(x, codes, ends, _books(books, dim)), "vectors": x}
        packed = [pa.array([np.ascontiguousarray(got[c].astype(k)).tobytes()], pa.binary()) for c, k in _ARRAYS.items()]
        return pa.table([t["dim"][:1], t["block"][:1], *packed], names=["dim", "block", *_ARRAYS])

    return cut(rows.groupBy("dim", "block").applyInArrow(run, _BLOCK))


def _unpacked(row: dict, dim: int) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(row[c], k) for c, k in _ARRAYS.items() if c in row}
    return out | {"codes": out["codes"].reshape(2, -1)} | ({"vectors": out["vectors"].reshape(-1, dim)} if "vectors" in out else {})


def half_bounds(anchors: np.ndarray, books: tuple[np.ndarray, np.ndarray], radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor and codeword of a half, what the half's score is at most; no row, no score."""
    out = []
    for q, means, r in zip(_halves(anchors.astype(np.float64)), books, (radii[: len(books[0])], radii[len(books[0]) :]), strict=True):
        norm = np.linalg.norm(q, axis=1)[:, None]
        reach = norm * r
        slack = 1e-9 * norm * (np.linalg.norm(means, axis=1) + r) + 1e-3
        out.append(np.where(r < 0, -np.inf, q @ means.T + reach + slack))
    return out[0], out[1]


def walk(u: np.ndarray, w: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of codewords by falling sums of their bounds, each with its sum."""
    a, b = (np.argsort(-x, kind="stable")[: int((x > -np.inf).sum())] for x in (u, w))
    first, second = u[a].tolist(), w[b].tolist()
    heap = [(-(first[0] + second[0]), 0, 0)] if first and second else []
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(a[i]), int(b[j])
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


class Shard:
    """A block of rows as anchors search it."""

    def __init__(self, block: dict[str, np.ndarray], books: tuple[np.ndarray, np.ndarray]):
        self.ids, self.labels, self.books, self.radii = block["ids"], block["labels"], books, block["radii"]
        self.starts, self.ends = np.append(0, block["ends"][:-1]), block["ends"]
        self.cell = np.full((len(books[0]), len(books[1])), -1)
        self.cell[block["codes"][0], block["codes"][1]] = np.arange(block["codes"].shape[1])
        self.most = float(np.abs(block["vectors"]).max(initial=0))
        self.vectors, self.exact = block["vectors"], block["vectors"].astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        top = self.most * float(np.abs(anchor).max(initial=0)) * len(anchor)
        if top < 2**52:
            return np.rint(self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if top < 2**63:
            return self.vectors[rows] @ anchor
        raise OverflowError("a score of these vectors may not fit 64 bits")

    def visited(self, anchor: np.ndarray, u: np.ndarray, w: np.ndarray, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores, cell after cell in the heap's order, some cells at once, until the
        next sum is under ``least()``."""
        cells, n = [], 0
        for bound, i, j in walk(u, w):
            if bound < least():
                break
            if (c := self.cell[i, j]) >= 0:
                cells.append(c)
                n += self.ends[c] - self.starts[c]
            if n >= AT_ONCE:
                rows = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in cells])
                yield rows, self.scores(rows, anchor)
                cells, n = [], 0
        if cells:
            rows = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in cells])
            yield rows, self.scores(rows, anchor)


class Best:
    """The k best (score, id) between two scores, ties to smaller ids."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        return max(self.low, int(self.score[-1])) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score >= self.least()) & (score <= self.high)
        if ok.any():
            score, ids = np.concatenate((self.score, score[ok])), np.concatenate((self.ids, ids[ok]))
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.ids = score[order], ids[order]


def positives(shard: Shard, anchors: dict[str, np.ndarray], bounds: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray) -> list[Best]:
    """Per anchor the k best rows of its label with another id, of scores from ``floor`` on."""
    out = []
    for n, (q, id_, label) in enumerate(zip(anchors["vectors"], anchors["ids"], anchors["labels"], strict=True)):
        best = Best(k, int(floor[n]), np.iinfo(np.int64).max)
        for rows, score in shard.visited(q, bounds[0][n], bounds[1][n], best.least):
            own = (shard.labels[rows] == label) & (shard.ids[rows] != id_)
            best.add(score[own], shard.ids[rows][own])
        out.append(best)
    return out


def window_of(p: int, least: int) -> tuple[int, int]:
    """Lowest and highest score of a negative of a positive's score, for a share in percent."""
    return -(-least * p // 100), p


def negatives(shard: Shard, anchors: dict[str, np.ndarray], bounds: tuple[np.ndarray, np.ndarray], k: int, windows: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, list[Best]]]:
    """Per anchor (by its place) and window the k best rows of other labels and ids."""
    for n, own in windows.items():
        best = [Best(k, low, high) for low, high in own]
        open_ = [b for b in best if b.low <= b.high]
        if not open_:
            continue
        for rows, score in shard.visited(anchors["vectors"][n], bounds[0][n], bounds[1][n], lambda o=open_: min(b.least() for b in o)):
            other = (shard.labels[rows] != anchors["labels"][n]) & (shard.ids[rows] != anchors["ids"][n])
            for b in open_:
                b.add(score[other], shard.ids[rows][other])
        yield n, best


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _pairs(anchors: DataFrame, shards: DataFrame, books: dict) -> DataFrame:
    """``dim, qb, db, up, mean``: every anchor block against every shard's cells, with the
    highest sum for each anchor, and their mean. No row of a shard is read."""
    n = shards.count() // CHUNK + 1
    heads = shards.select("dim", F.pmod(F.xxhash64("block"), F.lit(n)).alias("chunk"), F.struct(F.col("block").alias("db"), "codes", "radii").alias("head"))
    heads = heads.groupBy("dim", "chunk").agg(F.collect_list("head").alias("heads"))  # about CHUNK of them
    left = anchors.select("dim", F.col("block").alias("qb"), "vectors").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            q, own = np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dim"]), _books(books, row["dim"])
            for head in row["heads"]:
                u, w = half_bounds(q, own, np.frombuffer(head["radii"]))
                i, j = np.frombuffer(head["codes"], np.int32).reshape(2, -1)
                up = np.full(len(q), -np.inf)
                for lo in range(0, len(i), 256):
                    up = np.maximum(up, (u[:, i[lo : lo + 256]] + w[:, j[lo : lo + 256]]).max(1))
                yield pa.record_batch([pa.array([row["dim"]], pa.int32()), pa.array([row["qb"]]), pa.array([head["db"]]), pa.array([up.tobytes()]), pa.array([float(up.mean())])], ["dim", "qb", "db", "up", "mean"])

    return cut(left.join(heads, ["dim", "chunk"]).mapInArrow(run, "dim int, qb long, db long, up binary, mean double"))


def _tiles(pairs: DataFrame, anchors: DataFrame, shards: DataFrame) -> DataFrame:
    """Pairs with all that their search needs."""
    q = anchors.select("dim", F.col("block").alias("qb"), F.struct(*_ARRAYS).alias("q"))
    r = shards.select("dim", F.col("block").alias("db"), F.struct(*_ARRAYS).alias("r"))
    return pairs.join(q.hint("merge"), ["dim", "qb"]).join(r.hint("merge"), ["dim", "db"])


def _opened(row: dict, books: dict) -> tuple[Shard, dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    own, q = _books(books, row["dim"]), _unpacked(row["q"], row["dim"])
    shard = Shard(_unpacked(row["r"], row["dim"]), own)
    return shard, q, half_bounds(q["vectors"], own, shard.radii)


def _find_positives(tiles: DataFrame, k: int, books: dict) -> DataFrame:
    """Positives in each tile; ``floor`` (if the tiles have it) is what anchors know already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            shard, q, bounds = _opened(row, books)
            floor = np.full(len(q["ids"]), NONE)
            for x in row.get("floor") or []:
                floor[x["pos"]] = x["score"]
            found = positives(shard, q, bounds, k, floor)
            pos = np.repeat(np.arange(len(found)), [len(b.ids) for b in found])
            ids, score = (np.concatenate([getattr(b, c) for b in found]) if found else np.empty(0, np.int64) for c in ("ids", "score"))
            yield pa.record_batch([pa.array(np.full(len(pos), row["dim"], np.int32)), pa.array(np.full(len(pos), row["qb"])), pa.array(pos.astype(np.int32)), pa.array(ids), pa.array(score)], ["dim", "qb", "pos", "vec_id", "score"])

    return tiles.mapInArrow(run, _FOUND)


def _reaching(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs in which some anchor's sum reaches the least score that it still looks for:
    ``wanted`` has ``least``, an array of ``pos, score``; ``otherwise`` is for anchors without."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            up = np.frombuffer(row["up"])
            least = np.full(len(up), row["otherwise"])
            for x in row["least"] or []:
                least[x["pos"]] = x["score"]
            keep = slice(0, int((up >= least).any()))
            yield pa.record_batch([pa.array([row["dim"]], pa.int32())[keep], pa.array([row["qb"]])[keep], pa.array([row["db"]])[keep]], ["dim", "qb", "db"])

    return pairs.join(wanted, ["dim", "qb"], "left").mapInArrow(run, "dim int, qb long, db long")


def _best(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def mine(vectors: DataFrame, anchor_test: str, positives_k: int = 5, negatives_k: int = 5, least: int = 80, shard: int = SHARD, block: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every
    anchor (``anchor_test`` is SQL over ``vec_id``) and each of its ``positives_k`` best rows of
    the same label, the ``negatives_k`` best rows of other labels that score from ``least``
    percent of the positive up to the positive.

    Rows and labels as ``usable`` says; rows of another dimension than the anchor's are not
    compared with it, nor are rows of its own id. Ties go to smaller ids. An id with several
    different vectors or labels is that many rows, and as an anchor each of them has results of
    its own. Anchors without a positive, and positives without a negative in the window, give no
    row. Scores beyond 64 bits raise an error. An empty table gives an empty result.
    """
    rows = cut(usable(vectors))
    books = fitted(rows)
    coded = cut(_coded(rows, books))
    shards = _blocks(coded, shard, books)
    anchors = _blocks(coded.where(anchor_test), block, books)
    pairs = _pairs(anchors, shards, books)
    # the nearest shard gives every anchor a score to beat in the others
    near = pairs.groupBy("dim", "qb").agg(F.max_by("db", F.struct("mean", "db")).alias("db"))
    first = cut(_find_positives(_tiles(near, anchors, shards), positives_k, books))
    kth = _best(first, ["dim", "qb", "pos"], positives_k, "place").where(F.col("place") == positives_k)
    floor = cut(kth.groupBy("dim", "qb").agg(F.collect_list(F.struct("pos", "score")).alias("least")))  # a block's anchors
    rest = pairs.join(near, ["dim", "qb", "db"], "left_anti")
    rest = _reaching(rest.withColumn("otherwise", F.lit(float("-inf"))), floor)
    more = _find_positives(_tiles(rest.join(floor.withColumnRenamed("least", "floor"), ["dim", "qb"], "left"), anchors, shards), positives_k, books)
    chosen = cut(_best(first.unionByName(more), ["dim", "qb", "pos"], positives_k, "place"))

    # a little under the least lower end, for a double may be a little over it
    lowest = F.floor(F.min(F.when(F.col("score") >= 0, F.col("score"))) * (least / 100 * (1 - 1e-12))) - 1
    lows = chosen.groupBy("dim", "qb", "pos").agg(lowest.alias("score")).where("score is not null")
    low = lows.groupBy("dim", "qb").agg(F.collect_list(F.struct("pos", "score")).alias("least"))
    reached = _reaching(pairs.withColumn("otherwise", F.lit(float("inf"))), low)
    windows = chosen.groupBy("dim", "qb").agg(F.collect_list(F.struct("pos", "place", "score")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            shard_, q, bounds = _opened(row, books)
            places: dict[int, list[tuple[int, int]]] = {}
            for x in sorted(row["windows"], key=lambda x: (x["pos"], x["place"])):
                places.setdefault(x["pos"], []).append((x["place"], x["score"]))
            own = {pos: [window_of(p, least) for _, p in of] for pos, of in places.items()}
            out = [(pos, place, i, s) for pos, best in negatives(shard_, q, bounds, negatives_k, own) for (place, _), b in zip(places[pos], best, strict=True) for i, s in zip(b.ids.tolist(), b.score.tolist(), strict=True)]
            pos, place, ids, score = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [], [])))
            yield pa.record_batch([pa.array(np.full(len(pos), row["dim"], np.int32)), pa.array(np.full(len(pos), row["qb"])), pa.array(pos.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(ids), pa.array(score)], ["dim", "qb", "pos", "place", "vec_id", "score"])

    found = _tiles(reached.join(windows, ["dim", "qb"]), anchors, shards).mapInArrow(run, "dim int, qb long, pos int, place int, vec_id long, score long")
    best = _best(found, ["dim", "qb", "pos", "place"], negatives_k, "rank").select("dim", "qb", "pos", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.record_batch([pa.array(np.full(len(ids), row["dim"], np.int32)), pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["dim", "qb", "pos", "anchor_id"])

    who = anchors.select("dim", "block", "ids").mapInArrow(names, "dim int, qb long, pos int, anchor_id long")
    known = chosen.select("dim", "qb", "pos", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(who, ["dim", "qb", "pos"])
    return best.join(known, ["dim", "qb", "pos", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: the same by all pairs
ORACLE_SQL = """
with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
 from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
v as (select *, row_number() over () as n from r),
c as (select n, vec_id, label, len(x) as dim, unnest(x) as c, generate_subscripts(x, 1) as i from v),
p as (select a.n, b.n as m, any_value(a.vec_id) as anchor_id, any_value(b.vec_id) as vec_id, any_value(a.label = b.label) as same, cast(sum(a.c * b.c) as bigint) as score
 from c a join c b on a.i = b.i and a.dim = b.dim and a.vec_id <> b.vec_id where a.vec_id % 100 = 0 group by a.n, b.n),
g as (select * from p where same qualify row_number() over (partition by n order by score desc, vec_id) <= 5),
h as (select g.anchor_id, g.vec_id as positive_id, row_number() over (partition by g.n, g.m order by p.score desc, p.vec_id) as rank, p.vec_id as negative_id, g.score as positive_score, p.score as negative_score
 from g join p on p.n = g.n and not p.same and 80 * g.score <= 100 * p.score and p.score <= g.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from h where rank <= 5"""
