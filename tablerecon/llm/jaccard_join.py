"""Exact Jaccard join of documents on word shingles, as connected groups.

Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of
``percent`` / 100 or more. No link between different texts is lost:

1. Texts with equal shingle sets fall together first (one *set* stands for all its copies).
2. Shingle hashes are dealt into buckets as packed arrays; each bucket finds the shingles that
   at least two sets hold, and how many hold them. Shingles that a sample shows to be in very
   many sets are dealt by row instead, over all buckets: that they are shared is known. A set
   whose shared shingles are fewer than the similarity needs can link with nothing and leaves.
   A task writes at most LANES packed rows per run of shingles; more buckets, or groups of
   sets, than that are reached in a second exchange, so rows stay well filled at any size.
3. A set's shingles are ordered rarest first; two sets over the threshold share a shingle
   within the first n - ceil(t n) + 1 of each (prefix principle), so only sets that meet
   under such a shingle are compared.
4. Cheap links first: every set is compared with one leader of each of its min-hash groups,
   then with one leader of each prefix shingle; verified links form groups.
5. What still meets under a shingle across different groups is compared in size-banded tiles:
   hashed bitmap signatures bound the overlap from above (sets that differ in d bits differ in
   at least d elements), and only pairs that pass get the exact intersection. A tile never
   compares inside one group, and gives at most ``pairs_per_set`` untried pairs a set and
   round; the rounds go on until no untried pair is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, passed_on, pieces_for
from .textbytes import chunks, mix, shingle_sets

BITS = 1024
TILE = 1024
#: rows that a run of shingles is dealt to at once
LANES = 4096
#: shingles of one run
RUN = 1_000_000
#: the share of documents, and the most of them, that are searched for hot shingles; a shingle is
#: hot if HOT_SETS of their sets, and one in HOT_ONE_IN, hold it
HOT_SHARE, HOT_DOCS, HOT_SETS, HOT_ONE_IN = 0.02, 200_000, 20, 200
#: up to so many edges (16 bytes each) a step's minima are broadcast
BROADCAST_EDGES = 200_000
_U = np.uint64


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set of hashes."""
    return tuple(int(np.sum(mix(s ^ _U(c))).astype(np.uint64).view(np.int64)) for c in (0x1234567F, 0x7B00B135FF))


def shingle_counts(docs: DataFrame, k: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_shingles, d1, d2``: size and digest of each text's shingle set. Columns
    ``keep`` of ``docs`` are passed on."""
    keep = keep or []
    kept, schema = passed_on(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2 = [], [], []
            for texts in chunks(b.column("text")):
                for s in shingle_sets(texts, k):
                    x, y = _digests(s) if len(s) else (0, 0)
                    n.append(len(s)), d1.append(x), d2.append(y)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *(b.column(c) for c in keep)], ["doc_id", "n_shingles", "d1", "d2", *keep])

    return docs.select("doc_id", "text", *kept).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long" + schema)


def _parts(rows: dict[str, list], part: np.ndarray, ent: np.ndarray, size: np.ndarray, token: np.ndarray, rank: np.ndarray) -> None:
    """Adds a packed row per part to ``rows``: the part's sets, their sizes and numbers of
    tokens, the tokens and ranks."""
    order = np.lexsort((ent, part))
    part, ent, size, token, rank = part[order], ent[order], size[order], token[order], rank[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for lo, hi in zip(first, [*first[1:], len(part)], strict=True):
        own = ent[lo:hi]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows["part"].append(int(part[lo]))
        rows["sets"].append(own[head].tobytes())
        rows["sizes"].append(size[lo:hi][head].astype(np.int32).tobytes())
        rows["counts"].append(np.diff(np.append(head, hi - lo)).astype(np.int32).tobytes())
        rows["tokens"].append(token[lo:hi].tobytes())
        rows["ranks"].append(rank[lo:hi].tobytes())


_PART = ["part", "sets", "sizes", "counts", "tokens", "ranks"]
_PART_KIND = "part int, sets binary, sizes binary, counts binary, tokens binary, ranks binary"
_DEALT_KIND = "bucket int, sub int, sets binary, sizes binary, entries binary"


def _flat_parts(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set, size, token and rank of every entry of packed part rows."""
    kinds = {"sets": np.int64, "sizes": np.int32, "counts": np.int32, "tokens": np.uint64, "ranks": np.uint8}
    cols = {c: np.concatenate([np.frombuffer(x, d) for x in t[c].to_pylist()]) for c, d in kinds.items()}
    return np.repeat(cols["sets"], cols["counts"]), np.repeat(cols["sizes"], cols["counts"]), cols["tokens"], cols["ranks"]


def _hot(docs: DataFrame, k: int, share: float) -> np.ndarray:
    """Hashes of shingles that many sets hold, by a sample of the documents. It only decides
    which way a shingle goes; results are the same with any."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * share)).select("text")
    sets = _entries_of(sample, k)
    n = sets.agg(F.countDistinct("d")).first()[0]
    held = sets.groupBy("h").agg(F.countDistinct("d").alias("n")).where(F.col("n") >= max(HOT_SETS, n // HOT_ONE_IN))
    return np.sort(np.array([r["h"] for r in held.select("h").collect()], np.int64).view(np.uint64))  # HOT_ONE_IN times a set's size at most


def _entries_of(docs: DataFrame, k: int) -> DataFrame:
    """``d, h``: digest and shingle hash, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in chunks(b.column("text"), 1 << 18):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                if sets:
                    d = np.repeat(np.array([_digests(s)[0] for s in sets], np.int64), [len(s) for s in sets])
                    yield pa.record_batch([pa.array(d), _as_long(np.concatenate(sets))], ["d", "h"])

    return docs.mapInArrow(run, "d long, h long")


def _pack_entries(rows: dict[str, list], bucket: int, sub: int, keys: np.ndarray, size: np.ndarray, key: np.ndarray, of: np.ndarray) -> None:
    """Adds a row of a bucket: its sets, and per entry 48 bits over a 16-bit index into them."""
    own, idx = np.unique(of, return_inverse=True)
    rows["bucket"].append(bucket)
    rows["sub"].append(sub)
    rows["sets"].append(keys[own].tobytes())
    rows["sizes"].append(size[own].astype(np.int32).tobytes())
    rows["entries"].append((key & ~_U(0xFFFF) | idx.astype(np.uint64)).tobytes())


def _dealt_batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows["bucket"], pa.int32()), pa.array(rows["sub"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("sets", "sizes", "entries"))], list(rows))


def _no_rows() -> dict[str, list]:
    return {"bucket": [], "sub": [], "sets": [], "sizes": [], "entries": []}


def _dealt(docs: DataFrame, k: int, n_lanes: int, hot: np.ndarray) -> DataFrame:
    """Shingle hashes by lane, the first bits of the hash. A row holds one task run's entries of
    a lane. Hot shingles go, by their number in ``hot``, to lanes from ``n_lanes`` on, whichever
    the run is dealt to."""
    bits = (n_lanes - 1).bit_length()

    def flush(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(sets, np.int64, len(sets))
        size = np.fromiter((len(s) for s in sets.values()), np.int64, len(sets))
        h = np.concatenate(list(sets.values()))
        of = np.repeat(np.arange(len(keys)), size)
        rows = _no_rows()
        if len(hot):
            nth = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            known = hot[nth] == h
            if known.any():
                _pack_entries(rows, n_lanes + int(mix(keys[:1].view(np.uint64))[0] % _U(n_lanes)), 0, keys, size, nth[known].astype(np.uint64) << _U(16), of[known])
            h, of = h[~known], of[~known]
        lane = (h >> _U(64 - bits)).astype(np.uint16) if bits else np.zeros(len(h), np.uint16)
        order = np.argsort(lane, kind="stable")
        at = np.searchsorted(lane[order], np.arange(n_lanes + 1))
        h, of = (h << _U(bits))[order], of[order]
        for i in np.flatnonzero(at[1:] > at[:-1]):
            _pack_entries(rows, int(i), 0, keys, size, h[at[i] : at[i + 1]], of[at[i] : at[i + 1]])
        yield _dealt_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            for texts in chunks(b.column("text")):
                for s in shingle_sets(texts, k):
                    if len(s) and (d := _digests(s)[0]) not in sets:
                        sets[d] = s
                        held += len(s)
                    if held > RUN or len(sets) >= 60_000:
                        yield from flush(sets)
                        sets, held = {}, 0
        if sets:
            yield from flush(sets)

    return docs.select("text").mapInArrow(run, _DEALT_KIND)


def _deal_again(dealt: DataFrame, n_lanes: int, n_sub: int) -> DataFrame:
    """Splits every lane by the next bits of its hashes into ``n_sub`` parts, ``sub``; the rows
    of hot shingles are dealt by row."""
    bits = _U((n_sub - 1).bit_length())

    def flush(lane: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(s) for s, _, _ in held)])
        keys, size = np.concatenate([s for s, _, _ in held]), np.concatenate([n for _, n, _ in held])
        entries = np.concatenate([e for _, _, e in held])
        of = (entries & _U(0xFFFF)).astype(np.int64) + np.repeat(base[:-1], [len(e) for _, _, e in held])
        sub = (entries >> (_U(64) - bits)).astype(np.int64) if lane < n_lanes else np.full(len(entries), int(mix(keys[:1].view(np.uint64))[0] % _U(n_sub)))
        order = np.argsort(sub, kind="stable")
        at = np.searchsorted(sub[order], np.arange(n_sub + 1))
        rows = _no_rows()
        for i in np.flatnonzero(at[1:] > at[:-1]):
            own = order[at[i] : at[i + 1]]
            _pack_entries(rows, lane, int(i), keys, size, entries[own], of[own])
        yield _dealt_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes: dict[int, list] = {}
        count: dict[int, list[int]] = {}
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                lane, own = row["bucket"], (np.frombuffer(row["sets"], np.int64), np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["entries"], np.uint64))
                n = count.setdefault(lane, [0, 0])
                if n[0] + len(own[0]) > 60_000 or n[1] > RUN:
                    yield from flush(lane, lanes.pop(lane))
                    n = count[lane] = [0, 0]
                lanes.setdefault(lane, []).append(own)
                n[0] += len(own[0])
                n[1] += len(own[2])
        for lane, held in lanes.items():
            yield from flush(lane, held)

    # a lane is many tasks' work: it goes to as many as it will have parts
    return dealt.repartition(F.col("bucket"), F.pmod(F.xxhash64("sets"), F.lit(max(1, n_sub // 4)))).mapInArrow(run, _DEALT_KIND)


def _shared(dealt: DataFrame, n_parts: int, n_lanes: int, hot: np.ndarray) -> DataFrame:
    """Per bucket: the entries whose shingle at least two sets hold, dealt by set. ``rank`` is
    a coarse logarithm of the number of holders, the order of step 3; hot shingles come last."""
    bits = _U((n_lanes - 1).bit_length())
    low = _U((1 << (16 - int(bits))) - 1)

    def run(t: pa.Table) -> pa.Table:
        ents, sizes, entries, of, base = [], [], [], [], 0
        for s, n, e in zip(t["sets"].to_pylist(), t["sizes"].to_pylist(), t["entries"].to_pylist(), strict=True):
            ents.append(np.frombuffer(s, np.int64))
            sizes.append(np.frombuffer(n, np.int32))
            entries.append(np.frombuffer(e, np.uint64))
            of.append((entries[-1] & _U(0xFFFF)).astype(np.int64) + base)
            base += len(ents[-1])
        ent, size, key, of = np.concatenate(ents), np.concatenate(sizes), np.concatenate(entries) >> _U(16), np.concatenate(of)
        bucket = int(t["bucket"][0].as_py())
        if bucket < n_lanes:
            order = np.argsort(key)
            key, of = key[order], of[order]
            same = key[1:] == key[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, of = key[twice], of[twice]
        order = np.lexsort((ent[of], key))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ent[of][1:] != ent[of][:-1])
        key, of = key[new], of[new]
        if bucket < n_lanes:
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            holders = np.diff(np.append(first, len(key)))
            rank = np.repeat(np.minimum(254, np.log2(np.maximum(holders, 1)) * 8).astype(np.uint8), holders)
            keep = np.repeat(holders > 1, holders)
            key, of, rank = key[keep], of[keep], rank[keep]
            token = (_U(bucket) << (_U(64) - bits) if bits else _U(0)) | (key << (_U(16) - bits))
        else:
            token, rank = hot[key.astype(np.int64)] & ~low, np.full(len(key), 255, np.uint8)
        rows: dict[str, list] = {c: [] for c in _PART}
        _parts(rows, (mix(ent[of].view(np.uint64)) % _U(n_parts)).astype(np.int64), ent[of], size[of], token, rank)
        return pa.table([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in _PART[1:])], names=_PART)

    return dealt.groupBy("bucket", "sub").applyInArrow(run, _PART_KIND)


def _part_again(shared: DataFrame, n_parts: int, n_sub: int) -> DataFrame:
    """Splits every part of sets into ``n_sub``, ``part`` then being of n_parts x n_sub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ent, size, token, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            h = mix(ent.view(np.uint64))
            rows: dict[str, list] = {c: [] for c in _PART}
            _parts(rows, (h % _U(n_parts) * _U(n_sub) + h // _U(n_parts) % _U(n_sub)).astype(np.int64), ent, size, token, rank)
            return pa.record_batch([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in _PART[1:])], _PART)

        for b in batches:
            for lo in range(0, len(b), 16):
                held.append(_flat_parts(b.slice(lo, 16)))
                n += len(held[-1][0])
                if n > RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return shared.repartition(F.col("part"), F.pmod(F.xxhash64("tokens"), F.lit(max(1, n_sub // 4)))).mapInArrow(run, _PART_KIND)


def _able(shared: DataFrame, percent: int) -> DataFrame:
    """Sets that can link with another: ``ent, n, toks`` (shared shingles, rarest first),
    ``n_pre`` (how many of them are in the prefix) and ``mh`` (two min-hashes)."""

    def run(t: pa.Table) -> pa.Table:
        ent, size, token, rank = _flat_parts(t)
        order = np.lexsort((token, rank, ent))
        ent, size, token = ent[order], size[order], token[order]
        head = np.flatnonzero(np.concatenate(([True], ent[1:] != ent[:-1])))
        count, n = np.diff(np.append(head, len(ent))), size[head].astype(np.int64)
        need = (n * percent + 99) // 100
        able = count >= need
        pre = n - need + 1 - (n - count)
        mh = [np.minimum.reduceat(mix(token ^ _U(c)), head) for c in (0xA5A5A5A5A5A5, 0x5A5A5A5A5A5A5A)]
        wide = np.repeat(able, count)
        return pa.table(
            [
                pa.array(ent[head][able]), pa.array(n[able]),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[able]))).astype(np.int32)), _as_long(token[wide])),
                pa.array(pre[able].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * able.sum() + 1, 2, dtype=np.int32)), _as_long(np.stack([m[able] for m in mh], 1).ravel() if able.any() else np.zeros(0, np.uint64))),
            ],
            names=["ent", "n", "toks", "n_pre", "mh"],
        )

    return shared.groupBy("part").applyInArrow(run, "ent long, n long, toks array<long>, n_pre int, mh array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets whose exact similarity reaches the threshold."""
    a = sets.select(F.col("ent").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    b = sets.select(F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").where(near & (100 * both >= percent * (F.col("na") + F.col("nb") - both))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``ent, comp``: the smallest id reachable from each end of the edges ``a, b``.

    Alternates large-star and small-star steps until nothing moves; a node with many
    neighbours costs rows, not one task, for each step's minimum is pre-aggregated and its
    join is left to Spark's skew splitting.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    small = False

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = F.broadcast(low) if small else cut(low)
        near = near.join(low, "a")
        if large:
            return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")).where("a <> b")).distinct()

    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    was = None
    while (now := edges.agg(F.count("*"), total).first()) != was:
        small = now[0] <= BROADCAST_EDGES
        half = star(edges, True)
        was, edges = now, cut(star(half if small else cut(half), False))
    return edges.select(F.col("a").alias("ent"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("ent"), F.col("b").alias("comp")).distinct())


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("ent"))
    return rows.join(comps, "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))


def _mixed(tokens: DataFrame) -> DataFrame:
    """Rows of the prefix shingles under which sets of different groups still meet."""
    open_ = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    return tokens.join(cut(open_), "token")


def _tile_pairs(percent: int, pairs_per_set: int):
    """Pairs of each tile: different groups, close sizes, bitmaps that allow the overlap. One
    call gets some whole tiles, told apart by ``tile``."""

    def run(t: pa.Table) -> pa.Table:
        cols = [np.asarray(t[c]) for c in ("tile", "n", "ent", "own", "comp", "side")]
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(t), BITS // 64)
        order = np.lexsort((cols[1], cols[0]))
        tile, n, ent, own, comp, side = (c[order] for c in cols)
        bits = bits[order]
        head = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        last = np.append(head[1:], len(tile))
        out_a, out_b, more = [], [], False
        for first, end in zip(head, last, strict=True):
            size = n[first:end]
            lo = first + np.searchsorted(size, (size * percent + 99) // 100)
            hi = first + np.searchsorted(size, size * 100 // percent, "right")
            for i in range(first, end):
                if side[i] == 1:
                    continue
                j = np.arange(lo[i - first], hi[i - first])
                j = j[(comp[j] != comp[i]) & ((side[j] == 1) | ((side[j] == 2) & (j > i)))]
                if not len(j):
                    continue
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
                bound = (own[i] + own[j] - apart.astype(np.int64)) // 2
                ok = 100 * bound >= percent * (n[i] + n[j] - bound)
                j, bound = j[ok], bound[ok]
                if len(j) > pairs_per_set:
                    more = True
                    j = j[np.argsort(-bound, kind="stable")[:pairs_per_set]]
                out_a.append(np.full(len(j), ent[i]))
                out_b.append(ent[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), more))], names=["a", "b", "more"])

    return run


def _bitmaps(sets: DataFrame) -> DataFrame:
    """``ent, bits``: each set's shared shingles hashed into BITS bits. Shingles that only one
    set holds add nothing to any overlap and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = b.column("toks")
            flat, at = np.asarray(toks.flatten()).view(np.uint64), np.asarray(toks.offsets)
            at = at - at[0]
            bit = mix(flat ^ _U(0xB17)) % _U(BITS)
            out = np.zeros((len(b), BITS), np.uint8)
            out[np.repeat(np.arange(len(b)), np.diff(at)), bit.astype(np.int64)] = 1
            packed = np.packbits(out, axis=1)
            yield pa.record_batch([b.column("ent"), pa.array([x.tobytes() for x in packed], pa.binary())], ["ent", "bits"])

    return sets.select("ent", "toks").mapInArrow(run, "ent long, bits binary")


def _tiles(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the tiles. Under one shingle, the largest group is dealt into chunks (side 1)
    that never meet each other; all other sets (side 0 against them, side 2 among themselves)
    are dealt into chunks that meet every chunk."""
    count = tokens.groupBy("token", "comp").agg(F.count("*").alias("c"))
    top = count.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m")).select("token", F.col("top.comp").alias("major"), F.ceil(F.col("top.c") / TILE).cast("int").alias("cj"), F.ceil((F.col("m") - F.col("top.c")) / TILE).cast("int").alias("ci"))
    x = tokens.select("token", "ent", "comp").join(cut(top), "token").withColumn("deal", F.pmod(F.xxhash64("ent"), F.lit(1 << 30)).cast("int"))
    major = F.col("comp") == F.col("major")
    i, j = F.col("deal") % F.col("ci"), F.col("deal") % F.col("cj")
    tile = lambda kind, p, q, side: F.struct(kind.alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
    to_minor = F.transform(F.sequence(F.lit(0), F.col("ci") - 1), lambda p: tile(F.lit(0), p, j, F.lit(1)))
    from_minor = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("cj") - 1), lambda q: tile(F.lit(0), i, q, F.lit(0))),
        F.transform(F.sequence(F.lit(0), F.col("ci") - 1), lambda p: tile(F.lit(1), F.least(p, i), F.greatest(p, i), F.lit(2))),
    )
    x = x.select("token", "ent", "comp", F.explode(F.when(major, to_minor).otherwise(from_minor)).alias("t")).select("ent", "comp", "t.side", F.xxhash64("token", "t.kind", "t.p", "t.q").alias("tile"))
    return x.join(sets.select("ent", "n", F.size("toks").cast("long").alias("own")), "ent").join(_bitmaps(sets), "ent")


def _shared_of(docs: DataFrame, k: int, total: int, bucket_bytes: int, lanes: int, n_docs: int) -> DataFrame:
    """Step 2 for ``total`` shingles: as many buckets as keep one under ``bucket_bytes``, and as
    many parts of sets."""
    n = 1 << (pieces_for(total * 8.0, bucket_bytes) - 1).bit_length()
    hot = _hot(docs, k, min(HOT_SHARE, HOT_DOCS / max(1, n_docs)))
    first = min(n, lanes)
    dealt = _dealt(docs, k, first, hot)
    if n > first:
        dealt = _deal_again(dealt, first, n // first)
    shared = _shared(dealt, first, first, hot)
    return _part_again(shared, first, n // first) if n > first else shared


def _grouped(docs: DataFrame, best: Column, k: int, percent: int, pairs_per_set: int, bucket_bytes: int, keep: list[str] | None = None, lanes: int = LANES) -> tuple[DataFrame, DataFrame]:
    """The rows' ``shingle_counts``, and ``ent, d2, rep, comp`` of every shingle set: ``best``
    over the rows that hold it, and its group."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(keep or []))
    counts = cut(shingle_counts(docs, k, keep))
    total = counts.agg(F.sum("n_shingles")).first()[0] or 0
    reps = counts.where("n_shingles > 0").groupBy("d1", "d2").agg(best.alias("rep"))
    comps = None
    if total:
        comps = _linked(cut(_able(_shared_of(docs, k, total, bucket_bytes, lanes, counts.count()), percent)), percent, pairs_per_set)
    if comps is not None:
        reps = reps.withColumnRenamed("d1", "ent").join(comps, "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
    else:
        reps = reps.withColumnRenamed("d1", "ent").withColumn("comp", F.col("ent"))
    return counts, cut(reps)


def first_of_groups(docs: DataFrame, key: list[str], k: int = 5, percent: int = 75, pairs_per_set: int = 32, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles`` of every row, and ``doc_id`` with the whole-number columns
    ``key`` of the first row of each group of ``similar_groups``: the smallest id, null ids
    last, then the smallest ``key``. Wordless rows are in no group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key))
    counts, reps = _grouped(docs, first, k, percent, pairs_per_set, bucket_bytes, key)
    return counts.select("doc_id", "n_shingles"), reps.groupBy("comp").agg(F.min("rep").alias("rep")).select("rep.doc_id", *[f"rep.{c}" for c in key])


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 75, pairs_per_set: int = 32, bucket_bytes: int = 16 << 20, lanes: int = LANES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable by links, the row's own included. Null
    and wordless texts have no shingles and link with nothing. Rows with a null doc_id keep
    it and form groups whose id is the smallest non-null one, if any. Repeated rows come back
    as often as they came. Other columns are ignored.
    """
    counts, reps = _grouped(docs, F.min("doc_id"), k, percent, pairs_per_set, bucket_bytes, lanes=lanes)
    names = cut(reps.groupBy("comp").agg(F.min("rep").alias("component_id")))
    label = cut(reps.join(names, "comp").select(F.col("ent").alias("d1"), "d2", "component_id"))
    return counts.join(label, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _linked(sets: DataFrame, percent: int, pairs_per_set: int) -> DataFrame | None:
    """Groups of the sets, steps 4 and 5 of the module's method; None without any link."""
    keys = sets.select("ent", F.posexplode("mh").alias("k", "mh"))
    lead = cut(keys.groupBy("k", "mh").agg(F.min("ent").alias("lead"), F.count("*").alias("m")).where("m > 1"))
    pairs = keys.join(lead, ["k", "mh"]).where("ent <> lead").select(F.col("ent").alias("a"), F.col("lead").alias("b")).distinct()
    links = cut(_verified(cut(pairs), sets, percent))
    # until links are joined up, a set counts as grouped with its smallest verified leader
    stars = links.groupBy(F.greatest("a", "b").alias("ent")).agg(F.min(F.least("a", "b")).alias("comp"))
    heads = cut(stars.select("comp").distinct()).select(F.col("comp").alias("ent"), "comp")
    comps = stars.unionByName(heads.join(stars.select("ent"), "ent", "left_anti"))
    tokens = cut(sets.select("ent", "n", F.explode(F.slice("toks", 1, F.col("n_pre"))).alias("token")))
    leaders_only = True
    while True:
        comps = cut(comps) if comps is not None else None
        open_ = cut(_mixed(_labelled(tokens, comps)))
        if not open_.take(1):
            return comps
        if leaders_only:  # one leader of each shingle against one set of each other group
            ends = open_.groupBy("token", "comp").agg(F.min("ent").alias("a"))
            heads = cut(open_.groupBy("token").agg(F.min(F.struct("comp", "ent")).alias("head")))
            pairs = ends.join(heads, "token").where("comp <> head.comp").select("a", F.col("head.ent").alias("b")).distinct()
            leaders_only, more = False, True
        else:
            deal = F.pmod("tile", F.lit(pieces_for(open_.count() * 400.0, 4 << 20)))
            found = cut(_tiles(open_, sets).groupBy(deal.alias("deal")).applyInArrow(_tile_pairs(percent, pairs_per_set), "a long, b long, more boolean"))
            more = found.agg(F.max("more")).first()[0]
            pairs = found.select("a", "b").distinct()
            pairs_per_set *= 16
        links = cut(links.unionByName(_verified(cut(pairs), sets, percent)))
        comps = components(links) if links.take(1) else None
        if not more:
            return comps
