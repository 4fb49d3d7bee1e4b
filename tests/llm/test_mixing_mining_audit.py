"""Source mixing, hard negatives and the filter audit against plain versions."""

import heapq
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablerecon.llm import filter_audit, hard_negatives, mixing
from tablerecon.llm.common import stored

DOCS = "doc_id long, text string, source string, size long"


# --- mixing


def corpus(spark, sources):
    """Documents of 1 to 40 words; a source's name and number of documents are given."""
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for name, n in sources:
        for _ in range(n):
            i += 1
            rows.append((i, " \n".join(f"w{i}x{k}" for k in range(int(rng.integers(1, 40)))), name, -1))
    return spark.createDataFrame(rows, DOCS)


def plain_targets(sizes):
    """Limits held one after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held = {s for s in names if not sizes[s]}
    total = Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        rate = (total - sum(2 * sizes[s] for s in held)) / (sum(weight[s] for s in free) or 1)
        above = {s for s in free if weight[s] * rate > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in held else weight[s] * rate for s in names}
        held |= above


def plain_blocks(targets, sizes, block):
    """Block by block to the highest quotient."""
    house, blocks = int(sum(targets.values()) / block + Fraction(1, 2)), Counter()
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    heap = [(-targets[s], i, s) for i, s in enumerate(names)]
    heapq.heapify(heap)
    for _ in range(house):
        while heap and (blocks[heap[0][2]] + 1) * block > 2 * sizes[heap[0][2]]:
            heapq.heappop(heap)
        if not heap:
            break
        _, i, s = heapq.heappop(heap)
        blocks[s] += 1
        heapq.heappush(heap, (-targets[s] / (2 * blocks[s] + 1), i, s))
    return blocks


@pytest.mark.parametrize("block", [1, 16, 50])
def test_mix_against_highest_quotients(spark, block):
    docs = corpus(spark, [("b", 60), ("a", 9), (None, 40), ("é", 3), ("z", 0), ("A", 30), ("c", 1), ("d", 1)])
    got = mixing.mix(docs, block=block, shard_blocks=20).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(r.text.split())
    want = plain_targets(sizes)
    blocks = plain_blocks(want, sizes, block)
    assert len(got) == docs.count()
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(math.isclose(r.target, float(want[s]), rel_tol=1e-12) for r in own)
        assert sum(r.taken for r in own) == blocks[s] * block
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    # no word is taken twice before all of its source are taken once
    for s in sizes:
        least = blocks[s] * block // sizes[s]
        assert all(least * r.size <= r.taken <= (least + 1) * r.size for r in got if r.source == s)


def test_mix_pieces_and_quotas(spark):
    docs = corpus(spark, [("a", 50), ("b", 50), (None, 50)])
    mixed = stored(mixing.mix(docs, block=4, shard_blocks=50), "mixed")
    rows = mixed.collect()
    assert all(sum(p.length for p in r.pieces) == r.taken and all(0 <= p.start and p.start + p.length <= r.size for p in r.pieces) for r in rows)
    words = Counter()
    for r in rows:
        for p in r.pieces:
            words[p.shard, r.source] += p.length
    blocks = Counter()
    for r in rows:
        blocks[r.source] += r.taken
    sources = spark.createDataFrame([(s, n // 4) for s, n in blocks.items()], "source string, blocks long")
    shards = 1 + max(k for k, _ in words)
    quotas = {(r.shard, r.source): r.blocks * 4 for r in mixing.shard_quotas(sources, shards).collect()}
    assert {k: v for k, v in quotas.items() if v} == dict(words) and shards > 10
    for s, n in blocks.items():  # each shard is within a block of its share
        assert all(abs(quotas[k, s] - n / shards) <= 4 for k in range(shards))
    text = {r.doc_id: r.text.split() for r in docs.collect()}
    for r in mixing.texts(docs, mixed).collect():
        assert r.text == " ".join(text[r.doc_id][r.start : r.start + r.length])


def test_mix_is_seeded(spark):
    docs = corpus(spark, [("a", 30), ("b", 90)])
    take = lambda seed, d: {r.doc_id: r.taken for r in mixing.mix(d, seed=seed).collect()}
    assert take("x", docs) == take("x", docs.repartition(7)) != take("y", docs)


def test_mix_of_repeated_and_wordless_rows(spark):
    rows = [(1, "a b c", "s", 0)] * 9000 + [(None, "a b", None, 0)] * 50 + [(None, None, None, 0), (2, "", "t", 0), (3, " \t", "t", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == {(1, 3): 9000, (None, 2): 50, (None, 0): 1, (2, 0): 1, (3, 0): 1}
    assert all(r.taken <= 2 * r.size for r in got) and {r.target for r in got if r.source == "t"} == {0.0}
    nothing = mixing.mix(spark.createDataFrame([(1, None, None, 0)], DOCS)).collect()
    assert [(r.size, r.source_size, r.target, r.taken, r.pieces) for r in nothing] == [(0, 0, 0.0, 0, [])]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a ", "a\x0bb\x0cc\rd\te\nf", "\u00a0 x\u2003y", "\n\n", "ab  cd", "a" * 100_000 + " b", " " * 200_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.n_words(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 1, 6, 2, 0, 2, 2, 0]


# --- hard negatives


def plain_negatives(rows):
    """All pairs, by definition."""
    use = []
    for i, v, y in {(i, None if v is None else tuple(v), y) for i, v, y in rows}:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for a, v, y in use:
        if a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in use if i != a and len(w) == len(v)]
        for s, i, _ in sorted((x for x in scored if x[2] == y), key=lambda x: (-x[0], x[1]))[:5]:
            own = sorted((x for x in scored if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s), key=lambda x: (-x[0], x[1]))[:5]
            out += [(a, i, n, j, s, t) for n, (t, j, _) in enumerate(own, 1)]
    return Counter(out)


def mined(spark, rows, **options):
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, dim int, score int")
    return Counter(tuple(r) for r in hard_negatives.mine(vectors, "vec_id % 100 = 0", **options).collect())


def test_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    near = [(i, (rng.normal(size=6) / 8 + 1).round(2).tolist(), int(rng.integers(3))) for i in range(900)]  # many ties
    rows = near + near[:50] + [(2000, [1.0] * 6, 1), (2100, [1.0] * 4, 1), (2101, [1.0] * 4, 1), (2102, [0.9] * 4, 2)]
    rows += [(None, [1.0] * 6, 1), (3000, None, 1), (3100, [1.0] * 6, None), (3200, [float("nan")] * 6, 1), (3300, [None] + [1.0] * 5, 1), (3400, [float("inf")] * 6, 1), (3500, [], 1), (-100, [1.0] * 6, 2)]
    want = plain_negatives(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, shard=100, block=3) == want


def test_negatives_of_odd_tables(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(100, [1.0, 2.0], 1)])
    assert not mined(spark, [(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)])  # a positive below zero has no window
    same = [(i, [1.0, 1.0], i % 2) for i in range(301) if i % 7]
    assert mined(spark, same) == plain_negatives(same)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [1e17] * 8, 1), (1, [1e17] * 8, 1)])


def test_walk_goes_by_falling_sums():
    rng = np.random.default_rng(1)
    u, w = rng.normal(size=12), rng.normal(size=9)
    u[3] = -np.inf
    got = list(hard_negatives.walk(u, w))
    assert len({(i, j) for _, i, j in got}) == len(got) == 99 and all(s == u[i] + w[j] for s, i, j in got)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)


def test_bounds_hold_and_leave_cells_out():
    """On clustered vectors most rows are never scored, and no score is over its cell's sum."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 100
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16))).astype(np.int64)
    books = tuple(hard_negatives.codebook(h.astype(float), 30) for h in hard_negatives._halves(x))
    i, j = (hard_negatives._nearest(h, m) for h, m in zip(hard_negatives._halves(x), books, strict=True))
    order = np.lexsort((j, i))
    code = (i << 32 | j)[order]
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
    codes = np.stack((code[ends - 1] >> 32, code[ends - 1] & 0xFFFFFFFF))
    x, radii = x[order], hard_negatives._radii(x[order], codes, ends, books)
    shard = hard_negatives.Shard({"ids": np.arange(4000), "labels": np.zeros(4000, np.int64), "codes": codes, "ends": ends, "radii": radii, "vectors": x}, books)
    u, w = hard_negatives.half_bounds(x[:5], books, radii)
    scores = x[:5] @ x.T
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    assert (scores <= u[:, codes[0, of]] + w[:, codes[1, of]]).all()
    seen = 0
    for n in range(5):
        best = hard_negatives.Best(5, hard_negatives.NONE, np.iinfo(np.int64).max)
        for rows, s in shard.visited(x[n], u[n], w[n], best.least):
            seen += len(rows)
            best.add(s, shard.ids[rows])
        assert best.score.tolist() == sorted(scores[n].tolist(), reverse=True)[:5]
    assert seen < 0.75 * 5 * 4000


# --- filter audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, p in docs:
        t = t or ""
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        parts[p or ""].append((fails, i in good, i in toxic))
    out, total = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                redundant = sum(r[0][f] for r in rows) - len(gone)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_walking_through(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["LOUD", "a#b", "x|y"]
    docs = [(int(i), " ".join(rng.choice(vocabulary[: int(rng.integers(5, 303))], int(rng.integers(1, 200)))), str(rng.choice(["en", "de", ""]))) for i in range(250)]
    docs += [(i + 1000, docs[i][1], docs[i + 7][2]) for i in range(60)] + docs[:20] + [(None, docs[3][1], "en"), (None, None, None), (5000, None, None), (5001, "", "en"), (-3, "", None), (-3, "", None), (-3, "", "fr")]
    labels = [(i, i % 2, i % 3) for i in range(0, 1050)] + [(4, 1, None), (None, 1, 1), (-3, None, 1)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, n long, digest string").repartition(5)
    got = filter_audit.audit(d, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, salt int"))
    want = plain_audit(docs, labels)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) == 600 * 4
    none = filter_audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_shapley_by_least_squares_is_shapley():
    got = filter_audit.shapley_coefficients()
    for f in range(5):
        for s in range(32):
            size = s.bit_count()
            inside = s >> f & 1
            rest = size - 1 if inside else size
            want = Fraction(math.factorial(rest) * math.factorial(4 - rest), 120) * (1 if inside else -1)
            # the empty coalition removes nothing, so its share does not matter
            assert not s or got[f][s] == want
    assert sum(got[f][31] for f in range(5)) == 1
