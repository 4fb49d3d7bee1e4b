"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document whose statistic exceeds a cutoff. Labelled documents are split by
a hash of the id. On a fifth of them every rule gets, per stratum (a band of word counts), the
cutoff that tells bad from good best; the grid levels down to there make up a path of ever
stricter rule sets, one rule a step. The others test the path by fixed-sequence testing: a step
holds if the exact (Clopper-Pearson) upper bound on the share of good documents that the whole
rule set rejects is at most ``alpha``, at confidence 1 - ``delta`` / strata; the first failure
ends the path. Steps of a fixed sequence need no further correction, Bonferroni covers the
strata: with probability 1 - delta no stratum's rules reject more than ``alpha`` of its good
documents. A stratum with fewer than about 80 good test documents proves nothing; its rules
stay off.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder
from .docstats import document_counts

#: rule -> statistic, each over counts of the document
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "shouting": ("n_bang", "n_words"),
    "capitals": ("n_upper", "n_letters"),
    "echo": ("n_same", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
#: fixed cutoffs, loose to tight
GRID = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05]
#: upper ends of the strata, in words
BANDS = [60, 300]
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def binomial_at_most(r: int, n: int, p: float) -> float:
    """The probability of at most ``r`` of ``n`` at share ``p``: an incomplete beta function by
    its continued fraction, in about sqrt(n) steps."""
    if r >= n or p <= 0:
        return 1.0
    if p >= 1 or r < 0:
        return 0.0
    a, b, x = float(n - r), float(r + 1), 1 - p
    if swap := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return 1 - front * h if swap else front * h


def binomial_upper(r: int, n: int, delta: float) -> float:
    """The largest share under which at most ``r`` of ``n`` still has probability ``delta``."""
    if r >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_at_most(r, n, mid) > delta else (lo, mid)
    return hi


def _stratum():
    out = F.lit(len(BANDS))
    for i, top in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < top, i).otherwise(out)
    return out


def _value(rule: str):
    over, under = RULES[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def _path(levels: dict[str, int]) -> list[tuple[str, int]]:
    """Steps (rule, grid level): level by level, each rule down to its own last one."""
    return [(r, i) for i in range(len(GRID)) for r in RULES if i < levels[r]]


def _with_levels(counts: DataFrame) -> DataFrame:
    """Adds the stratum, and per rule its level: how many cutoffs of the grid its statistic is
    over. They are told once, in a step of their own, so that what counts them stays small
    enough to be compiled."""
    levels = {f"_{r}": sum((F.when(_value(r) > c, 1).otherwise(0) for c in GRID), F.lit(0)) for r in RULES}
    return counts.withColumns({"_s": _stratum(), **levels})


def _first_step(paths: dict[int, list[tuple[str, int]]]):
    """The first step of the stratum's path at which the document is rejected, or the path's
    length, from its levels. A value over one level is over all later, stricter ones."""
    steps = []
    for r in RULES:
        of = []
        for s in range(len(BANDS) + 1):
            at = {step: n for n, step in enumerate(paths[s])}
            # a value over n cutoffs is over the last n of the grid, of which the first is met first
            firsts = [at.get((r, len(GRID) - n), len(paths[s])) for n in range(len(GRID) + 1)]
            of.append(F.array(*map(F.lit, firsts)))
        steps.append(F.get(F.get(F.array(*of), F.col("_s")), F.col(f"_{r}")))
    return F.least(*steps)


def choose_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[int, dict[str, float]]:
    """Cutoffs by stratum and rule, from ``labels`` (``doc_id, quality``): two small histograms
    over all labelled documents. A document labelled good and bad counts as good
    where good ones are guarded; labels other than 0 and 1 are left out."""
    own = counts.join(labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    tests = id_remainder(5) != 0
    own = cut(_with_levels(own).select("doc_id", "quality", "_s", *[f"_{r}" for r in RULES]))
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("level")) for r in RULES]))
    seen: dict[tuple[int, int, str], dict[int, int]] = {}
    for row in own.where(~tests).select("_s", "quality", each).groupBy("_s", "quality", "rule", "level").count().collect():
        seen.setdefault((row["_s"], row["quality"], row["rule"]), {})[row["level"]] = row["count"]

    def share(s: int, quality: int, rule: str, i: int) -> float:
        """Of the stratum's documents of a quality, those over the grid's i-th cutoff."""
        own = seen.get((s, quality, rule), {})
        return sum(n for level, n in own.items() if level >= len(GRID) - i) / max(sum(own.values()), 1)

    paths = {}
    for s in range(len(BANDS) + 1):
        levels = {}
        for r in RULES:
            worth = [share(s, 0, r, i) - 20 * share(s, 1, r, i) for i in range(len(GRID))]
            levels[r] = worth.index(max(worth)) + 1 if max(worth) > 0 else 0
        paths[s] = _path(levels)
    good = own.where(tests & (F.col("quality") == 1)).groupBy(F.col("_s").alias("s"), _first_step(paths).alias("step")).agg(F.count("*").alias("n")).collect()
    out: dict[int, dict[str, float]] = {}
    for s, path in paths.items():
        mine = {row["step"]: row["n"] for row in good if row["s"] == s}
        n, rejected, out[s] = sum(mine.values()), 0, {}
        for step, (r, i) in enumerate(path):
            rejected += mine.get(step, 0)
            if binomial_at_most(rejected, n, alpha) > delta / (len(BANDS) + 1):
                break
            out[s][r] = GRID[i]
    return out


def apply_rules(counts: DataFrame, cutoffs: dict[int, dict[str, float]]) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names, in the order of RULES) and ``kept``. A
    document without words fails the base; statistics over nothing count as 0."""
    failed = [F.when((_stratum() == s) & (_value(r) > c), F.lit(r)) for s, own in sorted(cutoffs.items()) for r, c in own.items()]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return counts.withColumn("base_failed", base).withColumn("failed_rules", rules).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with its counts and verdict. Null texts count as
    empty, repeated rows come back as often, rows with a null id are judged like others, other
    columns are ignored; an empty table gives an empty result, and without labels only the base
    rejects."""
    counts = cut(document_counts(docs))
    return apply_rules(counts, choose_cutoffs(counts, labels, alpha, delta))
