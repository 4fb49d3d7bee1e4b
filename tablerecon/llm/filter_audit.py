"""What filters remove together: an audit of five filters in every order.

1. Every document gets a mask of the filters that it fails. Whether a text has an earlier copy is
   told from aggregates by digest, which combine before they are shuffled, so that a text with
   any number of copies costs a row a task.
2. Per part, the documents are counted by mask, and from these at most 32 rows all 32 coalitions
   of filters get what they remove together.
3. A step's count is a difference of two coalitions. Shapley values come from least squares: of
   all additive explanations that sum up to what all filters remove, the one nearest to the
   coalitions' removals under Shapley kernel weights. Its normal equations do not depend on the
   counts, so they are solved once, in rationals, for every coalition's unit vector; the values
   are exact sums of counts times coefficients.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
N = len(FILTERS)
ALL = (1 << N) - 1
_WHITE = r"[\x20\x09-\x0D]+"
#: places that rows with a null id are dealt to when ids are joined
SALTS = 1 << 16


def masks(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is bit 0), judged on the whole text."""
    words = F.array_remove(F.split(text, _WHITE), "")
    few = F.size(words) < 100
    repetitive = F.size(F.array_distinct(words)) * 100 < F.size(words) * 80
    loud = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 10
    odd = text.rlike(r"[#$%&*|]")
    return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate((few, repetitive, loud, odd))), F.lit(0))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, digest, mask, doc_id, n, good, toxic``: equal rows as one with their number. A
    document is good or toxic if any of its labels says so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), masks(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # null ids join nothing; a salt keeps them from meeting in one task
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.withColumn("salt", salt).join(said.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    return joined.drop("salt").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters that they fail, at most 32 rows a
    part. Filter E: the text is that of a row with a smaller id; rows of the smallest id are no
    copies of each other, and a null id is neither smaller nor larger."""
    keys = ["digest", "part", "mask", "good", "toxic"]
    ids = F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0))
    groups = _labelled(docs, labels).groupBy(*keys).agg(F.sum("n").alias("n"), ids.alias("ids"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("firsts"))
    # a row or a few a text
    least = F.min("least").over(Window.partitionBy("digest"))
    copies = F.col("ids") - F.when(F.col("least") == least, F.col("firsts")).otherwise(0)
    split = groups.withColumn("copies", copies).select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), F.col("copies").alias("n"))))
    )
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of a regular system for several right sides, by elimination in rationals."""
    n = len(matrix)
    rows = [m + r for m, r in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [a - rows[j][i] * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_coefficients(n: int = N) -> list[list[Fraction]]:
    """Per filter and coalition (by its bits), the coalition's share in the filter's value.

    Least squares over all coalitions but the empty and the whole one, coalition S of size s with
    weight (n - 1) / (C(n, s) s (n - s)), under the condition that the values sum up to what the
    whole one removes: normal equations with a multiplier, a right side for each coalition."""
    whole = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    inner = range(1, whole)
    has = lambda s, i: s >> i & 1
    matrix = [[sum((weight[s.bit_count()] for s in inner if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight[s.bit_count()] if 0 < s < whole and has(s, i) else Fraction(0) for s in range(whole + 1)] for i in range(n)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    return _solved(matrix, right)[:n]


def _steps() -> str:
    """All orders and their steps, with the coalitions before and after."""
    out = []
    for order in permutations(range(N)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: for every part (value of ``lang``, null as an empty string), each of the 120
    orders and each step in it.

    A null text is an empty one. Repeated rows count as often as they come; a document with
    several labels is good or toxic if one of them says so; rows with a null id have no label
    and are no copies. Other columns are ignored. A part with no failing documents has zeros; an
    empty table gives an empty result, and without labels nothing is good or toxic.
    """
    orders = factorial(N)
    scaled = [[x * orders for x in row] for row in shapley_coefficients()]
    unit = lcm(*(x.denominator for row in scaled for x in row))
    coefficients = [[int(x * unit) for x in row] for row in scaled]
    # the 32 coalitions of a part: what each removes
    coalition = F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("s")
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    tally = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c)
    removals = mask_counts(docs, labels).select("*", coalition).groupBy("part", "s").agg(F.sum("n").alias("total"), *[tally(c) for c in ("n", "good", "toxic")])
    share = lambda f: F.sum(F.element_at(F.array(*map(F.lit, coefficients[f])), F.col("s") + 1) * F.col("n"))
    value = F.array(*[share(f) / unit for f in range(N)])
    parts = removals.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"), value.alias("shapley"))
    kind = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    rows = parts.select("part", "total", "v", "shapley", F.inline(F.from_json(F.lit(_steps()), kind)))
    at = lambda s, c: F.get("v", s)[c]
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(N)]), F.col("f") + 1)
    lost = lambda c: at(F.col("after"), c) - at(F.col("before"), c)
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at(F.col("after"), "n")).alias("kept"), lost("n").alias("removed"), (at(bit, "n") - lost("n")).alias("redundant"),
        (at(F.lit(ALL), "n") - at(F.lit(ALL) - bit, "n")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("f")).cast("long").alias("shapley"),
    )


#: the same by walking through all orders
ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as x, coalesce(lang, '') as part from documents),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
w as (select *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by x) as least from d),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
 [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x),
  regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails from w left join l using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by part, fails),
f as (select unnest([1, 2, 3, 4, 5]) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from f a join f b on b.i <> a.i join f c on c.i not in (a.i, b.i) join f d on d.i not in (a.i, b.i, c.i) join f e on e.i not in (a.i, b.i, c.i, d.i)),
s as (select o, list_aggregate(list_transform(o, lambda i: chr(cast(64 + i as integer))), 'string_agg', '') as filter_order, step, o[step] as i, o[:step - 1] as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, s.i, n, good, toxic, fails[s.i] as fails_here,
 len(list_filter(before, lambda b: fails[b])) > 0 as gone, len(list_filter(fails, lambda b: b)) as n_fails from c, s),
t as (select part, filter_order, step, i, cast(sum(case when not gone and not fails_here then n else 0 end) as bigint) as kept,
 cast(sum(case when not gone and fails_here then n else 0 end) as bigint) as removed, cast(sum(case when gone and fails_here then n else 0 end) as bigint) as redundant,
 cast(sum(case when fails_here and n_fails = 1 then n else 0 end) as bigint) as unique_fails, cast(sum(case when not gone and fails_here then good else 0 end) as bigint) as good_lost,
 cast(sum(case when not gone and fails_here then toxic else 0 end) as bigint) as toxic_lost from r group by part, filter_order, step, i)
select part, filter_order, cast(step as integer) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 cast(sum(removed) over (partition by part, i) as bigint) as shapley from t"""
