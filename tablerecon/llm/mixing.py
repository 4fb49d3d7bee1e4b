"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. A source's target is its share by weight of ``SHARE`` times all words, at most ``MOST`` times
   its own words; what is over goes to the others by weight, until none is above.
2. The mix is a house of equal blocks of ``block`` words. Sources get blocks by highest
   quotients target / (2 * blocks + 1), none more than its words allow ``MOST`` times over.
3. The blocks of a source are dealt to the mix's shards by the same rule, the shards in turn:
   shard k gets the blocks whose quotients are under the k-th of equally spaced cutoffs. So every
   shard has a whole number of blocks of every source, near its share.
4. The documents of a source, put in a seeded order, are one stream of words; its blocks are
   taken from there, from a seeded one on, around the end as often as needed. A run of blocks of
   a shuffled stream is a random sample, and cuts few documents.

Places in a stream are sums over parts and within them, so no source is held by one task; the
numbers of blocks come from a few aggregates of fixed width over the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: weights of the sources in their order, repeating
WEIGHTS = (5, 2, 1)
#: words of the mix for every word of the sources
SHARE = 1.5
#: times that a document may be taken
MOST = 2
#: words of a block; the work does not depend on it
BLOCK = 16
SHARD_BLOCKS = 1 << 20
SEED = "mix"
#: parts of a stream at least; words and rows of one, about
PARTS, PART_WORDS, PART_ROWS = 256, 1 << 24, 1 << 17
#: divisors that one aggregate tries
TRIES = 32
#: blocks that are ranked, if there are not more sources
OPEN = 1 << 10
#: copies that one generated row stands for
COPIES = 4096
_WHITE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words (runs without blanks, tabs and line ends) of a text; 0 for null. Linear and without
    an array of words, so that a text of any length is fine."""
    words = F.regexp_replace(F.ltrim(text, F.lit(_WHITE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(words), F.lit(0)).cast("long")


def _fraction(text: Column) -> Column:
    """A number in [0, 1) from a text's digest; digests and fractions have the same order."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def in_order(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds column ``name``: every row's place, from 0, in an order without ties. Rows are sorted
    over all tasks, and only the numbers of rows of the tasks are summed up."""
    at = cut(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_id")))
    tasks = at.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row a task
    before = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")
    placed = at.join(F.broadcast(tasks.select("_task", (before - F.col("_first")).alias("_shift"))), "_task")
    return placed.withColumn(name, F.col("_id") + F.col("_shift")).drop("_task", "_id", "_shift")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, copies``: rows that agree in all three are one with their number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sources: DataFrame) -> DataFrame:
    """``place, weight, target`` of ``source, source_size``: sources by code point, null last,
    weigh WEIGHTS in turn. Every round holds more sources to their limit, one aggregate each,
    until none is above."""
    placed = in_order(sources, "place", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = cut(placed.withColumn("weight", weight))
    limit = F.col("source_size") * MOST
    words, free = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total, held, free, before, rate = SHARE * (words or 0), 0, free or 0, None, 0.0
    while free and (held, free) != before:
        before, rate = (held, free), (total - held) / free
        above = limit <= F.col("weight") * rate
        held, free = (x or 0 for x in rows.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first())
    return rows.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(rate)))


def _seats(divisor: Column) -> Column:
    """Blocks of a source with a quotient target / (2 * blocks + 1) of at least half a divisor."""
    return F.least(F.col("limit"), F.floor(F.col("target") / divisor + F.lit(0.5)))


def _cutoff(filled, house: int, block: int, most_open: int) -> tuple[tuple[float, int], tuple[float, int]]:
    """Two divisors and the blocks that each gives: the first ``house`` at most, the other
    ``house`` at least, and between them ``most_open`` blocks at most, if divisors differ at all."""
    few = enough = None
    low, high = block / 2, block * 2.0
    while few is None or enough is None:
        tries = [high * (low / high) ** (i / TRIES) for i in range(TRIES + 1)]  # falling
        got = list(zip(tries, filled(tries), strict=True))
        few = next((x for x in reversed(got) if x[1] <= house), None)
        enough = next((x for x in got if x[1] >= house), None)
        low, high = (low if enough else low * 2.0**-16), (high if few else high * 2.0**16)
    while few[1] < house and enough[1] - few[1] > most_open and few[0] - enough[0] > 1e-13 * few[0]:
        tries = [few[0] + (enough[0] - few[0]) * i / TRIES for i in range(TRIES + 1)]
        got = list(zip(tries, filled(tries), strict=True))
        few = next(x for x in reversed([few, *got]) if x[1] <= house)
        enough = next(x for x in [*got, enough] if x[1] >= house)
    return few, enough


def apportioned(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``blocks`` to ``place, source_size, target``: as many in all as the targets' words
    fill (or the limits allow), given by highest quotients; ties go to the first sources. The
    cutoff is searched for with TRIES divisors an aggregate; the last quotients, a few a source,
    are ranked."""
    rows = cut(rows.withColumn("limit", F.floor(F.col("source_size") * MOST / block)))
    words, most, n = rows.agg(F.sum("target"), F.sum("limit"), F.count("*")).first()
    house = min(int((words or 0.0) / block + 0.5), most or 0)
    if not house:
        return rows.withColumn("blocks", F.lit(0).cast("long"))

    def filled(divisors: list[float]) -> list[int]:
        tried = rows.select("limit", "target", F.posexplode(F.array(*map(F.lit, divisors))).alias("i", "d"))
        return [r["n"] for r in tried.groupBy("i").agg(F.sum(_seats(F.col("d"))).alias("n")).orderBy("i").collect()]

    few, enough = _cutoff(filled, house, block, max(OPEN, 4 * n))
    given = rows.withColumn("blocks", _seats(F.lit(few[0])))
    if few[1] == house:
        return given
    last = _seats(F.lit(enough[0]))
    close = given.where(last > F.col("blocks")).select("place", "target", F.explode(F.sequence(F.col("blocks"), last - 1)).alias("seat"))
    ranked = in_order(close, "rank", F.desc(F.col("target") / (2 * F.col("seat") + 1)), "place", "seat")
    won = ranked.where(F.col("rank") < house - few[1]).groupBy("place").agg(F.count("*").alias("won"))
    return given.join(won, "place", "left").withColumn("blocks", F.col("blocks") + F.coalesce("won", F.lit(0))).drop("won")


def shard_quotas(sources: DataFrame, shards: int) -> DataFrame:
    """``shard, source, blocks``: how many blocks of each source every shard of the mix gets."""
    upto = lambda k: F.floor((2 * F.col("blocks") * k + (shards - 1)) / (2 * shards))
    each = sources.select("source", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    return each.select("shard", "source", (upto(F.col("shard") + 1) - upto(F.col("shard"))).cast("long").alias("blocks"))


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _streams(rows: DataFrame, sources: DataFrame, parts: int, seed: str, block: int) -> DataFrame:
    """``rows`` with the columns of their source, ``start`` (the words of the stream before the
    row) and ``first`` (where the source's first block begins)."""
    at = rows.select("*", _key().alias("_key"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_at"))
    share = F.conv(F.substring("_at", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    at = at.withColumn("_part", F.floor(share * parts))
    words = F.col("size") * F.col("copies")
    per = at.groupBy("_key", "_part").agg(F.sum(words).alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_words")
    first = F.floor(_fraction(F.concat(F.lit(seed + "="), F.col("_key"))) * F.ceil(F.col("source_size") / block)) * block
    own = sources.select(_key().alias("_key"), "source_size", "target", "blocks", first.alias("first"))
    placed = per.select("_key", "_part", before.alias("_before")).join(own, "_key")
    inside = Window.partitionBy("_key", "_part").orderBy("_at", "doc_id", "size")
    return at.withColumn("_upto", F.sum(words).over(inside) - words).join(placed, ["_key", "_part"]).withColumn("start", F.col("_before") + F.col("_upto"))


def mix(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """One row for every row of ``docs`` (``doc_id, text, source``): ``doc_id, source, size,
    source_size, target, taken`` (words that the mix takes of it, repeats counted) and
    ``pieces``, an array of ``shard, start, length`` in words of the document.

    A null text has no words; a null id is an id like others, its rows are told apart by size;
    a null source is a source, the last one. Repeated rows each have their own place. Sources
    without words have target 0. Other columns are ignored; an empty table gives an empty
    result. The same seed gives the same mix.
    """
    rows = cut(sizes(docs))
    n = rows.agg(F.count("*"), F.sum(F.col("size") * F.col("copies"))).first()
    parts = PARTS + int(max(n[0] / PART_ROWS, (n[1] or 0) / PART_WORDS))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = cut(apportioned(targets(sources), block))
    shards = int((sources.agg(F.sum("blocks")).first()[0] or 0) / shard_blocks) + 1
    placed = _streams(rows, sources, parts, seed, block)
    runs = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("_run"))
    copy = F.explode(F.sequence(F.col("_run") * COPIES, F.least(F.col("copies"), (F.col("_run") + 1) * COPIES) - 1)).alias("_copy")
    each = runs.select("doc_id", "source", "size", "source_size", "target", "blocks", "first", "start", copy)
    # words of the stream counted from the first block on; what lies before it comes round later
    length = F.greatest("source_size", F.lit(1))
    at = F.pmod(F.col("start") + F.col("_copy") * F.col("size") - F.col("first"), length)
    each = each.withColumns({"_at": at, "_words": F.col("blocks") * block})

    def turn(c: int) -> tuple[Column, Column]:
        lo = F.col("_at") + F.lit(c) * F.col("source_size")
        return F.greatest(lo, F.lit(0)), F.least(lo + F.col("size"), F.col("_words"))

    turns = [turn(c) for c in range(-1, MOST)]
    taken = sum((F.greatest(hi - lo, F.lit(0)) for lo, hi in turns), F.lit(0).cast("long"))

    def pieces(c: int) -> Column:
        """Of one turn of the stream, the document's words by the shards that take them."""
        lo, hi = turn(c)
        shard = lambda word: F.floor(F.floor(word / block) * 2 + 1).cast("long") * shards / (2 * F.col("blocks"))
        begin = lambda k: F.floor((2 * F.col("blocks") * k + (shards - 1)) / (2 * shards)) * block
        shift = F.col("_at") + F.lit(c) * F.col("source_size")
        own = F.transform(
            F.sequence(F.floor(shard(lo)), F.floor(shard(hi - 1))),
            lambda k: F.struct(k.alias("shard"), (F.greatest(lo, begin(k)) - shift).cast("long").alias("start"), (F.least(hi, begin(k + 1)) - F.greatest(lo, begin(k))).cast("long").alias("length")),
        )
        return F.when(hi > lo, F.filter(own, lambda x: x["length"] > 0)).otherwise(F.array().cast("array<struct<shard:bigint,start:bigint,length:bigint>>"))

    return each.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.concat(*[pieces(c) for c in range(-1, MOST)]).alias("pieces"))


def texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``shard, doc_id, start, length, text``: the words of every piece, a blank between two;
    for tables in which an id is one row's."""
    pieces = mixed.select("doc_id", F.inline("pieces"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    cut_out = F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return pieces.join(own, "doc_id").select("shard", "doc_id", "start", "length", F.array_join(cut_out, " ").alias("text"))


#: the same by enumeration: every block's quotient ranked, streams by running sums
ORACLE_SQL = f"""
with recursive d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as place from d group by source),
w as (select *, {MOST} * source_size as most, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
o as (select *, coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as held,
 sum(weight) over (order by most / weight, place rows between current row and unbounded following) as free from w),
r as (select coalesce(arg_min(rate, (ratio, place)) filter (where ratio > rate), 1e300) as rate from (select place, most / weight as ratio, ({SHARE} * (select sum(source_size) from w) - held) / free as rate from o)),
t as (select w.*, least(cast(most as double), weight * rate) as target, most // {BLOCK} as limit_ from w, r),
h as (select least(cast(floor(sum(target) / {BLOCK} + 0.5) as bigint), cast(sum(limit_) as bigint)) as house from t),
q as (select place, row_number() over (order by target / (2 * seat + 1) desc, place, seat) as n from (select place, target, unnest(range(limit_)) as seat from t)),
b as (select t.*, coalesce(c.blocks, 0) as blocks from t left join (select place, count(*) as blocks from q, h where n <= house group by place) c using (place)),
a as (select b.*, cast(floor(cast(('0x' || substr(md5('{SEED}=' || coalesce('=' || source, '')), 1, 8)) as bigint) / 4294967296.0 * ceil(source_size / {BLOCK})) as bigint) * {BLOCK} as first_ from b),
p as (select d.doc_id, d.size, a.source_size, a.target, a.blocks * {BLOCK} as words, a.first_,
 sum(d.size) over (partition by d.source order by md5('{SEED}:' || coalesce(cast(d.doc_id as varchar), '')), d.doc_id nulls first, d.size rows unbounded preceding) - d.size as start_
 from d join a on d.source is not distinct from a.source),
g as (select *, case when source_size = 0 then 0 else (start_ - first_ + source_size) % source_size end as at_ from p)
select doc_id, size, source_size, target, cast(greatest(least(at_ - source_size + size, words) - greatest(at_ - source_size, 0), 0) + greatest(least(at_ + size, words) - at_, 0)
 + greatest(least(at_ + source_size + size, words) - (at_ + source_size), 0) as bigint) as taken from g"""
