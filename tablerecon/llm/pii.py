"""Personal data in whole texts, with DataFrame functions only.

Four kinds have fixed definitions (email, ip, card, phone). Beside them, high-recall
generators propose overlapping candidate spans of further kinds; boosted trees, compiled to
one SQL expression, score each candidate by its format and the text around it; a threshold
per kind, calibrated for precision on held-out examples, selects what is redacted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed patterns of the base kinds; look-behind and possessive forms only spare retries that
#: cannot match, \G lets a match start where the last one ended. A run of digits that is no
#: card is not taken: a run of fewer than 16 holds none, and starts no longer one
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must hold for the kind's pattern to match at all
NEEDS = {"email": "@", "ip": ".", "phone": "+", "card": ""}
#: candidate generators of the added kinds, in the order of the results
EXTRA = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+=*+",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
#: words near a candidate that speak for it
CUES = {"account": "iban|account|konto|compte|cuenta|bank", "hidden_email": "mail|contact|write|kontakt", "local_phone": "tel|phone|call|fax|mobil|numero", "secret": "token|secret|key|passw|auth|bearer", "ssn": "ssn|social|security|tax"}
FEATURES = ["length", "digits", "capitals", "cue", "closed", "varied", "quoted", "valid"]
PRECISION = 0.995


#: array items that one inner loop of ``fold`` takes
FOLD = 128
_SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """Goes through ``items`` with a state and joins the arrays (of type ``kind``) that ``emit``
    makes of the state before an item and the item. Arrays grow within runs of FOLD items and
    the runs are joined once, so the time is nearly linear in the items."""
    none, none_of = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out"))

    def run(own: Column) -> Callable[[Column, Column], Column]:
        def some(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(own, i * FOLD + 1, FOLD), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        return some

    zeros = F.struct(zero.alias("state"), none_of.alias("out"))
    last = lambda own: F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / FOLD).cast("int")
    return let(items, lambda own: F.flatten(F.aggregate(F.sequence(F.lit(0), last(own)), zeros, run(own))["out"]))


def _tail(x: Column) -> Column:
    return F.substring(x, F.lit(-24), F.lit(24))


def _spans(text: Column, pattern: str, context: bool = False) -> Column:
    """Start, end and string of the leftmost non-overlapping matches, in code points; with
    ``context`` also the 24 characters before and the one after (matches that meet have none
    between). ``text`` must not hold the two marks."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02")), "[\x01\x02]", -1)
    nothing = F.lit("")

    def step(st: Column, x: Column) -> Column:
        tail = _tail(F.concat(st["tail"], x)) if context else nothing
        return F.struct((st["at"] + F.length(x)).alias("at"), (~st["odd"]).alias("odd"), F.when(st["odd"], x).alias("s"), (F.when(st["odd"], st["tail"]).otherwise("") if context else nothing).alias("before"), tail.alias("tail"))

    def emit(st: Column, x: Column) -> Column:
        after = F.substring(x, 1, 1) if context else nothing
        span = F.struct((st["at"] - F.length(st["s"])).alias("start"), st["at"].alias("end"), st["s"].alias("s"), st["before"].alias("before"), after.alias("after"))
        return F.when(st["s"].isNotNull(), F.array(span)).otherwise(F.array().cast(_SPAN))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.lit(None).cast("string").alias("s"), nothing.alias("before"), nothing.alias("tail"))
    return fold(parts, zero, step, emit, _SPAN)


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(d))

    def add(acc, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x >= 5, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    d = _digits(s)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    """Candidates of an added kind with their features."""

    def featured(x: Column) -> Column:
        s = x["s"]
        n = F.length(s)
        before = F.lower(x["before"])
        around = F.concat(F.substring(x["before"], -1, 1), F.lit("|"), x["after"])
        share = lambda p: (n - F.length(F.regexp_replace(s, p, ""))) / n
        valid = {
            "ssn": ~s.rlike("^(000|666|9[0-9]{2})|-00-|-0000$"),
            "local_phone": s.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"),
            "account": F.length(F.regexp_replace(s, " ", "")).between(15, 34),
        }.get(kind, F.lit(True))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            n.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"),
            before.rlike(CUES[kind]).cast("double").alias("cue"), around.rlike(r"^[^A-Za-z0-9]?\|[^A-Za-z0-9]?$").cast("double").alias("closed"),
            (F.size(F.array_distinct(F.split(F.lower(s), ""))) / F.least(n, F.lit(16))).alias("varied"),
            around.rlike("^[\"'=:]").cast("double").alias("quoted"), valid.cast("double").alias("valid"),
        )

    needs = {"hidden_email": text.rlike(r"[(\[{]at[)\]}]"), "secret": F.length(text) >= 20}.get(kind, text.rlike("[0-9]{2}"))
    return F.transform(_when(needs, _spans(text, EXTRA[kind], context=True)), featured)


@dataclass
class Trees:
    """Boosted stumps of depth two: (feature, cut, feature, cut, four leaves), a log-odds base
    and, by kind, the threshold on the score."""

    base: float = 0.0
    trees: list[tuple[int, float, int, float, list[float]]] = field(default_factory=list)
    cutoffs: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a, ca, b, cb, leaf in self.trees:
            out += np.array(leaf)[2 * (x[:, a] > ca) + (x[:, b] > cb)]
        return out

    def column(self, x: Column) -> Column:
        names = [*FEATURES, "kind"]
        out = F.lit(self.base)
        for a, ca, b, cb, leaf in self.trees:
            left, right = x[names[a]] > ca, x[names[b]] > cb
            out = out + F.when(left, F.when(right, leaf[3]).otherwise(leaf[2])).otherwise(F.when(right, leaf[1]).otherwise(leaf[0]))
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4, bins: int = 8) -> Trees:
    """Logistic boosting with Newton leaves over pairs of cuts at quantiles."""
    p = np.clip(y.mean(), 0.01, 0.99)
    model, f = Trees(float(np.log(p / (1 - p)))), np.full(len(y), np.log(p / (1 - p)))
    cuts = [(j, float(c)) for j in range(x.shape[1]) for c in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, bins)))]
    over = np.array([x[:, j] > c for j, c in cuts], float)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        G, H = (over * g) @ over.T, (over * h) @ over.T
        ga, ha, gt, ht = over @ g, over @ h, g.sum(), h.sum()
        gain = sum(a**2 / (b + 1.0) for a, b in ((G, H), (ga[:, None] - G, ha[:, None] - H), (ga[None] - G, ha[None] - H), (gt - ga[:, None] - ga[None] + G, ht - ha[:, None] - ha[None] + H)))
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        cell = (2 * over[i] + over[j]).astype(int)
        leaf = [float(rate * g[cell == k].sum() / (h[cell == k].sum() + 1.0)) for k in range(4)]
        model.trees.append((*cuts[i], *cuts[j], leaf))
        f += np.array(leaf)[cell]
    return model


def _examples(seed: int, n: int) -> list[tuple[str, str, int]]:
    """(kind, text, label): candidates in sentences, true ones and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k, a="abcdefghijklmnopqrstuvwxyz": "".join(pick(a) for _ in range(k))
    word = lambda: letters(rng.integers(2, 9))
    out = []
    for _ in range(n):
        for kind, cues in CUES.items():
            true = rng.random() < 0.5
            cue = pick(cues.split("|")) if rng.random() < (0.85 if true else 0.08) else word()
            joint = pick([": ", " = ", " ", ' = "']) if true else pick([" ", " ", ", ", "/"])
            if kind == "account":
                s = pick(["DE", "FR", "ES", "GB"]) + digits(2) + "".join(digits(4) for _ in range(rng.integers(3, 6))) if true else letters(2, "ABCDEFGHKLMNP") + digits(2) + "".join(letters(4, "ABCDEFGHKLMNP0123") for _ in range(rng.integers(2, 6)))
            elif kind == "hidden_email":
                s = word() + pick([" (at) ", "[at]", "(at)"]) + word() + pick([".", " (dot) "]) + pick(["com", "org", "net"]) if true else word() + " (at) " + word() + ". " + word()
            elif kind == "local_phone":
                s = pick("23456789") + digits(2) + pick("-. ") + pick("23456789") + digits(2) + pick("-. ") + digits(4) if true else pick("01") + digits(2) + pick("-. ") + digits(3) + pick("-. ") + digits(4)
            elif kind == "secret":
                s = (letters(rng.integers(24, 60), "abcdef0123456789") if rng.random() < 0.5 else letters(rng.integers(24, 60), "abcdefghijkmnpqrstuvwxyzABCDEFGHKLMNP23456789")) if true else pick([letters(rng.integers(20, 40)), letters(8) + "/" + letters(9) + "-" + letters(7), letters(1) * 30, "-" * 30, "_" * 24, digits(22)])
            else:
                s = digits(3) + "-" + digits(2) + "-" + digits(4) if true else pick(["000", "666", "9" + digits(2)]) + "-" + digits(2) + "-" + digits(4)
            out.append((kind, f"{word()} {word()} {cue}{joint}{s}" + ('"' if joint.endswith('"') else "") + pick(["", ".", ", "]) + f" {word()}", int(true)))
    return out


@lru_cache(maxsize=1)
def _training_rows() -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    return _examples(1, 500), _examples(2, 300)


def train(spark: SparkSession) -> Trees:
    """Trees and thresholds from generated examples; their features come from the same
    expressions as those of the corpus. A kind's threshold is the lowest score above which a
    share PRECISION of the held-out candidates is true; a kind that never gets there is off."""
    fit, held = _training_rows()
    rows = [(k, t, y, 0) for k, t, y in fit] + [(k, t, y, 1) for k, t, y in held]
    df = spark.createDataFrame(rows, "kind string, text string, y int, held int")
    own = F.lit(None)
    for kind in EXTRA:
        own = F.when(F.col("kind") == kind, _candidates(F.col("text"), kind)).otherwise(own)
    got = df.select("kind", "y", "held", F.explode(own).alias("c")).select("kind", "y", "held", *[f"c.{f}" for f in FEATURES]).collect()
    kinds = list(EXTRA)
    x = np.array([[float(r[f]) for f in FEATURES] + [kinds.index(r["kind"])] for r in got])
    y, late = np.array([r["y"] for r in got]), np.array([r["held"] for r in got]) == 1
    model = boost(x[~late], y[~late])
    s = model.score(x)
    for i, kind in enumerate(kinds):
        mine = late & (x[:, -1] == i)
        order = np.argsort(-s[mine], kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.cutoffs[kind] = float(s[mine][order][good[-1]]) if len(good) else float("inf")
    return model


def _base_spans(kind: str, spans: Column) -> Column:
    ok = F.filter(spans, lambda x: _valid(kind, x["s"]))
    return F.transform(ok, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _scored_spans(i: int, kind: str, candidates: Column, model: Trees) -> Column:
    def scored(x: Column) -> Column:
        score = model.column({f: x[f] for f in FEATURES} | {"kind": F.lit(float(i))}) - model.cutoffs[kind]
        return F.struct(x["start"].alias("start"), score.alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"))

    return F.filter(F.transform(candidates, scored), lambda x: x["score"] >= 0)


_SCORED = "struct<start:int,score:double,order:int,kind:string,end:int>"


def _by_start(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["score"].alias("score"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end"))


def _uncovered(base: Column, scored: Column) -> Column:
    """The scored spans, by start, that no base span covers."""
    first = lambda x: F.struct(x["start"].alias("start"), F.lit(float("inf")).alias("score"), F.lit(0).alias("order"), F.lit("").alias("kind"), x["end"].alias("end"))
    mark = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x.alias("x"))
    all_ = F.array_sort(F.concat(F.transform(base, lambda x: mark(first(x), 0)), F.transform(scored, lambda x: mark(_by_start(x), 1))))
    step = lambda st, y: F.when(y["own"] == 0, F.greatest(st, y["x"]["end"])).otherwise(st)
    emit = lambda st, y: F.when((y["own"] == 1) & (y["x"]["end"] > st), F.array(y["x"])).otherwise(F.array().cast(f"array<{_SCORED}>"))
    return fold(all_, F.lit(0), step, emit, f"array<{_SCORED}>")


def _chains(scored: Column) -> Column:
    """The spans, sorted by start, in runs that overlap."""
    none = F.array().cast(f"array<{_SCORED}>")
    end = F.struct(F.lit(2147483647).alias("start"), F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit("").alias("kind"), F.lit(2147483647).alias("end"))
    step = lambda st, x: F.struct(F.greatest(st["end"], x["end"]).alias("end"), F.when(x["start"] < st["end"], F.concat(st["own"], F.array(x))).otherwise(F.array(x)).alias("own"))
    emit = lambda st, x: F.when((x["start"] >= st["end"]) & (F.size(st["own"]) > 0), F.array(st["own"])).otherwise(F.array().cast(f"array<array<{_SCORED}>>"))
    return fold(F.concat(scored, F.array(end)), F.struct(F.lit(0).alias("end"), none.alias("own")), step, emit, f"array<array<{_SCORED}>>")


def _greedy(chain: Column) -> Column:
    """Of one chain the best spans that do not meet."""
    ranked = F.transform(F.array_sort(F.transform(chain, lambda x: F.struct((-x["score"]).alias("a"), (-x["order"]).alias("b"), x["start"].alias("c"), x.alias("x")))), lambda y: y["x"])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    step = lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.size(chain) > 1, F.aggregate(ranked, F.array().cast(f"array<{_SCORED}>"), step)).otherwise(chain)


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, model: Trees | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with ``base`` and ``added``: arrays of
    ``kind, start, end`` in code points, ends exclusive, ordered by kind as listed and start.

    Null text counts as empty. Added spans are none that a base span covers; they are taken
    best score first (ties: the earlier kind, then start), each that meets none taken before.
    ``keep`` names columns to carry along; others, of whatever name, are ignored. Repeated rows
    come back as often, rows with a null id too; an empty table gives an empty result.

    Time is nearly linear in a text's length and candidates; only a chain of candidates of
    which each overlaps the next costs the square of its length.
    """
    model = model or train(docs.sparkSession)
    text = F.col("__text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(c) for c in keep or [] if c != "doc_id"], F.when(F.col("text").rlike("[\x01\x02]"), F.translate("text", "\x01\x02", "\x03\x03")).otherwise(F.coalesce("text", F.lit(""))).alias("__text"))
    has_digit = text.rlike("[0-9]")
    base = []
    for kind, pattern in BASE.items():
        test = text.contains(NEEDS[kind]) if kind == "email" else has_digit & text.contains(NEEDS[kind])
        base.append(_base_spans(kind, _when(test, _spans(text, pattern))))
    rows = rows.withColumn("base", F.concat(*base))
    scored = []
    for i, kind in enumerate(EXTRA):
        if model.cutoffs.get(kind, float("inf")) == float("inf"):
            continue
        scored.append(_scored_spans(i, kind, _candidates(text, kind), model))
    rows = rows.withColumn("__scored", F.concat(*scored) if scored else F.array().cast(f"array<{_SCORED}>"))
    rows = rows.withColumn("__scored", F.when(F.size("__scored") > 0, _uncovered(F.col("base"), F.col("__scored"))).otherwise(F.col("__scored")))
    best = F.when(F.size("__scored") > 1, F.flatten(F.transform(_chains(F.col("__scored")), _greedy))).otherwise(F.col("__scored"))
    order = lambda x: F.struct((-x["order"]).alias("nth"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    added = F.transform(F.array_sort(F.transform(best, order)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("added", added).drop("__text", "__scored")


#: characters of a text that ``redact`` cuts out at once
CHUNK = 2048


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the one
    that starts first (ties: that ends last) gives the kind, and what others cover beyond it
    goes too. Null stays null.

    Works chunk by chunk, for a place in a long text is found only by counting from its start.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    hole = "array<struct<start:int,end:int,kind:string>>"
    step = lambda at, x: F.greatest(at, -x["back"])
    # what each span adds to what those before it cover; a kind only if it is apart from them
    emit = lambda at, x: F.when(-x["back"] > at, F.array(F.struct(F.greatest(at, x["start"]).alias("start"), (-x["back"]).alias("end"), F.when(x["start"] >= at, x["kind"]).alias("kind")))).otherwise(F.array().cast(hole))
    holes = fold(ordered, F.lit(0), step, emit, hole)

    def chunk(all_: Column) -> Callable[[Column], Column]:
        def done(i: Column) -> Column:
            lo = i * CHUNK
            own = F.filter(all_, lambda h: (h["end"] > lo) & (h["start"] < lo + CHUNK))
            piece = F.substring(text, lo + 1, F.lit(CHUNK))

            def cut_out(of: Column) -> Column:
                add = lambda acc, h: F.struct(
                    (h["end"] - lo).alias("at"),
                    F.concat(acc["out"], F.array(F.substring(of, acc["at"] + 1, F.greatest(h["start"] - lo - acc["at"], F.lit(0))), F.when((h["start"] >= lo) & h["kind"].isNotNull(), F.concat(F.lit("["), F.upper(h["kind"]), F.lit("]"))).otherwise(""))).alias("out"),
                )
                end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(of, acc["at"] + 1, F.lit(CHUNK)))
                return let(F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add), end)

            return F.when(F.size(own) > 0, let(piece, cut_out)).otherwise(piece)

        return done

    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / CHUNK).cast("int")
    return F.when(F.size(spans) > 0, let(holes, lambda all_: F.array_join(F.transform(F.sequence(F.lit(0), last), chunk(all_)), ""))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[_count(k) for k in BASE], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "added")).alias("spans"))
