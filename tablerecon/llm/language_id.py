"""Language of texts that may mix languages, word by word.

Byte-trigram log-probabilities of each language, learned from labelled rows, give every word
one score a language. The scripts of a word's letters narrow its candidates to the languages
that were seen in one of them; if none was, all stay. A Viterbi pass with a switching penalty
then labels each text's words in spans, over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, passed_on
from .textbytes import _LOWER, Texts, chunks

CELLS = 1 << 15
SWITCH = 12.0
#: taken from the score of a language that is no candidate for the word
NO_CANDIDATE = 1e6
#: labelled rows of a language to learn from, about
TRAIN_DOCS = 10_000
#: UTF-8 lead byte ranges of scripts: latin, greek, cyrillic, armenian and hebrew, arabic,
#: indic and thai, georgian and others, kana and han, hangul
SCRIPTS = [(0xC3, 0xCD), (0xCE, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE1), (0xE3, 0xE9), (0xEA, 0xED)]
_SCRIPT = np.zeros(256, np.uint16)
for _i, (_lo, _hi) in enumerate(SCRIPTS):
    _SCRIPT[_lo : _hi + 1] = 1 << _i
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_FOLD = _LOWER.copy()
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32


def _cells(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cell centred on each byte, and which bytes belong to letters."""
    d = _FOLD[t.data]
    key = d.astype(np.uint32) << np.uint32(8)
    key[1:] |= d[:-1].astype(np.uint32) << np.uint32(16)
    key[:-1] |= d[1:]
    if len(d):  # white space before the first text and after the last
        key[0] |= np.uint32(32 << 16)
        key[-1] |= np.uint32(32)
    key = (key * np.uint32(0x9E3779B1)) ^ (key >> np.uint32(11))
    key *= np.uint32(0x85EBCA6B)
    key >>= np.uint32(17)
    return key.view(np.int32), d != 32


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Of each language all rows or, if there are more than ``most``, about that many, chosen by
    a hash; one row at least. One number a language passes through the driver."""
    by = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(by).alias("least")).collect()
    if all(r["n"] <= most for r in sizes):
        return rows
    below = [(r["lang"], max((1 << 62) if r["n"] <= most else (1 << 62) * most // r["n"], r["least"] + 1)) for r in sizes]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where(by < F.col("below"))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (cells x languages) and the languages of each script.

    Fits on the rows of ``docs`` (``doc_id, text, lang``) with a language: on all of a
    language's or, if there are more than ``train_docs``, on about that many of them, chosen by
    a hash, so that a rare language is learned whatever the size of the table. Null texts are
    left out; without rows no language is learned.
    """
    rows = _sample(docs.where("lang is not null and text is not null").select("doc_id", "text", "lang"), train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for t in chunks(b.column("text")):
                cell, letter = _cells(t)
                names, of = np.unique(langs[t.lo : t.lo + t.n].astype(str), return_inverse=True)
                of = np.repeat(of, np.diff(t.at))
                script = _SCRIPT[t.data]
                for i, name in enumerate(names.tolist()):
                    mine = of == i
                    got = seen.setdefault(name, np.zeros(CELLS + 16, np.int64))
                    got[:CELLS] += np.bincount(cell[mine & letter], minlength=CELLS)
                    scripts = np.bincount(script[mine], minlength=1)
                    for k in range(len(SCRIPTS)):
                        if len(scripts) > 1 << k:
                            got[CELLS + k] += scripts[1 << k]
        for lang, got in seen.items():
            cells = np.flatnonzero(got)
            yield pa.record_batch([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(got[cells])], ["lang", "cell", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    count = np.zeros((CELLS + 16, len(langs)))
    count[found["cell"], np.searchsorted(langs, found["lang"]) if langs else []] = found["n"]
    cells, scripts = count[:CELLS], count[CELLS : CELLS + len(SCRIPTS)]
    logp = np.log((cells + 0.5) / (cells.sum(0) + 0.5 * CELLS)) if langs else cells
    logp -= logp.mean(1, keepdims=True) if langs else 0
    return langs, logp.astype(np.float32), scripts >= 0.01 * np.maximum(1, scripts.sum(0))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word. ``scores``: words x labels, all texts one after another;
    ``first``: the first word of each text and, last, the number of words."""
    n_words = np.diff(first)
    order = np.argsort(-n_words, kind="stable")
    n_words, base = n_words[order], first[:-1][order]
    steps = int(n_words[0]) if len(n_words) else 0
    active = np.searchsorted(-n_words, -np.arange(1, steps + 1), "right")
    labels = np.zeros(len(scores), np.int16)
    if not steps:
        return labels
    # came[w]: the label of the word before w if w stays or switches: the best one there
    best_before = np.zeros(len(scores), np.int16)
    stays = np.zeros(scores.shape, bool)
    v = scores[base[: active[0]]].astype(np.float64)
    ends = np.zeros(len(n_words), np.int64)
    for s in range(1, steps):
        a = active[s]
        if a < len(v):
            ends[a : len(v)] = v[a:].argmax(1)
            v = v[:a]
        w = base[:a] + s
        best = v.argmax(1)
        top = v[np.arange(a), best] - switch
        best_before[w] = best
        stay = v >= top[:, None]
        stays[w] = stay
        v = np.where(stay, v, top[:, None]) + scores[w]
    ends[: len(v)] = v.argmax(1)
    now = ends[: active[steps - 1]]
    for s in range(steps - 1, -1, -1):
        a = active[s]
        if a > len(now):
            now = np.concatenate((now, ends[len(now) : a]))
        w = base[:a] + s
        labels[w] = now
        if s:
            now = np.where(stays[w, now], now, best_before[w])
    return labels


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], switch: float = SWITCH, spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, recognised`` of every row of ``docs`` (``doc_id, text``),
    then the columns ``keep`` of ``docs``.

    ``lang_pred`` is the language of most letters (ties: the first by name), ``score`` its
    share of the letters, ``recognised`` the share of letters in words of a script that a
    learned language is written in. Null texts and texts without a letter are ``und`` with
    score 0, as is every text if no language was learned. With ``spans``, a column of word
    ranges and their languages follows. Other columns are ignored, repeated rows come back as
    often, rows with a null id too.
    """
    langs, logp, by_script = model
    keep = keep or []
    columns = [np.ascontiguousarray(logp[:, k]) for k in range(len(langs))]
    carried, kinds = passed_on(docs, keep)
    kind = "doc_id long, lang_pred string, score double, recognised double" + (", spans array<struct<first:int,last:int,lang:string>>" if spans else "") + kinds
    names = ["doc_id", "lang_pred", "score", "recognised", *["spans"] * spans, *keep]

    def score_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = t.words()
        cell, letter = _cells(t)
        scores, sums = np.empty((len(starts), len(langs)), np.float32), np.zeros(len(cell) + 1)
        for k in range(len(langs)):
            np.cumsum(np.where(letter, columns[k][cell], 0), dtype=np.float64, out=sums[1:])
            scores[:, k] = sums[ends] - sums[starts]
        sums = np.concatenate(([0], np.cumsum((_SCRIPT[t.data] > 0))))
        n_letters = sums[ends] - sums[starts]
        known = np.zeros(len(starts), bool)
        if len(starts):
            has = np.bitwise_or.reduceat(_SCRIPT[t.data], starts)
            fits, written = np.zeros((1 << len(SCRIPTS), len(langs)), bool), np.zeros(1 << len(SCRIPTS), bool)
            for mask in np.unique(has):
                own = [k for k in range(len(SCRIPTS)) if mask >> k & 1]
                written[mask] = bool(own) and bool(by_script[own].any())
                fits[mask] = by_script[own].any(0) if written[mask] else True
            scores[~fits[has]] -= NO_CANDIDATE
            known = written[has]
        return scores, n_letters, n_letters * known, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1), 2 << 20):
                texts = b.column(1).slice(t.lo, t.n).to_pylist()
                pred, share, recognised, out = ["und"] * t.n, np.zeros(t.n), np.zeros(t.n), [[] for _ in range(t.n)]
                if langs:
                    scores, n_letters, n_known, first = score_words(t)
                    labels = viterbi(scores, first, switch)
                    of = np.repeat(np.arange(t.n), np.diff(first))
                    weight = np.bincount(of * len(langs) + labels, n_letters, t.n * len(langs)).reshape(t.n, len(langs))
                    best, total = weight.argmax(1), weight.sum(1)
                    recognised = np.bincount(of, n_known, t.n) / np.maximum(total, 1)
                    for i in np.flatnonzero(total > 0):
                        pred[i], share[i] = langs[best[i]], weight[i, best[i]] / total[i]
                    # a letter of a script that the ranges do not know still is a letter
                    for i in np.flatnonzero(total == 0):
                        if any(c.isalpha() for c in texts[i] or ""):
                            pred[i], share[i] = langs[0], 1 / len(langs)
                    for i in np.flatnonzero((total > 0) & ~np.array([has_letter(x) for x in texts])):
                        pred[i], share[i], recognised[i] = "und", 0.0, 0.0
                    if spans:
                        cuts = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])))) if len(labels) else []
                        for lo, hi in zip(cuts, [*cuts[1:], len(labels)], strict=True):
                            out[of[lo]].append({"first": int(lo - first[of[lo]]), "last": int(hi - 1 - first[of[lo]]), "lang": langs[labels[lo]]})
                cols = [b.column(0).slice(t.lo, t.n), pa.array(pred, pa.string()), pa.array(share), pa.array(recognised)]
                if spans:
                    cols.append(pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                cols += [b.column(2 + i).slice(t.lo, t.n) for i in range(len(keep))]
                yield pa.record_batch(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *carried).mapInArrow(run, kind)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text) if text else False


def learned(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``fit`` on the rows that the split rule gives for learning."""
    return fit(docs.where(id_remainder(3) != 1), train_docs)
