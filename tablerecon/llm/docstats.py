"""Counts over whole texts that the quality operators share, one row per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passed_on
from .textbytes import _SPACE, Texts, chunks, mix

#: words, code points in words, characters of [#*$%&|<>], lines with a word, such lines equal
#: to an earlier one, words in 8-word windows that the text holds twice, letters, capitals,
#: exclamation marks, digits, words equal to the word before, distinct words
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bang", "n_digits", "n_same", "n_distinct"]
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(key: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    key = np.sort(mix(key ^ mix(of.astype(np.uint64) + np.uint64(1))) & ~np.uint64(0xFFFF) | (of & 0xFFFF).astype(np.uint64))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] & np.uint64(0xFFFF)).astype(np.int64), minlength=n)[:n]


def counts_of(t: Texts) -> dict[str, np.ndarray]:
    """All COUNTS of a run of fewer than 65,536 texts."""
    d, at, n = t.data, t.at, t.n
    starts, ends, first = t.words()
    per = np.diff(first)
    of = np.repeat(np.arange(n), per)
    h = t.span_hashes(starts, ends)
    whole = (d & 0xC0) != 0x80
    space = _SPACE[d]
    upper = (d >= 65) & (d <= 90)
    wide = d == 0xC3
    wide[:-1] &= (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
    letters = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 0xC3)

    ends_of_line = np.flatnonzero(d == 10)
    line_starts = np.concatenate(([0], ends_of_line[:-1] + 1)) if len(ends_of_line) else ends_of_line
    word_at = np.searchsorted(starts, line_starts)
    has_word = (word_at < len(starts)) & (np.append(starts, len(d))[word_at] < ends_of_line)
    line_starts, line_ends = line_starts[has_word], ends_of_line[has_word]
    line_of = np.searchsorted(at, line_starts, "right") - 1
    n_lines = np.bincount(line_of, minlength=n)[:n]
    lines = t.span_hashes(line_starts, line_ends)

    repeat = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        roll = h.copy()
        for j in range(1, WINDOW):
            roll[:-j] = mix(roll[:-j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
        inside = np.flatnonzero(of[: len(h) - WINDOW + 1] == of[WINDOW - 1 :])
        key = mix(roll[inside] ^ mix(of[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, inside[twice], 1)
        np.add.at(repeat, inside[twice] + WINDOW, -1)
    covered = np.cumsum(repeat)[:-1] > 0
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (of[1:] == of[:-1]))) if len(h) else np.zeros(0, bool)
    return {
        "n_words": per, "word_chars": _per_text(whole & ~space, at), "n_symbols": _per_text(_SYMBOL[d], at), "n_lines": n_lines,
        "n_dup_lines": n_lines - _distinct(lines, line_of, n), "n_repeat_words": np.bincount(of[covered], minlength=n)[:n],
        "n_letters": _per_text(letters & whole, at), "n_upper": _per_text(upper | wide, at), "n_bang": _per_text(d == 33, at),
        "n_digits": _per_text((d >= 48) & (d <= 57), at), "n_same": np.bincount(of[again], minlength=n)[:n], "n_distinct": _distinct(h, of, n),
    }


def document_counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` and COUNTS (long) of every row, then the columns ``keep`` of ``docs``; null
    text counts as empty, other columns are ignored, repeated rows come back as often."""
    keep = keep or []
    carried, kinds = passed_on(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1), 1 << 19):
                got = counts_of(t)
                yield pa.record_batch([b.column(0).slice(t.lo, t.n), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), *(b.column(2 + i).slice(t.lo, t.n) for i in range(len(keep)))], ["doc_id", *COUNTS, *keep])

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *carried).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]) + kinds)
