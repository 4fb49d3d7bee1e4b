"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. All that packing needs of the corpus
is how many pieces there are of each length, a table of at most ``capacity`` rows however
large the corpus. On it, each step takes the longest length left and, by bitset subset-sum
dynamic programming over the lengths left, the combination that fills the rest of a bin
fullest; that combination is removed as often as the counts allow at once. The resulting
slots (which run of the pieces of a length goes to which sequences, at which offset) are
again few, and every piece finds its own by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textbytes import plain

CAPACITY = 2048
END_ID = 0
#: pieces of one length that one task ranks
SHARE = 500_000
#: words, and parts of words, whose ids a worker keeps, twice (see Recent); longer ones are not kept
CACHE = 60_000
LONGEST_KEPT = 48
#: characters whose white space and normal form need no library: outside, the whole text is encoded at once
ODD = re.compile(r"[^\t-\r -~¡-įı-ʯ‐-‧‰-⁞€]|[²³¹¼-¾]|<\|(?:startof|endof)text\|>")
#: how the tokenizer splits words, for characters that are not ODD
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_words: dict[str, Recent] = {}
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is
    printable in Latin-1, else, in order, the characters from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


_LETTER = byte_letters()


def split_ids(part: str, path: str) -> bytes:
    """Ids of one part that the tokenizer's own splitting leaves whole, as little-endian
    32-bit integers."""
    if part[0] == " " and part[1:].isalpha() and part.isascii():
        part = _LETTER[32] + part[1:]
    elif not part.isascii() or " " in part or part.isspace():
        part = "".join([_LETTER[b] for b in part.encode()])
    return array("I", [t.id for t in tokenizer(path).model.tokenize(part)]).tobytes()


def whole_ids(text: str, path: str) -> bytes:
    return array("I", tokenizer(path).encode(text, add_special_tokens=False).ids).tobytes()


class Recent(dict):
    """Values of short strings, made when first asked for. When ``most`` are held they become
    the older half, which the next ``most`` replace: what is asked for again stays, and memory
    is bounded however many strings there are."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


def word_ids(path: str) -> Recent:
    """The ids of words without ODD characters, by the word."""
    if path not in _words:
        parts = Recent(lambda part: split_ids(part, path), 2 * CACHE)

        def word(w: str) -> bytes:
            w = w.lower()
            if w.isalpha():
                return parts[w]
            if w[:-1].isalpha() and not w[-1].isalnum():
                return parts[w[:-1]] + parts[w[-1]]
            return b"".join([parts[p] for p in SPLIT.findall(w)])

        _words[path] = Recent(word)
    return _words[path]


def token_bytes(column: pa.Array, path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit integers, for a tokenizer that lower-cases,
    drops white space and splits at it: parts of words are encoded once and kept."""
    known = word_ids(path).__getitem__
    for text, easy in zip(column.to_pylist(), plain(column).tolist(), strict=True):
        if not text:
            yield b""
        elif (easy and "<|" not in text) or not ODD.search(text):
            yield b"".join(map(known, text.split()))
        else:
            yield whole_ids(text, path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and END_ID, cut into
    pieces of ``capacity`` ids; the last may be shorter. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), path), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        for row, x in zip(rows, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            row.append(x)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) of a combination that fills ``room`` as full as possible; among
    equals the one with the longest lengths first."""
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & ((1 << (room + 1)) - 1)
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return list(out.items())


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, times), ...]) that use up ``counts``."""
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        own = dict(fullest({k: v for k, v in rest.items() if v}, capacity - top))
        own[top] = own.get(top, 0) + 1
        many = min(counts[k] // v for k, v in own.items())
        bins.append((many, sorted(own.items(), reverse=True)))
        for k, v in own.items():
            counts[k] -= many * v
            if not counts[k]:
                del counts[k]
    return bins


def pack(pieces_: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``pieces_`` must be stored (its rows
    are read again and must not change between). Pieces of equal length are ranked within
    salted shares of at most about ``share`` pieces, so a length that most pieces have is not one
    task's at any size of the corpus. Equal pieces may take each other's places."""
    counts = {r[0]: r[1] for r in pieces_.groupBy("length").count().collect()}  # capacity rows at most
    salts = [(k, max(n // share + 1, min(64, n // 64 + 1))) for k, n in counts.items()]
    lengths = pieces_.sparkSession.createDataFrame(salts, "length long, salts long")
    salted = pieces_.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    shares = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for many, own in pack_lengths(counts, capacity):
        at = 0
        for length, times in own:
            slots.append((length, used[length], base, times, at))
            used[length] += many * times
            at += length * times
        base += many
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    key = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            own = table[np.searchsorted(key, length << 48 | rank, "right") - 1] if len(table) else table
            nth = rank - own[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    # a row for each ``share`` pieces, and 64 for each length more
    starts = F.broadcast(shares.select("length", "salt", before.alias("before")))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs every row of ``docs`` (``doc_id, text``). Rows with a null id are
    packed too; repeated rows are packed as often as they come; other columns are ignored; an
    empty table gives an empty result."""
    return pack(cut(pieces(docs, path, capacity)), capacity)
