"""Byte-level BPE of whole texts through a table of distinct words.

Tasks split texts into units that the tokenizer never merges across (a run of non-spaces with
the one space before it, or white space) and write each block of documents as a dictionary of
its distinct units and the positions of its texts in it. The units of all blocks meet in hash
buckets, where each distinct one is encoded once, and decoded through the table of ids and
pieces. Ids return to the blocks, and each text is put together by position.

A block has about as many distinct units at any size of the corpus, and there are at most
MOST_BUCKETS buckets, so a row always holds many units. A bucket is read as a stream; of units
seen in it, the recent ones are kept (``Recent``), the others are encoded again when they return.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for
from .packing import Recent, byte_letters, split_ids, tokenizer, whole_ids
from .textbytes import plain

SPECIAL = "<|endoftext|>"
ODD = re.compile(r"[^\t-\r -~¡-ʯ‐-‧‰-⁞€]|[²³¹¼-¾]")
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: how the tokenizer splits units, for characters that are not ODD
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
BLOCK_UNITS = 5_000_000
MOST_BUCKETS = 2048
_pieces: dict[str, list[bytes]] = {}


def units(text: str, path: str, easy: bool = False) -> list[str]:
    """The text's units in order; they join to the text. ``easy`` texts hold no ODD character."""
    if SPECIAL in text:
        parts = text.split(SPECIAL)
        out = units(parts[0], path)
        for p in parts[1:]:
            out.append(SPECIAL)
            out += units(p, path)
        return out
    if not easy and ODD.search(text):
        return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return UNIT.findall(text)


def byte_pieces(path: str) -> list[bytes]:
    """The id-to-piece table."""
    if path not in _pieces:
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        _pieces[path] = out
    return _pieces[path]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, take: Callable[[list[str]], object]) -> Iterator[tuple[int, list[tuple[int, object]]]]:
    """Blocks of documents: an id, and per document what ``take`` makes of its units. The id is
    a digest of the whole block, so that both passes over a table name it alike. ``take`` is
    called for all documents of a block before it is given out."""
    docs: list[tuple[int, object]] = []
    held = 0
    digest = hashlib.blake2b(digest_size=8)
    for b in batches:
        for lo in range(0, len(b), 256):
            part = b.slice(lo, 256)
            for doc, text, easy in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), plain(part.column("text")).tolist(), strict=True):
                own = units(text or "", path, easy)
                digest.update(repr(doc).encode() + b"\0" + (text or "").encode() + b"\0")
                docs.append((doc, take(own)))
                held += len(own)
                if held >= BLOCK_UNITS or len(docs) >= 100_000:
                    yield int.from_bytes(digest.digest(), "little", signed=True), docs
                    docs, held, digest = [], 0, hashlib.blake2b(digest_size=8)
    if docs:
        yield int.from_bytes(digest.digest(), "little", signed=True), docs


def _packed(words: list[str]) -> bytes:
    """Strings as their lengths and their text, compressed."""
    size = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + _planes(size) + "".join(words).encode())


def _unpacked(blob: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(_from_planes(raw[4 : 4 + 4 * n])).tolist()
    text = raw[4 + 4 * n :].decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers byte by byte: all lowest bytes first."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _dictionaries(docs: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """``bucket, block, at, units``: each block's distinct units, dealt by a hash, sorted and
    packed, and their positions in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        pack = zstandard.ZstdCompressor(level=3)
        seen: dict[str, None] = {}
        for block, _ in _blocks(batches, path, lambda own: seen.update(dict.fromkeys(own))):
            words = list(seen)
            seen.clear()
            deal = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)) % n_buckets
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(deal[order], kind="stable")]
            bounds = np.searchsorted(deal[order], np.arange(n_buckets + 1))
            rows = [(i, order[bounds[i] : bounds[i + 1]]) for i in range(n_buckets) if bounds[i] < bounds[i + 1]]
            yield pa.record_batch(
                [pa.array([i for i, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([pack.compress(_planes(o)) for _, o in rows], pa.binary()), pa.array([_packed([words[j] for j in o]) for _, o in rows], pa.binary())],
                ["bucket", "block", "at", "units"],
            )

    return docs.mapInArrow(run, "bucket int, block long, at binary, units binary")


def _positions(docs: DataFrame, path: str) -> DataFrame:
    """``block, docs, counts, at``: runs of a block's documents as positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        seen: dict[str, int] = defaultdict(count().__next__)

        def positions(own: list[str]) -> np.ndarray:
            return np.fromiter(map(seen.__getitem__, own), np.uint32, len(own))

        for block, own in _blocks(batches, path, positions):
            seen.clear()
            seen.default_factory = count().__next__
            runs = [own[i : i + 512] for i in range(0, len(own), 512)]
            flat = [np.concatenate([a for _, a in r]) for r in runs]
            yield pa.record_batch(
                [pa.array([block] * len(runs), pa.int64()), pa.array([[d for d, _ in r] for r in runs], pa.list_(pa.int64())), pa.array([[len(a) for _, a in r] for r in runs], pa.list_(pa.int32())), pa.array([pack.compress(_planes(x)) for x in flat], pa.binary())],
                ["block", "docs", "counts", "at"],
            )

    return docs.mapInArrow(run, "block long, docs array<long>, counts array<int>, at binary")


def unit_ids(path: str) -> Recent:
    """The ids of units, by the unit."""
    parts = Recent(lambda part: split_ids(part, path), 100_000)

    def unit(u: str) -> bytes:
        if u == SPECIAL or ODD.search(u):
            return whole_ids(u, path)
        space, word = (" ", u[1:]) if u[0] == " " else ("", u)
        if word.isalpha():
            return parts[u]
        if word[:-1].isalpha() and not word[-1].isalnum() and not word[-1].isspace():
            return parts[space + word[:-1]] + parts[word[-1]]
        return b"".join([parts[p] for p in SPLIT.findall(u)])

    return Recent(unit, 200_000)


def _encoded_units(dictionaries: DataFrame, path: str) -> DataFrame:
    """``block, at, counts, ids``: the ids of the block's units in this bucket, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        known = unit_ids(path).__getitem__
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                counts, codes = [], []
                for blob in part.column("units").to_pylist():
                    own = list(map(known, _unpacked(blob)))
                    counts.append(pack.compress(_planes(np.fromiter(map(len, own), np.uint32, len(own)) // 4)))
                    codes.append(pack.compress(_planes(np.frombuffer(b"".join(own), "<u4"))))
                yield pa.record_batch([part.column("block"), part.column("at"), pa.array(counts, pa.binary()), pa.array(codes, pa.binary())], ["block", "at", "counts", "ids"])

    return dictionaries.groupBy("bucket").applyInArrow(run, "block long, at binary, counts binary, ids binary")


def encode_and_decode(docs: DataFrame, path: str, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``
    (``doc_id, text``), as the tokenizers library encodes without adding special tokens (the
    string of a special token in a text is that token) and decodes without skipping any.

    Null texts count as empty and have no tokens. ``docs`` must be a stored table: it is read
    twice, and both passes must see the same rows in the same order, which block digests
    check. Repeated rows come back as often; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = _encoded_units(_dictionaries(docs, path, min(MOST_BUCKETS, pieces_for(total * 0.15, bucket_bytes))), path)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        piece = byte_pieces(path)
        ids: list[bytes] = []
        decoded: list[bytes] = []
        for a, c, x in zip(*(right[k].to_pylist() for k in ("at", "counts", "ids")), strict=True):
            at, ends, code = (_from_planes(unpack.decompress(v)) for v in (a, c, x))
            if (size := int(at.max()) + 1) > len(ids):
                ids += [b""] * (size - len(ids))
                decoded += [b""] * (size - len(decoded))
            raw, said, lo = code.tobytes(), [piece[i] for i in code.tolist()], 0
            for j, hi in zip(at.tolist(), np.cumsum(ends).tolist(), strict=True):
                ids[j], decoded[j] = raw[4 * lo : 4 * hi], b"".join(said[lo:hi])
                lo = hi
        size = len(ids)
        out: list[list] = [[], [], [], []]
        for own, counts, at in zip(left["docs"].to_pylist(), left["counts"].to_pylist(), left["at"].to_pylist(), strict=True):
            flat = _from_planes(unpack.decompress(at)).tolist() if sum(counts) else []
            if flat and max(flat) >= size:
                raise RuntimeError("the two passes over the documents differ; store the table first")
            lo = 0
            for doc, n in zip(own, counts, strict=True):
                text = flat[lo : lo + n]
                lo += n
                code = b"".join(map(ids.__getitem__, text))
                back = b"".join(map(decoded.__getitem__, text)).decode("utf-8", "replace")
                for col, x in zip(out, (doc, len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), strict=True):
                    col.append(x)
        return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _positions(docs, path).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
