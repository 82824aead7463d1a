"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

A text is cut where a single space stands between two characters that are no white space; there
every pattern of this family ends a match, so the pieces can be encoded one by one and their ids
kept in a memo of bounded size. A new piece is split by the pattern into pre-tokens, and each
of them goes through two tiers:

1. a minimal perfect hash over the vocabulary (hash and displace): one displacement per bucket of
   tokens, chosen so that every token gets a slot of its own; the slot's token is compared, so that a
   pre-token outside the vocabulary is told apart. A hit is the id of the whole pre-token.
2. misses are merged from their bytes: a linked list of parts and a heap of adjacent pairs by
   rank, lowest rank first and the leftmost of equal ones.

Tier 1 gives what merging would give only for tokens that merging can reach; those that it cannot are
found while the table is built and left to tier 2.

Defined cases: null and empty texts have no ids (their digests are those of empty bytes); rows
are encoded one by one, so repeated rows, any key and any other column change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, utf8

MEMO = 1_000_000  # pieces, and as many pre-tokens, that a worker remembers
BUCKET_LOAD = 4  # tokens per displacement
CUT = re.compile(r"(?<=\S) (?=\S)")
_SINGLE = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of a set of byte strings: n strings, n slots."""

    def __init__(self, keys: list[bytes]) -> None:
        import xxhash

        self.digest = xxhash.xxh3_128_intdigest
        self.n = len(keys)
        self.buckets = max(1, self.n // BUCKET_LOAD)
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            wide = self.digest(key)
            members[wide % self.buckets].append((wide >> 64, i))
        self.shift = array("Q", bytes(8 * self.buckets))
        self.keys: list[bytes] = [b""] * self.n
        self.places = array("q", [-1]) * self.n
        taken = bytearray(self.n)
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            shift = 0
            while members[bucket]:
                slots = {(high ^ (shift * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 % 0xFFFFFFFFFFFFFFC5 % self.n for high, _ in members[bucket]}
                if len(slots) == len(members[bucket]) and not any(taken[s] for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for high, i in members[bucket]:
                slot = self._slot(high, shift)
                taken[slot] = 1
                self.keys[slot], self.places[slot] = keys[i], i

    def _slot(self, high: int, shift: int) -> int:
        return (high ^ (shift * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 % 0xFFFFFFFFFFFFFFC5 % self.n

    def place(self, key: bytes) -> int:
        """Where the key stood in the list; -1 if it was not there."""
        wide = self.digest(key)
        slot = self._slot(wide >> 64, self.shift[wide % self.buckets])
        return self.places[slot] if self.keys[slot] == key else -1


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Ids of a byte string by merges: always the pair of lowest rank, the leftmost of equals."""
    n, rank_of = len(word), ranks.get
    parts = [_SINGLE[b] for b in word]
    pairs = [rank_of(word[i : i + 2]) for i in range(n - 1)]  # rank of a part with the one after it
    pairs.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [rank << 32 | i for i, rank in enumerate(pairs) if rank is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        if pairs[i] != entry >> 32:
            continue  # the pair is no longer there
        j = after[i]
        k = after[i] = after[j]
        joined = parts[i] = parts[i] + parts[j]
        parts[j] = pairs[j] = pairs[i] = None
        if k < n:
            before[k] = i
            rank = pairs[i] = rank_of(joined + parts[k])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = pairs[h] = rank_of(parts[h] + joined)
            if rank is not None:
                heapq.heappush(heap, rank << 32 | h)
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Encodes texts to ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        whole = [token for token, rank in ranks.items() if merge(ranks, token) == [rank]]
        self.table = PerfectHash(whole)
        self.ids = [ranks[token].to_bytes(4, "little") for token in whole]
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._start()

    def _start(self) -> None:
        import regex

        self.split = regex.compile(self.pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        """Without the memos and the compiled pattern: what a broadcast carries."""
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "pieces", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        place = self.table.place(raw)
        found = self.ids[place] if place >= 0 else array("I", merge(self.ranks, raw)).tobytes()
        if len(self.words) >= MEMO:
            self.words.clear()
        self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        words = self.words
        found = b"".join([words.get(w) or self._word(w) for w in self.split(piece)])
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        memo, make = self.pieces, self._piece
        first, *others = CUT.split(text)
        out = [memo.get(first) or make(first)]
        for piece in others:
            piece = " " + piece
            out.append(memo.get(piece) or make(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file."""
    return Codec(read_ranks(path), pattern)


_CODECS: dict[tuple, Codec] = {}


def _shared(spark, path: str, pattern: str):
    """Built once on the driver, as large as the vocabulary, and sent to the executors; a function that gives a
    worker its codec, with the memos it has filled so far."""
    sent = spark.sparkContext.broadcast(codec(path, pattern))

    def own() -> Codec:
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = sent.value
        return _CODECS[path, pattern]

    return own


def _encode(codec_of, with_ids: bool):
    def task(batches) -> Iterator:
        import pyarrow as pa

        own = codec_of()
        for batch in batches:
            counts, ids, decoded, real = [], [], [], []
            for text in utf8(batch.column("text")):
                coded = own.encode(text.decode())
                counts.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                decoded.append(hashlib.sha256(own.decode(coded)).hexdigest())
                if with_ids:
                    real.append(array("I", coded).tolist())
            columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(real, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, digests of ids and of the decoded bytes, and with `with_ids` the ids.

    `ranks_path` is read on the driver.
    """
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_encode(_shared(df.sparkSession, ranks_path, pattern), with_ids), schema).withColumnRenamed("key", key)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded bytes of each list of ids; null is an empty list."""

    codec_of = _shared(df.sparkSession, ranks_path, pattern)

    def task(batches) -> Iterator:
        import pyarrow as pa

        own = codec_of()
        for batch in batches:
            made = [own.decode(array("I", x or []).tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], names=["key", "bytes"])

    rows = df.select(quoted(key).alias("key"), F.coalesce(quoted(ids), F.array().cast("array<long>")).cast("array<long>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(task, f"key {kind}, bytes binary").withColumnRenamed("key", key)
