"""Best-fit packing of tokenised documents by bin completion.

*Pieces.* Executors tokenise; a document is its ids and an end id, cut only if longer than a
sequence. Pieces are stored with their length, the number of their task, and their rank among the task's
pieces of that length.

*Plan.* What a plan needs is how many pieces of each length there are: at most `capacity` numbers,
whatever the corpus. Bin completion works on them: take the longest piece left, enumerate the
undominated fillings of the room beside it, apply a filling as often as the numbers allow, go on.
Branch and bound goes back to other fillings while the waste still allowed by the incumbent permits;
the first incumbent is a best-fit decreasing packing. Each step uses up a length, so a plan has at
most `capacity` patterns plus those of the incumbent's ties, and may be broadcast.

*Placing.* A piece's rank among all of its length (rank in its task plus the earlier tasks' numbers)
names its pattern, sequence and offset.

Defined cases: null text is empty, a document of just the end id; repeated rows are documents of
their own; an empty table packs into nothing; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import quoted, stored, utf8

NODES = 6_000  # patterns tried by branch and bound
FILLINGS = 24  # undominated fillings kept for one longest piece
STEPS = 1_000  # steps of one enumeration
MEMO = 500_000  # words of one generation that a worker remembers
SLICE = 2 << 20  # text tokenised at a time
TAIL = b".,!*#$%&"
LATIN = "\u0250"  # letters below are one composed character each, and are lowered one by one
# Fixed rule of byte-level tokenizers: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def parted(word: bytes) -> tuple[bytes, bytes]:
    """(core, tail): an ASCII punctuation tail behind an ASCII letter or digit is a token run of its own."""
    core = word.rstrip(TAIL)
    if core and core != word and core[-1:].isalnum():
        return core, word[len(core) :]
    return word, b""


class WordTokenizer:
    """A tokenizer that drops white space and never joins across it, word by word with a memo.

    Words are cut at ASCII white space. A-Z are lowered beforehand, as the tokenizer will; not so in texts with a combining
    mark (all that join with ASCII letters begin with the bytes CC or CD), which the tokenizer composes before it lowers. The memo
    has two generations: what is not met again while the new one fills is forgotten with the old one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        known, old, apart = self.known, self.old, []
        new: dict[bytes, None] = {}
        for word in words:
            if word in old:
                known[word] = old[word]
                continue
            core, tail = parted(word)
            if tail:
                apart.append((word, core, tail))
            for part in (core, tail):
                if part in old:
                    known[part] = old[part]
                elif part not in known:
                    new[part] = None
        new.pop(b"", None)
        mixed, merge = [], self.merge
        for part in new:
            text = part.decode()
            if text.isalpha() and max(text) < LATIN and "\u0130" not in text:  # one run of letters: only merging is left to do
                text = text.lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
                known[part] = array("I", [t.id for t in merge(text)]).tobytes()
            else:
                mixed.append(part)
        for part, coded in zip(mixed, self.tokenizer.encode_batch_fast([p.decode() for p in mixed], add_special_tokens=False)):
            known[part] = array("I", coded.ids).tobytes()
        for word, core, tail in apart:
            known[word] = known[core] + known[tail]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if len(self.known) > MEMO:
            self.known, self.old = {}, self.known
        known = self.known
        split = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        coded = [list(map(known.get, words)) for words in split]
        unknown: set[bytes] = set()
        for words, ids in zip(split, coded):
            if None in ids:
                unknown.update([w for w, i in zip(words, ids) if i is None])
        if unknown:
            self._learn(unknown)
        for words, ids in zip(split, coded):
            if None in ids:
                ids = [known[w] if i is None else i for w, i in zip(words, ids)]
            yield b"".join(ids)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def task(batches) -> Iterator:
        import pyarrow as pa

        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        own, chunk, seen, end_id = _TOKENIZERS[path], TaskContext.get().partitionId(), Counter(), end.to_bytes(4, "little")

        def packed(keys, texts):
            rows = []
            for key, ids in zip(keys, own.encode(texts)):
                ids += end_id
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((key, piece, at // 4, length, zlib.crc32(part), chunk, seen[length], part if with_ids else None))
                    seen[length] += 1
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names = ["key", "piece", "start", "length", "ids_crc32", "chunk", "local", "ids"]
        for batch in batches:
            types = [batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column("key").to_pylist(), utf8(batch.column("text"))):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= SLICE:
                    yield packed(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield packed(keys, texts)

    return task


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over numbers of pieces by length: (pattern, how many sequences)."""
    open_: dict[int, list[list]] = {}  # room left -> [[pattern as list of lengths, sequences]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                fits = min(capacity // length, left)
                times = left // fits
                open_.setdefault(capacity - fits * length, []).append([[length] * fits, times])
                left -= fits * times
                continue
            group = open_[room][-1]
            lengths, sequences = group
            fits = min(room // length, left)
            times = min(sequences, left // fits)
            group[1] -= times
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - fits * length, []).append([lengths + [length] * fits, times])
            left -= fits * times
    return [(_pattern(lengths), times) for groups in open_.values() for lengths, times in groups]


def _pattern(lengths: list[int]) -> Pattern:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def fillings(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, list[int]]]:
    """Undominated fillings of `room`, (waste, lengths), least waste first, longer pieces first.

    A filling is dominated if something still fits beside it, or if one or two of its
    pieces could give way to one longer piece.
    """
    from bisect import bisect_left, bisect_right

    found, steps = [], 0
    stack: list[int] = []
    used: Counter = Counter()

    def free(a: int, b: int) -> bool:
        """A piece of a length in [a, b] is left over."""
        return any(counts[x] > used[x] for x in lengths[bisect_left(lengths, a) : bisect_right(lengths, b)])

    def dominated(waste: int) -> bool:
        if free(1, waste):
            return True
        if not waste:
            return False
        kinds = sorted(set(stack))
        if any(free(x + 1, x + waste) for x in kinds):
            return True
        return any(free(x + y, x + y + waste) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or used[x] > 1)

    def descend(left: int, top: int) -> bool:
        nonlocal steps
        at = bisect_right(lengths, min(left, top)) - 1
        deeper = False
        while at >= 0 and steps < STEPS and len(found) < FILLINGS:
            x = lengths[at]
            if counts[x] > used[x]:
                steps += 1
                deeper = True
                stack.append(x)
                used[x] += 1
                perfect = descend(left - x, x)
                used[x] -= 1
                stack.pop()
                if perfect:
                    return True
            at -= 1
        if not deeper and not dominated(left):
            found.append((left, list(stack)))
            return left == 0 and len(found) >= FILLINGS // 4
        return False

    descend(room, room)
    return sorted(found, key=lambda f: (f[0], len(f[1]))) or [(room, [])]


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences each fills: all pieces placed, as few sequences as found."""
    total = sum(x * n for x, n in counts.items())

    def bound(weight: int, big: int) -> int:
        return max(-(-weight // capacity), big)

    least = bound(total, sum(n for x, n in counts.items() if 2 * x > capacity))
    best = best_fit(counts, capacity)
    best_size = sum(times for _, times in best)
    left = {x: n for x, n in counts.items() if n}
    lengths = sorted(left)
    path: list[tuple] = []  # (pattern, times, fillings still to try)
    weight, size, big, tried = total, 0, sum(n for x, n in left.items() if 2 * x > capacity), 0

    def apply(pattern: Pattern, times: int, sign: int) -> None:
        nonlocal weight, size, big
        for x, k in pattern:
            left[x] -= sign * times * k
            weight -= sign * times * k * x
            big -= sign * times * k * (2 * x > capacity)
        size += sign * times

    options = None
    while best_size > least and tried < nodes:
        if options is None:  # a new node
            lengths = [x for x in lengths if left[x]]
            if lengths:
                top = lengths[-1]
                left[top] -= 1
                options = [_pattern([top, *f]) for _, f in reversed(fillings(capacity - top, left, lengths))]
                left[top] += 1
            else:
                options = []
                if size < best_size:
                    best, best_size = [(pattern, times) for pattern, times, _ in path], size
        if options and size + bound(weight, big) < best_size:  # the waste the incumbent allows
            pattern = options.pop()
            times = min(left[x] // k for x, k in pattern)
            path.append((pattern, times, options))
            apply(pattern, times, 1)
            tried += 1
            options = None
            continue
        while path:  # go back to the last node with another filling
            pattern, times, options = path.pop()
            apply(pattern, times, -1)
            if options:
                lengths = sorted(x for x, n in left.items() if n)
                break
        else:
            break
    return best


def layout(plan: list[tuple[Pattern, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> ranges (first rank, first sequence, pieces a sequence, first offset), by rank."""
    ranges: dict[int, list] = {}
    ranks, sequence = Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length, many in pattern:
            ranges.setdefault(length, []).append((ranks[length], sequence, many, offset))
            ranks[length] += times * many
            offset += length * many
        sequence += times
    return ranges


def _place(shared):
    def task(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tables = {x: tuple(np.array(c, "int64") for c in zip(*rows)) for x, rows in shared.value.items()}
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), "int64"), np.zeros(len(rank), "int64")
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, start, many, at = tables[int(x)]
                k = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[k]
                sequence[own] = start[k] + inside // many[k]
                offset[own] = at[k] + inside % many[k] * x
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return task


def best_fit_packing(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", *, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and with
    `with_ids` the ids (little-endian unsigned 32-bit)."""
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, chunk int, local long, ids binary"
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_path, capacity, end, with_ids), schema), "packing-pieces")
    per_chunk = stored(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shared = df.sparkSession.sparkContext.broadcast(layout(pack(counts, capacity)))
    earlier = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["chunk", "length"]).select("key", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("local")).alias("rank"))
    out = f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    placed = ranked.mapInArrow(_place(shared), out).withColumnRenamed("key", key)
    return placed if with_ids else placed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of `best_fit_packing(..., with_ids=True)`: sequence_id and ids. A
    sequence has at most `capacity` pieces."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.aggregate("m", F.lit(b"").cast("binary"), lambda all_, m: F.concat(all_, m["ids"])).alias("ids")
    )
