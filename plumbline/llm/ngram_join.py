"""N-gram Jaccard join by a token-group matrix, exact, down to connected components.

A document's set are its distinct word shingles as 64-bit hashes. Documents of equal sets are one class,
and only classes are compared.

1. *Order.* Shingles are ordered by how many documents of the whole table have them, rarest first, as
   a sketch of fixed size counts them (SKETCH_BITS); any order that is the same for all is exact, a better
   one leaves less to do. A set that reaches the threshold with another shares one of its first
   n - ceil(threshold * n) + 1 shingles, its *prefix*, with the other's prefix.
2. *Groups.* Similar documents go together: a group are the classes whose prefix ends with the same shingle
   and whose sizes lie within one factor of the threshold. A large group is cut into blocks of about
   BLOCK classes.
3. *Matrix.* Per shingle the groups that have it in a member's prefix, with its first position there and the members' smallest and
   largest set. Two sets whose first common shingle is at places i and j share no more than the smaller of n - i and m - j, so two groups
   of neighbouring sizes are candidates only if their places leave room for the threshold. A shingle of very many groups is
   cut into a grid of cells, and groups meet cell by cell.
4. *Cores.* In a group of several blocks a *core* is found first: its members are compared with the same few leaders, and what links
   to the leaders' largest component in one piece need not be compared among itself any more, so copies of copies do not make all
   pairs. Cores of candidate groups whose leaders link are one core. The other members get blocks of their own.
5. *Bound and open.* Shingles fall into PARTS token groups by hash, and a class keeps how many it has in
   each. The sum of the smaller numbers bounds what two classes share; pairs of blocks, not both of one core, in which no two members reach
   the threshold by this bound are dropped, and only classes of the others are fetched in whole. A bloom filter of
   fixed size spares most of the others the work. Then a member is compared only if the other block's
   union of shingles holds enough of its own.
6. *Components.* Each comparison returns a spanning forest of its links; components are joined by
   large-star and small-star steps (Kiveris et al. 2014), each stored in the shared folder.

Defined cases: null text is empty; a text of fewer words than a shingle has its whole sequence as
one; without words the set is empty and the document is linked with nothing, so its component is its
own key; repeated rows are rows of one class; null keys never name a component unless all keys
of it are null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import fresh, quoted, stored, utf8, whole

SKETCH_BITS = 22
SLICE = 1 << 14
BLOCK = 128  # classes that are compared at a time
LEADERS = 64  # of a large group
PARTS = 128  # token groups of the bound
CUT = 1024  # groups of one shingle that meet in one task
BLOOM_BITS = 23  # of the filter of classes to fetch
MEMO = 500_000
FULL = 65_535  # a number by token group stops here; two such numbers bound nothing
RECALL = 200_000  # sets a task remembers to skip copies; forgetting only costs work
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_memo: dict[bytes, int] = {}


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of the text's k-word shingles, sorted hashes."""
    import xxhash

    words = _WORDS(text.lower())
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], "uint64")
    if len(_memo) > MEMO:
        _memo.clear()
    hashes, digest, memo = np.empty(len(words), "uint64"), xxhash.xxh3_64_intdigest, _memo
    for i, word in enumerate(words):
        known = memo.get(word)
        if known is None:
            known = memo[word] = digest(word)
        hashes[i] = known
    n = len(words) - k + 1
    mixed = hashes[:n].copy()
    for j in range(1, k):
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[j : n + j]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _first_pass(k: int):
    """Texts -> a row per document, and the task's part of the sketch in slices."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        cells, seen, types = np.zeros(1 << SKETCH_BITS, "int32"), set(), None
        for batch in batches:
            types = {"key": batch.schema.field("key").type}
            sizes, classes = [], []
            for text in utf8(batch.column("text")):
                own = shingles(text, k)
                sizes.append(len(own))
                name = class_of(own)
                classes.append(name)
                if name not in seen:
                    cells[(own >> np.uint64(64 - SKETCH_BITS)).astype("int64")] += 1
                    seen.add(name)
                    if len(seen) > RECALL:
                        seen.clear()
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
        if types:
            parts = [x.tobytes() for x in cells.reshape(-1, SLICE)]
            n, salt = len(parts), TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.nulls(n, types["key"]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int64()), pa.array(parts, pa.binary())], names=names)

    names = ["key", "row", "n", "class", "slice", "salt", "cells"]
    return task


def _add_slices(batches) -> Iterator:
    import pyarrow as pa

    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for at, salt, cells in zip(batch.column("slice").to_pylist(), batch.column("salt").to_pylist(), batch.column("cells").to_pylist()):
            sums[at, salt] = sums.get((at, salt), 0) + np.frombuffer(cells, "int32").astype("int64")
    for (at, salt), total in sums.items():
        clipped = np.minimum(total, 2**31 - 1).astype("int32")
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([salt], pa.int64()), pa.array([clipped.tobytes()], pa.binary())], names=["slice", "salt", "cells"])


def _levels(lines: DataFrame) -> np.ndarray:
    """The sketch of all tasks, a byte a cell: twice the logarithm of its count. Added in two steps."""
    schema, p = "slice int, salt long, cells binary", shuffle_partitions(lines.sparkSession)
    parts = lines.where("slice is not null").select("slice", "salt", "cells")
    once = parts.repartition(p, "slice", "salt").mapInArrow(_add_slices, schema)
    twice = once.withColumn("salt", F.lit(0).cast("long")).repartition(p, "slice").mapInArrow(_add_slices, schema)
    cells = np.zeros(1 << SKETCH_BITS, "int64")
    for r in twice.toLocalIterator():  # 2**SKETCH_BITS numbers in all
        cells[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["cells"], "int32")
    return (2 * np.log2(1 + cells)).astype("uint8")


def _second_pass(shared, k: int, num: int, den: int, cut: int):
    """Texts -> a row per class (copies in sight skipped), and rows (shingle, cell, group, bound) of the matrix.

    The groups of a shingle that more than `cut` documents may have, as the sketch tells, are dealt to parts by hash, and every two parts meet in
    a cell of their own. cell = 2 * number + side: a part meets itself where no row is of side 1."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        def flush():
            if matrix:
                cells = folded(np.concatenate(matrix))
                bound = cells[:, 3] << 32 | cells[:, 4]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in (*cells.T[:3], bound)], *[pa.nulls(len(cells), t) for t in kinds[1:]]], names=names)

        levels, seen, matrix, held = shared.value, set(), [], 0
        parts_at = np.array([max(1, math.ceil((2 ** ((level + 1) / 2) - 1) / cut)) for level in range(80)], "int64")
        factor = math.log(den / num)
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column("row").to_pylist(), utf8(batch.column("text"))):
                own = shingles(text, k)
                n = len(own)
                if not n or (name := class_of(own)) in seen:
                    continue
                seen.add(name)
                if len(seen) > RECALL:
                    seen.clear()
                rank = levels[(own >> np.uint64(64 - SKETCH_BITS)).astype("int64")]
                length = n - -(-num * n // den) + 1
                parts = np.bincount((own >> np.uint64(64 - SKETCH_BITS - 7)).astype("int64") % PARTS, minlength=PARTS)
                order = np.argsort(rank, kind="stable")[:length]
                prefix = own[order].view("int64")
                group = (int(prefix[-1]) & ~255) | min(255, int(math.log(n) / factor + 1e-9))
                cells = np.column_stack([prefix, np.zeros(length, "int64"), np.full(length, group, "int64"), n - np.arange(length), np.full(length, n, "int64")])
                many = parts_at[rank[order]]
                matrix.append(cells[many == 1])
                for row, s in zip(cells[many > 1], many[many > 1].tolist()):
                    mine, others = group_part(group, s), np.arange(s)
                    copies = np.repeat(row[None], s, axis=0)
                    copies[:, 1] = 2 * (np.minimum(mine, others) * s + np.maximum(mine, others)) + (mine > others)
                    matrix.append(copies)
                held += length
                rows.append((group, name, digest, n, np.minimum(parts, FULL).astype("<u2").tobytes()))
            if rows:
                group, *rest = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, group, none, *rest], names=names)
            if held > 1_000_000:
                yield from flush()
                matrix, held = [], 0
        yield from flush()

    import pyarrow as pa

    names = ["shingle", "cell", "group", "bound", "class", "row", "n", "parts"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return task


def group_part(group: int, parts: int) -> int:
    return (group * 0x9E3779B97F4A7C15 >> 17 & 0x7FFFFFFF) % parts


def folded(cells: np.ndarray) -> np.ndarray:
    """Rows (shingle, cell, group, room, least) in the order of the first three, one for each: the most room that is left from a
    member's place of the shingle, and the smallest set."""
    cells = cells[np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))]
    firsts = np.flatnonzero(np.append(True, (np.diff(cells[:, :3], axis=0) != 0).any(axis=1)))
    least = np.minimum.reduceat(cells[:, 4], firsts)
    return np.column_stack([cells[firsts, :3], np.maximum.reduceat(cells[:, 3], firsts), least])


def _candidate_groups(num: int, den: int):
    """Matrix rows in the order of shingle and cell -> pairs of groups that may hold a match."""

    def pairs_of(cells: np.ndarray):
        """Of one shingle and cell, by sides."""
        _, cell, group, room, least = cells.T
        sizes = group & 255
        behind = int(np.searchsorted(cell & 1, 1))  # where side 1 begins
        for i in range(behind):
            first = i + 1 if behind == len(cells) else behind
            enough = (num + den) * np.minimum(room[first:], room[i]) >= num * (least[first:] + least[i])
            near = group[first:][enough & (np.abs(sizes[first:] - sizes[i]) <= 1)]
            if len(near):
                yield np.column_stack([np.minimum(near, group[i]), np.maximum(near, group[i])])

    def task(batches) -> Iterator:
        import pyarrow as pa

        rest = np.zeros((0, 5), "int64")
        made: list[np.ndarray] = []

        def flush():
            both = np.unique(np.concatenate(made), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def through(rows: np.ndarray):
            if len(rows) < 2:
                return
            edges = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1] >> 1) != 0)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(rows))
            several = ends - starts > 1
            for start, end in zip(starts[several].tolist(), ends[several].tolist()):
                yield from pairs_of(folded(rows[start:end]))

        for batch in batches:
            bound = batch.column("bound").to_numpy()
            columns = [batch.column(n).to_numpy() for n in ("shingle", "cell", "group")]
            rows = np.concatenate([rest, np.column_stack([*columns, bound >> 32, bound & 0xFFFFFFFF])])
            if not len(rows):
                continue
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])  # the last shingle may go on in the next batch
            made += through(rows[:cut])
            rest = rows[cut:]
            if sum(map(len, made)) > 500_000:
                yield flush()
                made = []
        made += through(rest)
        if made:
            yield flush()

    return task


def _bounded(num: int, den: int):
    """Pairs of blocks with their members' numbers by token group -> the pairs in which two members may match."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        def side(column):
            lengths = column.value_lengths().to_numpy()
            flat = column.flatten()
            return np.append(0, np.cumsum(lengths)), flat.field("n").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(flat.field("parts").to_pylist()), "<u2").reshape(-1, PARTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            (at_a, n_a, parts_a), (at_b, n_b, parts_b) = side(batch.column("a")), side(batch.column("b"))
            may = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                for x in range(at_a[i], at_a[i + 1]):
                    b = slice(at_b[i], at_b[i + 1])
                    shared = np.minimum(parts_a[x], parts_b[b]).sum(axis=1, dtype="int64")
                    full = (parts_a[x].max() >= FULL) & (parts_b[b].max(axis=1) >= FULL)
                    may[i] |= bool((full | ((num + den) * shared >= num * (n_a[x] + n_b[b]))).any())
                    if may[i]:
                        break
            yield batch.filter(pa.array(may)).drop_columns(["a", "b"])

    return task


def _bloom(wanted: DataFrame) -> np.ndarray:
    """2**BLOOM_BITS bits, those set that belong to a row digest of `wanted`."""
    place = F.pmod(F.xxhash64("row"), F.lit(1 << BLOOM_BITS))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits"))
    bits = np.zeros(1 << (BLOOM_BITS - 5), "uint32")
    for r in words.toLocalIterator():  # at most 2**(BLOOM_BITS - 5) rows
        bits[r["at"]] = r["bits"]
    return bits


def _tokens(shared, k: int):
    """Rows whose place in the filter is set -> their shingles."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        bits = shared.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            kept = batch.filter(pa.array((bits[place >> 5] >> (place & 31).astype("uint32") & 1).astype(bool)))
            made = [shingles(t, k).tobytes() for t in utf8(kept.column("text"))]
            yield kept.select(["row"]).append_column("tokens", pa.array(made, pa.binary()))

    return task


class _Block:
    """Classes with their sets, one behind the other, and the core each is known to belong to."""

    def __init__(self, members: list[dict]) -> None:
        self.names = [m["class"] for m in members]
        self.sets = [np.frombuffer(m["tokens"], "uint64") for m in members]
        self.sizes = np.array([len(s) for s in self.sets], "int64")
        self.core = [m["core"] for m in members]
        self.flat = np.concatenate(self.sets)
        self.owner = np.repeat(np.arange(len(members)), self.sizes)

    def qualifying(self, union: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members of which the other block's union holds enough: shared >= threshold * size."""
        at = np.minimum(np.searchsorted(union, self.flat), len(union) - 1)
        shared = np.bincount(self.owner[union[at] == self.flat], minlength=len(self.names))
        return np.flatnonzero(den * shared >= num * self.sizes)

    def rows(self, members: np.ndarray, universe: np.ndarray) -> np.ndarray:
        table = np.zeros((len(members), len(universe)), "float32")
        for i, m in enumerate(members):
            at = np.minimum(np.searchsorted(universe, self.sets[m]), len(universe) - 1)
            table[i, at[universe[at] == self.sets[m]]] = 1
        return table


def linked(a: _Block, b: _Block, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Numbers of members of a and b whose Jaccard is at least num / den, but not of two of one core."""
    cores = {c: i for i, c in enumerate({*a.core, *b.core} - {None})}
    core_a, core_b = (np.array([cores.get(c, none) for c in x.core]) for x, none in ((a, -1), (b, -2)))
    union_a, union_b = np.unique(a.flat), np.unique(b.flat)
    in_a, in_b = a.qualifying(union_b, num, den), b.qualifying(union_a, num, den)
    if not len(in_a) or not len(in_b):
        return
    universe = np.intersect1d(union_a, union_b, assume_unique=True)
    step = max(1, (16 << 20) // (4 * len(universe)))
    for i in range(0, len(in_a), step):
        rows = in_a[i : i + step]
        table_a = a.rows(rows, universe)
        for j in range(0, len(in_b), step):
            columns = in_b[j : j + step]
            shared = np.rint(table_a @ b.rows(columns, universe).T).astype("int64")
            union = a.sizes[rows][:, None] + b.sizes[columns][None, :] - shared
            match = (den * shared >= num * union) & (core_a[rows][:, None] != core_b[columns][None, :])
            for x, y in zip(*np.nonzero(match)):
                yield int(rows[x]), int(columns[y])


class _Forest:
    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _heart(leaders: _Block, num: int, den: int) -> tuple[bytes, list[bool]]:
    """The leaders' largest component, by its smallest name, and which leaders are in it."""
    forest, sizes = _Forest(), {}
    for x, y in linked(leaders, leaders, num, den):
        forest.join(leaders.names[x], leaders.names[y])
    roots = [forest.root(name) for name in leaders.names]
    for root in roots:
        sizes[root] = sizes.get(root, 0) + 1
    heart = min(sizes, key=lambda r: (-sizes[r], r))
    return heart, [root == heart for root in roots]


def _links(edges_of, left: str, right: str):
    """A task over rows of two lists of members; edges_of(two blocks) -> links."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            edges: list[tuple] = []
            for i in range(batch.num_rows):  # one row at a time as Python values
                edges += edges_of(_Block(batch.column(left)[i].as_py()), _Block(batch.column(right)[i].as_py()))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges)], names=["u", "v"])

    return task


def _compare(num: int, den: int):
    """A spanning forest of the links between two blocks."""

    def edges_of(a: _Block, b: _Block):
        forest = _Forest()
        return [(a.names[x], b.names[y]) for x, y in linked(a, b, num, den) if forest.join(a.names[x], b.names[y])]

    return edges_of


def _core(num: int, den: int):
    """The members of a block that link to the heart of their group's leaders, with the heart."""

    def edges_of(leaders: _Block, block: _Block):
        heart, inside = _heart(leaders, num, den)
        return {block.names[y]: heart for x, y in linked(leaders, block, num, den) if inside[x]}.items()

    return edges_of


def _bridge(num: int, den: int):
    """The hearts of two groups' leaders, if they link."""

    def edges_of(a: _Block, b: _Block):
        (heart_a, in_a), (heart_b, in_b) = _heart(a, num, den), _heart(b, num, den)
        return [(heart_a, heart_b)] if any(in_a[x] and in_b[y] for x, y in linked(a, b, num, den)) else []

    return edges_of


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) -> (node, label): the smallest node of its component, for every node linked to another."""
    edges = edges.where(F.col("u") != F.col("v"))
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    while (now := edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != state and now[0]:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _row(key: str, text: str) -> Column:
    """What tells a row from others: a digest of key and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(quoted(key).cast("string"), F.lit("null")), F.lit("|"), F.md5(whole(text)))))


def _members(core: Column) -> Column:
    return F.collect_list(F.struct("class", "tokens", core.alias("core")))


def _leaders(sets: DataFrame, many: int = LEADERS) -> DataFrame:
    """group, leaders: up to `many` classes of each group of several blocks, those of the smallest names."""
    names = sets.where("blocks > 1").groupBy("group", "block").agg(F.slice(F.array_sort(F.collect_list("class")), 1, many).alias("names"))
    chosen = names.groupBy("group").agg(F.slice(F.array_sort(F.flatten(F.collect_list("names"))), 1, many).alias("names")).select("group", F.explode("names").alias("class"))
    return sets.select("class", "tokens").join(chosen, "class").groupBy("group").agg(_members(F.lit(None).cast("binary")).alias("leaders"))


def _fetched(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class, tokens, group, blocks, block: the sets of the classes in `wanted`, from one scan of the texts."""
    filter_ = rows.sparkSession.sparkContext.broadcast(_bloom(wanted))
    place = F.pmod(F.xxhash64("row"), F.lit(1 << BLOOM_BITS)).alias("place")
    known = rows.select("row", place, "text").mapInArrow(_tokens(filter_, k), "row binary, tokens binary")
    classes = wanted.select("class", "group", "blocks", "block", "row")
    return stored(known.join(classes, "row").drop("row").dropDuplicates(["class"]), "ngram-sets")  # rows repeated with key and text


def _block_pairs(pairs: DataFrame, heads: DataFrame, light: DataFrame) -> DataFrame:
    """Pairs of blocks, within a group (a block with itself, if it has two members) and of candidate groups, with their members. Two
    blocks of one core do not meet, so of a group's pairs one side is a block outside its core."""
    names = ["a_group", "a_block", "b_group", "b_block"]
    a, b = (heads.select(*[F.col(c).alias(f"{side}_{c}") for c in heads.columns]) for side in "ab")
    free_a, free_b = a.where("a_core is null"), b.where("b_core is null")
    own = (F.col("a_block") == F.col("b_block")) & (F.col("a_size") > 1)
    within = free_a.join(b, F.col("a_group") == F.col("b_group")).where(F.col("b_core").isNotNull() | (F.col("a_block") < F.col("b_block")) | own)
    # a free block on one side at least, or two cores that are not one
    one = pairs.join(free_a, F.col("a") == F.col("a_group")).join(b, F.col("b") == F.col("b_group"))
    core_a = a.where("a_core is not null")
    two = pairs.join(core_a, F.col("a") == F.col("a_group")).join(free_b, F.col("b") == F.col("b_group"))
    cores = heads.where("core is not null").select("group", "core").distinct()
    apart = pairs.join(cores.select(F.col("group").alias("a"), F.col("core").alias("x")), "a").join(cores.select(F.col("group").alias("b"), F.col("core").alias("y")), "b")
    three = apart.where("x <> y").select("a", "b").join(core_a, F.col("a") == F.col("a_group")).join(b.where("b_core is not null"), F.col("b") == F.col("b_group"))
    left, right = (light.select(F.col("group").alias(f"{s}_group"), F.col("block").alias(f"{s}_block"), F.col("members").alias(s)) for s in "ab")
    met = [x.select(*names) for x in (within, one, two, three)]
    all_ = met[0].unionByName(met[1]).unionByName(met[2]).unionByName(met[3])
    return all_.join(left, names[:2]).join(right, names[2:]).select(*names, "a", "b")


def ngram_classes(df: DataFrame, key: str, text: str, k: int, num: int, den: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, labels). rows: key, row (its digest), n, class; labels: node, label of linked classes."""
    spark = df.sparkSession
    p = shuffle_partitions(spark)
    rows = df.select(quoted(key).alias("key"), _row(key, text).alias("row"), quoted(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    lines = stored(rows.mapInArrow(_first_pass(k), f"key {kind}, row binary, n long, class binary, slice int, salt long, cells binary"), "ngram-rows")
    documents = lines.where("slice is null").select("key", "row", "n", "class")
    shared = spark.sparkContext.broadcast(_levels(lines))
    second = stored(rows.select("row", "text").mapInArrow(_second_pass(shared, k, num, den, CUT), "shingle long, cell long, group long, bound long, class binary, row binary, n long, parts binary"), "ngram-matrix")
    firsts = [F.first(c).alias(c) for c in ("group", "n", "parts")]  # the same in all copies
    members = stored(second.where("shingle is null").groupBy("class").agg(*firsts, F.min("row").alias("row")), "ngram-members")
    matrix = second.where("shingle is not null").select("shingle", "cell", "group", "bound")
    matrix = matrix.repartition(p, "shingle", F.shiftright("cell", 1)).sortWithinPartitions("shingle", "cell")
    pairs = stored(matrix.mapInArrow(_candidate_groups(num, den), "a long, b long").distinct(), "ngram-pairs")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    wanted = pairs.select(F.col("a").alias("group")).unionByName(pairs.select(F.col("b").alias("group"))).unionByName(sizes.where("size > 1").select("group")).distinct()
    groups = sizes.join(wanted, "group").select("group", F.ceil(F.col("size") / block).alias("blocks"))
    placed = members.join(groups, "group").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    asked = stored(placed.select("class", "group", "blocks", "block", "row", "n", "parts"), "ngram-asked")
    # the core of groups of several blocks, by leaders that are the same for all blocks
    schema, none = "u binary, v binary", F.lit(None).cast("binary")
    heavy = _fetched(rows, asked.where("blocks > 1"), k)
    leaders = stored(_leaders(heavy), "ngram-leaders")
    large = heavy.groupBy("group", "block").agg(_members(none).alias("members")).join(leaders, "group")
    hearts = stored(large.select("leaders", "members").mapInArrow(_links(_core(num, den), "leaders", "members"), schema), "ngram-core")
    left, right = (leaders.select(F.col("group").alias(side), F.col("leaders").alias(f"{side}_leaders")) for side in "ab")
    two = pairs.join(left, "a").join(right, "b").select("a_leaders", "b_leaders")
    bridges = stored(two.mapInArrow(_links(_bridge(num, den), "a_leaders", "b_leaders"), schema), "ngram-bridges")
    named = components(bridges).select(F.col("node").alias("v"), "label")
    core = hearts.join(named, "v", "left").groupBy(F.col("u").alias("class")).agg(F.min(F.coalesce("label", "v")).alias("core"))
    # members outside the core of such a group get blocks of their own, so a block is wholly in a core or has none
    marked = stored(asked.join(core, "class", "left"), "ngram-marked")
    outside = marked.where("blocks > 1 and core is null").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("others"))
    own_block = F.when(F.col("core").isNull() & F.col("others").isNotNull(), F.col("blocks") + F.pmod(F.xxhash64("class"), "others")).otherwise(F.col("block"))
    marked = stored(marked.join(outside, "group", "left").withColumn("block", own_block).drop("others"), "ngram-marked")
    light = stored(marked.groupBy("group", "block").agg(F.collect_list(F.struct("n", "parts")).alias("members"), F.min("core").alias("core")), "ngram-light")
    heads = light.select("group", "block", F.size("members").alias("size"), "core")
    may = stored(_block_pairs(pairs, heads, light).mapInArrow(_bounded(num, den), "a_group long, a_block long, b_group long, b_block long"), "ngram-may")
    # the classes of these blocks in whole
    opened = may.select(F.col("a_group").alias("group"), F.col("a_block").alias("block")).unionByName(may.select(F.col("b_group").alias("group"), F.col("b_block").alias("block"))).distinct()
    fetch = stored(marked.join(opened, ["group", "block"]), "ngram-fetch")
    columns = ["class", "tokens", "group", "block"]
    ready = heavy.select("class", "tokens").join(fetch.where("blocks > 1").select("class", "group", "block"), "class").select(*columns)
    sets = _fetched(rows, fetch.where("blocks = 1"), k).select(*columns).unionByName(ready)
    in_core = marked.where("core is not null").select("class", "core")
    packed = sets.join(in_core, "class", "left").groupBy("group", "block").agg(_members(F.col("core")).alias("members"))
    packed = stored(packed, "ngram-blocks")
    left, right = (packed.select(F.col("group").alias(f"{s}_group"), F.col("block").alias(f"{s}_block"), F.col("members").alias(s)) for s in "ab")
    opened = may.join(left, ["a_group", "a_block"]).join(right, ["b_group", "b_block"]).select("a", "b")
    edges = opened.mapInArrow(_links(_compare(num, den), "a", "b"), schema).unionByName(hearts).unionByName(bridges)
    return documents, components(edges)


def ngram_components(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id of every row; linked where den * shared >= num * union."""
    documents, labels = ngram_classes(df, key, text, words, num, den, block)
    named = documents.join(labels, F.col("class") == F.col("node"), "left").select("key", "n", F.coalesce("label", "class").alias("label"))
    least = named.where("n > 0").groupBy("label").agg(F.min("key").alias("least"))
    joined = named.join(least, "label", "left")
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """The rows of `df` that stay: of each component one row of the smallest key, and all rows without
    words. All columns as they were."""
    documents, labels = ngram_classes(df, key, text, words, num, den, block)
    named = documents.where("n > 0").join(labels, F.col("class") == F.col("node"), "left")
    ranked = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    stays = named.groupBy(F.coalesce("label", "class").alias("label")).agg(F.min(ranked).alias("first")).select(F.col("first.row").alias("_row"))
    row = fresh(df, "row_digest")
    known = df.withColumn(row, _row(key, text))
    has_words = whole(text).rlike(r"[^\x20\x09-\x0D]")
    kept = known.where(has_words).join(stays, quoted(row) == F.col("_row"), "left_semi")
    return kept.dropDuplicates([row]).unionByName(known.where(~has_words)).drop(row)
