"""Conversation prefix trie in balanced parentheses, a shard at a time.

1. *Sequences.* A turn is the digest of its role and text; a conversation is the string of its turns' digests. Copies are
   folded to one sequence with its number of conversations before anything is sorted.
2. *Shards.* Sequences are sorted over ranges, and a task cuts what it holds into shards of about SHARD turns. What a shard's first and
   last sequence share with their neighbours is its left and right *spine*; all its other nodes are in no other shard.
3. *Parentheses.* A shard's trie is written as balanced parentheses in the order of the sequences. Minima of the excess by block of BLOCK
   parentheses let `findclose` skip what cannot hold the end of a subtree; `rank` of the pairs `()` counts its leaves, and cumulative
   arrays over the opened nodes give members and savings of any subtree as a difference.
4. *Merging.* A node belongs to the first shard that holds it. Later shards that share it count neither its words once more nor it as a child, and a
   last leaf that the next shard goes on from is no leaf. So figures of shared spine nodes are sums over shards, by a digest of their path.
5. *Ends.* The keys that end at a node are hashed in ascending order as they stream by.

Defined cases: turns go by turn (null first), then role, then the digest of role and text; null role or text is empty; rows with
a null conversation id belong to none; repeated rows are turns of their own; a conversation whose turns are all replaced is turnless and ends
at the root; an empty table has no conversation and so no node, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import quoted, stored, whole
from .manifest import CRC, CRC_TABLE

SHARD = 1 << 18  # turns
BLOCK = 256  # parentheses
WIDTH = 16  # bytes of a turn's digest
WORD = r"[^\x20\x09-\x0D]+"
LONGEST_HEAD = 3  # turns taken from the first conversation of a block


class Parentheses:
    """A balanced sequence with block minima of the excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits  # 1 opens, 0 closes
        self.excess = np.cumsum(2 * bits.astype("int32") - 1)
        pairs = np.zeros(len(bits), "int64")
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaves_before = np.append(0, np.cumsum(pairs))  # rank of "()" before each position
        self.opens_before = np.append(0, np.cumsum(bits, dtype="int64"))
        blocks = np.arange(0, len(bits), BLOCK)
        self.minima = [np.minimum.reduceat(self.excess, blocks)] if len(bits) else [np.zeros(0, "int32")]
        while len(self.minima[-1]) > 1:
            last = self.minima[-1]
            self.minima.append(np.minimum.reduceat(last, np.arange(0, len(last), 2)))

    def findclose(self, at: int) -> int:
        """Where the parenthesis opened at `at` closes: the first place behind it with a smaller excess."""
        target = self.excess[at] - 1
        block = at // BLOCK
        end = min(len(self.bits), (block + 1) * BLOCK)
        below = self.excess[at + 1 : end] <= target
        if len(below) and below[i := int(below.argmax())]:
            return at + 1 + i
        level, node = 0, block
        while True:  # up to a right neighbour that reaches the target
            if node % 2 == 0 and node + 1 < len(self.minima[level]) and self.minima[level][node + 1] <= target:
                node += 1
                break
            level, node = level + 1, node // 2
        while level:  # down to the first block that does
            level, node = level - 1, 2 * node
            if self.minima[level][node] > target:
                node += 1
        start = node * BLOCK
        return start + int((self.excess[start : start + BLOCK] <= target).argmax())

    def leaves(self, at: int, close: int) -> int:
        return int(self.leaves_before[close] - self.leaves_before[at])


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two sequences share."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(s, "uint64", n * WIDTH // 8).reshape(n, WIDTH // 8) for s in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def shard_nodes(rows: list[dict], left: int, right: int, goes_on: bool) -> Iterator[tuple]:
    """Nodes of sorted, different sequences. The first shares `left` turns with the sequence before it and the last `right` turns with
    the one behind it (-1: there is none, so not even the root is shared), which goes on from the last if `goes_on`.

    Yields, parents first: depth, a sequence that runs through the node, the parent's number in this order, members, least key, children, leaves,
    savings, whether other shards may have the node too, and whether a sequence ends there."""
    bits, path_of, words, own, least, count, depth_of = [], [], [], [], [], [], []
    stack: list[int] = []  # opened nodes
    end_of = []  # the node at which each sequence ends
    before = b""
    for k, row in enumerate(rows):
        seq = row["seq"]
        depth = len(seq) // WIDTH
        keep = shared_turns(before, seq) + 1 if k else 0  # nodes that stay open, the root included
        while len(stack) > keep:
            stack.pop()
            bits.append(0)
        for d in range(keep, depth + 1):
            bits.append(1)
            stack.append(len(depth_of))
            depth_of.append(d)
            words.append(row["words"][d - 1] if d else 0)
            # a node is new to the table unless an earlier shard has it: only the first path can be shared with one
            own.append(0 if not k and d <= left else 1)
            path_of.append((k, d))
        end_of.append(stack[-1])
        before = seq
    bits += [0] * len(stack)
    tree = Parentheses(np.array(bits, "uint8"))
    opens = np.flatnonzero(tree.bits)
    n = len(opens)
    ending = np.zeros(n, "int64")
    smallest = [None] * n
    for at, row in zip(end_of, rows):
        ending[at] += row["n"]
        smallest[at] = row["least"]
    closes = np.array([tree.findclose(int(at)) for at in opens], "int64")
    behind = tree.opens_before[closes]  # the first node behind the subtree, in the order of opening
    members_before = np.append(0, np.cumsum(ending))
    members = members_before[behind] - members_before[:n]
    spent = np.array(words, "int64") * (members - np.array(own, "int64"))
    spent_before = np.append(0, np.cumsum(spent))
    saved = spent_before[behind] - spent_before[:n]
    leaves = tree.leaves_before[closes] - tree.leaves_before[opens]
    parents, children, key = np.full(n, -1), np.zeros(n, "int64"), list(smallest)
    last_path: list[int] = []
    for i, d in enumerate(depth_of):
        del last_path[d:]
        parents[i] = last_path[-1] if last_path else -1
        last_path.append(i)
        if d:
            children[parents[i]] += own[i]
    for i in range(n - 1, 0, -1):  # a parent opens before its children
        p = parents[i]
        if key[i] is not None and (key[p] is None or key[i] < key[p]):
            key[p] = key[i]
    if goes_on:  # the last sequence's end is no leaf: the next shard has its children
        for i in last_path:
            leaves[i] -= 1
    spine = [not path_of[i][0] and d <= left for i, d in enumerate(depth_of)]
    for i in last_path:
        spine[i] = spine[i] or depth_of[i] <= right
    for i in range(n):
        k, d = path_of[i]
        yield d, k, int(parents[i]), int(members[i]), key[i], int(children[i]), int(leaves[i]), int(saved[i]), spine[i], bool(ending[i])


def node_name(seq: bytes, depth: int) -> bytes:
    return hashlib.blake2b(seq[: depth * WIDTH], digest_size=16).digest()


def _shards(limit: int):
    """Sorted sequences of a range with what its ends share with the neighbour ranges -> nodes."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        names = ["node", "parent", "depth", "least", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "spine", "ends"]

        def rows_of():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row

        def emit(rows, left, right, goes_on):
            out, seen = [], []
            for d, k, parent, members, key, children, leaves, saved, spine, ends in shard_nodes(rows, left, right, goes_on):
                seq = rows[k]["seq"]
                name = node_name(seq, d) if spine or ends else None  # others are of this shard alone and need none
                parent_key, shared = seen[parent] if d else (None, False)
                seen.append((key, spine))
                out.append((name, node_name(seq, d - 1) if shared else None, d, key, None if shared else parent_key, members, children, leaves, saved, spine, ends))
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

        def made(out):
            types = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        held, turns, left, part = [], 0, -1, None
        for row in rows_of():
            if row["part"] != part:  # the first of a range
                if held:
                    yield from emit(held, left, held[0]["after"], held[0]["goes_on"])
                held, turns, left, part = [], 0, row["before"], row["part"]
            elif turns >= limit:
                here = shared_turns(held[-1]["seq"], row["seq"])
                yield from emit(held, left, here, here == len(held[-1]["seq"]) // WIDTH)
                held, turns, left = [], 0, here
            held.append(row)
            turns += len(row["seq"]) // WIDTH
        if held:
            yield from emit(held, left, held[0]["after"], held[0]["goes_on"])

    return task


def _between(batches) -> Iterator:
    """Last and first sequences of neighbour ranges -> how many turns they share, and whether the later goes on from the earlier."""
    import pyarrow as pa

    for batch in batches:
        rows = batch.to_pylist()
        left = [shared_turns(r["earlier"], r["first"]) if r["earlier"] is not None else -1 for r in rows]
        right = [shared_turns(r["last"], r["later"]) if r["later"] is not None else -1 for r in rows]
        goes_on = [r["later"] is not None and x == len(r["last"]) // WIDTH for r, x in zip(rows, right)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(goes_on, pa.bool_())], names=["part", "before", "after", "goes_on"])


def _hash_ends(batches) -> Iterator:
    """(node, key) in order -> sha256 of each node's keys, in memory that does not grow with them."""
    import pyarrow as pa

    node, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["node", "ends_sha256"])

    done: list[tuple] = []
    for batch in batches:
        for own, key in zip(batch.column("node").to_pylist(), batch.column("key").to_pylist()):
            if own != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(b"%d" % key)
            else:
                state.update(b",%d" % key)
        if done:
            yield row()
            done = []
    if state is not None:
        done.append((node, state.hexdigest()))
        yield row()


def _named(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in batch.column("seq").to_pylist()], pa.binary())], names=["key", "node"])


def rebuilt(df: DataFrame, key: str, turn: str, role: str, text: str, block: int, folds: int) -> DataFrame:
    """key, seq (turn digests), words of every conversation c: the first crc32(c) % folds turns of conversation c - c % block, then
    its own behind as many."""
    both = F.concat(F.octet_length(whole(role)).cast("string"), F.lit(":"), whole(role), whole(text))
    turns = df.where(quoted(key).isNotNull()).select(
        quoted(key).cast("long").alias("key"),
        F.struct(quoted(turn).alias("turn"), whole(role).alias("role"), F.md5(both).alias("digest"), F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("words")).alias("t"),
    )
    # a struct's own order would put null turns last
    listed = turns.groupBy("key").agg(F.array_sort(F.collect_list("t"), _turn_order).alias("ts"))
    listed = stored(listed.select("key", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("ts")), "conversations")
    heads = listed.select(F.col("key").alias("head"), F.slice("ts", 1, max(1, folds - 1)).alias("first"))
    taken = (F.crc32(F.col("key").cast("string").cast("binary")) % folds).cast("int")
    joined = listed.withColumn("head", F.col("key") - F.col("key") % block).join(heads, "head", "left").withColumn("h", taken)
    first = F.slice(F.coalesce("first", F.array().cast("array<struct<digest:string,words:bigint>>")), F.lit(1), F.col("h"))
    rest = F.filter("ts", lambda t, i: i >= F.col("h"))
    built = joined.select("key", F.concat(first, rest).alias("ts"))
    return built.select("key", F.unhex(F.array_join(F.transform("ts", lambda t: t["digest"]), "")).alias("seq"), F.transform("ts", lambda t: t["words"]).alias("words"))


def _turn_order(a, b):
    """Null turns first, then by turn, role and digest."""

    def three_way(x, y):
        return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    by = [three_way(a[c], b[c]) for c in ("turn", "role", "digest")]
    return F.when(by[0] != 0, by[0]).when(by[1] != 0, by[1]).otherwise(by[2])


def conversation_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, block: int = 20, folds: int = 4, shard: int = SHARD) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations; see the contract's columns."""
    p = shuffle_partitions(df.sparkSession)
    conversations = stored(rebuilt(df, key, turn, role, text, block, folds), "rebuilt")
    # a conversation's copies end at one node; the keys are sorted and hashed as a stream
    ended = conversations.select("key", "seq").mapInArrow(_named, "key long, node binary")
    ends = stored(ended.repartition(p, "node").sortWithinPartitions("node", "key").mapInArrow(_hash_ends, "node binary, ends_sha256 string"), "ends")
    sequences = conversations.groupBy("seq").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    spread = sequences.repartitionByRange(p, "seq").withColumn("part", F.spark_partition_id())
    rows = stored(spread, "sequences")
    edges = rows.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))  # a row per range, p at most
    along = Window.orderBy("part")
    edges = edges.select("part", "first", "last", F.lag("last").over(along).alias("earlier"), F.lead("first").over(along).alias("later"))
    between = edges.mapInArrow(_between, "part int, before long, after long, goes_on boolean")
    sorted_ = rows.join(F.broadcast(between), "part").repartition(p, "part").sortWithinPartitions("part", "seq")  # p rows of three numbers
    schema = "node binary, parent binary, depth long, least long, parent_key long, n_convs long, n_children long, n_leaves long, saved_tokens long, spine boolean, ends boolean"
    nodes = stored(sorted_.mapInArrow(_shards(shard), schema), "trie")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.where("spine").groupBy("node", "depth").agg(F.min("least").alias("least"), F.max("parent").alias("parent"), F.min("parent_key").alias("parent_key"), *sums, F.max("ends").alias("ends"))
    spine = stored(spine, "spines")
    columns = ["node", "parent", "parent_key", "depth", "least", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    merged = nodes.where(~F.col("spine")).select(*columns).unionByName(spine.select(*columns))
    # most nodes have neither a parent on a spine nor an end, and need no join
    ups = spine.select(F.col("node").alias("parent"), F.col("least").alias("up"))
    hung = merged.where("parent is not null").join(ups, "parent", "left").drop("parent")
    with_parent = hung.unionByName(merged.where("parent is null").drop("parent").withColumn("up", F.lit(None).cast("long")))
    ended_nodes = with_parent.where("ends").join(ends, "node", "left")
    with_ends = ended_nodes.unionByName(with_parent.where("not ends").withColumn("ends_sha256", F.lit(None).cast("string")))
    empty = hashlib.sha256(b"").hexdigest()
    return with_ends.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.coalesce("up", "parent_key").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


SQL = f"""
    with tab as {CRC_TABLE},
    t as (select conv_id, list(md5(concat(octet_length(encode(coalesce(role, ''))), ':', role, text)) order by turn nulls first, coalesce(role, ''), text) as ids,
                 list(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) order by turn nulls first, coalesce(role, ''), text) as ws
          from conversations where conv_id is not null group by conv_id),
    c as (select conv_id, ids, ws, conv_id - conv_id % 20 as head, {CRC.format("conv_id")} % 4 as h from t, tab),
    r as (select c.conv_id, list_concat(coalesce(b.ids, [])[1:c.h], c.ids[c.h + 1 :]) as ids, list_concat(coalesce(b.ws, [])[1:c.h], c.ws[c.h + 1 :]) as ws
          from c left join t b on b.conv_id = c.head),
    n as (select conv_id, d, md5(concat(d, array_to_string(ids[1:d], ''))) as node, md5(concat(d - 1, array_to_string(ids[1 : d - 1], ''))) as up,
                 ids[1:d] as path, case when d > 0 then ws[d] else 0 end as w, d = len(ids) as ends from (select *, unnest(range(0, len(ids) + 1)) as d from r)),
    g as (select node, any_value(up) as up, any_value(path) as path, d, any_value(w) as w, min(conv_id) as conv_id, count(*) as n_convs,
                 coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ended from n group by node, d),
    k as (select up, count(*) as n from g where d > 0 group by up),
    x as (select g.*, coalesce(k.n, 0) as n_children from g left join k on k.up = g.node),
    s as (select md5(concat(e, array_to_string(path[1:e], ''))) as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * w) as saved
          from (select *, unnest(range(0, d + 1)) as e from x) group by 1)
    select x.conv_id, x.d as depth, case when x.d > 0 then p.conv_id end as parent_conv_id, x.n_convs, x.n_children,
           s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(x.ended) as ends_sha256
    from x join s using (node) left join g p on p.node = x.up and x.d > 0
"""
