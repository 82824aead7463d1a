"""Merkle dataset manifest: a content-addressed DAG, and proofs of its leaves by descent.

1. *Leaves.* A row's digest is the sha256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and the value.
2. *Ranks.* Leaves of a tree are numbered in their order: rows are sorted over ranges, ranges are counted, and a
   range's first number comes from the counts before it.
3. *Nodes.* LEVELS levels are built at a time: the leaves whose ranks agree but for the last LEVELS binary digits are a *chunk*
   of at most 2**LEVELS, folded by one task to the chunk's root, two by two, a last one alone. A round later these
   roots are leaves themselves, until one remains for each tree. Every node is stored as digest -> children under the
   digest of its chunk's root. Equal subtrees have equal digests, so they are stored once.
4. *Descent.* Requests go down from the root, a chunk at a time. A request (chunk, rank digits) reads the records of its chunk,
   goes at each node to the child that the next digit names and collects the child not selected. Equal requests
   are one, so no more than 2**LEVELS meet in a chunk, the root's included, however many leaves stand below it.
5. *Proofs.* The segments that a leaf's requests collected, root first, are reversed to the siblings from leaf to root; the proof folds
   the leaf with them.

The forest has one tree per group (null first, then UTF-8 bytewise) and one more tree over their roots.

Defined cases: leaves of a tree ascend by key (null first), those of equal keys by digest; repeated rows are leaves of their
own; a lone leaf is its tree's root, with no siblings; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from .common import fold_of, quoted, renewed, stored

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 in lower-case hex of the fields' byte counts and values."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def digest_of(children: list[bytes]) -> bytes:
    """H of child digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def _count_along(batches) -> Iterator:
    """Sorted rows -> the same with their number within task and tree."""
    import pyarrow as pa

    tree, number = object(), 0
    for batch in batches:
        at = []
        for own in batch.column("tree").to_pylist():
            tree, number = own, number + 1 if own == tree else 0
            at.append(number)
        yield batch.append_column("at", pa.array(at, pa.int64()))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` (tree, ...) with rank, from 0 within each tree in the given order, and size, its number of rows."""
    p = shuffle_partitions(df.sparkSession)
    numbered = df.withColumn("salt", F.monotonically_increasing_id())
    by = ["tree", *order, "salt"]
    spread = numbered.repartitionByRange(p, *by).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*by).drop("salt")
    kinds = T.StructType([*spread.schema.fields, T.StructField("at", T.LongType())])
    rows = stored(spread.mapInArrow(_count_along, kinds), "ranks")
    counts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("many"))
    # a tree lies in consecutive ranges, so it has one row a range at most
    one = Window.partitionBy("tree")
    before = counts.select("tree", "part", (F.sum("many").over(one.orderBy("part")) - F.col("many")).alias("first"), F.sum("many").over(one).alias("size"))
    return rows.join(before, ["tree", "part"]).withColumn("rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def _fold_chunk(levels: int):
    """Leaves of a chunk -> its records and its root. All chunks of a tree of several reach the same height."""

    def group(rows):
        import pyarrow as pa

        tree, chunk = rows.column("tree")[0], rows.column("chunk")[0]
        size = rows.column("size")[0].as_py()
        lone = size <= 1 << levels  # the whole tree: it ends with its root
        nodes = [d for _, d in sorted(zip(rows.column("rank").to_pylist(), rows.column("digest").to_pylist()))]
        records: dict[bytes, list[bytes]] = {}
        height = 0
        while len(nodes) > 1 if lone else height < levels:
            above = []
            for i in range(0, len(nodes), 2):
                children = nodes[i : i + 2]
                above.append(digest_of(children))
                records[above[-1]] = children
            nodes, height = above, height + 1
        root, n = nodes[0], len(records)
        # the first row is the chunk's root, the others are records under it
        return pa.table(
            {
                "tree": pa.array([tree.as_py()] * (n + 1), tree.type),
                "chunk": pa.array([chunk.as_py()] * (n + 1), pa.int64()),
                "size": pa.array([-(-size >> levels)] * (n + 1), pa.int64()),
                "height": pa.array([height] * (n + 1), pa.int32()),
                "root": pa.array([root] * (n + 1), pa.binary()),
                "digest": pa.array([None, *records], pa.binary()),
                "children": pa.array([None, *records.values()], pa.list_(pa.binary())),
            }
        )

    return group


def _descend(requests, records):
    """Requests (digits, height) for one chunk -> the child each reaches and the digests it did not select, root first."""
    import pyarrow as pa

    children = dict(zip(records.column("digest").to_pylist(), records.column("children").to_pylist()))
    root = requests.column("root")[0].as_py() if requests.num_rows else None
    reached, segments = [], []
    for digits, height in zip(requests.column("digits").to_pylist(), requests.column("height").to_pylist()):
        node, segment = root, []
        for level in range(height - 1, -1, -1):
            digit = digits >> level & 1
            below = children[node]
            node = below[digit]
            segment.append(b"".join(c for i, c in enumerate(below) if i != digit))
        reached.append(node)
        segments.append(segment)
    n = requests.num_rows
    kinds = {"root": pa.binary(), "digits": pa.int64(), "height": pa.int32(), "reached": pa.binary(), "segment": pa.list_(pa.binary())}
    columns = ([root] * n, requests.column("digits").to_pylist(), requests.column("height").to_pylist(), reached, segments)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def build_tree(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of leaves (tree, rank, size, digest). A round has a row per chunk (tree, chunk, size, height, root) and its records
    (root, digest, children) beside; roots is (tree, digest)."""
    kind = leaves.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, chunk long, size long, height int, root binary, digest binary, children array<binary>"
    rounds, done, level = [], None, leaves.select("tree", "rank", "size", "digest")
    while True:
        chunks = level.withColumn("chunk", F.shiftright("rank", levels))
        made = stored(chunks.groupBy("tree", "chunk").applyInArrow(_fold_chunk(levels), schema), "nodes")
        rounds.append(made)
        roots = made.where("digest is null")
        whole_trees = roots.where("size <= 1").select("tree", F.col("root").alias("digest"))
        done = done.unionByName(whole_trees) if done else whole_trees
        if not roots.where("size > 1").limit(1).count():
            return rounds, done
        level = roots.where("size > 1").select("tree", F.col("chunk").alias("rank"), "size", F.col("root").alias("digest"))


def prove(leaves: DataFrame, rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """tree, rank, root, path of every different (tree, rank) of leaves: the digests beside its way, from the leaf to the root.

    A path has one entry per level, empty where a node has one child only; `way` has the digits beside them."""
    mask = (1 << levels) - 1
    asked = leaves.select("tree", "rank", "size").distinct()
    done = None
    for i in range(len(rounds) - 1, -1, -1):
        # the chunks of this round that hold leaves of trees with more rounds come from the round above
        heads = rounds[i].where("digest is null").select("tree", "chunk", "height", "root")
        records = rounds[i].where("digest is not null").select("root", "digest", "children").dropDuplicates(["root", "digest"])
        places = asked.where(F.col("size") > (1 << (levels * i))) if i else asked
        places = places.select("tree", F.shiftright("rank", levels * i).alias("place")).distinct()
        requests = places.withColumn("chunk", F.shiftright("place", levels)).join(heads, ["tree", "chunk"])
        requests = requests.withColumn("digits", F.col("place").bitwiseAND(F.lit(mask)))
        distinct = requests.select("root", "digits", "height").distinct()
        schema = "root binary, digits long, height int, reached binary, segment array<binary>"
        cut = distinct.groupBy("root").cogroup(renewed(records).groupBy("root")).applyInArrow(_descend, schema)
        below = requests.join(cut, ["root", "digits", "height"]).select("tree", "place", "chunk", "height", "digits", F.col("root").alias("top"), "segment")
        if done is None:
            merged = below.select("tree", "place", F.col("top").alias("root"), "segment", "digits", "height")
            merged = merged.select("tree", "place", "root", F.reverse("segment").alias("path"), _digits("digits", "height").alias("way"))
        else:
            above = done.select("tree", F.col("place").alias("chunk"), F.col("root").alias("upper"), F.col("path").alias("rest"), F.col("way").alias("rest_way"))
            merged = below.join(above, ["tree", "chunk"], "left").select(
                "tree",
                "place",
                F.coalesce("upper", "top").alias("root"),
                F.concat(F.reverse("segment"), F.coalesce("rest", F.array().cast("array<binary>"))).alias("path"),
                F.concat(_digits("digits", "height"), F.coalesce("rest_way", F.array().cast("array<int>"))).alias("way"),
            )
        done = stored(merged, "paths")
    return done.withColumnRenamed("place", "rank")


def _digits(digits: str, height: str) -> Column:
    """The binary digits of a place within its chunk, from the leaf up."""
    levels = F.when(F.col(height) > 0, F.sequence(F.lit(0), F.col(height) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda i: F.call_function("shiftright", F.col(digits), i).bitwiseAND(F.lit(1)).cast("int"))


def fold(leaf: bytes, path: list[bytes], way: list[int]) -> bytes:
    """The root that a leaf and the digests beside its way give."""
    for beside, digit in zip(path, way):
        sides = [x for x in ((beside, leaf) if digit else (leaf, beside)) if x]
        leaf = digest_of(sides)
    return leaf


def _checked(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        proofs, folded = [], []
        for leaf, path, way in zip(batch.column("shown").to_pylist(), batch.column("path").to_pylist(), batch.column("way").to_pylist()):
            proofs.append(hashlib.sha256(b"".join(p.hex().encode() for p in path)).hexdigest())
            folded.append(fold(leaf, path, way).hex())
        yield batch.select(["key", "leaf", "subroot", "root"]).append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = FIELDS, *, tampered_each: int = 7, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row. Rows whose key's crc32 is divisible by
    `tampered_each` are folded from a leaf with one more in `count`."""
    plain = leaf_digest([quoted(f) for f in fields])
    changed = leaf_digest([quoted(f) + 1 if f == count else quoted(f) for f in fields])
    shown = F.when(fold_of(key, tampered_each) == 0, changed).otherwise(plain)
    leaves = stored(df.select(quoted(key).alias("key"), quoted(group).alias("group"), F.unhex(plain).alias("digest"), F.unhex(shown).alias("shown")), "leaves")
    # a tree's name sorts as the groups do: null first, then bytewise
    tree = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    rows = stored(ranked(leaves.select(tree.alias("tree"), "key", "digest", "shown"), ["key", "digest"]), "ranked")
    rounds, subroots = build_tree(rows, levels)
    paths = prove(rows, rounds, levels)
    tops = stored(ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"]), "tops")
    top_rounds, _ = build_tree(tops, levels)
    over = prove(tops, top_rounds, levels).select("rank", F.col("root").alias("whole"), F.col("path").alias("rest"), F.col("way").alias("rest_way"))
    over = tops.join(over, "rank").select(F.col("group").alias("tree"), "whole", "rest", "rest_way")
    full = paths.join(over, "tree").select("tree", "rank", F.hex("root").alias("subroot"), F.hex("whole").alias("root"), F.concat("path", "rest").alias("path"), F.concat("way", "rest_way").alias("way"))
    joined = rows.join(full, ["tree", "rank"]).select("key", F.lower(F.hex("digest")).alias("leaf"), F.lower("subroot").alias("subroot"), F.lower("root").alias("root"), "shown", "path", "way")
    kind = df.schema[key].dataType.simpleString()
    checked = joined.mapInArrow(_checked, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return checked.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "case when {0} is null then '-' else concat(octet_length(encode({0}::varchar)), ':', {0}) end"
_LEAF = ", ".join(_FIELD.format(f) for f in FIELDS)
CRC_TABLE = """(select list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""
#: crc32 of a decimal number; `t` is CRC_TABLE's list
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}::varchar, ''), lambda x: ascii(x)::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
SQL = f"""
    with recursive tab as {CRC_TABLE},
    d as (select row_number() over () as r, doc_id, source, lang, n_chars, text, ({CRC.format("doc_id")} % 7 = 0) as bad from documents, tab),
    l as (select r, doc_id, lang, sha256(concat({_LEAF})) as leaf,
                 sha256(concat({_LEAF.replace("n_chars", "(n_chars + bad::int)")})) as shown from d),
    o as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
    v as (select lang, 0 as h, i, leaf as x, n from o
          union all select lang, h + 1, i // 2, sha256(string_agg(x, '' order by i)), (n + 1) // 2 from v where n > 1 group by lang, h, i // 2, n),
    tops as (select lang, x as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from v where n = 1),
    tv as (select 0 as h, i, subroot as x, n from tops
           union all select h + 1, i // 2, sha256(string_agg(x, '' order by i)), (n + 1) // 2 from tv where n > 1 group by h, i // 2, n),
    steps as (
      select o.r, e.h as step, case when s.x is null then 'U' when (o.i >> e.h) & 1 = 1 then 'L' || s.x else 'R' || s.x end as x
      from o join (select distinct lang, h from v where n > 1) e on e.lang is not distinct from o.lang
      left join v s on s.lang is not distinct from o.lang and s.h = e.h and s.i = xor(o.i >> e.h, 1)
      union all
      select o.r, 1000 + e.h, case when s.x is null then 'U' when (tops.i >> e.h) & 1 = 1 then 'L' || s.x else 'R' || s.x end
      from o join tops on tops.lang is not distinct from o.lang cross join (select distinct h from tv where n > 1) e
      left join tv s on s.h = e.h and s.i = xor(tops.i >> e.h, 1)),
    paths as (select r, list(x order by step) as xs from steps group by r),
    a as (select o.*, tops.subroot, (select x from tv where n = 1) as root, coalesce(xs, []) as xs
          from o join tops on tops.lang is not distinct from o.lang left join paths using (r)),
    f as (select *, sha256(array_to_string(list_transform(xs, lambda x: substr(x, 2)), '')) as proof_sha256,
                 list_reduce(list_prepend(shown, xs), lambda a, b: sha256(case left(b, 1) when 'L' then substr(b, 2) || a
                             when 'R' then a || substr(b, 2) else a end)) as folded_root from a)
    select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""
