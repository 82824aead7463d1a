"""Exact dedup: Grace hash deduplication over records partitioned to spill files.

1. *Runs.* Each task folds what it reads, at most RUN_BYTES at a time, through an open-addressing
   table. Of equal texts in a run only one record, the run's best, keeps its content. The result
   is stored in the shared folder. A text that a third of all rows hold is now there once a run.
2. *Merging.* A text that is best in more than FAN_IN runs is folded again in salted groups of
   runs, until no text is in more.
3. *Buckets.* Records go to buckets by the leading bits of a hash of the text. From lengths
   alone it is known which buckets hold more than BUCKET_BYTES of different texts; their
   records are partitioned by four more bits, and so on, until each bucket fits. Spark's
   exchange writes the spill files of a level, so no record moves twice.
4. *Tables.* A bucket's records pass through one open-addressing table, which compares hash and
   then complete content. Texts of equal hash but other content are different.

Defined cases: null text equals empty text; of equal texts the row with the largest key stays
(null keys come first in that order), and of rows with that key the one read last; repeated rows are rows of their
own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from .common import quoted, stored, whole

RUN_BYTES = 48 << 20  # content folded at a time when reading
BUCKET_BYTES = 24 << 20  # different content that one table holds
FAN_IN = 1024  # runs of one text that one table merges
STEP_BITS = 4  # a bucket too large is cut into 16


class ContentTable:
    """Open addressing with linear probing. A slot holds an entry's number; an entry is a hash
    and the complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, hash_: int, content: bytes) -> int:
        """The entry of this content; a new one has the number len(contents) had before."""
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == hash_ and self.contents[number] == content:
                return number
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(hash_)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for number, hash_ in enumerate(self.hashes):
            at = hash_ & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _contents(batch) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _rank(key, row: int) -> tuple:
    return (key is not None, key, row) if key is not None else (False, 0, row)


def _fold_runs(run_bytes: int):
    """(row, key, hash, sha, text, rest) -> the same with run, copies, bytes; content on a run's best only."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        def flush():
            whole_run = pa.Table.from_batches(pending)
            kept = set(best)
            rows = whole_run.column("row").to_pylist()
            run = pa.array([rows[best[e]] for e in entries], pa.int64())
            copies = [0] * len(best)
            for e in entries:
                copies[e] += 1
            whole_run = whole_run.append_column("run", run)
            for part, is_best in (([i for i in range(len(rows)) if i in kept], True), ([i for i in range(len(rows)) if i not in kept], False)):
                if not part:
                    continue
                out = whole_run.take(pa.array(part, pa.int64()))
                if not is_best:
                    for name in ("text", "rest"):
                        at = out.schema.get_field_index(name)
                        out = out.set_column(at, out.schema.field(at), pa.nulls(len(part), out.schema.field(at).type))
                own = [entries[i] for i in part]
                out = out.append_column("copies", pa.array([copies[e] if is_best else 0 for e in own], pa.int64()))
                out = out.append_column("bytes", pa.array([len(table.contents[e]) if is_best else None for e in own], pa.int64()))
                yield from out.to_batches()

        table, pending, entries, best, ranks, size = ContentTable(), [], [], [], [], 0
        for batch in batches:
            start = len(entries)
            for i, (key, row, hash_, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), batch.column("hash").to_pylist(), _contents(batch))):
                entry, rank = table.entry(hash_, text), _rank(key, row)
                entries.append(entry)
                if entry == len(best):
                    best.append(start + i)
                    ranks.append(rank)
                elif rank > ranks[entry]:
                    best[entry], ranks[entry] = start + i, rank
            pending.append(batch)
            size += batch.nbytes
            if size >= run_bytes:
                yield from flush()
                table, pending, entries, best, ranks, size = ContentTable(), [], [], [], [], 0
        if pending:
            yield from flush()

    return task


def _tables(schema: T.StructType, carry: bool):
    """Records in the order of their bucket -> one row per record: its run, the row, key and size
    of its group; with `carry` the content on the row that stays."""
    names = schema.names

    def task(batches) -> Iterator:
        import pyarrow as pa

        def flush():
            rows = []
            for number, members in enumerate(groups):
                rank, at = stays[number]
                size = sum(copies for _, copies in members)
                for run, _ in members:
                    kept = carry and run == at["run"]
                    rows.append({"run": run, "keep_row": at["run"], "keep_key": at["key"], "group_size": size, "hash": at["hash"],
                                 "text": at["text"] if kept else None, "rest": at["rest"] if kept else None, "bytes": at["bytes"] if kept else None})
                    if len(rows) == 4096:
                        yield arrow(rows)
                        rows = []
            if rows:
                yield arrow(rows)

        def arrow(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

        types, bucket = None, None
        table, groups, stays = ContentTable(), [], []
        for batch in batches:
            if types is None:
                own = {f.name: f.type for f in batch.schema}
                types = {"run": pa.int64(), "keep_row": pa.int64(), "keep_key": own["key"], "group_size": pa.int64(), "hash": pa.int64(), "text": own["text"], "rest": own["rest"], "bytes": pa.int64()}
            lists = {n: batch.column(n).to_pylist() for n in ("bucket", "run", "key", "hash", "copies", "bytes", "text")}
            for i, text in enumerate(_contents(batch)):
                if lists["bucket"][i] != bucket:
                    yield from flush()
                    table, groups, stays, bucket = ContentTable(), [], [], lists["bucket"][i]
                entry, rank = table.entry(lists["hash"][i], text), _rank(lists["key"][i], lists["run"][i])
                if entry == len(groups):
                    groups.append([])
                    stays.append(((False, -1, -1), None))
                groups[entry].append((lists["run"][i], lists["copies"][i]))
                if rank > stays[entry][0] or stays[entry][1] is None:
                    stays[entry] = (rank, {n: lists[n][i] for n in ("run", "key", "hash", "bytes", "text")} | {"rest": batch.column("rest")[i].as_py()})
        yield from flush()

    return task


def _merge(records: DataFrame, bucket, carry: bool) -> DataFrame:
    own = {f.name: f.dataType for f in records.schema}
    schema = T.StructType([T.StructField(n, t) for n, t in (("run", T.LongType()), ("keep_row", T.LongType()), ("keep_key", own["key"]), ("group_size", T.LongType()), ("hash", T.LongType()), ("text", T.StringType()), ("rest", own["rest"]), ("bytes", T.LongType()))])
    dealt = records.withColumn("bucket", bucket)
    dealt = dealt.repartition(shuffle_partitions(records.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "run", "key", "hash", "copies", "bytes", "text", "rest").mapInArrow(_tables(schema, carry), schema)


def _bits(width: int):
    return F.shiftrightunsigned("hash", 64 - width) if width else F.lit(0).cast("long")


def _buckets(records: DataFrame, bucket_bytes: int, width: int, carry: bool) -> DataFrame:
    """Bucket by the first `width` bits; what does not fit is partitioned again."""
    bucket = _bits(width)
    texts = records.groupBy("hash").agg(F.max("bytes").alias("b"))
    over = texts.groupBy(bucket.alias("full")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    over = stored(over.where((F.col("b") > bucket_bytes) & (F.col("n") > 1)).select("full"), "dedup-over")
    if width + STEP_BITS > 63 or over.isEmpty():
        return _merge(records, bucket, carry)
    fits = records.join(over, bucket == F.col("full"), "left_anti")
    rest = records.join(over, bucket == F.col("full"), "left_semi")
    return _merge(fits, bucket, carry).unionByName(_buckets(rest, bucket_bytes, width + STEP_BITS, carry))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", *, payload: bool = False,
                 run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: row, key, sha, run. groups: run, keep_row, keep_key, group_size, and
    on each row that stays its text and, if `payload`, all other columns as `rest`."""
    others = [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)] if payload else []
    others = [c for c, name in zip(others, df.columns) if name != text] or [F.lit(0).alias("none")]
    numbered = df.select(
        F.monotonically_increasing_id().alias("row"), quoted(key).alias("key"),
        F.xxhash64(whole(text)).alias("hash"), F.sha2(whole(text), 256).alias("sha"),
        quoted(text).alias("text"), F.struct(*others).alias("rest"),
    )
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in numbered.schema], *[T.StructField(n, T.LongType()) for n in ("run", "copies", "bytes")]])
    runs = stored(numbered.mapInArrow(_fold_runs(run_bytes), schema), "dedup-runs")
    rows = runs.select("row", "key", "sha", "run")
    records = runs.where(F.col("copies") > 0).select("run", "key", "hash", "copies", "bytes", "text", "rest")
    chain = None
    while True:
        many = records.groupBy("hash").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > fan_in)
        many = stored(many, "dedup-many")
        if many.isEmpty():
            break
        salted = records.join(many, "hash").withColumn("salt", F.pmod(F.xxhash64("run"), F.ceil(F.col("runs") / fan_in)))
        folded = stored(_merge(salted, F.struct("hash", "salt"), True), "dedup-merged")
        best = folded.where(F.col("run") == F.col("keep_row")).select("run", F.col("keep_key").alias("key"), "hash", F.col("group_size").alias("copies"), "bytes", "text", "rest")
        step = folded.select(F.col("run").alias("from"), F.col("keep_row").alias("to"))
        records = records.join(many, "hash", "left_anti").unionByName(best)
        if chain is None:
            chain = step
        else:
            later = step.select(F.col("from").alias("to"), F.col("to").alias("last"))
            moved = chain.join(later, "to", "left").select("from", F.coalesce("last", "to").alias("to"))
            chain = moved.unionByName(step.join(chain.select("from"), "from", "left_anti"))
    total = records.agg(F.sum("bytes")).first()[0] or 0
    width = min(40, max(0, math.ceil(math.log2(max(1, 4 * total / bucket_bytes)))))
    groups = _buckets(records, bucket_bytes, width, payload)
    if chain is not None:
        start = chain.select(F.col("from").alias("run"), "to")
        rows = rows.join(start, "run", "left").select("row", "key", "sha", F.coalesce("to", "run").alias("run"))
    return rows, groups


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per row of `df`: key, keep_id, group_size, kept, text_sha256."""
    rows, groups = exact_groups(df, key, text, **limits)
    joined = rows.join(groups.select("run", "keep_row", "keep_key", "group_size"), "run")
    return joined.select(
        F.col("key").alias(key), F.col("keep_key").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of `df` that stay, all columns as they were."""
    _, groups = exact_groups(df, key, text, payload=True, **limits)
    stays = groups.where(F.col("run") == F.col("keep_row"))
    return stays.select(*[(F.col("text") if c == text else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(df.columns)])
