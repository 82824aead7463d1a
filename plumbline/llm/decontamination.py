"""Benchmark decontamination over a distributed positional inverted index.

1. *Index.* Every task of the scan cuts its documents into segments of about SEGMENT words and writes one row
   per segment and term: the places of the term, ascending, as differences. A segment counts its places through, document
   after document; one more row holds where its documents start. Postings stay with their segment, so a frequent
   term is spread over all of them and nothing is shuffled to build the index, which is stored in the shared folder.
2. *Windows.* Test texts are cut into windows of `size` consecutive words, equal ones kept once with the set
   of items that have them. Terms of a window are put in the order of their postings in the whole index, rarest first; a
   window with a term that the index lacks is done.
3. *Search.* A window goes to the segments that hold its rarest term, in blocks of BLOCK windows. There the rarest list
   is thinned by each further list, next rarest first: a place stays while the other term has one less than `span`
   words away. From what stays come the *phrase* matches (every list, moved by its offset in the window, holds the same
   start) and the *proximity* matches (all different words of the window within `span` words of one document, in any order).
4. *Answer.* Words under phrase matches and sets of items per document; sets are joined to items at the end.

Terms are 64-bit hashes of words. A segment, its lists and a block of windows are what a task holds; a document of more
than SEGMENT words is a segment of its own.

Defined cases: null text has no words; texts without words have no windows and no hits; a null item id is never named
or counted, but its words hit; repeated item ids count once; repeated documents and null keys are rows of their own; an
empty table on either side gives no hits; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, renewed, stored, utf8

SEGMENT = 1 << 22  # words
BLOCK = 1 << 15  # windows that meet a segment at a time
MEMO = 400_000
WINDOW = 10
SPAN = 12
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Terms(dict):
    """word -> 64-bit hash; forgetting words only costs work."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        term = self[word] = xxhash.xxh3_64_intdigest(word)
        return term


def terms_of(text: bytes, memo: _Terms) -> np.ndarray:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, A-Z lowered, as hashes in their order."""
    words = text.translate(_TABLE).split()
    return np.fromiter(map(memo.__getitem__, words), "uint64", len(words)).view("int64")


def _binaries(data: np.ndarray, ends: np.ndarray):
    """An Arrow column of byte strings that lie one behind the other in `data` (4 bytes an entry)."""
    import pyarrow as pa

    offsets = np.append(0, ends * 4).astype("int32")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _segments(segment_words: int):
    def task(batches) -> Iterator:
        import pyarrow as pa

        memo, kind, number = _Terms(), None, TaskContext.get().partitionId() << 24
        held, keys, words = [], [], 0

        def table(rows: int, **columns):
            types = {"segment": pa.int64(), "term": pa.int64(), "n": pa.int64(), "places": pa.binary(), "key": kind, "start": pa.int64()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in types.items()], names=list(types))

        def written():
            terms = np.concatenate(held)
            lengths = np.array([len(x) for x in held], "int64")
            starts = np.append(0, np.cumsum(lengths))
            n = len(keys)
            yield table(n, segment=pa.array([number] * n, pa.int64()), key=pa.array(keys, kind), start=pa.array(starts[:-1]), n=pa.array(lengths))
            yield table(1, segment=pa.array([number], pa.int64()), n=pa.array([n], pa.int64()), places=pa.array([starts.astype("uint32").tobytes()], pa.binary()))
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            firsts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, "int64")
            ends = np.append(firsts[1:], len(terms))[: len(firsts)]
            places = order.astype("uint32")
            gaps = np.diff(places, prepend=places[:1])
            gaps[firsts] = places[firsts]
            for i in range(0, len(firsts), 1 << 16):
                first, end = firsts[i : i + (1 << 16)], ends[i : i + (1 << 16)]
                m = len(first)
                yield table(m, segment=pa.array([number] * m, pa.int64()), term=pa.array(terms[first]), n=pa.array(end - first), places=_binaries(gaps[first[0] : end[-1]], end - first[0]))

        for batch in batches:
            kind = batch.schema.field("key").type
            for key, text in zip(batch.column("key").to_pylist(), utf8(batch.column("text"))):
                own = terms_of(text, memo)
                if held and words + len(own) > segment_words:
                    yield from written()
                    held, keys, words, number = [], [], 0, number + 1
                held.append(own)
                keys.append(key)
                words += len(own)
        if held:
            yield from written()

    return task


def build_index(df: DataFrame, key: str, text: str, segment_words: int = SEGMENT) -> DataFrame:
    """The stored index: rows (segment, term, n, places), a row per document (segment, key, start, n words) and a row of
    the documents' starts per segment, where term and start are null."""
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return stored(rows.mapInArrow(_segments(segment_words), f"segment long, term long, n long, places binary, key {kind}, start long"), "index")


def _windows(size: int):
    def task(batches) -> Iterator:
        import pyarrow as pa

        memo = _Terms()
        for batch in batches:
            items, names, terms = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                own = terms_of(text, memo)
                for i in range(max(1, len(own) - size + 1) if len(own) else 0):
                    window = own[i : i + size]
                    items.append(item)
                    names.append(hashlib.blake2b(window.tobytes(), digest_size=16).digest())
                    terms.append(window)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(names, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "window", "terms"])

    return task


def windows_of(items: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """window, terms, items (sorted distinct ids as strings), set (a digest of them) of each different window."""
    rows = items.select(quoted(key).cast("string").alias("item"), quoted(text).alias("text")).mapInArrow(_windows(size), "item string, window binary, terms array<bigint>")
    named = rows.groupBy("window").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))
    own = F.transform("items", lambda i: F.concat(F.octet_length(i).cast("string"), F.lit(":"), i))
    return stored(named.withColumn("set", F.unhex(F.md5(F.array_join(own, "")))), "windows")


def near(lists: list[np.ndarray], span: int) -> np.ndarray:
    """Places of the first list that have one of every other list less than `span` words away."""
    places = lists[0].astype("int64")
    for other in lists[1:]:
        at = np.minimum(np.searchsorted(other, places - span + 1), len(other) - 1)
        reach = other[at]
        places = places[(reach > places - span) & (reach < places + span)]
        if not len(places):
            break
    return places


def phrase_starts(places: np.ndarray, offset: int, lists: list[tuple[int, np.ndarray]], starts: np.ndarray, size: int) -> np.ndarray:
    """Starts at which every (offset, list) has its place, inside one document; `places` are those of the word at `offset`."""
    begin = places - offset
    begin = begin[begin >= 0]
    for moved, other in lists:
        if not len(begin):
            return begin
        at = np.minimum(np.searchsorted(other, begin + moved), len(other) - 1)
        begin = begin[other[at] == begin + moved]
    inside = np.searchsorted(starts, begin, "right") == np.searchsorted(starts, begin + size - 1, "right")
    return begin[inside]


def proximity(places: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, span: int) -> np.ndarray:
    """Those places, of the rarest word, that lie in `span` words of their document which hold a word of every list."""
    if not len(places):
        return places
    document = np.searchsorted(starts, places, "right")
    first, behind = starts[document - 1][:, None], starts[document][:, None]
    low = places[:, None] - np.arange(span)[None, :]
    high = np.minimum(low + span, behind)
    low = np.maximum(low, first)
    held = np.ones(low.shape, bool)
    for other in lists:
        at = np.minimum(np.searchsorted(other, low), len(other) - 1)
        held &= (other[at] >= low) & (other[at] < high)
    return places[held.any(axis=1)]


def _search(span: int):
    """(segment, block): its lists and its windows -> a row per document with matches."""

    def group(lists, windows):
        import pyarrow as pa

        coded = {t: p for t, p in zip(lists.column("term").to_pylist(), lists.column("places").to_pylist())}
        starts = np.frombuffer(coded.pop(None), "uint32").astype("int64")
        known: dict[int, np.ndarray] = {}

        def places_of(term: int) -> np.ndarray:
            if term not in known:
                known[term] = np.cumsum(np.frombuffer(coded[term], "uint32"), dtype="int64")
            return known[term]

        words: dict[int, list] = {}
        found: dict[int, set] = {}
        close: dict[int, set] = {}
        for name, ordered in zip(windows.column("set").to_pylist(), windows.column("ordered").to_pylist()):
            if any(o["term"] not in coded for o in ordered):
                continue
            different = {o["term"]: o["at"] for o in reversed(ordered)}  # its first place in the window
            by_rarity = [places_of(t) for t in dict.fromkeys(o["term"] for o in ordered)]
            rarest = ordered[0]["term"]
            places = near(by_rarity, span)
            if not len(places):
                continue
            size = len(ordered)
            begin = phrase_starts(places, different[rarest], [(o["at"], places_of(o["term"])) for o in ordered[1:]], starts, size)
            for s, d in zip(begin.tolist(), (np.searchsorted(starts, begin, "right") - 1).tolist()):
                words.setdefault(d, []).append((s, size))
                found.setdefault(d, set()).add(name)
            for d in np.unique(np.searchsorted(starts, proximity(places, by_rarity[1:], starts, span), "right") - 1).tolist():
                close.setdefault(d, set()).add(name)
        rows = []
        for d in sorted(close.keys() | found.keys()):
            hit = {w - int(starts[d]) for s, size in words.get(d, ()) for w in range(s, s + size)}
            rows.append((int(starts[d]), sorted(hit), sorted(found.get(d, ())), sorted(close.get(d, ()))))
        segment = [lists.column("segment")[0].as_py()] * len(rows)
        start, hit, exact, around = zip(*rows) if rows else ([], [], [], [])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        # documents without words start where the next one does: the one that has words is the last of them
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip((segment, start, hit, exact, around), kinds)], names=["segment", "start", "hit", "found", "close"])

    return group


def search(index: DataFrame, windows: DataFrame, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """segment, start (of a document), hit (its word places under phrase matches), found and close (sets of phrase and
    proximity matches) of every document with a match."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    postings = index.where("term is not null").select("segment", "term", "n", "places")
    needed = stored(postings.join(terms, "term", "left_semi").select("segment", "term", "n", "places"), "postings")
    frequency = needed.groupBy("term").agg(F.sum("n").alias("n"))
    each = windows.select("window", "set", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term")).join(frequency, "term")
    ordered = each.groupBy("window", "set", "size").agg(F.array_sort(F.collect_list(F.struct("n", "term", "at"))).alias("ordered"))
    ordered = stored(ordered.where(F.size("ordered") == F.col("size")).select("window", "set", "ordered", F.col("ordered")[0]["term"].alias("term")), "ordered")
    blocks = max(1, -(-ordered.count() // block))
    asked = needed.select("segment", "term").join(ordered, "term").withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))).select("segment", "block", "set", "ordered")
    lists = needed.select("segment", "term", "places").unionByName(index.where("term is null and start is null").select("segment", "term", "places"))
    lists = lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = asked.select("segment", "block").distinct()
    lists = lists.join(pairs, ["segment", "block"], "left_semi")
    keys = ["segment", "block"]
    schema = "segment long, start long, hit array<int>, found array<binary>, close array<binary>"
    hits = renewed(lists).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(span), schema)
    return stored(hits, "hits")


def decontaminate(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", *, size: int = WINDOW, span: int = SPAN, segment_words: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match) of every row."""
    index = build_index(df, key, text, segment_words)
    windows = windows_of(items, item_key, item_text, size)
    place = ["segment", "start"]
    hits = search(index, windows, max(span, size), block).groupBy(*place).agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit", "found", "close")])
    sets = windows.groupBy("set").agg(F.first("items").alias("items"))
    named = hits.select(*place, "found", F.explode("close").alias("set")).join(sets, "set")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.array_contains("found", F.col("set")), F.col("items"))))))
    named = named.groupBy(*place).agg(ids.alias("ids"), F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n_near"))
    found = hits.join(named, place, "left").select(*place, F.size("hit").cast("long").alias("n_hit"), "ids", "n_near")
    documents = index.where("start is not null").select(*place, "key", F.col("n").alias("n_words"))
    joined = documents.join(found.withColumn("any", F.lit(True)), (documents["segment"] == found["segment"]) & (documents["start"] == found["start"]) & (documents["n_words"] > 0), "left")
    ids, n_hit = F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.col("n_near").cast("long"), F.lit(0).cast("long")).alias("n_near"),
    )


SQL = r"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
    w as (select distinct item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [ws]
                 else list_transform(range(1, len(ws) - 8), lambda i: ws[i : i + 9]) end) as win from b),
    sizes as (select distinct len(win) as k from w),
    places as (select r, k, unnest(range(1, len(ws) - k + 2)) as i, ws from d, sizes),
    hits as (select p.r, p.i, p.k, w.item_id from places p join w on p.ws[p.i : p.i + p.k - 1] = w.win),
    words as (select r, count(distinct j) as n from (select r, unnest(range(i, i + k)) as j from hits) group by r),
    named as (select r, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
              from hits group by r),
    t as (select distinct win, unnest(win) as word from w),
    n as (select win, count(*) as n from t group by win),
    p as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
    q as (select r, word, i from p semi join t using (word)),
    able as (select q.r, t.win from q join t using (word) group by q.r, t.win having count(distinct q.word) = (select any_value(n) from n where n.win = t.win)),
    near as (select distinct able.r, able.win from able join t on t.win = able.win join q a on a.r = able.r and a.word = t.word
             join t u on u.win = able.win join q c on c.r = able.r and c.word = u.word and c.i between a.i and a.i + 11
             group by able.r, able.win, a.i having count(distinct c.word) = (select any_value(n) from n where n.win = able.win)),
    around as (select r, count(distinct item_id) as n from near join w using (win) group by r)
    select doc_id, len(ws)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated, coalesce(around.n, 0)::bigint as n_near
    from d left join words using (r) left join named using (r) left join around using (r)
"""
