"""LM scoring with a probabilistic suffix tree.

Tokens are words and one end per document. The symbols of the tree are words; its contexts are the last 1 .. `words`
words before a symbol, across the text, an end standing for the document's start. The tree's root is the chance of a
word by itself, spelled by a second, smaller tree of characters, so that unseen words have chances too. The score
is the log10 probability of the whole token sequence.

*Counting.* Each task makes chunks of the texts it reads, at most CHUNK_BYTES at a time: a row of the chunk's tokens, its different
words and their counts. Ranges of words (by hash) are merged over all chunks; each chunk gets back the counts and chances of its own words.

*Tree of words.* A context is a candidate if it was learned MIN_COUNT times, whatever the size of the corpus, so the tree grows with
it. Lengths are grown one by one: every chunk asks for the counts of its different windows (context and
symbol, as 64-bit hashes) whose context is a candidate; a range of hashes is summed over all chunks in one task and the sums go back. What was
learned of a context is its own count as a window. A candidate is kept if for some symbol the chance
differs from that after its longest proper suffix by a factor of RATIO (the divergence test), or if a longer context that ends in it
is kept: one more question, of contexts. Nothing of this tree is collected or broadcast. What a context has not
seen falls back to its longest kept suffix with the weight of STRENGTH learned symbols.

*Tree of characters.* A word starts with a boundary, which is a context symbol, and ends with a stop symbol. Contexts are the
last 0..DEPTH characters before a symbol, within the word. A context is a candidate if at least MIN_SHARE of all
symbols follow it, so there are at most DEPTH / MIN_SHARE + 1 of them; it is kept by the same divergence test.
Next-symbol distributions hold symbols of at least MIN_SHARE / 16
of all, so this tree is bounded whatever the corpus, and is broadcast. They are smoothed: what a context has not
seen falls back to its suffix with a share that grows with the number of different symbols seen
(Witten-Bell); the root falls back to a uniform choice of 2**21 symbols.

*Scoring.* Each different word is scored once between the chance of its characters q and its own count c, again Witten-Bell:
(c + V * q) / (N + V); this is the root of the tree of words. Then every token by its longest kept context.

Defined cases: null text is empty, just an end; if nothing is to be learned from, N = V = 0 and every
known count is 0; repeated rows count each; other columns are not looked at; `words` 0 scores words by themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import dropped, fold_of, lowered, quoted, stored, utf8

CHUNK_BYTES = 20 << 20
DEPTH = 5
MIN_SHARE = 1e-5
RATIO = 1.1
LEAST_CHANCE = 1e-3  # of a symbol that the divergence test looks at
UNIFORM = 2.0**-21
WORDS = 2  # of the longest context
MIN_COUNT = 16
STRENGTH = 256.0  # learned symbols that the shorter context counts for
STATE = "chunk long, kind int, piece int, a binary, b binary, c binary"
_STOP, _BOUNDARY = "\0", "\1"


def _packed(x) -> bytes:
    """Numbers as bytes, all lowest ones first, so that small numbers take little room when compressed."""
    import numpy as np

    return np.ascontiguousarray(x).view("uint8").reshape(-1, x.itemsize).T.tobytes()


def _unpacked(blob: bytes, kind: str):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(blob, "uint8").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_keys(x) -> bytes:
    """Ascending 64-bit keys as their steps."""
    import numpy as np

    return _packed(np.diff(x, prepend=np.uint64(0)))


def _unpacked_keys(blob: bytes):
    import numpy as np

    return np.cumsum(_unpacked(blob, "<u8"), dtype="uint64")


def _cut(keys, pieces: int):
    """Ascending keys -> numbers of the ranges of keys that they are in, and where each begins and the next ends."""
    import numpy as np

    own, starts = np.unique(((keys >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32), return_index=True)
    starts = [*starts.tolist(), len(keys)]
    return own.astype("int32"), list(zip(starts, starts[1:]))


def _chunks(batches) -> Iterator:
    """Texts -> a row per document, and a row per chunk: its different words by their hashes, how often they are learned,
    its tokens as places in them, and which documents are held out. The tokens begin with one more end, so that what stands before
    a word is the word before it or an end, the document's start."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["chunk", "place", "key", "held_out", "n_tokens", "ids", "held", "h", "words", "learned"]
    task, number = TaskContext.get().partitionId(), 0

    def batch_of(**columns):
        n = len(next(iter(columns.values())))
        columns = {"chunk": pa.array([chunk] * n, pa.int64())} | columns
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types.get(c, pa.binary())) for c in names], names=names)

    def flush():
        out, space = np.array(held), np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        letters = np.frombuffer(b"".join(texts), "uint8")
        ends = np.cumsum([len(t) for t in texts])
        texts.clear()
        inside = ~space[letters]
        edges = ends[:-1][ends[:-1] < len(letters)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last[:-1] &= ~inside[1:]
        edges = edges[edges > 0] - 1
        last[edges] = inside[edges]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) - starts + 1
        sizes = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(held))
        at = np.cumsum(np.concatenate([[0, 0], np.insert(lengths, np.cumsum(sizes), 0)]))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(letters[inside].tobytes())]).dictionary_encode()
        words = tokens.dictionary.to_pylist()
        h = pd.util.hash_array(np.array(words, object), categorize=False)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(words), "<i4")
        rank[order] = np.arange(len(words))
        ids = rank[tokens.indices.to_numpy()]
        learned = np.bincount(ids[1:][np.repeat(~out, sizes + 1)], minlength=len(words)).astype("<u4")
        yield batch_of(place=pa.array(range(len(keys)), pa.int32()), key=pa.array(keys, types["key"]), held_out=pa.array(held), n_tokens=pa.array(sizes + 1, pa.int64()))
        blobs = {"ids": _packed(ids), "held": out.astype("uint8").tobytes(), "h": _packed_keys(h[order]), "words": b"\n".join([words[i] for i in order]), "learned": _packed(learned)}
        yield batch_of(**{c: pa.array([x], pa.binary()) for c, x in blobs.items()})

    types, pending = None, 0
    for batch in batches:
        if types is None:
            types = {"place": pa.int32(), "key": batch.schema.field("key").type, "held_out": pa.bool_(), "n_tokens": pa.int64()}
        for key, out, text in zip(batch.column("key").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch.column("text"))):
            if not pending:
                chunk = (task << 33) + number
                keys, held, texts = [], [], []
            texts.append(lowered(text))
            keys.append(key)
            held.append(out)
            pending += len(text) + 64
            if pending >= CHUNK_BYTES:
                yield from flush()
                number, pending = number + 1, 0
    if pending:
        yield from flush()


def _rows(chunks, kind: int, pieces, a, b=None, c=None):
    """A batch of STATE. Kind 0: a chunk's tokens, which documents are held out, hashes of the words. Kind 1: words, later
    their counts and chances. Kind k + 1: a piece of question k, ascending keys and their numbers; or of its answer, the numbers' sums."""
    import pyarrow as pa

    blobs = [pa.array(x, pa.binary()) if x else pa.nulls(len(a), pa.binary()) for x in (a, b, c)]
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([kind] * len(a), pa.int32()), pa.array(pieces, pa.int32()), *blobs], names=["chunk", "kind", "piece", "a", "b", "c"])


def _by(column: str, batches) -> Iterator:
    """Rows in the order of a column -> its values, each with its rows."""
    now, rows = None, []
    for batch in batches:
        for i, value in enumerate(batch.column(column).to_pylist()):
            row = tuple(batch.column(c)[i].as_py() for c in ("chunk", "kind", "piece", "a", "b", "c"))
            if rows and value != now:
                yield now, rows
                rows = []
            now = value
            rows.append(row)
    if rows:
        yield now, rows


def _word_pieces(pieces: int):
    """Chunks' words -> the same by ranges of hashes."""

    def task(batches) -> Iterator:
        for batch in batches:
            for chunk, h, words, learned in zip(*(batch.column(c).to_pylist() for c in ("chunk", "h", "words", "learned"))):
                words, learned = words.split(b"\n"), _unpacked(learned, "<u4")
                own, edges = _cut(_unpacked_keys(h), pieces)
                yield _rows([chunk] * len(own), 1, own, [b"\n".join(words[a:b]) for a, b in edges], [_packed(learned[a:b]) for a, b in edges])

    return task


def _merged(batches) -> Iterator:
    """Words of one range from all chunks -> a row: the different ones, their counts, and which of them each chunk has."""
    import numpy as np
    import pyarrow as pa

    for piece, rows in _by("piece", batches):
        lists = [r[3].split(b"\n") for r in rows]
        edges = np.cumsum([0] + [len(x) for x in lists])
        words = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
        of, words = words.indices.to_numpy(), words.dictionary.to_pylist()
        n = np.bincount(of, np.concatenate([_unpacked(r[4], "<u4") for r in rows]), len(words)).astype("<i8")
        chunks = np.array([r[0] for r in rows], "<i8")
        blobs = [b"\n".join(words), _packed(n), chunks.tobytes(), edges.astype("<i8").tobytes(), _packed(of.astype("<i4"))]
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *(pa.array([x], pa.int64()) for x in (int(n.sum()), int((n > 0).sum()))), *(pa.array([x], pa.binary()) for x in blobs)], names=["piece", "learned", "kinds", "words", "n", "chunks", "edges", "of"])


def _learned_words(batches) -> Iterator:
    """Rows of `_merged` -> the words that are learned and their counts, one a row."""
    import pyarrow as pa

    for batch in batches:
        for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
            n = _unpacked(n, "<i8")
            rows = pa.RecordBatch.from_arrays([pa.array(words.split(b"\n"), pa.binary()), pa.array(n)], names=["word", "n"]).filter(pa.array(n > 0))
            for a in range(0, len(rows), 50_000):
                yield rows.slice(a, 50_000)


def symbols(word: str) -> str:
    """Boundary, the word's characters, stop. The two controls used as marks move to private places."""
    return _BOUNDARY + word.replace(_STOP, "\ue000").replace(_BOUNDARY, "\ue001") + _STOP


def _context_counts(depth: int, limit: int = 400_000):
    """Words and counts -> counts of (context, symbol), pre-aggregated in the task. Only the longest
    windows are counted word by word; shorter ones are summed from them."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        def flush():
            seen: dict[str, int] = defaultdict(int)
            for window, n in windows.items():
                for k in range(len(window)):
                    seen[window[k:]] += n
            lines = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in lines], pa.string()), pa.array([x[-1] for x in lines], pa.string()), pa.array(seen.values(), pa.int64())], names=["context", "symbol", "n"])

        windows: dict[str, int] = defaultdict(int)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                line = symbols(word.decode("utf-8", "replace"))
                for i in range(1, len(line)):
                    windows[line[max(0, i - depth) : i + 1]] += n
            if len(windows) > limit:
                yield from flush()
                windows.clear()
        yield from flush()

    return task


class SuffixTree:
    """context -> (log10 of next-symbol chances, log10 of the chance of falling back)."""

    def __init__(self, nodes: dict[str, tuple[dict[str, int], int, int]], depth: int) -> None:
        """nodes: context -> (symbol counts held, all that followed, how many different symbols)."""
        self.depth = depth
        self.chances: dict[str, dict[str, float]] = {}
        self.fallback: dict[str, float] = {}
        self.memo: dict[str, float] = {}
        for context in sorted(nodes, key=len):
            held, total, kinds = nodes[context]
            parts = max(1, total + kinds)
            spare = parts - sum(held.values())
            self.fallback[context] = math.log10(spare / parts)
            shorter = {s: 10 ** self.chance(context[1:], s) if context else UNIFORM for s in held}
            self.chances[context] = {s: math.log10((n + spare * shorter[s]) / parts) for s, n in held.items()}

    def state(self, context: str) -> str:
        """The longest suffix of the context that the tree has."""
        while context and context not in self.chances:
            context = context[1:]
        return context

    def chance(self, context: str, symbol: str) -> float:
        """log10 of the chance of the symbol after the context."""
        total, context = 0.0, self.state(context)
        while context in self.chances:
            known = self.chances[context].get(symbol)
            if known is not None:
                return total + known
            total += self.fallback[context]
            if not context:
                break
            context = self.state(context[1:])
        return total + math.log10(UNIFORM)

    def word(self, word: str) -> float:
        line, memo, total = symbols(word), self.memo, 0.0
        if len(memo) > 400_000:
            memo.clear()
        for i in range(1, len(line)):
            window = line[max(0, i - self.depth) : i + 1]
            known = memo.get(window)
            if known is None:
                known = memo[window] = self.chance(window[:-1], window[-1])
            total += known
        return total


def build_tree(words: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, ratio: float = RATIO) -> SuffixTree:
    """Grow the tree from (word, n)."""
    spark = words.sparkSession
    spread = words.select("word", "n").repartition(max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism))  # files are read by size, counting costs by row
    pairs = spread.mapInArrow(_context_counts(depth), "context string, symbol string, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "tree-pairs")
    totals = pairs.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    whole = totals.where(F.col("context") == "").first()
    if whole is None:
        return SuffixTree({"": ({}, 0, 1)}, depth)
    least = min_share * whole["total"]
    candidates = stored(totals.where((F.col("total") >= least) | (F.col("context") == "")), "tree-contexts")
    held = pairs.join(candidates, "context").where(F.col("n") >= least / 16)
    # the divergence test against the longest proper suffix
    parent = held.select(F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("total")).alias("p_suffix"))
    own = held.where(F.col("context") != "").withColumn("suffix", F.expr("substring(context, 2)"))
    p = F.col("n") / F.col("total")
    tested = own.join(parent, ["suffix", "symbol"]).select("context", p.alias("p"), (p / F.col("p_suffix")).alias("r"))
    diverging = tested.where((F.col("p") >= LEAST_CHANCE) & ((F.col("r") >= ratio) | (F.col("r") <= 1 / ratio))).select("context")
    suffixes = F.transform(F.sequence(F.lit(1), F.length("context")), lambda i: F.substring("context", i, F.length("context")))
    kept = diverging.select(F.explode(suffixes).alias("context")).distinct().unionByName(candidates.where(F.col("context") == "").select("context"))
    nodes: dict = {}
    # bounded: at most depth / min_share + 1 contexts, 16 / min_share symbols at each depth
    for r in held.join(kept, "context").groupBy("context", "total", "kinds").agg(F.collect_list(F.struct("symbol", "n")).alias("next")).toLocalIterator():
        nodes[r["context"]] = ({x["symbol"]: x["n"] for x in r["next"]}, r["total"], r["kinds"])
    return SuffixTree(nodes, depth)


def _score_words(shared, learned: int, kinds: int):
    """Rows of `_merged` -> for each chunk its words' counts and chances."""

    def task(batches) -> Iterator:
        import numpy as np

        tree, all_ = shared.value, max(1, learned + kinds)
        spare = kinds / all_ if learned else 1.0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("piece", "words", "n", "chunks", "edges", "of"))):
                n, of = _unpacked(row[2], "<i8"), _unpacked(row[5], "<i4")
                spelled = (tree.word(w.decode("utf-8", "replace")) for w in row[1].split(b"\n"))
                # in logarithms where the word is unknown: long words are too rare for a float
                p = np.array([math.log10(c / all_ + spare * 10**q) if c else math.log10(spare) + q for c, q in zip(n.tolist(), spelled)])
                chunks, edges = np.frombuffer(row[3], "<i8"), np.frombuffer(row[4], "<i8").tolist()
                edges = list(zip(edges, edges[1:]))
                yield _rows(chunks, 1, [row[0]] * len(chunks), [_packed(n[of[a:b]]) for a, b in edges], [_packed(p[of[a:b]]) for a, b in edges])

    return task


def _summed(batches) -> Iterator:
    """Pieces of a question, those of one range of keys from all chunks -> pieces of the answer."""
    import numpy as np

    for piece, rows in _by("piece", batches):
        parts = [_unpacked_keys(r[3]) for r in rows]
        edges = np.cumsum([0] + [len(x) for x in parts])
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(of, np.concatenate([_unpacked(r[4], "<u4") for r in rows]), len(keys)).astype("<i8")
        yield _rows([r[0] for r in rows], rows[0][1], [piece] * len(rows), [_packed(sums[of[a:b]]) for a, b in zip(edges, edges[1:])])


class Chunk:
    """A chunk's words in order, with what is known of their windows: each word after its last 1 .. `words` words."""

    def __init__(self, rows: list, words: int, asked: int) -> None:
        """asked: how many questions are answered in the rows: the windows' counts for 1, 2 .. words, then the kept contexts."""
        import numpy as np

        def whole(kind: int, at: int, number: str):
            pieces = sorted((r for r in rows if r[1] == kind), key=lambda r: r[2])
            return np.concatenate([np.empty(0, number), *(_unpacked(r[at], number) for r in pieces)])

        _, _, _, ids, held, h = next(r for r in rows if r[1] == 0)
        self.ids, self.held, self.h = _unpacked(ids, "<i4"), np.frombuffer(held, "uint8"), _unpacked_keys(h)
        self.end = self.ids[0]
        self.n, self.p = whole(1, 3, "<i8"), whole(1, 4, "<f8")
        self.sizes = np.diff(np.flatnonzero(self.ids == self.end))
        self.words, self.levels, self.question = words, [], None
        self.answers = [whole(k + 1, 3, "<i8") for k in range(1, asked + 1)]
        rows.clear()

    def grow(self) -> None:
        """Puts together levels: for each length of context the places that have one of MIN_COUNT or more, the windows'
        and the contexts' counts, the different contexts' keys and which of them each place has. The first length
        that is not answered becomes the question."""
        import numpy as np

        ids, learned = self.ids, np.concatenate([[False], np.repeat(self.held == 0, self.sizes)])
        # of the windows one word shorter: their keys and counts, which one ends at each place, and if one does
        keys, numbers, slot, alive = self.h, self.n, ids, np.ones(len(ids), bool)
        for k in range(1, self.words + 1):
            grown = alive[:-1] & np.append(numbers >= MIN_COUNT, False)[slot[:-1]]  # a context was seen as often as it was a window of the word before
            alive[:k] = False
            if k > 1:  # only the oldest word may be the document's start
                alive[k:] &= ids[1 : len(ids) - k + 1] != self.end
            alive[1:] &= grown
            at = np.flatnonzero(alive).astype("int32")
            own, before = keys[slot[at]], slot[at - 1]
            longer, of = np.unique((own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.h[ids[at - k]] * np.uint64(0xC2B2AE3D27D4EB4F), return_inverse=True)
            if k > len(self.answers):
                self.question = longer, np.bincount(of[learned[at]], minlength=len(longer))
                return
            seen = self.answers[k - 1]
            if len(self.answers) >= self.words:
                present, which = np.flatnonzero(np.bincount(before, minlength=len(keys))), np.empty(len(keys), "int32")
                which[present] = np.arange(len(present))
                self.levels.append((at, seen[of], numbers[before], keys[present], which[before]))
            keys, numbers, slot = longer, seen, np.zeros(len(ids), "int32")
            slot[at] = of

    def contexts(self):
        """The contexts' keys, and the order that makes them ascend."""
        import numpy as np

        keys = np.concatenate([level[3] for level in self.levels])
        return keys, np.argsort(keys, kind="stable")

    def diverge(self, learned: int) -> None:
        """The divergence test, at each place: it is what keeps a context and all its suffixes."""
        import numpy as np

        shorter, marks = self.n[self.ids] / max(1, learned), []
        for at, seen, support, _, _ in self.levels:
            p = seen / support
            ratio = np.divide(p, shorter[at], out=np.ones(len(at)), where=seen > 0)
            marks.append((seen > 0) & (p >= LEAST_CHANCE) & ((ratio >= RATIO) | (ratio <= 1 / RATIO)))
            shorter[at] = p
        found, numbers = np.zeros(len(self.ids), bool), []
        for (at, _, _, contexts, which), own in zip(self.levels[::-1], marks[::-1]):
            found[at] |= own
            numbers.append(np.bincount(which[found[at]], minlength=len(contexts)) > 0)
        keys, order = self.contexts()
        self.question = keys[order], np.concatenate(numbers[::-1])[order]

    def chances(self):
        """log10 of the chance of each word, by the kept contexts that end before it."""
        import numpy as np

        chance = self.p[self.ids]
        if not self.words:
            return chance
        _, order = self.contexts()
        kept, a = np.empty(len(order), bool), 0
        kept[order] = self.answers[self.words] > 0
        for at, seen, support, contexts, which in self.levels:
            own = kept[a : a + len(contexts)][which]
            a += len(contexts)
            at, n, all_ = at[own], seen[own], support[own] + STRENGTH
            chance[at] = np.where(n > 0, np.log10(n / all_ + STRENGTH / all_ * 10 ** chance[at]), np.log10(STRENGTH / all_) + chance[at])
        return chance


def _questions(words: int, asked: int, pieces: int, learned: int):
    """Chunks and the answers so far -> the next question, in pieces by ranges of keys."""

    def task(batches) -> Iterator:
        import numpy as np

        for number, rows in _by("chunk", batches):
            chunk = Chunk(rows, words, asked)
            chunk.grow()
            if asked == words:
                chunk.diverge(learned)
            keys, numbers = chunk.question
            own, edges = _cut(keys, pieces)
            if len(own):
                yield _rows([number] * len(own), asked + 2, own, [_packed_keys(keys[a:b]) for a, b in edges], [_packed(numbers[a:b].astype("<u4")) for a, b in edges])

    return task


def _sums(words: int):
    """Chunks and all answers -> sums per document."""

    def task(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for number, rows in _by("chunk", batches):
            chunk = Chunk(rows, words, words + 1 if words else 0)
            chunk.grow()
            n, of = chunk.n[chunk.ids[1:]], np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            sums = [np.bincount(of, x, len(chunk.sizes)) for x in (np.log10(n + 0.5), chunk.chances()[1:], n > 0)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(chunk.sizes), pa.int64()), pa.array(range(len(chunk.sizes)), pa.int32()), *map(pa.array, sums)], names=["chunk", "place", "b", "p", "k"])

    return task


def _stored(df: DataFrame, label: str) -> DataFrame:
    """`stored`; what its job shuffled is removed with the job's end, as later jobs read the table."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        conf.set(name, before)


def lm_score(df: DataFrame, key: str = "doc_id", text: str = "text", *, parts: int = 5, out: int = 1, words: int = 0) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score. `words` is the longest context in words."""
    spark = df.sparkSession
    rows = df.select(quoted(key).alias("key"), (fold_of(key, parts) == out).alias("held_out"), quoted(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"chunk long, place int, key {kind}, held_out boolean, n_tokens long, ids binary, held binary, h binary, words binary, learned binary"
    lines = _stored(rows.mapInArrow(_chunks, schema), "lm-chunks")
    documents = _stored(lines.where("ids is null").select("chunk", "place", "key", "held_out", "n_tokens"), "lm-documents")
    chunks = lines.where("ids is not null")
    pieces = max(shuffle_partitions(spark), chunks.select("chunk").count())  # tasks and ranges of keys: each grows as a chunk does and no more
    listed = chunks.select("chunk", "h", "words", "learned").mapInArrow(_word_pieces(pieces), STATE)
    listed = listed.repartition(pieces, "piece").sortWithinPartitions("piece")
    merged = _stored(listed.mapInArrow(_merged, "piece int, learned long, kinds long, words binary, n binary, chunks binary, edges binary, of binary"), "lm-words")
    seen = merged.agg(F.sum("learned").alias("learned"), F.sum("kinds").alias("kinds")).first()
    learned, kinds = seen["learned"] or 0, seen["kinds"] or 0
    shared = spark.sparkContext.broadcast(build_tree(merged.select("words", "n").mapInArrow(_learned_words, "word binary, n long")))
    spread = merged.drop("learned", "kinds").repartition(pieces)  # files are read by size, scoring costs by row
    answers = [_stored(spread.mapInArrow(_score_words(shared, learned, kinds), STATE), "lm-figures")]
    dropped(merged)
    none = F.lit(0).alias("kind"), F.lit(0).alias("piece")
    state = chunks.select("chunk", *none, F.col("ids").alias("a"), F.col("held").alias("b"), F.col("h").alias("c"))
    for asked in range(words + 1 if words else 0):
        known = reduce(DataFrame.unionByName, answers, state).repartition(3 * pieces, "chunk").sortWithinPartitions("chunk")
        question = known.mapInArrow(_questions(words, asked, pieces, learned), STATE)
        answer = question.repartition(pieces, "piece").sortWithinPartitions("piece").mapInArrow(_summed, STATE)
        answers.append(_stored(answer, f"lm-answer-{asked}"))
    known = reduce(DataFrame.unionByName, answers, state).repartition(3 * pieces, "chunk").sortWithinPartitions("chunk")
    sums = _stored(known.mapInArrow(_sums(words), "chunk long, place int, b double, p double, k double"), "lm-sums")
    dropped(lines, *answers)
    base = math.log10(learned + 0.5 * (kinds + 1))
    return documents.join(sums, ["chunk", "place"]).select(
        F.col("key").alias(key), "held_out", "n_tokens", F.col("k").cast("long").alias("n_known"), F.lit(learned).cast("long").alias("train_tokens"),
        (F.col("b") - F.col("n_tokens") * F.lit(base)).alias("base_score"), F.col("p").alias("score"),
    )
