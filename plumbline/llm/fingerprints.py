"""Document fingerprints by SpotSigs.

A spot signature is a chain: an anchor (a common word) and the CHAIN content words that follow it, common
words between them left out. A document's fingerprint is the set of its signatures, each a
64-bit hash in hex, sorted and joined by spaces.

*Matching.* Sets are partitioned by length so that a partition spans one factor of the threshold: a
set can only match in its own partition and the next. Rare signatures come first in a set;
sets that reach the threshold share one of the first |S| - ceil(threshold * |S|) + 1, which is where
they meet. Equal sets are one class with one representative. A class first meets the two ends of each bin (signature and partition), which
are as many pairs as entries; links make components. Bins that hold more than one of them do the same with classes drawn by hash, in a few rounds as long as more pairs than entries are left, and
what is then left pairs classes of different components only, so the links within a group of near copies are never listed. Lengths, places in the order and 128 bits of each set bound Jaccard before
sets are compared in whole. class_id is the smallest key that links reach.

*Edited texts.* The half of a text is replaced by the start of the next document in descending order of
keys. Keys are cut into ranges by approximate quantiles, so each task has its range, and the first
document of each range is also sent to the range before it. No task has all keys.

Defined cases: null text is empty; a text without words has an empty set, two empty sets are
alike (1.0) and one class; a text without a chain has one signature, of all its words; null keys come last;
rows that share a key follow each other in the order of their texts; a table of one row has
itself as the next; class_id is null where a class has null keys only; other columns are not looked at. Keys are numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.skew import range_index
from ..session import shuffle_partitions
from .common import dropped, quoted, stored, whole
from .ngram_join import components

CHAIN = 2
ROUNDS, REPRESENTATIVES = 3, 4  # of classes drawn in each bin before the others are paired, where many pairs are left
MEMBER = ("id", "n", "place", "part", "low", "high", "label")
THRESHOLD = 0.8
#: Common words of the languages in question.
ANCHORS = (
    "a", "an", "and", "are", "is", "of", "that", "the", "to", "was",
    "das", "der", "die", "ein", "ist", "nicht", "und", "zu",
    "de", "des", "est", "et", "la", "le", "les", "que",
    "con", "el", "en", "los", "por", "un", "una", "y",
)


def joined_words(text: Column) -> Column:
    """' w1 w2 ... ', or a single space without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return _let(words, lambda w: F.when(w == "", " ").otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """The set of spot signatures, sorted hashes.

    Words are cut into parts before each content word: a part is a content word and the common
    words behind it (the first part has only common words), so the content words that follow an
    anchor are the first words of the next parts.
    """

    def first(part: Column) -> Column:
        return F.substring_index(part, " ", 1)

    def chains(part: Column) -> Column:
        common = F.filter(F.slice(F.split(part["0"], " "), 2, 1 << 30), lambda w: w != "")
        nexts = [first(part[str(i + 1)]) for i in range(chain)]
        none = F.array().cast("array<bigint>")
        return F.when(part[str(chain)].isNull(), none).otherwise(F.transform(common, lambda w: F.xxhash64(F.concat_ws(" ", w, *nexts))))

    def of_words(words: Column) -> Column:
        cut = F.regexp_replace(words, rf" (?!(?:{'|'.join(anchors)}) )(?=[^ ])", "\n")
        zipped = _let(F.split(cut, "\n"), lambda parts: F.arrays_zip(*[F.slice(parts, i + 1, 1 << 30) for i in range(chain + 1)]))
        found = F.flatten(F.transform(zipped, chains))
        alone = F.when(words == " ", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
        return _let(found, lambda hashes: F.when(F.size(hashes) > 0, hashes).otherwise(alone))

    return F.array_sort(F.array_distinct(_let(joined_words(text), of_words)))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda h: F.lpad(F.hex(h), 16, "0")), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; where the shorter is empty the bound by lengths already says 0."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(most == 0, 1.0).when(least == 0, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _bits(sigs: Column) -> list[Column]:
    """The set as 128 bits, in two numbers: each signature sets the bit that its last seven bits name."""

    def half(high: int) -> Column:
        bit = lambda h: F.when(h.bitwiseAND(64) == high, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).otherwise(0)
        return F.aggregate(F.transform(sigs, bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return [half(0).alias("low"), half(64).alias("high")]


def _shared(x: str, y: str) -> Column:
    """At most so many signatures of the set whose columns begin with `x` are in that of `y`: the others set a bit that y's do not."""
    alone = [F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}{c}")))) for c in ("low", "high")]
    return F.col(f"{x}n") - alone[0] - alone[1]


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """u, v, u_label, v_label: of pairs of different classes those whose Jaccard reaches the threshold."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("sigs").alias(f"{name}_sigs"))

    compared = pairs.join(side("u"), "u").join(side("v"), "v")
    return stored(compared.where(jaccard(F.col("u_sigs"), F.col("v_sigs")) >= threshold).select("u", "v", "u_label", "v_label"), "spots-links")


def _probes(classes: DataFrame, threshold: float) -> DataFrame:
    """id, n, sig, place, part: the signatures of each prefix that some other class has, and their places from the rarest."""
    counts = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a signature of one class joins nothing: it only counts as one of the places before
    spots = classes.select("id", "n", F.explode("sigs").alias("sig")).join(counts, "sig")
    one = W.partitionBy("id")
    place = F.row_number().over(one.orderBy("df", "sig")) + F.col("n") - F.count(F.lit(1)).over(one)
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    width = -math.log(threshold) if threshold < 1 else 1.0
    part = F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("int")
    placed = spots.withColumn("place", place).where(F.col("place") <= prefix)
    return placed.select("id", "n", "sig", F.col("place").cast("int").alias("place"), part.alias("part"))


def _linked(classes: DataFrame, threshold: float) -> list[DataFrame]:
    """Tables of node, label: which label each takes, to be followed one after the other from a class's own id. A class that
    links reach ends at the smallest id of its component; one that is in none of them is linked with no other."""
    parts = F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("bin")
    bins = stored(_probes(classes, threshold).select("*", parts, F.col("id").alias("label")), "spots-bins")
    left = stored(_mixed(bins).join(classes.select("id", "low", "high"), "id"), "spots-mixed")
    # whatever is paired comes from these entries, so only their sets are fetched
    sets = stored(classes.select("id", "sigs").join(left.select("id").distinct(), "id", "left_semi"), "spots-sets")
    # first each class meets the smallest and the largest of a bin: a group of near copies is held together by them
    ends = left.groupBy("sig", "bin").agg(F.min(F.struct(*MEMBER)).alias("first"), F.max(F.struct(*MEMBER)).alias("last"))
    star = stored(_met(left.alias("a"), _drawn(ends), threshold, F.col("a.id") != F.col("b.id")), "spots-star")
    merged = [_merged(_verified(star, sets, threshold))]
    left = _relabelled(left, merged[-1])
    # groups that the ends did not hold together meet a few others of each bin, drawn anew each round: as many pairs as entries
    for round_ in range(ROUNDS):
        todo = left.agg(F.sum("share").alias("pairs"), F.count(F.lit(1)).alias("entries")).first()
        if (todo["pairs"] or 0) <= todo["entries"]:
            break  # less than a round would make
        drawn = left.groupBy("sig", "bin").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(REPRESENTATIVES * round_ + i)).alias("h"), *MEMBER)).alias(f"r{i}") for i in range(REPRESENTATIVES)])
        found = _verified(_met(left.alias("a"), _drawn(drawn), threshold, F.col("a.label") != F.col("b.label")), sets, threshold)
        if found.isEmpty():
            break
        merged.append(_merged(found))
        left = _relabelled(left, merged[-1])
    apart = (F.col("a.label") < F.col("b.label")) & (F.col("a.bin") == F.greatest("a.part", "b.part"))
    pairs = stored(_met(left.alias("a"), left.alias("b"), threshold, apart), "spots-pairs")
    merged.append(_merged(_verified(pairs, sets, threshold)))
    dropped(bins, left, sets, star, pairs)
    return merged


def _merged(links: DataFrame) -> DataFrame:
    """node, label: the smallest label that links of labels reach."""
    return components(links.select(F.col("u_label").alias("u"), F.col("v_label").alias("v")))


def _drawn(bins: DataFrame) -> DataFrame:
    """The different members that the columns beside sig and bin hold, as side b of `_met`."""
    held = [F.struct(*[f"{name}.{c}" for c in MEMBER]) for name in bins.columns if name not in ("sig", "bin")]
    return bins.select("sig", "bin", F.explode(F.array_distinct(F.array(*held))).alias("b")).select("sig", "bin", "b.*").alias("b")


def _mixed(labelled: DataFrame) -> DataFrame:
    """The entries of bins that hold more than one component, with their shares in the pairs of different components there."""
    parts = labelled.groupBy("sig", "bin", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    mixed = parts.groupBy("sig", "bin").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    share = ((F.col("all") * F.col("all") - F.col("same")) / 2 / F.col("all")).alias("share")
    return labelled.join(mixed.select("sig", "bin", share), ["sig", "bin"])


def _relabelled(left: DataFrame, merged: DataFrame) -> DataFrame:
    """The entries under their new labels, without the bins that hold one component: those have nothing left to link."""
    new = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    labelled = left.drop("share").join(new, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    labelled = stored(labelled, "spots-labelled")
    out = stored(_mixed(labelled), "spots-mixed")
    dropped(labelled, left)
    return out


def _met(a: DataFrame, b: DataFrame, threshold: float, apart: Column) -> DataFrame:
    """u, v, u_label, v_label: pairs of entries a and b of one bin that are `apart` and that lengths, places and bits leave a chance."""
    need = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    together = F.least(F.col("a.place"), F.col("b.place")) + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    bounds = (
        apart & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9)
        & (together >= need) & (F.least(_shared("a.", "b."), _shared("b.", "a.")) >= need)
    )
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.bin") == F.col("b.bin")) & bounds)
    least, most = F.col("a.id") < F.col("b.id"), F.col("a.id") > F.col("b.id")
    named = [F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(name) for first, c, name in ((least, "id", "u"), (most, "id", "v"), (least, "label", "u_label"), (most, "label", "v_label"))]
    return pairs.select(*named).distinct()


def signed_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tie (the text's SHA-1), sigs; stored, as signatures are dear and read more than once."""
    rows = df.select(quoted(key).alias("key"), F.sha1(whole(text)).alias("tie"), signatures(whole(text)).alias("sigs"))
    return stored(rows, "spots-signed")


def spot_classes(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of signed_rows: key, tie, class_id, a row per different key and text: the smallest key among the documents that links
    reach. Documents link when their sets are equal, or not empty and of a Jaccard of `threshold` or more."""
    rows = signed.withColumn("set", F.unhex(F.md5(fingerprint(F.col("sigs")))))
    members = rows.select("key", "tie", "set").distinct()
    sets = rows.where(F.size("sigs") > 0).groupBy("set").agg(F.first("sigs").alias("sigs"))
    numbered = sets.select(F.monotonically_increasing_id().alias("id"), "set", "sigs", F.size("sigs").alias("n"), *_bits(F.col("sigs")))
    classes = stored(numbered, "spots-classes")
    known = classes.select("set", F.col("id").alias("label"))
    for merged in _linked(classes, threshold):
        new = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
        known = known.join(new, "label", "left").select("set", F.coalesce("new", "label").alias("label"))
    least = members.groupBy("set").agg(F.min("key").alias("least")).join(known, "set", "left").withColumn("label", F.coalesce("label", F.lit(-1)))  # -1: the empty set
    least = stored(least, "spots-least")
    dropped(classes)
    named = least.groupBy("label").agg(F.min("least").alias("class_id")).join(least, "label").select("set", "class_id")
    return members.join(named, "set").select("key", "tie", "class_id")


def with_next(rows: DataFrame, signed: DataFrame, named: DataFrame) -> DataFrame:
    """rows (key, text, tie) with class_id, sigs, and next_text, next_sigs of the next row in descending order of `key`, then `tie`; after
    the last, the first. `signed` and `named` have the sigs and the class_id of every key and tie; their rows travel without a text and stand before
    the rows they tell of, so no row with a text is shuffled twice.
    """
    spark = rows.sparkSession
    steps = (4 * shuffle_partitions(spark) - 1).bit_length()
    cuts = rows.agg(F.percentile_approx("key", [i / 2**steps for i in range(1, 2**steps)], 8 * 2**steps)).first()[0]
    last = F.lit(-1)  # null keys
    at = range_index(F.col("key"), F.lit(cuts), steps) if cuts else F.lit(0)
    in_range = F.when(F.col("key").isNull(), last).otherwise(at)
    no_text, no_class, no_sigs = (F.lit(None).cast(t) for t in ("string", rows.schema["key"].dataType, "array<bigint>"))
    told = signed.select("key", "tie", no_class.alias("class_id"), "sigs").unionByName(named.select("key", "tie", "class_id", no_sigs.alias("sigs")))
    told = told.select("*", no_text.alias("text"), F.lit(0).alias("row"))
    ranged = rows.select("*", no_class.alias("class_id"), no_sigs.alias("sigs"), F.lit(1).alias("row")).unionByName(told).withColumn("range", in_range)
    tops = {r["range"]: r["top"] for r in rows.select("key", in_range.alias("range")).groupBy("range").agg(F.max("key").alias("top")).collect()}  # at most 4 ranges a partition
    if not tops:
        none = rows.withColumn("class_id", F.col("key")).withColumn("sigs", signatures(F.col("text")))
        return none.select("*", F.col("text").alias("next_text"), F.col("sigs").alias("next_sigs"))
    order = sorted(tops, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's top also ends the last range
    # arrays by range number, from -1
    size = max(order) + 2
    top = F.array(*[F.lit(tops.get(i - 1)).cast(rows.schema["key"].dataType) for i in range(size)])
    goes = F.array(*[F.lit(before.get(i - 1)).cast("int") for i in range(size)])
    slot = F.col("range") + 1
    first = F.col("key").eqNullSafe(F.get(top, slot))
    own = F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("ghost"))
    sent = F.struct(F.get(goes, slot).alias("range"), F.lit(True).alias("ghost"))
    dealt = ranged.withColumn("at", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own)))).drop("range")
    dealt = dealt.select("*", "at.*").drop("at")
    # a ghost follows all rows of the range; of ghosts that share the key the first counts
    order = ["ghost", F.col("key").desc_nulls_last(), "tie"]
    line = W.partitionBy("range").orderBy(*order, "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    name = F.last(F.when(F.col("sigs").isNull() & (F.col("row") == 0), F.struct("class_id")), ignorenulls=True).over(line)
    latest = dealt.select(*rows.columns, "range", "ghost", "row", name["class_id"].alias("class_id"), F.last("sigs", ignorenulls=True).over(line).alias("sigs"))
    following = [F.lead(c).over(W.partitionBy("range").orderBy(*order)).alias(f"next_{c}") for c in ("text", "sigs")]
    return latest.where("row = 1").select(*rows.columns, "class_id", "sigs", "ghost", *following).where(~F.col("ghost")).drop("ghost")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id."""
    rows = df.select(quoted(key).alias("key"), whole(text).alias("text")).withColumn("tie", F.sha1("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    signed = signed_rows(df, key, text)
    pairs = with_next(rows, signed, spot_classes(signed))
    edited = pairs.select(
        "key", "class_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    compared = edited.select("key", "class_id", "n_chars", "sigs", "next_sigs", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return compared.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"), "class_id",
    )
