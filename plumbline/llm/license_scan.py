"""License scans: phrases at their places, and an exact set-similarity join of blocks and templates.

A template is a notice's sequence of words. It matches a run of at most STRETCH times as many consecutive words of the text that holds
CONTAINMENT of its words in its order, wherever the lines break, among them those few words, if any, without which it would be a part of another
label's template. The set-similarity join finds where that can be: blocks are windows of the words, two
steps long and starting at every step, a step being as long as the longest run, so every run lies in one; only words
of templates can matter, so a block is reduced to the set of those:

* *global order*: the template words, ordered by the number of blocks of the whole table that hold them,
  rarest first;
* *prefix filter*: a run that matches lacks few of the template's words, so its block shares a word
  with the first ones in this order, and only these are indexed;
* *length filter*: the reduced block has at least `need` words;
* *positional filter*: at a shared word in places i and j, at most 1 + min of what follows in
  both can still be shared, besides what may come before;
* what passes is verified on the whole sets, and then word by word: the longest common subsequence of the template and each run
  that begins with one of its first words.

A match loses to one of another label that lies whole within its run and has a word that the loser's template lacks: the notice
of the lesser license holds all words of the general one, and one more.

Templates are a parameter of bounded size (MAX_TEMPLATE_WORDS), so their index is broadcast; blocks
meet it without being shuffled, whichever word or source is frequent. Only texts with a candidate block are read
again, found by a filter of fixed size (BLOOM_BITS).

Defined cases: null text is empty; without words nothing is found (labels are empty strings, first
and last are null, score 0); repeated rows are rows of their own; other columns are not looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, quoted, stored, whole

CONTAINMENT = 0.9
STRETCH = 1.5  # words of a run by word of the template
BLOOM_BITS = 20  # of the filter of texts to read again
MAX_TEMPLATE_WORDS = 10_000
# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Words of notices, by label.
TEMPLATES = (
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "released under the cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(padded: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase stands in ' w0 w1 ... ', and its smallest and largest start."""
    k = len(phrase.split())
    has = F.contains(padded, F.lit(f" {phrase} "))
    parts = F.split(padded, f"(?<= ){re.escape(phrase)}(?= )")
    first = _spaces(F.get(parts, F.lit(0))) - 1
    last = n_words + 1 - _spaces(F.element_at(parts, -1)) - k
    return F.when(has, F.size(parts) - 1).otherwise(0).cast("long"), F.when(has, first), F.when(has, last)


def prepared(templates=TEMPLATES, containment: float = CONTAINMENT) -> list[dict]:
    """Of each template its label, words, the `need` of them in order, the set of words and how many of these a run must hold, the longest
    run, the words a match can begin with, the words that it must have, and which other templates it beats where both match."""
    if sum(len(text.split()) for _, text in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    made = []
    for label, text in templates:
        words = text.split()
        need = max(1, math.ceil(containment * len(words) - 1e-9))
        different = frozenset(words)
        least = max(1, len(different) - (len(words) - need))
        made.append({"label": label, "words": words, "need": need, "set": different, "least": least, "run": math.ceil(STRETCH * len(words)), "starts": sorted(set(words[: len(words) - need + 1]))})
    for t in made:
        apart = [t["set"] - o["set"] for o in made if o["label"] != t["label"]]
        t["must"] = sorted(set().union(*[words for words in apart if len(words) <= len(t["words"]) - t["need"]]))
        t["beats"] = [i for i, o in enumerate(made) if o["label"] != t["label"] and not t["set"] <= o["set"]]
    return made


def window_step(templates=TEMPLATES) -> int:
    """Words from the start of a window to that of the next; a window is twice as long."""
    return max(t["run"] for t in prepared(templates))


def license_matches(blocks: DataFrame, templates: list[tuple[str, frozenset, int]]) -> DataFrame:
    """Blocks (row, block, words: distinct template words) and templates (label, set of words, how many are needed) -> row, block, template, label
    and share (of the template's words in the block) of every match."""
    spark = blocks.sparkSession
    counted = blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["w"]: r["n"] for r in counted.collect()}  # at most the template words
    vocabulary = sorted(set().union(*[words for _, words, _ in templates]), key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(vocabulary)}
    index, kinds = [], []
    for number, (label, words, need) in enumerate(templates):
        ordered = sorted(place[w] for w in words)
        kinds.append((number, label, need, ordered))
        index += [(w, number, i, len(ordered), need) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "word int, template int, i int, t_size int, need int"))
    whole_templates = F.broadcast(spark.createDataFrame(kinds, "template int, label string, need int, t_words array<int>"))
    least = min(need for _, _, need, _ in kinds)
    order = F.create_map(*[x for w, i in place.items() for x in (F.lit(w), F.lit(i))])
    ordered = blocks.where(F.size("words") >= least).select("row", "block", F.array_sort(F.transform("words", lambda w: order[w])).alias("words"))
    probes = ordered.select("row", "block", "words", F.posexplode("words").alias("j", "word"))
    left = F.least(F.col("t_size") - F.col("i"), F.size("words") - F.col("j"))  # this word and what follows
    before = F.least("i", "j")
    candidates = (
        probes.join(prefixes, "word")
        .where(F.size("words") >= F.col("need"))
        .where(left + before >= F.col("need"))
        .select("row", "block", "words", "template")
        .distinct()
    )
    shared = F.size(F.array_intersect("words", "t_words"))
    met = candidates.join(whole_templates, "template").where(shared >= F.col("need"))
    return met.select("row", "block", "template", "label", (shared / F.size("t_words")).alias("share"))


def _alignments(templates: list[dict], vocabulary: list[str], spark) -> DataFrame:
    """What verifying a template takes, in places (from 1) of the vocabulary. `before` has for each word of the vocabulary and each length j of
    the template's beginning the last place up to j where the word stands, 0 if there is none."""
    rows = []
    for number, t in enumerate(templates):
        before = [[max((i for i in range(1, j + 1) if t["words"][i - 1] == w), default=0) for j in range(len(t["words"]) + 1)] for w in vocabulary]
        rows.append((number, t["need"], len(t["words"]), t["run"], [vocabulary.index(w) + 1 for w in t["starts"]], [vocabulary.index(w) + 1 for w in t["must"]], before, t["beats"]))
    return F.broadcast(spark.createDataFrame(rows, "template int, need int, size int, run int, starts array<int>, must array<int>, before array<array<int>>, beats array<int>"))


def verified(windows: DataFrame, templates: list[dict]) -> DataFrame:
    """Windows (row, first: their first word's place, words, template) -> row, template, label, start, end and containment of the matches in
    order that lose to no other."""
    spark = windows.sparkSession
    vocabulary = sorted(set().union(*[t["set"] for t in templates]))
    known = F.array(*[F.lit(w) for w in vocabulary])
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("int").alias("p"), F.array_position(known, w).cast("int").alias("w"))), lambda s: s["w"] > 0)
    rows = windows.withColumn("spots", spots).join(_alignments(templates, vocabulary, spark), "template")
    kind = "struct<best:array<int>,top:int,end:int>"
    start = F.struct(F.array_repeat(F.lit(0), F.col("size") + 1).alias("best"), F.lit(0).alias("top"), F.lit(-1).alias("end")).cast(kind)

    def longer(state: Column, spot: Column) -> Column:
        """The common subsequence's length with each beginning of the template, one word further."""
        best = F.zip_with(state["best"], F.element_at("before", spot["w"]), lambda b, at: F.when(at > 0, F.greatest(b, F.element_at(state["best"], at) + 1)).otherwise(b))
        top = F.element_at(best, -1)
        return F.struct(best.alias("best"), top.alias("top"), F.when(top > state["top"], spot["p"]).otherwise(state["end"]).alias("end")).cast(kind)

    def run_from(anchor: Column) -> Column:
        run = F.filter("spots", lambda s: (s["p"] >= anchor["p"]) & (s["p"] < anchor["p"] + F.col("run")))
        lacks = F.size(F.array_except("must", F.transform(run, lambda s: s["w"])))
        return F.aggregate(run, start, longer, lambda state: F.struct(anchor["p"].alias("start"), F.when(lacks == 0, state["top"]).otherwise(0).alias("top"), state["end"].alias("end")))

    anchors = F.filter("spots", lambda s: F.array_contains("starts", s["w"]))
    runs = F.filter(F.transform(anchors, run_from), lambda m: m["top"] >= F.col("need"))
    found = rows.select("row", "template", "first", "size", "beats", F.explode(runs).alias("m"))
    # the tightest run for each end; windows overlap
    found = found.groupBy("row", "template", (F.col("first") + F.col("m.end")).alias("end")).agg(
        F.max(F.col("first") + F.col("m.start")).alias("start"), F.max("m.top").alias("top"), F.first("size").alias("size"), F.first("beats").alias("beats")
    )
    found = stored(found, "license-found")
    step = max(t["run"] for t in templates)
    place = F.floor(F.col("start") / step)
    strong = found.where("top = size").select(F.col("row").alias("s_row"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.explode("beats").alias("s_beaten"), place.alias("s_place"))
    weak = found.withColumn("place", F.explode(F.array(place, place + 1)))
    lies = (F.col("row") == F.col("s_row")) & (F.col("template") == F.col("s_beaten")) & (F.col("place") == F.col("s_place")) & (F.col("s_start") >= F.col("start")) & (F.col("s_end") <= F.col("end"))
    lost = weak.join(strong, lies, "left_semi").select("row", "template", "end").distinct()
    stays = found.join(lost, ["row", "template", "end"], "left_anti")
    label = F.element_at(F.array(*[F.lit(t["label"]) for t in templates]), F.col("template") + 1)
    return stays.select("row", "template", label.alias("label"), "start", "end", (F.col("top") / F.col("size")).alias("containment"))


def _read_again(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of `rows` (row, ...) whose row is probably in `wanted`, by 2**BLOOM_BITS bits."""
    place = F.pmod("row", F.lit(1 << BLOOM_BITS))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits"))
    bits = [0] * (1 << (BLOOM_BITS - 5))
    for r in words.toLocalIterator():  # at most 2**(BLOOM_BITS - 5) rows
        bits[r["at"]] = r["bits"]
    table = F.broadcast(rows.sparkSession.createDataFrame([(bits,)], "bits array<bigint>"))
    word = F.element_at("bits", (F.shiftright(place, 5) + 1).cast("int"))
    marked = rows.withColumn("one", F.lit(1)).join(table.withColumn("one", F.lit(1)), "one")
    return marked.where(F.call_function("shiftright", word, (place % 32).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("one", "bits")


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    wanted, step = prepared(templates, containment), window_step(templates)
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*[t["set"] for t in wanted]))])
    joined = F.trim(F.regexp_replace(ascii_lower(whole(text)), _SEPARATORS, " "))
    source = df.select(quoted(key).alias("key"), F.xxhash64(quoted(key), whole(text)).alias("row"), joined.alias("joined"))
    padded = source.select(
        "key", "row", F.concat(F.lit(" "), "joined", F.lit(" ")).alias("padded"),
        F.when(F.col("joined") == "", 0).otherwise(_spaces(F.col("joined")) + 1).cast("long").alias("n_words"),
    )
    places = [(*_places(F.col("padded"), F.col("n_words"), phrase), label) for phrase, label in PHRASES]
    # every step of words as a line of its own; a pattern that matches wherever it is tried reads the text once
    steps = F.regexp_replace(F.ltrim("padded"), f"(?:[^ ]++ ){{1,{step}}}", "$0\n")
    step_words = F.transform(F.split(steps, "\n"), lambda part: F.array_intersect(F.split(part, " "), vocabulary))
    cut = padded.select("key", "row", "padded", "n_words", step_words.alias("step_words"))
    none, least = F.array().cast("array<string>"), min(t["least"] for t in wanted)
    windows = F.zip_with("step_words", F.slice("step_words", F.lit(2), F.size("step_words")), lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    rows = stored(
        cut.select(
            "row", "key", "n_words",
            sum(n for n, _, _, _ in places).alias("n_base"),
            F.least(*[first for _, first, _, _ in places]).alias("first_word"),
            F.greatest(*[last for _, _, last, _ in places]).alias("last_word"),
            F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, _, _, label in places]))).alias("base"),
            F.filter(F.transform(windows, lambda w, i: F.struct(i.cast("int").alias("block"), w.alias("words"))), lambda b: F.size(b["words"]) >= least).alias("blocks"),
        ),
        "license-rows",
    )
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    candidates = license_matches(blocks, [(t["label"], t["set"], t["least"]) for t in wanted]).select("row", "block", "template").distinct()
    candidates = stored(candidates, "license-candidates")
    texts = _read_again(source.select("row", "joined"), candidates.select("row").distinct()).join(candidates, "row")
    first = F.col("block") * step
    window = F.slice(F.split("joined", " "), first + 1, F.lit(2 * step))
    found = verified(texts.select("row", first.alias("first"), window.alias("words"), "template"), wanted)
    found = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    joined = rows.drop("blocks").join(found, "row", "left")
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """DuckDB, run by run and template by template."""
    made = prepared()
    kinds = ", ".join(f"({i}, '{t['label']}', {t['words']!r}, {t['need']}, {sorted(t['set'])!r}, {t['least']}, {t['run']}, {t['starts']!r}, {t['must']!r}::varchar[], {t['beats']!r}::int[])" for i, t in enumerate(made))
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES)
    return f"""
    with recursive w as (
      select row_number() over () as r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}', ' ', 'g'), ' '), lambda x: x <> '') as words from documents),
    phrase(label, ws) as (values {phrases}),
    hit as (select r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(ws)] = ws)) as pos from w, phrase),
    base as (select r, count(*) as n, min(pos) as first_word, max(pos) as last_word, list_sort(list_distinct(list(label))) as labels from hit group by r),
    template(template, label, ws, need, different, least, run, starts, must, beats) as (values {kinds}),
    anchor as (select r, template, unnest(list_filter(range(1, len(words) + 1), lambda i: list_contains(starts, words[i]))) as i from w, template),
    start as (
      select r, t.template, ws, need, i, w.words[i : i + run - 1] as run from anchor join template t using (template) join w using (r)
      where len(list_intersect(w.words[i : i + run - 1], different)) >= least and list_has_all(w.words[i : i + run - 1], must)),
    common as (
      select r, template, ws, need, i, run, 0 as k, list_transform(range(len(ws) + 1), lambda x: 0) as best, 0 as last from start
      union all
      select r, template, ws, need, i, run, k, new, case when new[-1] > best[-1] then i + k - 1 else last end from (
        select r, template, ws, need, i, run, k + 1 as k, best, last, list_transform(range(len(ws) + 1), lambda j: greatest(best[j + 1],
               coalesce(best[list_max(list_filter(range(1, j + 1), lambda x: ws[x] = run[k + 1]))] + 1, 0))) as new
        from common where k < len(run))),
    match as (select r, template, last, max(i) as i, max(best[-1]) as top, len(any_value(ws)) as size from common
              where k = len(run) and best[-1] >= need group by r, template, last),
    found as (
      select m.r, list_distinct(list(label)) as labels, max(top / size) as best from match m join template t using (template)
      where not exists (select 1 from match s join template u on u.template = s.template where s.r = m.r and s.top = s.size and s.i >= m.i
                        and s.last <= m.last and list_contains(u.beats, m.template)) group by m.r)
    select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
           coalesce(array_to_string(base.labels, ','), '') as base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') as labels,
           case when n > 0 then 1.0::double else coalesce(best, 0)::double end as score
    from w left join base using (r) left join found using (r)
    """


SQL = _sql()
