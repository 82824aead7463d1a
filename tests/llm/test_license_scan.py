import math
import re

import pytest
from oracle import connect, differences

from plumbline.llm.license_scan import CONTAINMENT, PHRASES, SQL, license_matches, license_scan, prepared, window_step

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def _common(template, run):
    """Length of the longest common subsequence, and the last place of the run that it first reaches it at."""
    best, last = [0] * (len(template) + 1), -1
    for p, word in enumerate(run):
        new = [0]
        for j, own in enumerate(template, 1):
            new.append(max(best[j], new[-1], best[j - 1] + 1 if own == word else 0))
        if new[-1] > best[-1]:
            last = p
        best = new
    return best[-1], last


def _matches(words):
    """{(template, end): (start, length)} of the runs that hold enough of a template in order and lose to no other."""
    found, templates = {}, prepared()
    for number, t in enumerate(templates):
        for i, word in enumerate(words):
            if word in t["starts"] and set(t["must"]) <= set(words[i : i + t["run"]]):
                top, last = _common(t["words"], words[i : i + t["run"]])
                if top >= CONTAINMENT * len(t["words"]) - 1e-9:
                    start, length = found.get((number, i + last), (i, top))
                    found[number, i + last] = max(start, i), max(length, top)
    for (number, end), (start, length) in found.items():
        own = templates[number]
        beaten = any(
            templates[o]["label"] != own["label"] and top == len(templates[o]["words"]) and s >= start and e <= end and not templates[o]["set"] <= own["set"]
            for (o, e), (s, top) in found.items()
        )
        if not beaten:
            yield own["label"], length / len(own["words"])


def _plain(text):
    text = text or ""
    words, starts, base, labels, best = _words(text), [], set(), set(), 0.0
    for phrase, label in PHRASES:
        ws = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(ws)] == ws]
        starts += at
        base |= {label} if at else set()
    for label, share in _matches(words):
        labels.add(label)
        best = max(best, share)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(base | labels), 1.0 if starts else best


CASES = [
    "MIT License mit license MIT LICENSE",
    "mit licenses, the MIT\nlicense: cc-by cc by by cc by",
    "apache license\n\nLicensed under the Apache License, Version 2.0",
    "gnu gnu general public license gnu general public license",
    "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "redistribute it, modify it under terms of the GNU General Public License as published by Free Software Foundation",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
    "Released under the CC0 1.0 Universal public domain dedication, see the end",
    "Kmit license MİT license été mit license",
    "\x00\x7f mit\x1flicense ~",
]


def test_against_a_plain_scan(spark, odd, documents, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in license_scan(df).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == pytest.approx(_plain(t)), t
    got = {r[0]: tuple(r)[1:] for r in license_scan(documents).collect()}
    assert got == {i: pytest.approx(_plain(t)) for i, t in texts.items()}
    rows = sorted(((r["doc_id"], *_plain(r["text"])) for r in odd.collect()), key=repr)
    assert sorted(map(tuple, license_scan(odd).collect()), key=repr) == rows


def test_empty(empty):
    assert license_scan(empty).collect() == []


def test_join_finds_every_match_whatever_the_order(spark):
    import random

    rng = random.Random(3)
    templates = [(f"t{i}", frozenset(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9)))) for i in range(25)]
    blocks = [(i, 0, sorted({f"w{min(30, int(rng.expovariate(0.1)))}" for _ in range(rng.randint(1, 15))})) for i in range(300)]
    for containment in (0.5, 0.8, 1.0):
        asked = [(label, words, max(1, math.ceil(containment * len(words) - 1e-9))) for label, words in templates]
        got = {(r["row"], r["label"]) for r in license_matches(spark.createDataFrame(blocks, "row long, block int, words array<string>"), asked).collect()}
        want = {(i, label) for i, _, ws in blocks for label, t in templates if len(t & set(ws)) >= containment * len(t) - 1e-9}
        assert got == want


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
APACHE = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
NOTICES = (("mit", MIT), ("bsd", BSD), ("gpl", GPL), ("apache-2", APACHE))


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = LGPL.replace("Lesser", "Affero")
PROSE = [
    "We walked under the bridge. The old press was released in 1990 by MIT. A fishing license was needed there.",
    "Under the public terms of the contract, the Mozilla foundation is subject to a license fee.",
    "files documentation associated and software this of copy a obtaining person any to charge of free granted hereby is permission",
]


def test_prose_with_the_words_of_a_notice_is_none(spark):
    rows = license_scan(spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")).collect()
    assert {(r["labels"], r["score"]) for r in rows} == {("", 0.0)}


def test_the_more_specific_notice_stands(spark):
    cases = [LGPL, AGPL, GPL, GPL + "\n\n" + LGPL, "# " + LGPL.replace("\n", "\n# dnl ")]
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == {0: "lgpl", 1: "agpl", 2: "gpl", 3: "gpl,lgpl", 4: "lgpl"}


def test_sql_with_notices(spark, tmp_path):
    filler = "some words of prose that are no notice " * 9
    cases = [n for _, n in NOTICES] + [LGPL, AGPL, *PROSE, *CASES, "", None]
    cases += [filler + n.replace("\n", "\n// ") + filler for n in (MIT, BSD, GPL, APACHE, LGPL)] + [GPL + LGPL + MIT]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(str(tmp_path / "none"))
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(license_scan(df), con, SQL) is None


def test_notices_are_found_however_they_are_wrapped(spark):
    filler, step = "some words of prose\nthat are no notice ", window_step()
    cases = []
    for label, notice in NOTICES:
        for mark in ("", "# ", " * ", "dnl ", "REM "):
            cases.append((label, "\n".join(mark + line for line in notice.split("\n"))))
        cases.append((label, "\r\n".join(notice.split())))  # one word a line
        for before in (1, step - 12, step - 1, step, 2 * step - 7, 5 * step - 20):  # over the edges of steps
            cases.append((label, "\n".join([" ".join((filler * before).split(" ")[:before]), notice, filler * 40])))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in license_scan(df).collect()}
    for i, (label, t) in enumerate(cases):
        assert got[i] == pytest.approx(_plain(t)), t
        assert label in got[i][5].split(",") and got[i][6] >= CONTAINMENT, t


def test_words_far_apart_are_no_notice(spark):
    spread = "\n".join(w + " x" * window_step() for w in sorted(set(_words(MIT))))
    rows = license_scan(spark.createDataFrame([(1, spread)], "doc_id long, text string")).collect()
    assert (rows[0]["labels"], rows[0]["score"]) == ("", 0.0)


def test_one_endless_word_after_a_notice(spark):
    text = MIT + "\n" + "z" * 2_000_000
    assert license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == "mit"
