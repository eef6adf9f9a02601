import re

from tests.llm.brute import awkward, by_id, fixture
from tessera.llm import license
from tessera.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [(r.label, r.priority, r.words, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in license.rules()]


def plain(text, gated=False):
    """Every rule on every text; gated: only rules whose keywords are among the words, which other tests show to be no loss."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, base = [], set()
    for phrase, label in license.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                at.append(i)
                base.add(label)
    s = f" {' '.join(words)} " if words else ""
    found, own = [], set(words)
    for k, (label, p, needed, rx) in enumerate(RULES):
        if not gated or own.issuperset(needed):
            found += [(m.start(), -m.end(), -p, k, label) for m in rx.finditer(s)]
    found.sort()
    kept = []
    for d in found:  # every kept one before it begins no later
        if not any(x[1] <= d[1] and x[2] <= d[2] for x in kept):
            kept.append(d)
    labels = base | {d[4] for d in kept}
    score = 1.0 if at else max((-d[2] for d in kept), default=0) / 4
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(kept)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")
MORE = [
    "Licensed under the Apache License, Version 2.0, and released under the MIT license. Also CC BY-NC 4.0! CC BY-NC-SA 3.0",
    "under the mit license under the mit license UNDER THE MIT LICENSE",
    "SPDX-License-Identifier: GPL-3.0-only. Copyright (c) 1999 all rights reserved",
    "This work is licensed under the GNU General Public License, version 3. public domain",
    "cc by nc " * 300,
    "under the mít license, underthe mit license; under\x00the\x7fmit{license",
    "\N{GRINNING FACE} " * 10 + "under the mit license, and \N{GRINNING FACE} released under the MIT \N{GRINNING FACE} licence",
    "mit license mit license license mit", "cc by nc cc by nc nd 4 0 cc by", "GPLv3, licensed under the GPLv2 or GPL v3; licensed under LGPL 2.1",
]


def test_rules_are_many():
    assert len(RULES) > 600 and len(license.NOTICES) + len(license.NAMES) + len(license.FORMS) > 180


def test_whole_table(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = by_id(license.scan_licenses(d))
    for r in d.collect():
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS) == plain(r["text"], True), r["doc_id"]


def test_whole_table_without_gates(spark, sf):
    d = table(spark, sf, "documents")
    got = by_id(license.scan_licenses(d))
    for r in d.collect():
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS) == plain(r["text"]), r["doc_id"]


def test_awkward_rows(spark):
    rows = awkward() + [(1000 + i, t, None, None, None) for i, t in enumerate(MORE)]
    got = by_id(license.scan_licenses(fixture(spark, rows)))
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in COLUMNS) == plain(t), t[:80]
    assert license.scan_licenses(fixture(spark, [])).count() == 0


def spellings(rx, most=1):
    """Strings of a rule's pattern, with the last digit of each range: all, or with most=0 those without any optional part."""

    def some(parsed):
        out = [""]
        for op, x in parsed:
            kind = str(op)
            if kind == "LITERAL":
                ways = [chr(x)]
            elif kind == "NOT_LITERAL":
                ways = ["x"]
            elif kind == "IN":
                ways = [chr(v if str(k) == "LITERAL" else v[1]) for k, v in x]
            elif kind == "SUBPATTERN":
                ways = some(x[-1])
            elif kind == "BRANCH":
                ways = [w for way in x[1] for w in some(way)]
            elif kind == "MAX_REPEAT":
                ways = [w * n for n in {x[0], max(x[0], min(x[1], 2) * most)} for w in some(x[2])]
            else:
                raise ValueError(kind)
            out = [a + w for a in out for w in ways]
        return out

    return some(re._parser.parse(rx))


UNGATED = {
    "Released under the MIT": "mit",
    "Distributed under BSD-3-Clause": "bsd-3-clause",
    "available under Apache 2.0": "apache-2",
    "provided under MPL 2.0": "mpl-2",
    "published under ISC": "isc",
    "governed by ISC": "isc",
    "subject to zlib": "zlib",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
}


def test_texts_without_the_word_license(spark):
    got = by_id(license.scan_licenses(fixture(spark, [(i, t, None, None, None) for i, t in enumerate(UNGATED)])))
    for i, (t, label) in enumerate(UNGATED.items()):
        assert (got[i]["labels"], got[i]["n_detections"]) == (label, 1), t


def test_every_spelling_holds_its_keywords():
    parts = [(word, rx) for _, word, rx in license.NAMES] + [(word, rx.replace("{}", "name")) for _, word, rx in license.FORMS] + [(word, rx) for _, _, word, rx in license.NOTICES]
    for words, rx in parts:
        for most in (0, 1):
            assert all(set(words.split()) <= set(x.split()) for x in spellings(rx, most)), (words, rx)


def test_a_spelling_of_every_notice_is_found(spark):
    rows = [(i, f"x {spellings(rx, 0)[0]}. y", None, None, None) for i, (_, _, _, rx) in enumerate(license.NOTICES)]
    got = by_id(license.scan_licenses(fixture(spark, rows)))
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in COLUMNS) == plain(t) and license.NOTICES[i][0] in got[i]["labels"].split(","), t


def test_spellings_of_a_name(spark):
    want = {
        "Licensed under Creative Commons Attribution-Non-Commercial 4.0": "cc-by-nc",
        "Licensed under Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
        "Licensed under the PSF license": "python-2",
        "Licensed under the Python Software Foundation License Version 2": "python-2",
    }
    got = by_id(license.scan_licenses(fixture(spark, [(i, t, None, None, None) for i, t in enumerate(want)])))
    for i, (t, label) in enumerate(want.items()):
        assert (got[i]["labels"], got[i]["n_detections"], got[i]["score"]) == (label, 1, 1.0), t
