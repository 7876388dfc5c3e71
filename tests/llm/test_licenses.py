import random
import re

from fixtures import AWKWARD, documents, empty
from tessera.llm import licenses

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hit = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels), " " + "".join(w + " " for w in words)


def spans(form):
    found = {(m.start() + 1, m.end(), p, label) for key, of in licenses.families().items() if key in form for label, p, x in of for m in re.finditer(x, form)}
    keep = []
    for s in found:
        rivals = [o for o in found if o != s and o[0] <= s[0] and o[1] >= s[1] and o[2] <= s[2]]
        same = [o for o in rivals if o[:3] == s[:3]]
        if not [o for o in rivals if o[:3] != s[:3]] and not any(o[3] < s[3] for o in same):
            keep.append(s)
    return sorted(keep)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. All Rights Reserved, all rights reserved",
    "This work is licensed under the GNU General Public License, version 3. CC-BY-NC 4.0 cc by",
    "Copyright (c) 2021 me. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ccc by cc by cc byx cc by cc by",
    "SPDX-License-Identifier: GPL-2.0-or-later; dual licensed under the BSD 3-Clause License",
    "http://creativecommons.org/licenses/by-sa/4.0/ and the Mozilla Public License v2",
    "cc by " * 300,
    "nothing of the kind é",
]


def test_licenses_against_plain_search(spark):
    rng = random.Random(2)
    bits = [*TEXTS[:7], "cc", "by", "all rights", "reserved", "general public license", "license", "É", "apache license", "\n", "—"]
    texts = AWKWARD + TEXTS + [rng.choice([" ", "\n", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(150)]
    got = {r.doc_id: r for r in licenses.license_detections(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        *base, form = brute(t)
        r = got[k]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] == base, t
        want = spans(form)
        assert [tuple(d) for d in r.detections] == want, t
        assert r.labels == sorted(set(r.base_labels) | {d[3] for d in want})
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.license_detections(empty(spark)).count() == 0


def samples(pattern):
    """Texts that a pattern matches: ways through its alternatives, at the least repeats and with what is optional."""
    import itertools
    import re._constants as sre
    import re._parser as parser

    def ways(items, most):
        out = [""]
        for op, arg in items:
            if op is sre.LITERAL:
                part = [chr(arg)]
            elif op is sre.IN:
                part = [chr(arg[0][1] if arg[0][0] is sre.LITERAL else arg[0][1][0])]
            elif op is sre.ANY:
                part = ["x"]
            elif op is sre.SUBPATTERN:
                part = ways(arg[3], most)
            elif op is sre.BRANCH:
                part = list(itertools.chain(*(ways(x, most) for x in arg[1])))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                n = max(arg[0], min(arg[1], 1) if most else 0)
                part = ["".join(x) for x in itertools.product(ways(arg[2], most), repeat=n)]
            else:
                assert op is sre.ASSERT, op
                part = [" "]
            out = [x + y for x in out for y in part][:200]
        return out

    return ways(parser.parse(pattern), False) + ways(parser.parse(pattern), True)


def test_rules_are_many_and_every_match_holds_its_keyword():
    assert len(licenses.NOTICES) + len(licenses.NAMES) >= 270
    for key, of in licenses.families().items():
        for _, _, x in of:
            for text in samples(x):
                assert re.match(x, text) and key in text, (key, text)


def test_every_notice_is_found(spark):
    texts = [(label, samples(f" {x}(?= )")[0]) for label, _, _, x in licenses.NOTICES]
    got = {r.doc_id: r for r in licenses.license_detections(documents(spark, [f"So: {t}. And" for _, t in texts])).collect()}
    for k, (_, text) in enumerate(texts):
        want = spans(brute(f"So: {text}. And")[-1])
        assert [tuple(d) for d in got[k].detections] == want and want, text


def test_no_python_in_the_plan(spark, sf):
    plan = licenses.op8_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
