import re

import pytest

from corpusloom.llm import license_rules as lr
from corpusloom.llm import license_scan
from tests.llm.texts import awkward, empty

TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.\nsome text MIT\t\tlicense mit-license MITLICENSE mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-2.0-or-later. Copyright (c) 2019 by X. All rights reserved.",
    "The quick licence. Copyright 1999. creative commons attribution share-alike 3.0 license",
    "apache license apache license 2.0 mit license apache",
    "See https://creativecommons.org/licenses/by-sa/4.0 and CC0 1.0 or cc 0 1.0",
    "Kelvin mit lİcense MIT LICENSEé émit license",
    "no such words",
    "is licensed under the terms of the mozilla public license version 2.0",
    "mit license " * 500,
]


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    norm = " " + " ".join(words) + " "

    def places(pattern):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            yield first, first + m[0].count(" ")

    base = [(first, label) for phrase, label in lr.BASE for first, _ in places(phrase)]
    found = sorted((f, -e, r.priority, r.number, r) for r in lr.RULES if r.keyword in norm and any(w in norm for w in r.words) for f, e in places(r.pattern))
    stays = [x[4] for i, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
    labels = {label for _, label in base} | {r.label for r in stays}
    score = max([lr.SCORES[r.priority] for r in stays] + [lr.BASE_SCORE] * bool(base), default=0.0)
    starts = [f for f, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, len(stays) + len(base))


def check(docs):
    got = sorted((str(tuple(r)) for r in license_scan.scan(docs).collect()))
    assert got == sorted(str((r.doc_id, *brute(r.text))) for r in docs.collect())


def test_texts(spark):
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_awkward(spark):
    check(awkward(spark))
    assert license_scan.scan(empty(spark)).collect() == []


def test_driver_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_planted_labels():
    assert brute(TEXTS[0])[5] == "apache,apache-2.0"
    assert brute(TEXTS[3])[5] == "cc-by-nc-4.0"
    assert "gpl-3.0" in brute(TEXTS[2])[5]


def test_rules_are_many_and_ordered():
    assert len(lr.RULES) > 250
    assert [r.number for r in lr.RULES] == list(range(len(lr.RULES)))
    assert [r.priority for r in lr.RULES] == sorted(r.priority for r in lr.RULES)
    for r in lr.RULES:
        re.compile(r.pattern)
        assert r.keyword in lr.KEYWORDS


def test_words_miss_nothing():
    """A rule's own words are in whatever its pattern matches, for patterns without classes, with optional parts left out."""
    for r in lr.RULES:
        plain = re.sub(r"\(\?:[^()]*\)\?|\[[^]]*\]\{?\d*\}?|.\?", "", re.sub(r"\[cs\]", "s", r.pattern))
        if "(" not in plain:
            assert any(w.strip() in plain for w in r.words) or r.words == (r.keyword,), r


@pytest.mark.parametrize("text", TEXTS)
def test_gate_misses_nothing(text):
    n = brute(text)
    gate = re.search("(?i)" + "|".join({*lr.KEYWORDS.values()}), text, re.ASCII)
    assert gate or not n[7]


def test_plan_is_native(spark):
    plan = license_scan.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


UNGATED = [
    "Released under the GNU GPL v3.", "Available under the terms of Apache 2.0", "distributed under MIT", "GPL v3", "lgpl 2.1", "AGPL-3", "MPL 2.0", "EPL 2.0", "GFDL 1.3",
    "CDDL", "cpl", "PSF 2", "Python Software Foundation", "odbl", "Open Database", "Apache 2.0", "artistic 2.0", "PHP 3.01", "elastic 2", "Boost Software", "business source 1.1",
    "https://mozilla.org/MPL/2.0", "mozilla.org/MPL/1.1", "eclipse.org/legal/epl-v10", "eclipse.org/legal/epl/2.0", "mariadb.com/bsl11", "www.wtfpl.net", "scripts.sil.org/OFL", "cecill.info",
    "Creative\nCommons Attribution 4.0 International", "creative commons attribution share-alike 3.0", "Published under CC BY 4.0",
]


def matching(text):
    """Numbers of the rules that match, with no gate before them."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) + " "
    return sorted(r.number for r in lr.RULES if re.search(f" (?:{r.pattern})(?= )", norm))


def test_keywords_lose_no_match(spark):
    docs = spark.createDataFrame(list(enumerate(UNGATED + TEXTS)), "doc_id long, text string")
    got = {r.text: sorted({d.rule for d in r.found or [] if not d.base}) for r in license_scan.detections(docs).select("text", "found").collect()}
    assert got == {t: matching(t) for t in UNGATED + TEXTS}
    assert all(got[t] for t in UNGATED)
