import itertools
import random
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm.license_scan import NOTICES, SHORT, WEIGHT, Scanner, _words, differences, own_words, scan_licenses

SCHEMA = "doc_id long, text string, findings string"


def weight(run, want, kept):
    """Least weight of edits that make want of run, by the textbook table."""
    table = {(0, 0): 0}
    for i in range(len(run) + 1):
        for j in range(len(want) + 1):
            options = [table[i, j]] if (i, j) in table else []
            lost = 10**6 if j and want[j - 1] in kept else 0
            if i and j:
                options.append(table[i - 1, j - 1] + (0 if run[i - 1] == want[j - 1] else WEIGHT[1] + lost))
            if i:
                options.append(table[i - 1, j] + WEIGHT[3])
            if j:
                options.append(table[i, j - 1] + WEIGHT[2] + lost)
            table[i, j] = min(options)
    return table[len(run), len(want)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdx"), max_size=14), st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(0, 3))
def test_differences_match_brute_force(block, want, most):
    kept = frozenset("d")
    found = differences(block, want, kept, most)
    runs = {(a, z): weight(block[a:z], want, kept) for a in range(len(block)) for z in range(a + 1, len(block) + 1)}
    for a, z, edits in found:
        assert len(edits) <= most and sum(WEIGHT[k] for k, _ in edits) == runs[a, z] == min(w for (x, y), w in runs.items() if y == z)
        assert not any(k in (1, 2) and w[0] in kept for k, w in edits)
    assert all(z <= x or y <= a for (a, z, _), (x, y, _) in itertools.combinations(found, 2))
    exact = [i for i in range(len(block) - len(want) + 1) if block[i : i + len(want)] == want]
    assert all(any(a <= i + len(want) - 1 and i < z for a, z, _ in found) for i in exact)


def corpus():
    rng = random.Random(8)
    v = ["stone", "license", "under", "the", "License", "of", "Version", "CC", "MIT", "4.0", "work"]
    rows, want = [], {}
    for i in range(200):
        lines = [" ".join(rng.choices(v, k=rng.randrange(12))) for _ in range(3)]
        name, notice = NOTICES[i % len(NOTICES)]
        words, kept, kind = notice.split(), own_words([(n, _words(t)[0]) for n, t in NOTICES])[i % len(NOTICES)], i % 5
        long = len(words) >= 5
        if kind == 1:
            for _ in range(3 if long else 1):
                words.insert(rng.randrange(1, len(words)), "really")
        elif kind == 2:
            loose = [k for k, w in enumerate(words) if not set(_words(w)[0]) & kept]
            if loose and long:
                del words[rng.choice(loose)]
        elif kind == 3:
            words = [w.upper() for w in words]
        elif kind == 4 and len(words) <= SHORT:
            gone = [k for k, w in enumerate(words) if set(_words(w)[0]) & kept]
            del words[rng.choice(gone)]
        lines.insert(rng.randrange(4), "Note: " + " ".join(words) + ". Quiet rivers here.")
        if not Scanner(NOTICES, 0).cue.search(" ".join(words)):
            continue  # the words put in part its only cue
        rows.append((i, "\n".join(lines), "x"))
        want[i] = (name, kind != 4 or len(notice.split()) > SHORT)
    more = [(900, None, "x"), (901, "", "x"), (902, "word " * 30_000 + "Released under the MIT License. " + "word " * 30_000, "x"), (902, "x", "x"), (None, "All rights reserved", "x")]
    return rows + more, want


def test_planted_notices(spark):
    rows, want = corpus()
    out = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append([f["license"] for f in r["findings"]])
    for i, (name, there) in want.items():
        assert (name in got[i][0]) if there else (got[i][0].count(name) == 0 or name == "MIT"), rows[i]
    assert sorted(got[902]) == [[], ["MIT"]] and got[900] == got[901] == [[]] and got[None] == [["proprietary"]]


@pytest.mark.parametrize(
    ("text", "name", "difference"),
    [("Released under the terms of the MIT License", "MIT", "+the +terms +of"), ("Released under the very same old MIT License", "MIT", "+very +same +old"), ("Licensed under Apache 2.0", "Apache-2.0", "-the -license -version"),
     ("Released under this MIT License", "MIT", "~the>this")],
)
def test_wordings_that_differ(text, name, difference):
    rng = random.Random(2)
    prose = [f"stone{rng.randrange(99)}" for _ in range(200)]
    _, (f,) = Scanner(NOTICES, 3).scan(" ".join(prose[:100] + [text] + prose[100:]))
    assert (f["license"], f["difference"]) == (name, difference) and f["inserted"] + f["deleted"] + f["replaced"] == len(difference.split())


def test_candidates_are_ranked_by_what_they_save():
    s = Scanner(NOTICES, 3)
    text = "Released under the MIT License. Once upon a time. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    words, spans = _words(text)
    ranked = s.candidates(words, s.cues(text, spans))
    assert len(ranked) > 2 and [c[0] for c in ranked] == sorted((c[0] for c in ranked), reverse=True)
    assert all(c[0] == s.reductions(words[c[2] : c[3]])[c[1]] >= s.least[c[1]] for c in ranked)
    bsd = dict(reversed([(n, t) for n, t in NOTICES if t.startswith("Redistribution")]))["BSD-3-Clause"].split()
    for k in (3, 20, 60):
        assert [f["license"] for f in s.scan(" ".join(bsd[:k] + bsd[k + 1 :]) + " and so on")[1]] == ["BSD-3-Clause"]


@pytest.mark.parametrize(("name", "notice"), NOTICES)
def test_every_notice_is_found_and_saves_most(name, notice):
    s = Scanner(NOTICES, 3)
    text = f"Once upon a time. {notice}."
    _, (f,) = s.scan(text)
    assert (f["license"], text[f["start"] : f["end"]]) == (name, notice)
    saved = s.reductions(_words(notice)[0])
    assert f["saved"] > 0 and saved[[n for _, n in NOTICES].index(notice)] == max(saved)


def test_near_wordings_are_told_apart():
    s = Scanner(NOTICES, 0)
    assert [f["license"] for f in s.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.\nLicensed under CC BY-ND 4.0.")[1]] == ["CC-BY-NC-4.0", "CC-BY-4.0"]
    assert s.scan("the licence of stones") == (1, [])


def licenses(text, edits=3):
    out = Scanner(NOTICES, edits).scan(text)[1]
    assert all(f["saved"] > 0 and 0 <= f["start"] < f["end"] <= len(text) for f in out)
    return [f["license"] for f in out]


@pytest.mark.parametrize(("name", "notice"), NOTICES)
@pytest.mark.parametrize("width", [20, 60])
def test_wrapped_notices(name, notice, width):
    text = "".join(f" * {x}\n" for x in textwrap.wrap(notice, width, break_on_hyphens=False, break_long_words=False))
    assert licenses(f"once\n{text}upon a time") == [name]


def test_wrapped_in_a_table(spark):
    rows = [(1, "subject to the terms of the\nMozilla Public License", "x"), (2, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0", "x"), (3, "all\n# rights reserved", "x")]
    out = {r["doc_id"]: [f["license"] for f in r["findings"]] for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: [], 2: ["MPL-2.0"], 3: ["proprietary"]}


def test_texts_and_headers_are_told_apart():
    text = dict(reversed([(n, t) for n, t in NOTICES if t.startswith("Redistribution")]))
    assert licenses(text["BSD-3-Clause"] + " ACME nor the names of its contributors may be used") == ["BSD-3-Clause"]
    assert licenses(text["BSD-2-Clause"] + " THE AUTHORS") == ["BSD-2-Clause"] and licenses(text["BSD-4-Clause"]) == ["BSD-4-Clause"]
    gnu = "Foo is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\nthe Free Software Foundation; "
    assert licenses(gnu + "either version 3 of the License, or\n(at your option) any later version.") == ["GPL-3.0-or-later"]
    assert licenses(gnu + "version 2 of the License.") == ["GPL-2.0-only"]


@pytest.mark.parametrize(
    ("tag", "names"),
    [("MIT", ["MIT"]), ("(Apache-2.0 OR MIT) */", ["Apache-2.0", "MIT"]), ("GPL-2.0-only WITH Classpath-exception-2.0 AND BSL-1.0.", ["GPL-2.0-only WITH Classpath-exception-2.0", "BSL-1.0"]),
     ("LicenseRef-own-1", ["LicenseRef-own-1"]), ("GPL-2.0+ -->", ["GPL-2.0+"]), ("NONE", []), ("\nMIT", [])],
)
def test_spdx_tags(tag, names):
    text = f"// SPDX-License-Identifier: {tag}\nor else"
    assert licenses(text) == names
    found = Scanner(NOTICES, 3).scan(text)[1]
    assert [text[f["start"] : f["end"]].removeprefix("SPDX-License-Identifier: ").lstrip("(") for f in found] == names


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
