"""Licence scans: names that must be told apart, common forms, parts of long licences, and the whole scan against a plain alignment."""

import random

import numpy as np
import pytest

from scholia_spark.llm import license_texts, licenses


@pytest.fixture(scope="module")
def index():
    return licenses.Index(license_texts.templates())


def ids(text, index):
    return [license_texts.identifier(m[0]) for m in licenses.scan_text(text, index)]


@pytest.mark.parametrize("text, want", [
    ("This project is MIT licensed.", ["MIT"]), ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("License: GPL-2.0-or-later", ["GPL-2.0-or-later"]), ("Licensed under GPLv3", ["GPL-3.0"]), ("Licensed under GPLv2.", ["GPL-2.0"]),
    ("dual licensed under the terms of the MIT license and Apache License, Version 2.0", ["MIT", "Apache-2.0"]), ("Released under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("// SPDX-License-Identifier: MIT\ncode", ["MIT"]), ("License: BSD-3-Clause", ["BSD-3-Clause"]), ("License: BSD-4-Clause", []), ("SPDX-License-Identifier: LGPL-2.1-only", ["LGPL-2.1-only"]), ("licensed under a rock", []),
])
def test_common_forms(index, text, want):
    assert ids(text, index) == want


def test_a_name_that_is_put_in(index):
    body = license_texts.bodies()["GPL-3.0-body"]
    renamed = body.replace("GNU General Public", "GNU Affero General Public").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    assert "GPL-3.0" not in ids(renamed, index)
    assert "GPL-3.0" not in ids(body.replace("Version 3, 29", "Version 2, 29"), index)
    assert ids(license_texts.bodies()["AGPL-3.0-body"], index) == ["AGPL-3.0"]
    titled = body.replace("GNU GENERAL PUBLIC", "GNU LESSER GENERAL PUBLIC", 1)
    assert "GPL-3.0" not in ids(titled, index)


@pytest.mark.parametrize("name", ["GPL-3.0-body", "Apache-2.0-body", "MPL-2.0-body", "CC-BY-SA-4.0-body"])
def test_parts_are_reported(index, name):
    text = license_texts.bodies()[name]
    for part in (text[:8000], text[3000:9000]):
        found = licenses.scan_text(f"Some other text. {part}", index)
        best = max(found, key=lambda m: m[2])
        n = licenses.words_of(part)[0].size
        assert best[0] == name and 0.9 * n <= best[2] <= n and best[5] > 0.9 and best[1] < 0.8


def plain_lcs(a, b):
    """Length of the longest common subsequence, row by row."""
    row = np.zeros(b.size + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def test_whole_scan_equals_a_plain_alignment(index):
    """200 texts with an edited template each: the scan names it and finds as many words as an alignment without bands."""
    rnd = random.Random(11)
    plain = {n: t.replace("{", "").replace("}", "") for n, t in license_texts.templates().items()}
    names = sorted(plain)
    other = "zorp quib lant mesk drovel hint".split()
    for case in range(200):
        name = names[case % len(names)] if case % 5 else rnd.choice([n for n in names if n.endswith("-body")])
        words = plain[name].split()
        long_ = len(words) > licenses.LONG
        edited = []
        for w in words:
            roll = rnd.random()
            if long_ and roll < 0.01:
                continue
            edited.append(w)
            if long_ and roll > 0.99:
                edited.append(rnd.choice(other))
        text = " ".join(rnd.choices(other, k=rnd.randrange(30)) + edited + rnd.choices(other, k=rnd.randrange(30)))
        found = licenses.scan_text(text, index)
        assert [m[0] for m in found] == [name], (name, found)
        template, hashes = licenses.marked(license_texts.templates()[name])[0], licenses.words_of(text)[0]
        assert 0.97 * plain_lcs(template, hashes) <= found[0][2] <= plain_lcs(template, hashes)


def test_ties_and_repeats_of_long_licences(index):
    body = license_texts.bodies()["Artistic-1.0-Perl-body"]
    found = licenses.scan_text(f"{body}\nbetween them\n{body}", index)
    assert [(m[0], m[1]) for m in found] == [("Artistic-1.0-Perl-body", 1.0)] * 2 and found[0][4] <= found[1][3]
