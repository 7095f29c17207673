"""Licences inside other text: several paragraphs, longer lines, full texts."""

from __future__ import annotations

import pytest

from pitchfold.llm import license_scan

from .helpers import words

MIT = license_scan.TEMPLATES["MIT"].replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
APACHE = license_scan.TEMPLATES["Apache-2.0"].replace("You may", "\n\nYou may", 1).replace("Unless", "\n\nUnless")
CODE = "\n".join(f"def f{k}(x):\n    return {words(k, 8)}\n" for k in range(60))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        (f"Copyright (c) 1999 A. Person\n\n{MIT}\n\n{CODE}", "MIT"),
        (f"{CODE}\n\n{APACHE}\n\n{CODE}", "Apache-2.0"),
        (f"{words(1, 90)} {license_scan.TEMPLATES['MIT-notice']} {words(2, 90)}", "MIT-notice"),
        ("Licensed under the MIT License.", "MIT-notice-3"),
        (f"{CODE}\n{license_scan.TEMPLATES['BSD-3-Clause']}\n{CODE}", "BSD-3-Clause"),
        (license_scan.TEMPLATES["AGPL-3.0-or-later"].replace(" ", "\n\n", 3) + "\n\n" + CODE, "AGPL-3.0-or-later"),
        (f"# SPDX-License-Identifier: LGPL-3.0-or-later\n{CODE}", "LGPL-3.0-or-later-SPDX"),
    ],
)
def test_a_licence_inside_other_text(text, name):
    found = license_scan.scanner(license_scan.TEMPLATES, 0.8)(text)
    assert found[0][0] == name and found[0][1] > 0.9


def test_runs_of_paragraphs_are_compared_whole():
    """Edited words between paragraphs: the run is nearer to the template than any window of its size."""
    template = words(7, 40)
    half = template.split()
    text = "\n\n".join([words(8, 50), " ".join(half[:15]), words(9, 12), " ".join(half[15:]), words(10, 50)])
    ((_, dice),) = license_scan.scanner({"t": template}, 0.8)(text)
    assert dice == 2 * 38 / (39 + 51)


def test_other_text_has_no_licence():
    scan = license_scan.scanner(license_scan.TEMPLATES, 0.8)
    assert scan(CODE) == scan(words(5, 2000)) == scan("the license of this software is under the terms") == scan("") == []
