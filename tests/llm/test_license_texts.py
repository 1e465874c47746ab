"""Published wordings of licenses, and the same with one word altered near the end."""

from __future__ import annotations

import re

import pytest

from touchline.llm import licenses, wordings

GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as "
    "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
)

MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)


def published(label):
    """The template with a holder's name for replaceable regions and with its optional ones."""
    return re.sub(r"<<var;min=(\d+);max=\d+>>", lambda m: " the" * int(m[1]), re.sub(r"<<(begin|end)Optional>>", " ", licenses.TEMPLATES[label]))


@pytest.mark.parametrize(
    ("label", "text", "last"),
    [
        ("gpl-2-header", GPL.format("General", "2"), "details"),
        ("gpl-3-header", GPL.format("General", "3"), "details"),
        ("lgpl-2.1-header", GPL.format("Lesser General", "2.1"), "details"),
        ("lgpl-3-header", GPL.format("Lesser General", "3"), "details"),
        ("agpl-3-header", GPL.format("Affero General", "3"), "details"),
        ("isc-text", published("isc-text"), "PERFORMANCE"),
        ("bsd-2-text", published("bsd-2-text"), "ADVISED"),
        ("bsd-3-text", published("bsd-3-text"), "ADVISED"),
        ("apache-2-header", APACHE, "governing"),
        ("mpl-2-header", MPL, "obtain"),
        ("unlicense-text", published("unlicense-text"), "DEALINGS"),
        ("cc-by-notice", "This work is licensed under CC BY 4.0.", "4"),
        ("cc-by-sa-notice", "Licensed under a CC BY-SA 4.0 license", "SA"),
        ("cc-by-sa-name", "the Creative Commons Attribution-ShareAlike 4.0 International License", "ShareAlike"),
        ("cc0-notice", "CC0 1.0 Universal", "Universal"),
        ("cc-by-3.0", "Photographs: CC BY 3.0.", "BY"),
        ("cc-by-nc-sa-2.5", "CC-BY-NC-SA 2.5", "SA"),
        ("cc-by-nd-4.0-name", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "NoDerivatives"),
        ("spdx-mit", "// SPDX-License-Identifier: MIT", "Identifier"),
        ("spdx-gpl-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later", "GPL"),
        ("apache-2-text", wordings.APACHE_2, "warranty"),
        ("mpl-2-text", wordings.MPL_2, "attached"),
        ("gpl-2-text", wordings.GPL_2, "ADVISED"),
        ("gpl-3-text", wordings.GPL_3, "fee"),
        ("lgpl-2.1-text", wordings.LGPL_2_1, "ADVISED"),
        ("lgpl-3-text", wordings.LGPL_3, "authorization"),
        ("cc0-text", wordings.CC0_1, "duty"),
    ],
)
def test_published_and_altered(label, text, last):
    assert label in licenses.scan("Some words. " + text + " More.")[5].split(",")
    assert label not in licenses.scan("Some words. " + re.sub(rf"\b{last}\b", "altered", text) + " More.")[5].split(",")


def test_disclaimed_openings_get_no_label():
    opening = published("bsd-2-text").split("are met")[0] + "are met"
    assert licenses.scan(opening)[5] == ""


@pytest.mark.parametrize(
    ("label", "last"),
    [("apache-2-text", "liability"), ("mpl-2-text", "attached"), ("gpl-2-text", "DAMAGES"), ("gpl-3-text", "fee"), ("lgpl-2.1-text", "DAMAGES")],
)
def test_only_the_last_word_altered(label, last):
    text = licenses.TEMPLATES[label].rstrip()
    head, found, tail = text.rpartition(last)
    assert found and len(tail) < 3
    assert label in licenses.scan(text)[5].split(",")
    assert label not in licenses.scan(head + "altered" + tail)[5].split(",")
    assert label not in licenses.scan(head)[5].split(",")


def test_other_lines_do_not_matter_to_a_whole_text():
    text = "Copyright the authors\n\n" + wordings.GPL_2.replace("\n", "\r\n   ") + "\nHow to Apply These Terms"
    assert "gpl-2-text" in licenses.scan(text)[5].split(",")
    assert "gpl-3-text" not in licenses.scan(text)[5].split(",")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("CC BY-NC 4.0", "cc-by-nc,cc-by-nc-4.0"),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4.0"),
        ("CC BY 3.0", "cc-by-3.0"),
        ("Creative Commons Attribution-NonCommercial 3.0", "cc-by-nc-3.0-name"),
        ("Creative Commons Attribution-NoDerivs 3.0 Unported", "cc-by-nd-3.0-name"),
        ("Creative Commons Attribution License 2.0", "cc-by-2.0-name"),
        ("CC BY 1.7", ""),
        ("SPDX-License-Identifier: LicenseRef-MIT", ""),
    ],
)
def test_one_license_of_a_family(text, labels):
    assert licenses.scan(text)[5] == labels
