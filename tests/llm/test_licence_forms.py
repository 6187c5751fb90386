import time

import pytest

from vantage.llm import licences

from . import brute


@pytest.mark.parametrize("text, labels, expressions", [
    ('{"name": "x", "license": "MIT"}', "mit", "mit"), ("license = 'Apache-2.0'", "apache-2.0", "apache-2.0"),
    ("It is GPL-3.0-or-later software", "gpl-3.0-or-later", ""), ("released under GPLv3, see there", "gpl-3.0", ""),
    ("released under MIT", "mit", ""), ("mit der Bahn", "", ""),
    ("// SPDX-License-Identifier: (MIT OR\n// Apache-2.0) AND BSD-3-Clause\n", "apache-2.0,bsd-3-clause,mit", "mit apache-2.0 or bsd-3-clause and"),
    ("# SPDX-License-Identifier: (MIT\n#   OR ISC)", "isc,mit", "mit isc or"), ("license: (MIT OR\n\n\nISC", "", ""),
    ("SPDX-License-Identifier: MIT OR\nnothing", "mit", "mit"), ("license: {'x': 1}", "", ""), ("licensee: MIT", "", ""),
    ("SPDX-License-Identifier: MIT\nLicense: ISC", "isc,mit", "mit;isc")])
def test_forms(text, labels, expressions):
    row = licences.scan_text(text)
    assert (row[5], row[7]) == (labels, expressions)


def test_places_are_counted_on():
    text = "cc by general public license x all rights reserved cc by y cc by sa all rights reserved general public license " * 30
    assert licences.scan_text(text)[:5] == brute.licence_row(text)


def test_long_texts_take_linear_time():
    began = time.time()
    assert licences.scan_text("cc by " * 200_000)[1] == 200_000
    for text in ("license: (" * 50_000, "license: (a or\n" * 50_000, "license:" + "(" * 200_000, "license" + " " * 300_000, "(license:\n" * 50_000):
        licences.scan_text(text)
    assert time.time() - began < 10
