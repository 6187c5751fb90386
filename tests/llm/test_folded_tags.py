from vantage.llm import licences


def test_tags_beside_letters_that_change_their_length():
    for text in ("\u0130stanbul\nSPDX-License-Identifier: MIT", "SPDX-License-Identifier: MIT\n\u0130", "License: MIT \u0130\u0130"):
        row = licences.scan_text(text)
        assert (row[5], row[6], row[7], row[8]) == ("mit", 1.0, "mit", 1.0)
    assert licences.scan_text("\u0130 LICENSE: (MIT OR GPL-2.0-only) \u0130")[7] == "mit gpl-2.0-only or"
