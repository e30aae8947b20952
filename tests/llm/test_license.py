"""Genuine tags, notices and licence texts get their licence's label."""

import itertools
import re

import pytest

from noctua.llm import license_scan

TAGS = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0-only": "gpl-2.0-only", "GPL-3.0-or-later": "gpl-3.0-or-later", "GPL-2.0": "gpl-2.0", "BSD-3-Clause": "bsd-3-clause",
    "BSD-2-Clause": "bsd-2-clause", "MPL-2.0": "mpl-2.0", "LGPL-2.1-or-later": "lgpl-2.1-or-later", "ISC": "isc", "CC-BY-4.0": "cc-by-4.0", "CC0-1.0": "cc0-1.0",
    "(MIT OR Apache-2.0)": "apache-2.0,mit", "GPL-2.0-only WITH Classpath-exception-2.0 OR BSD-3-Clause": "bsd-3-clause,gpl-2.0-only",
}
TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license": "boost-1.0",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software": "bsd-3-clause",
    "3. The name of the author may not be used to endorse or promote products derived from this software": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "isc",
    "you may not use this file except in compliance with the License.\nYou may obtain a copy at\n    http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.": "gpl-3.0-or-later",
    "under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": "gpl-2.0-only",
    "the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-or-later",
    "If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Altered source versions must be plainly marked as such, and must not be\nmisrepresented as being the original software.": "zlib",
    "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
    "free software, GPLv3": "gpl-3.0", "it is GPL-2.0+ code": "gpl-2.0", "GPL v2 or later": "gpl-2.0-or-later", "(BSD 3-Clause)": "bsd-3-clause", "uses Apache-2.0": "apache-2.0", "LGPLv2.1": "lgpl-2.1",
}


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: r for r in license_scan.scan_licenses(df).collect()}


def test_tags(spark):
    got = labels(spark, [f"# SPDX-License-Identifier: {t}\nimport mit or isc" for t in TAGS])
    assert {t: r.labels for t, r in zip(TAGS, got.values(), strict=True)} == TAGS
    assert {r.score for r in got.values()} == {1.0}


def test_wording(spark):
    got = labels(spark, list(TEXTS))
    missed = {t: r.labels for t, r in got.items() if TEXTS[t] not in r.labels.split(",")}
    assert not missed
    lgpl = next(r for t, r in got.items() if TEXTS[t] == "lgpl-2.1-or-later")
    assert not any(d.x.startswith("gpl-") for d in lgpl.kept)


@pytest.mark.parametrize("text", ["limit of permission", "the apache helicopter 2", "mit der Zeit", "a source of redistribution"])
def test_common_words_have_no_label(spark, text):
    assert labels(spark, [text])[text].labels == ""


def expanded(tree):
    """Strings that a parsed pattern matches: each branch, and each optional part both left out and there."""
    out = [""]
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "BRANCH":
            ways = [w for t in arg[1] for w in expanded(t)]
        elif name == "SUBPATTERN":
            ways = expanded(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = expanded(arg[2])
            ways = sorted({w * n for w in one for n in {arg[0], max(arg[0], 1)}})
        elif name in ("NOT_LITERAL", "ANY"):
            ways = ["x"]
        elif name == "IN":
            kind, value = arg[0]
            ways = [chr(value)] if str(kind) == "LITERAL" else [chr(value[0])] if str(kind) == "RANGE" else ["x"]
        else:
            assert name in ("ASSERT", "ASSERT_NOT", "AT"), name
            ways = [""]
        out = [a + b for a, b in itertools.product(out, ways)]
    return out


def test_no_rule_matches_what_the_gate_refuses():
    for _, keyword, pattern, label, _ in license_scan.rules()[len(license_scan.SPDX) :]:
        for text in expanded(re._parser.parse(pattern)):
            assert any(g in text or g in keyword for g in license_scan.GATES) or re.search(license_scan.CC_BY, text), (label, text)


def test_words_parted_by_breaks_and_signs(spark):
    texts = {"All rights\nreserved.": "all-rights-reserved", "released into the public\ndomain": "public-domain", "Creative\nCommons Attribution  4.0 International": "cc-by", "CC_BY_4.0": "cc-by-4.0", "PUBLIC license, in the public  domain": "public-domain"}
    assert {t: r.labels for t, r in labels(spark, list(texts)).items()} == texts
