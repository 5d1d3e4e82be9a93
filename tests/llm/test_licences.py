"""Signature rules: a literal text for every label, gates, suppression by a sweep, long and wrapped texts."""
import random

import regex
from pyspark.sql import functions as F

from cuewright.llm import licences as L

TAGGED = {
    "mit": "MIT", "mit-0": "MIT-0", "x11": "X11", "isc": "ISC", "0bsd": "0BSD", "bsd-1-clause": "BSD-1-Clause", "bsd-2-clause": "BSD-2-Clause-Patent",
    "bsd-3-clause": "BSD-3-Clause", "bsd-4-clause": "BSD-4-Clause", "apache-1.0": "Apache-1.0", "apache-1.1": "Apache-1.1", "apache-2.0": "Apache-2.0",
    "agpl-1.0": "AGPL-1.0-only", "agpl-3.0": "AGPL-3.0-or-later", "gpl-1.0": "GPL-1.0+", "gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0", "lgpl-2.0": "LGPL-2.0",
    "lgpl-2.1": "LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0", "gfdl": "GFDL-1.3", "mpl-1.0": "MPL-1.0", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0",
    "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0", "cddl-1.0": "CDDL-1.0", "cddl-1.1": "CDDL-1.1", "cpl-1.0": "CPL-1.0", "cpal-1.0": "CPAL-1.0", "eupl-1.1": "EUPL-1.1",
    "eupl-1.2": "EUPL-1.2", "artistic": "Artistic-1.0-Perl", "artistic-2.0": "Artistic-2.0", "zlib": "Zlib", "boost-1.0": "BSL-1.0", "bsl-1.1": "BUSL-1.1",
    "unlicense": "Unlicense", "wtfpl": "WTFPL", "ncsa": "NCSA", "python-2.0": "PSF-2.0", "php-3.0": "PHP-3.0", "php-3.01": "PHP-3.01", "ruby": "Ruby",
    "postgresql": "PostgreSQL", "openssl": "OpenSSL", "sleepycat": "Sleepycat", "sspl-1.0": "SSPL-1.0", "elastic-2.0": "Elastic-2.0", "osl-3.0": "OSL-3.0",
    "afl-3.0": "AFL-3.0", "ecl-2.0": "ECL-2.0", "ofl-1.1": "OFL-1.1-RFN", "odbl": "ODbL-1.0", "odc-by-1.0": "ODC-By-1.0", "pddl-1.0": "PDDL-1.0", "ms-pl": "MS-PL",
    "ms-rl": "MS-RL", "vim": "Vim", "w3c": "W3C", "mulan-psl-2.0": "MulanPSL-2.0", "blueoak-1.0.0": "BlueOak-1.0.0", "json": "JSON", "curl": "curl", "hpnd": "HPND",
    "icu": "ICU", "unicode": "Unicode-3.0", "upl-1.0": "UPL-1.0", "tcl": "TCL", "beerware": "Beerware", "blessing": "blessing", "cc-by": "CC-BY-4.0",
    "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nd": "CC-BY-ND-3.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nc-sa": "CC-BY-NC-SA-2.5", "cc-by-nc-nd": "CC-BY-NC-ND-4.0",
    "cc0-1.0": "CC0-1.0",
}
SAID = {
    "agpl": "see the AGPL", "lgpl": "the GNU Lesser General Public License", "gpl": "under the GPL", "apache": "the Apache License", "bsd": "a BSD-style license",
    "mpl": "the Mozilla Public License", "epl": "the Eclipse Public License", "eupl": "the European Union Public Licence", "php": "the PHP license",
    "public-domain": "put into the public domain", "proprietary": "All rights reserved.", "openrail": "an OpenRAIL-M license",
}
SHOWN = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that the above\n// copyright notice"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    ("bsd-3-clause", "Neither the name of the Regents nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "you may not use this file except in compliance with the License."),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("ncsa", "to deal with the Software without restriction"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("json", "The Software shall be used for Good, not Evil."),
    ("blessing", "In place of a legal notice, here is a blessing"),
    ("wtfpl", "just do what the fuck you want to"),
    ("apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"), ("gpl-3.0", "https://www.gnu.org/licenses/gpl-3.0.html"), ("mit", "https://opensource.org/licenses/MIT"),
    ("mpl-2.0", "http://mozilla.org/MPL/2.0/."), ("cc-by-sa", "https://creativecommons.org/licenses/by-sa/4.0/"), ("cc0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("boost-1.0", "http://www.boost.org/LICENSE_1_0.txt"), ("mit", "under the MIT\n   License"), ("lgpl-2.1", "the GNU Lesser General Public\nLicense, version 2.1"),
]


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "vid long, text string")
    return {r.vid: r for r in L.licence_scan(rows).collect()}


def test_every_label_has_a_text_that_gives_it(spark):
    cases = [(k, f"# SPDX-License-Identifier: {v}\n") for k, v in TAGGED.items()] + list(SAID.items()) + SHOWN
    got = scanned(spark, [t for _, t in cases])
    wrong = [(label, text, got[i].labels) for i, (label, text) in enumerate(cases) if label not in got[i].labels]
    assert not wrong
    assert {s.label for s in L.SIGNATURES} == set(TAGGED) | set(SAID)
    for i, label in enumerate(TAGGED):  # a tag gives its own licence alone
        assert [h.label for h in got[i].hits] == [label] or got[i].labels == sorted({label, "proprietary"} & set(got[i].labels))


def test_a_tag_names_each_licence_of_its_expression(spark):
    got = scanned(spark, ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath",
                          "SPDX-License-Identifier:\nMIT", "the spdx list has MIT", "license-free prose on the isc and its ruby mitre", None, ""])
    assert [got[i].labels for i in range(8)] == [["apache-2.0", "bsd-3-clause", "mit"], ["mit-0"], ["gpl-2.0"], [], [], [], [], []]
    assert got[0].score > got[1].score > 0 == got[7].score


def test_rules_demand_a_word_of_the_gate_and_their_keyword():
    assert len(L.SIGNATURES) > 250 and len({(s.label, s.regex) for s in L.SIGNATURES}) == len(L.SIGNATURES)
    for s in L.SIGNATURES:
        assert regex.compile(s.regex)
        plain = s.regex.replace("licen[cs]", "licens").replace(r"\.", ".").replace("[- ]", "-").replace(r"[-\s]", "-").replace(r"\s", " ")
        assert s.keyword in plain or s.keyword == "spdx"
        assert any(g in s.keyword or g in plain for g in L.GATE), s
    assert [s.priority for s in L.SIGNATURES] == list(range(len(L.SIGNATURES)))


def test_sweep_is_the_comparison_of_all_pairs(spark):
    r, cases = random.Random(5), []
    for n in (0, 1, 2, L.SWEEP, L.SWEEP + 1, 400):
        hits = [(a, a + r.randint(1, 60 if r.random() < 0.9 else 900), r.randint(0, 6), "x", 1.0) for a in (r.randint(0, 3 * n) for _ in range(n))]
        cases.append((n, hits + hits[:3]))
    out = spark.createDataFrame(cases, f"n long, hits {L.HITS}").select("n", L._outermost(F.col("hits")).alias("kept")).collect()
    want = {n: sorted(x for x in hits if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] < x[2] for y in hits)) for n, hits in cases}
    assert {row.n: sorted(map(tuple, row.kept)) for row in out} == want


def test_a_very_long_text_of_notices(spark):
    line = "Licensed under the Apache License, Version 2.0. All rights reserved.\n"
    got = scanned(spark, [line * 3000, "plain words " * 20000])
    assert len(got[0].hits) == 6000 and got[0].labels == ["apache", "apache-2.0", "proprietary"] and got[0].n_words == 33000
    assert got[1].hits == [] and got[1].n_words == 40000
