"""Findings in whole licence texts, wrapped lines and odd input; the query against its SQL and a plain search."""

import random
import re

import parity
from pyspark.sql import functions as F

from snapcat.llm import licenses as m


def names(text):
    return [(x["licence"], x["rule"]) for x in m.match(m.Sentences(m.SENTENCES).recognise(text), m.by_first(m.RULES))]


def wrapped(text, width=37):
    return re.sub(rf"(.{{1,{width}}})(\s|$)", r"\1\n", text)


def test_whole_texts():
    s = m.SENTENCES
    mit = "\n\n".join([s["mit-title"], "Copyright (c) 2020 Someone", s["mit-grant"], s["mit-notice"], s["as-is-software"]])
    assert names(mit) == names(wrapped(mit)) == [("MIT", "mit-text")]
    bsd = "\n".join([s["bsd-grant"], "1. " + s["bsd-source"], "2. " + s["bsd-binary"]])
    assert names(re.sub(r"\d\. ", "", bsd)) == [("BSD-2-Clause", "bsd-2")]
    assert names(re.sub(r"\d\. ", "", wrapped(bsd) + "\n" + s["bsd-name"])) == [("BSD-3-Clause", "bsd-3")]
    apache = f"{s['apache-grant']}\n{s['apache-copy']}\n\n   http://example.org/licence\n\n{s['apache-as-is']}"
    assert names(wrapped(apache, 60)) == [("Apache-2.0", "apache-header")]


def test_order_distance_and_repeats():
    s = m.SENTENCES
    assert names(f"{s['mit-notice']}\n{s['mit-grant']}") == []
    assert names(s["bsd-source"]) == []
    far = "\nother words" * (m.MOST_APART + 1) + "\n"
    assert names(s["gpl-grant"] + far + s["gpl-hope"]) == [("GPL-3.0-or-later", "gpl-3-grant")]
    assert names(s["gpl-grant"] + "\nother words\n" + s["gpl-hope"]) == [("GPL-3.0-or-later", "gpl-3-header")]
    assert names(f"{s['mit-short']} x.\n{s['mit-short']}") == [("MIT", "mit-released")] * 2
    assert names("licensed under cc by 4.0\nLicensed under CC BY-NC 4.0!") == [("CC-BY-4.0", "cc-by-named"), ("CC-BY-NC-4.0", "cc-by-nc-named")]
    assert names("We are released under the MIT License.") == []


def test_notices_and_spdx_lines():
    of = lambda text: [x for x, _ in names(text)]
    assert of("This project is licensed under the MIT License.") == of("Licensed under the MIT License (see LICENSE)") == ["MIT"]
    assert of("This project is licensed under the MIT License - see the LICENSE file for details.") == ["MIT"]
    assert of("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;") == ["GPL-2.0-or-later"]
    assert of("# SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    assert of("SPDX-License-Identifier: LGPL-2.1-only") == ["LGPL-2.1-only"]
    assert of("The software is released under the terms of the GNU Affero General Public License, version 3.") == ["AGPL-3.0-only"]
    assert of("Licensed under GPLv2 or later.") == ["GPL-2.0-or-later"]
    assert of("This program is licensed under the GNU General Public License version 2 only.") == ["GPL-2.0-only"]
    assert of("Distributed under the Boost Software License, Version 1.0.") == ["BSL-1.0"]
    assert of("This code is made available under\nthe Eclipse Public License v2.0.") == ["EPL-2.0"]
    assert of("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == ["CC-BY-ND-4.0"]
    assert of("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0"]
    grant = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    assert of(wrapped(grant)) == ["LGPL-2.1-or-later"]
    assert of("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989") == ["GPL-2.0-only"]
    assert of("This project is not licensed under the MIT License.") == of("Released under the moon.") == of("We talk of MIT.") == []


def test_titles_and_later_versions():
    of = lambda text: [x for x, _ in names(text)]
    assert of("SPDX-License-Identifier: GPL-2.0+") == ["GPL-2.0-or-later"]
    assert of("SPDX-License-Identifier: (LGPL-2.1+ OR Apache-2.0+) */") == ["LGPL-2.1-or-later", "Apache-2.0"]
    assert of("SPDX-License-Identifier: GPL-2.0") == ["GPL-2.0-only"]
    assert of("This code is GPLv3+") == of("Licensed under GPLv3+.") == ["GPL-3.0-or-later"]
    assert of("x\nMIT License\ny") == of("License: MIT") == of("## License: MIT") == ["MIT"]
    assert of("BSD 3-Clause License") == ["BSD-3-Clause"] and of("Apache License 2.0") == ["Apache-2.0"]
    s = m.SENTENCES
    assert names("\n\n".join(["MIT License", "Copyright (c) 2020 Someone", s["mit-grant"], s["mit-notice"]])) == [("MIT", "mit-part")]
    assert names("\n".join(["BSD 3-Clause License", s["bsd-grant"], s["bsd-source"], s["bsd-binary"], s["bsd-name"]])) == [("BSD-3-Clause", "bsd-3")]
    assert of("We like the MIT License") == of("MIT") == of("License") == of("The MIT License is short.") == of("1+ licenses") == of("This code is GPLv3 and C++.") == []


def test_recognition_against_all_spans():
    """The longest run of units that spells a sentence, from left to right."""
    rng = random.Random(3)
    sentences = {"a": "one two three", "b": "one two", "c": "four. five", "d": "two"}
    ids = {m.normalised(x): k for k, x in sentences.items()}
    for _ in range(300):
        text = "".join(rng.choice(["one", "two", "three", "four", "five", "."]) + rng.choice([" ", "\n", ". ", "\n.\n"]) for _ in range(rng.randrange(12)))
        units, expected, i = [m.normalised(u) for u in m.UNIT.split(text)], [], 0
        while i < len(units):
            ends = [k for k in range(i, len(units)) if units[i] and units[k] and " ".join(u for u in units[i : k + 1] if u) in ids]
            if ends:
                expected.append((ids[" ".join(u for u in units[i : ends[-1] + 1] if u)], i, ends[-1]))
                i = ends[-1]
            i += 1
        assert m.Sentences(sentences).recognise(text) == expected


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert parity.compare(spark, parity.connect(sf_dir), sf_dir, m.op7_licences, m.OP7) == ""


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = "x\nReleased under the MIT License.\ny"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "word " * 400_000 + ".\n" + text)], "doc_id long, text string").withColumn("licences", F.lit(1)).withColumn("rule", F.lit(1))
    found = m.scan_licences(docs).select("doc_id", F.inline("licences")).collect()
    assert [(r.doc_id, r.rule) for r in found] == [(None, "mit-released"), (3, "mit-released"), (3, "mit-released"), (4, "mit-released")]
    assert m.scan_licences(docs.limit(0)).count() == 0
