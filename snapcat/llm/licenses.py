"""Licences by their sentences.

Known sentences have identifiers. A text is cut into units at line ends and after sentence marks, and a
unit is normalised to lower-case words. Units that spell a known sentence, one alone or several in a row
(wrapped lines, inner marks), become its identifier; other units break nothing. The sequence of identifiers
of a text is matched from its start against ordered rules, sequences of identifiers that stand for a licence:
at each place the first rule that fits is taken, so longer and stricter rules come first. Identifiers of one
rule may have a few other units between them (copyright lines, numbered clauses), ``MOST_APART`` at most.

Besides, SPDX lines and short notices ("This project is licensed under the ...", with a licence's name, several names,
and what follows like "see LICENSE") are read by pattern, over ``MOST_UNITS`` units at most, where no known sentence
starts; a line with several licences gives a finding for each. So are titles, units that are nothing but a licence's
name with the word licence ("BSD 3-Clause License", "License: MIT"), and units like "This code is GPLv3"; a title and
the text of its licence are one finding. A whole unit must fit, so a licence that is only talked about is not found, nor
one whose name ``NAMES`` does not have. A plus after a version means "or later", which only the GNU licences tell apart.

Defined results: null and empty texts have no units and no findings. A sentence that stands twice is found
twice. Equal rows get equal findings. An identifier that no rule begins with at its place is passed over.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents

MOST_APART = 12

#: Known sentences of public licences, by identifier.
SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"),
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."),
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "bsd-name": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights": "All rights reserved.",
}

#: Ordered rules: licence, rule, identifiers in order. The first that fits at a place is taken.
RULES = [
    ("MIT", "mit-text", ["mit-title", "mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", "mit-body", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", "mit-part", ["mit-grant", "mit-notice"]),
    ("MIT", "mit-named", ["mit-title"]),
    ("MIT", "mit-released", ["mit-short"]),
    ("MIT", "mit-licensed", ["mit-licensed"]),
    ("ISC", "isc-body", ["isc-grant"]),
    ("Apache-2.0", "apache-header", ["apache-grant", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", "apache-grant", ["apache-grant"]),
    ("Apache-2.0", "apache-named", ["apache-short"]),
    ("BSD-3-Clause", "bsd-3", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", "bsd-2", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", "gpl-3-header", ["gpl-grant", "gpl-hope"]),
    ("GPL-3.0-or-later", "gpl-3-grant", ["gpl-grant"]),
    ("GPL-2.0-or-later", "gpl-2-header", ["gpl2-grant", "gpl-hope"]),
    ("GPL-2.0-or-later", "gpl-2-grant", ["gpl2-grant"]),
    ("GPL-3.0-only", "gpl-3-named", ["gpl3-short"]),
    ("MPL-2.0", "mpl-2", ["mpl2"]),
    ("Unlicense", "unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", "cc-by-nc-named", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", "cc-by-sa-named", ["cc-by-sa-4"]),
    ("CC-BY-4.0", "cc-by-named", ["cc-by-4"]),
    ("CC-BY-4.0", "cc-by-long", ["cc-by-4-long"]),
    ("CC0-1.0", "cc0", ["cc0"]),
    ("Proprietary", "all-rights", ["all-rights"]),
]

#: Grants of the GNU licences by name and version, titles of whole licence texts; sentence, licence, rule.
GNU = [("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"), ("LGPL", "Lesser General Public License", "2.1"),
       ("LGPL", "Lesser General Public License", "3"), ("LGPL", "Library General Public License", "2"), ("AGPL", "Affero General Public License", "3")]
MORE = [
    *((f"This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software "
       f"Foundation{either} version {v} of the License{later}.", f"{name}-{v if '.' in v else v + '.0'}-{which}", "gnu-grant")
      for name, title, v in GNU for it in ("program", "library", "file", "software")
      for either, later, which in (("; either", ", or (at your option) any later version", "or-later"), (",", "", "only"), (";", "", "only"), ("; only", "", "only"))),
    ("Apache License Version 2.0, January 2004", "Apache-2.0", "text-title"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0-only", "text-title"),
    ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-2.0-only", "text-title"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "LGPL-3.0-only", "text-title"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPL-2.1-only", "text-title"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "AGPL-3.0-only", "text-title"),
    ("Mozilla Public License Version 2.0", "MPL-2.0", "text-title"),
    ("Eclipse Public License - v 2.0", "EPL-2.0", "text-title"),
    ("Eclipse Public License - v 1.0", "EPL-1.0", "text-title"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0", "text-title"),
]

V, L = r"(?: licen[cs]e)?(?: \w?gpl| mpl| epl)?(?: version| v)? ?v?", r"(?: licen[cs]e)?"
#: Names of licences as they are normalised, by pattern.
NAMES = [
    (r"(?:mit|expat|mit x11)" + L, "MIT"), (r"isc" + L, "ISC"), (r"zlib" + L, "Zlib"), (r"wtfpl" + L, "WTFPL"), (r"(?:the )?unlicense", "Unlicense"),
    (r"(?:apache(?: software)?|asl)" + V + r"2(?: 0)?" + L, "Apache-2.0"),
    (r"(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd)" + L, "BSD-2-Clause"),
    (r"(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)" + L, "BSD-3-Clause"), (r"0bsd|bsd zero clause" + L, "0BSD"),
    *((rf"(?:gnu )?(?:{short}|{long} public)" + V + v.replace(".", " ") + (r"(?: 0)?" if "." not in v else "") + r"(?: of the licen[cs]e)?" + L + late, f"{name}-{v if '.' in v else v + '.0'}-{which}")
      for name, short, long in (("AGPL", "agpl", "affero general"), ("LGPL", "lgpl", "(?:lesser|library) general"), ("GPL", "gpl", "general"))
      for v in ("2.1", "2", "3") if (v == "3" or name != "AGPL") and (v != "2.1" or name == "LGPL")
      for late, which in ((r"(?: or (?:any )?later(?: versions?)?| or at your option any later version)", "or-later"), (r"(?: only)?", "only"))),
    (r"(?:mozilla public|mpl)" + V + r"2(?: 0)?" + L, "MPL-2.0"), (r"(?:mozilla public|mpl)" + V + r"1 1" + L, "MPL-1.1"),
    (r"(?:eclipse public|epl)" + V + r"2(?: 0)?" + L, "EPL-2.0"), (r"(?:eclipse public|epl)" + V + r"1(?: 0)?" + L, "EPL-1.0"),
    (r"(?:european union public|eupl)" + V + r"1 2" + L, "EUPL-1.2"), (r"(?:common development and distribution|cddl)" + V + r"1 0" + L, "CDDL-1.0"),
    (r"(?:boost software" + V + r"(?:1 0)?|bsl 1 0)" + L, "BSL-1.0"), (r"(?:business source" + V + r"1 1|busl 1 1)" + L, "BUSL-1.1"),
    (r"artistic" + V + r"2(?: 0)?" + L, "Artistic-2.0"), (r"(?:creative commons zero|cc0)" + V + r"(?:1 0)?(?: universal)?" + L, "CC0-1.0"),
    *((rf"(?:creative commons|cc)(?: {a}| {b})(?: cc {a})?(?: licen[cs]e)?(?: version| v)? ?v?{v[0]} {v[2]}(?: international| unported| generic)?(?: public)?" + L, f"CC-{a.replace(' ', '-').upper()}-{v}")
      for a, b in (("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"),
                   ("by nd", "attribution no ?deriv(?:ative)?s"), ("by sa", "attribution share ?alike"), ("by", "attribution"))
      for v in ("4.0", "3.0", "2.5", "2.0")),
]
NAMED = [(re.compile(rf"(?:the |an? )?(?:{pattern})(?= |$)"), licence) for pattern, licence in NAMES]
THING = r"project|software|program|library|package|code|work|files?|repository|document|documentation|module|plugin|tool|app|application|content|contents|product|component|framework|book|text|article|dataset|data|material|site|website|crate|gem"
SPDX = re.compile(r"spdx licen[cs]e identifier ")
NOTICE = re.compile(
    rf"(?:(?:(?:this|the|all|our|its|any) )?(?:\w+ ){{0,4}}?(?:{THING}) (?:is|are) (?:free software |open source |also |hereby |dual |both |and )*)?"
    r"(?:made )?(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed) (?:under|by) (?:(?:the )?terms(?: and conditions)? of )?(?:either |both )?")
#: What may follow the names of a notice.
FOLLOWS = re.compile(r"(?: (?:see|for|as|which|that|please|found|included|in|with|copyright|c|a copy|https?|at your option|unless)(?: .*)?)?$")
#: Cheap test for texts and units that may have a notice.
HINT = re.compile(r"spdx|(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed)\s+(?:\W*\s)?(?:under|by)\s", re.IGNORECASE)
NOTICE_OPENS = re.compile(rf"^(?:licen[cs]ed|released|distributed|available)|(?:^| )(?:{THING})(?: is| are|$)")
#: Units, and characters, that a notice runs over at most.
MOST_UNITS, MOST_NOTICE = 4, 600


#: A plus that ends a version; a title, and a unit that says what licence a thing is.
PLUS = re.compile(r"(?<=\d)\+(?![\w+])")
TITLE = re.compile(r"(?:licen[cs]e )?(?:the )?")
IS_UNDER = re.compile(rf"(?:this|the) (?:{THING}) is (?:an? )?(?=\w)")
TITLED = re.compile(r"licen[cs]e|\bis\b", re.IGNORECASE)


def longest_name(words: str, at: int) -> tuple[int, str] | None:
    """Where the longest licence name that stands at a place ends, and which licence it is."""
    end, licence = max(((m.end(), licence) for p, licence in NAMED if (m := p.match(words, at))), key=lambda x: x[0], default=(0, None))
    if licence is None:
        return None
    # Licences without a form for later versions.
    later = " or later"
    return end + len(later) * words.startswith(later, end), licence


def titled(words: str) -> str | None:
    """Identifier of the licence that normalised words are a title of, or say that a thing is."""
    for head, kind in ((IS_UNDER, "notice"), (TITLE, "title")):
        if (m := head.match(words)) and (kind == "notice" or "licen" in words) and (own := longest_name(words, m.end())) and own[0] == len(words):
            return f"{kind} {own[1]}"
    return None


def noticed(words: str) -> list[str]:
    """Identifiers of the licences that an SPDX line or a notice in normalised words names; none if it is neither."""
    spdx = SPDX.match(words)
    if not (head := spdx or NOTICE.match(words)):
        return []
    at, found = head.end(), []
    while True:
        if (own := longest_name(words, at)) is None:
            return []
        at = own[0]
        found.append(f"{'spdx' if spdx else 'notice'} {own[1]}")
        more = re.compile(r" (?:or|and)(?: under)? ").match(words, at)
        if more is None:
            return found if FOLLOWS.match(words, at) else []
        at = more.end()


#: Sentences above keep their identifiers and rules.
KNOWN = {" ".join(re.findall(r"[^\W_]+", x.lower())) for x in SENTENCES.values()}
MORE = [x for x in MORE if " ".join(re.findall(r"[^\W_]+", x[0].lower())) not in KNOWN]
SENTENCES |= {text: text for text, _, _ in MORE}
RULES += [(licence, rule, [text]) for text, licence, rule in MORE]
RULES += [(licence, kind, [f"{kind} {licence}"]) for licence in sorted({x for _, x in NAMES}) for kind in ("spdx", "notice", "title")]
# Titles before a text belong to it.
RULES[:0] = [(licence, rule, [f"title {licence}", *ids]) for licence, rule, ids in RULES if rule in ("mit-body", "mit-part", "isc-body", "bsd-3", "bsd-2")]

#: Units end at line ends, and after a sentence mark before white space.
UNIT = re.compile(r"\n+|(?<=[.!?;:])\s+")
WORD = re.compile(r"[^\W_]+")
FINDING = "array<struct<licence:string,rule:string,first_unit:int,last_unit:int>>"
FINDING_ARROW = pa.list_(pa.struct([("licence", pa.string()), ("rule", pa.string()), ("first_unit", pa.int32()), ("last_unit", pa.int32())]))


def normalised(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


class Sentences:
    """Identifiers by normalised sentence, and all beginnings of sentences, for spelling over several units."""

    def __init__(self, sentences: dict[str, str]):
        self.ids = {normalised(s): name for name, s in sentences.items()}
        self.beginnings = set()
        for s in self.ids:
            words = s.split(" ")
            self.beginnings.update(" ".join(words[:k]) for k in range(1, len(words) + 1))
        #: First words in the spellings a text may have them, to pass over units quickly.
        self.openers = {s.split(" ")[0] for s in self.ids}

    def recognise(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, first unit, last unit) in order. The longest sentence that starts with a unit is taken."""
        units, found, i = UNIT.split(text), [], 0
        spelled: dict[int, str] = {}
        hinted = bool(HINT.search(text))

        def words(k: int) -> str:
            if k not in spelled:
                spelled[k] = normalised(units[k])
            return spelled[k]

        def later(k: int) -> str:
            return normalised(PLUS.sub(" or later", units[k])) if "+" in units[k] else words(k)

        def title(k: int) -> tuple[str, int, int] | None:
            # "License:" and the name after it are two units.
            last = k + (words(k) in ("license", "licence") and units[k].endswith(":") and k + 1 < len(units))
            own = titled(" ".join(later(j) for j in range(k, last + 1)))
            return (own, k, last) if own else None

        while i < len(units):
            head = WORD.search(units[i])
            best = None
            if head and head[0].lower() in self.openers:
                joined = words(i)
                k = i
                while joined in self.beginnings:
                    if joined in self.ids:
                        best = (self.ids[joined], i, k)
                    k += 1
                    while k < len(units) and not words(k):
                        k += 1
                    if k == len(units):
                        break
                    joined += " " + words(k)
            if best:
                found.append(best)
                i = best[2]
            elif head and TITLED.search(units[i]) and (own := title(i)):
                found.append(own)
                i = own[2]
            elif hinted and head and ("spdx" in words(i) or " under" in words(i) + " " or " by" in words(i) + " " or NOTICE_OPENS.search(words(i))):
                joined, last = "", None
                for k in range(i, min(i + MOST_UNITS, len(units))):
                    joined = f"{joined} {later(k)}".strip()
                    if len(joined) > MOST_NOTICE:
                        break
                    if words(k) and (own := noticed(joined)):
                        last = own, k
                if last:
                    found.extend((x, i, last[1]) for x in last[0])
                    i = last[1]
            i += 1
        return found


def match(found: list[tuple[str, int, int]], rules: dict[str, list[tuple]], apart: int = MOST_APART) -> list[dict]:
    """Licences of a sequence of identifiers; ``rules`` by first identifier, in order."""
    out, i = [], 0
    while i < len(found):
        step = 1
        for licence, rule, ids in rules.get(found[i][0], ()):
            own = found[i : i + len(ids)]
            if [x[0] for x in own] == ids and all(b[1] - a[2] <= apart + 1 for a, b in zip(own, own[1:], strict=False)):
                out.append({"licence": licence, "rule": rule, "first_unit": own[0][1], "last_unit": own[-1][2]})
                step = len(ids)
                break
        i += step
    return out


def by_first(rules: list[tuple]) -> dict[str, list[tuple]]:
    out = defaultdict(list)
    for rule in rules:
        out[rule[2][0]].append(rule)
    return dict(out)


def scan_licences(docs: DataFrame, text_col: str = "text", to: str = "licences", sentences: dict[str, str] | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """Adds ``to``: the licences found in the whole text, in order, each with its rule and units."""
    known, ordered = sentences or SENTENCES, by_first(rules or RULES)

    @F.arrow_udf(FINDING)
    def licences(texts: pa.Array) -> pa.Array:
        table = Sentences(known)
        return pa.array([match(table.recognise(t), ordered) if (t := x.as_py()) else [] for x in texts], FINDING_ARROW)

    # So that the findings are not looked for a second time to pass over rows without any.
    return docs.withColumn(to, licences.asNondeterministic()(F.col(text_col)))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence found in any document."""
    found = scan_licences(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.inline("licences"))


#: On texts whose known sentences stand in one unit each, which is how the given documents have them.
OP7 = r"""
WITH unit AS (
    SELECT doc_id, unnest(range(0, len(u))) AS k, unnest(u) AS unit FROM (
        SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(10), 'g'), '\n+') AS u FROM documents)
), spelled AS (
    SELECT doc_id, k, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM unit
), named(s, licence, rule) AS (
    VALUES ('released under the mit license', 'MIT', 'mit-released'),
        ('licensed under the mit license', 'MIT', 'mit-licensed'),
        ('licensed under the apache license version 2 0', 'Apache-2.0', 'apache-named'),
        ('this work is licensed under the gnu general public license version 3', 'GPL-3.0-only', 'gpl-3-named'),
        ('licensed under cc by nc 4 0', 'CC-BY-NC-4.0', 'cc-by-nc-named'),
        ('licensed under cc by sa 4 0', 'CC-BY-SA-4.0', 'cc-by-sa-named'),
        ('licensed under cc by 4 0', 'CC-BY-4.0', 'cc-by-named'),
        ('all rights reserved', 'Proprietary', 'all-rights')
)
SELECT doc_id, licence, rule, CAST(k AS INTEGER) AS first_unit, CAST(k AS INTEGER) AS last_unit FROM spelled JOIN named USING (s)
"""

QUERIES = {"op7_licences": op7_licences}
ORACLES = {"op7_licences": OP7}
