"""License scans by ordered signature rules, in built-in functions only.

A text is folded to its words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z) with one space before,
between and after. A text is looked at only if it passes gates that every rule's matches pass; a rule runs only if the
folded text holds its keyword. A rule's pattern matches whole words. Rules are SPDX tags, the wording of notices and licence texts, names in
sentence frames, and abbreviations, in this order. Of detections, one that lies within the interval of another of higher
priority (or of the same rule order and longer) is suppressed.

A long folded text is looked at in blocks of BLOCK characters, each with REACH more on both sides, and a block gives the
detections that begin in it; no match is longer than REACH. So the time grows with the text's length, not with the
square of its detections.

Null and empty texts have no words and no labels. Repeated rows are scanned alike; an empty table gives an empty
result. A text's detections stay in its row: no shuffle. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def other_than(*ranges: tuple[int, int]) -> str:
    """A word pattern of all but these characters, each of them named: Java then looks one up instead of comparing ranges."""
    return "[^" + "".join(f"\\x{c:02X}" for low, high in ranges for c in range(low, high + 1)) + "]++"


WORD = other_than((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WORD_ANY_CASE = other_than((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
BLOCK, REACH = 16384, 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Single words, or parts of them, as they stand in the raw lower-cased text: every match of a rule holds one of these, or
#: CC_BY. Phrases would miss words parted by line breaks or signs.
GATES = [
    "licen", "spdx", "reserved", "domain", "commons", "creativecommons", "cc0", "gpl", "copyleft", "hereby", "permission", "redistribution", "advertising",
    "endorse", "apache", "bsd", "mpl", "eupl", "cddl", "altered", "psf", "deed", "warranty",
]
CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"

#: label, keyword, name as folded words (a regular expression), confidence of a bare mention
FAMILIES = [
    ("apache-2.0", "apache", "apache (?:software )?license version 2(?: 0)?|apache license 2(?: 0)?|apache 2(?: 0)? license", 0.9),
    ("apache-1.1", "apache", "apache (?:software )?license version 1 1|apache license 1 1", 0.9),
    ("apache", "apache", "apache (?:software )?license", 0.7),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", 0.9),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 2 1", 0.9),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?", 0.9),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", 0.7),
    ("gpl-1.0", "general", "(?:gnu )?general public license(?: version| v)? 1(?: 0)?", 0.9),
    ("gpl-2.0", "general", "(?:gnu )?general public license(?: version| v)? 2(?: 0)?", 0.9),
    ("gpl-3.0", "general", "(?:gnu )?general public license(?: version| v)? 3(?: 0)?", 0.9),
    ("gpl", "general", "(?:gnu )?general public license", 0.7),
    ("fdl", "documentation", "(?:gnu )?free documentation license(?: version)?(?: 1 [1-3])?", 0.8),
    ("mit", "mit", "(?:mit|mit x11|mit expat) license", 0.9),
    ("bsd-2-clause", "bsd", "(?:2 clause|simplified|freebsd) bsd license|bsd 2 clause license", 0.9),
    ("bsd-3-clause", "bsd", "(?:3 clause|new|revised|modified) bsd license|bsd 3 clause license", 0.9),
    ("bsd-4-clause", "bsd", "(?:4 clause|original) bsd license|bsd 4 clause license", 0.9),
    ("bsd", "bsd", "bsd license", 0.6),
    ("isc", "isc", "isc license", 0.8),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1", 0.9),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?", 0.9),
    ("mpl", "mozilla", "mozilla public license", 0.7),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", 0.9),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", 0.9),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version)?(?: 1 0)?", 0.9),
    ("eupl-1.2", "union", "european union public licen[cs]e(?: version| v)?(?: 1 [12])?", 0.9),
    ("artistic-2.0", "artistic", "artistic license(?: version)?(?: 2(?: 0)?)?", 0.8),
    ("zlib", "zlib", "zlib(?: libpng)? license", 0.8),
    ("boost-1.0", "boost", "boost software license(?: version)?(?: 1 0)?", 0.9),
    ("python-2.0", "python", "python (?:software foundation )?license(?: version)?(?: 2(?: 0)?)?", 0.8),
    ("unlicense", "unlicense", "unlicense", 0.6),
    ("wtfpl", "want", "do what the f\\w* you want to public license", 0.9),
    ("ofl-1.1", "sil", "sil open font license(?: version)?(?: 1 [01])?", 0.9),
    ("odbl-1.0", "database", "open (?:data commons )?database license(?: 1 0)?", 0.8),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.7),
    ("cc-by-4.0", "cc", "cc by 4 0", 0.9),
    ("cc-by-3.0", "cc", "cc by 3 0", 0.9),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", 0.9),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", 0.9),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", 0.9),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", 0.9),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", 0.9),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", 0.9),
    ("cc-by", "creative", "creative commons attribution(?: (?:4|3) 0)?(?: international| unported)?(?: license)?", 0.7),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: (?:4|3) 0)?(?: international| unported)?(?: license)?", 0.8),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: (?:4|3) 0)?(?: international| unported)?(?: license)?", 0.8),
    ("public-domain", "public", "(?:in|into|to) the public domain", 0.6),
    ("all-rights-reserved", "reserved", "all rights reserved", 0.5),
]
#: how a name may stand in a text, from the surest to the least: pattern around the name, confidence (0: the bare mention's)
FRAMES = [
    ("spdx license identifier (?:{})", 1.0),
    ("(?:this (?:work|file|program|software|project) is )?(?:dual )?(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:{})", 0.98),
    ("under the terms (?:and conditions )?of (?:the )?(?:{})", 0.95),
    ("(?:subject to|governed by|covered by) (?:the )?(?:{})", 0.93),
    ("(?:see|read) (?:the )?(?:{})", 0.75),
    ("(?:{})", 0.0),
]


#: SPDX short identifiers, lower-cased.
SPDX = (
    "mit mit-0 x11 isc 0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsd-source-code "
    "apache-1.0 apache-1.1 apache-2.0 gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later "
    "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later "
    "gfdl-1.1 gfdl-1.1-only gfdl-1.1-or-later gfdl-1.2 gfdl-1.2-only gfdl-1.2-or-later gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later "
    "mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 cpl-1.0 eupl-1.1 eupl-1.2 artistic-1.0 artistic-2.0 zlib libpng bsl-1.0 psf-2.0 python-2.0 unlicense wtfpl "
    "ofl-1.0 ofl-1.1 odbl-1.0 pddl-1.0 odc-by-1.0 ms-pl ms-rl ncsa postgresql openssl curl ruby vim php-3.01 w3c afl-3.0 osl-3.0 ecl-2.0 upl-1.0 blueoak-1.0.0 mulanpsl-2.0 cc0-1.0 "
    "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 "
    "cc-by-nd-2.0 cc-by-nd-2.5 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nc-nd-2.0 cc-by-nc-nd-2.5 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0"
).split()
#: from the longest: an alternation takes the first that fits
SPDX_WORDS = sorted((x.replace("-", " ").replace(".", " ") for x in SPDX), key=lambda x: (-len(x), x))
SPDX_TERM = "(?: (?:" + "|".join(SPDX_WORDS) + ")(?: with [a-z0-9 ]{1,60}? exception(?: [0-9])?(?: [0-9])?)? (?:and|or))?"
#: what stands before an identifier in a tag: up to three others of its expression (Java wants a bound it can see)
SPDX_BEFORE = " spdx license identifier" + 3 * SPDX_TERM



def notices() -> list[tuple[str, str, str, float]]:
    """The notices of the GNU licences, by version, with and without later ones; names that hold others come first."""
    made = []
    kinds = [("agpl", "affero general public license", ["3.0"]), ("lgpl", "(?:lesser|library) general public license", ["2.0", "2.1", "3.0"]), ("gpl", "general public license", ["1.0", "2.0", "3.0"])]
    for short, name, versions in kinds:
        for version in versions:
            n = version.replace(".", " ") if version == "2.1" else version[0] + "(?: 0)?"
            after = "as published by the free software foundation"
            body = f"(?:{name} {after} (?:either |only )?version {n}(?: of the license)?|{name}(?: version| v)? {n} {after})"
            later = f"{body} or(?: at your option)? any later version|{name}(?: version| v)? {n} or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"
            made.append((f"{short}-{version}-or-later", " general public license ", later, 0.99))
            made.append((f"{short}-{version}-only", " published by the free software foundation ", f"{body}(?! or)", 0.97))
    return made


def abbreviations() -> list[tuple[str, str, str, float]]:
    """Short names that need no word like license beside them."""
    made = []
    for short, versions in (("agpl", ["3.0"]), ("lgpl", ["2.0", "2.1", "3.0"]), ("gpl", ["1.0", "2.0", "3.0"])):
        for version in versions:
            n = version.replace(".", " ") if version == "2.1" else version[0] + "(?: 0)?"
            said = f"{short}(?: ?v| version)? ?{n}"
            made.append((f"{short}-{version}-or-later", f" {short}", f"{said} or(?: any)? (?:later|newer)(?: version)?", 0.9))
            made.append((f"{short}-{version}-only", f" {short}", f"{said} only", 0.9))
            made.append((f"{short}-{version}", f" {short}", f"(?:gnu )?{said}(?: license)?", 0.8))
        made.append((short, f" {short} ", f"(?:gnu )?{short}(?: license)?", 0.6))
    made += [(f"bsd-{n}-clause", " bsd ", f"bsd {n} clause|{n} clause bsd", 0.8) for n in (2, 3, 4)]
    made += [(f"{x}-{v}.{m}", f" {x}", f"{x}(?: ?v| version)? ?{v} {m}", 0.8) for x, v, m in (("apache", 2, 0), ("apache", 1, 1), ("mpl", 1, 1), ("mpl", 2, 0), ("eupl", 1, 1), ("eupl", 1, 2), ("cddl", 1, 0))]
    made += [("mit", " mit ", "mit licensed|mit style license|expat license", 0.7), ("bsd", " bsd ", "bsd licensed|bsd style license", 0.6), ("isc", " isc ", "isc licensed", 0.7)]
    return made


#: Wording of the licences' own texts and notices: label, keyword as it stands among the words, pattern, confidence.
SENTENCES = [
    ("boost-1.0", " hereby granted ", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.99),
    ("mit", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.97),
    ("mit", " substantial portions ", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.9),
    ("isc", " hereby granted ", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.98),
    ("0bsd", " hereby granted ", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.95),
    ("bsd-4-clause", " advertising materials ", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.97),
    ("bsd-3-clause", " endorse or promote ", "(?:neither the names? of(?: [^ ]{1,40}){1,25}? nor the names? of(?: [^ ]{1,40}){1,8}?|the names? of(?: [^ ]{1,40}){1,25}?) may(?: not)? be used to endorse or promote products derived from this software", 0.95),
    ("bsd-2-clause", " binary form ", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided", 0.95),
    ("bsd", " redistribution ", "redistribution and use(?: of this software)? in source and binary forms(?: with or without modification)?", 0.85),
    ("apache-2.0", " apache ", "(?:www )?apache org licenses license 2 0(?: txt| html)?", 0.98),
    ("apache-2.0", " compliance with the license ", "you may not use this (?:file|work|software|project) except in compliance with the license", 0.9),
    ("apache-2.0", " agreed to in writing ", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("agpl-3.0", " copyleft ", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 0.98),
    ("gpl-3.0", " copyleft ", "the gnu general public license is a free copyleft license for software and other kinds of works", 0.98),
    ("gpl-3.0", " by contrast the gnu ", "by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program", 0.95),
    ("gpl-2.0", " by contrast the gnu ", "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software", 0.95),
    ("lgpl-2.1", " lesser general public license ", "this license the lesser general public license applies to some specially designated software packages", 0.95),
    ("lgpl-3.0", " lesser general public license ", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 0.98),
    ("mpl-2.0", " mpl ", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.97),
    ("mpl-2.0", " incompatible with secondary licenses ", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 0.97),
    ("epl", " eclipse ", "the accompanying program is provided under the terms of this eclipse public license agreement", 0.9),
    ("zlib", " altered source versions ", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("zlib", " express or implied warranty ", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("unlicense", " unencumbered ", "this is free and unencumbered software released into the public domain", 0.98),
    ("wtfpl", " license document ", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 0.98),
    ("ofl-1.1", " open font license ", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", 0.97),
    ("python-2.0", " psf ", "psf is making python available to licensee on an as is basis", 0.97),
    ("cc0-1.0", " creativecommons ", "creativecommons org publicdomain zero 1 0", 0.98),
    ("cc0-1.0", " this deed ", "the person who associated a work with this deed has dedicated the work to the public domain", 0.98),
    *[(f"cc-{x.replace(' ', '-')}-{v}", " creativecommons ", f"creativecommons org licenses {x} {v.replace('.', ' ')}", 0.98) for x in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
]


def signatures() -> list[tuple[str, str, str, float]]:
    """label, keyword, pattern, confidence, in order. A tag's match is the identifier alone: of an expression each counts."""
    tags = [(x, f" {w} ", f"(?:{w})(?<={SPDX_BEFORE} {w})(?!{longer})", 1.0) for x, w, longer in spdx_words()]
    return tags + notices() + SENTENCES


def spdx_words() -> list[tuple[str, str, str]]:
    """Identifier, its words, and what must not follow them: the rest of longer identifiers."""
    words = {x: x.replace("-", " ").replace(".", " ") for x in SPDX}
    return [(x, w, "|".join(o[len(w) :] + " " for o in SPDX_WORDS if o.startswith(w + " ")) or "(?!)") for x, w in words.items()]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, pattern, label, confidence) of every rule, in order: signatures, a frame's rules before the
    next frame's, abbreviations."""
    framed = [(label, f" {keyword} ", frame.format(name), conf or bare) for frame, conf in FRAMES for label, keyword, name, bare in FAMILIES]
    made = [*signatures(), *framed, *abbreviations()]
    return [(k, keyword, f" (?:{pattern})(?= )", label, conf) for k, (label, keyword, pattern, conf) in enumerate(made)]


def folded(text):
    """The text's words, lower-cased A-Z, with one space before, between and after."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def total_length(strings):
    return F.aggregate(strings, F.lit(0), lambda acc, x: acc + F.length(x))


def detections(s):
    """Array of (start, end, priority, label, confidence) before suppression; start and end count characters of s."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(x).alias("x"), F.lit(c).alias("c")) for k, w, p, x, c in rules()])

    def places(r):
        found, between = F.regexp_extract_all(s, r["p"], F.lit(0)), F.split(s, r["p"])

        def place(m, i):
            start = total_length(F.slice(between, 1, i + 1)) + total_length(F.slice(found, 1, i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), r["k"].alias("k"), r["x"].alias("x"), r["c"].alias("c"))

        return F.transform(found, place)

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(s, r["w"]) & ((r["k"] >= len(SPDX)) | F.contains(s, F.lit(" spdx ")))), places))


def suppressed(found):
    def covers(e, d):
        within = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
        return within & ((e["k"] < d["k"]) | ((e["k"] == d["k"]) & (e["end"] - e["start"] > d["end"] - d["start"])))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: covers(e, d)))


def kept_in_blocks(s):
    """The detections of s that are not suppressed, block by block: only those near one another are compared."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / BLOCK).cast("int"))

    def of_block(b):
        first = F.greatest(b * BLOCK - REACH, F.lit(0))
        part = F.substring(s, first + 1, (b + 1) * BLOCK + REACH - first)
        mine = lambda d: (d["start"] + first >= b * BLOCK) & (d["start"] + first < (b + 1) * BLOCK)
        moved = lambda d: F.struct((d["start"] + first).alias("start"), (d["end"] + first).alias("end"), d["k"].alias("k"), d["x"].alias("x"), d["c"].alias("c"))
        # the text and its detections as elements of arrays of one, so that each is computed once
        return F.transform(F.filter(F.flatten(F.transform(F.array(part), lambda t: F.flatten(F.transform(F.array(detections(t)), suppressed)))), mine), moved)

    return F.flatten(F.transform(blocks, of_block))


def spaces(s):
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the places of the base phrases, labels, score, and the kept detections."""
    low = F.lower("text")
    gate = reduce(or_, [F.contains(low, F.lit(g)) for g in GATES]) | (F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(CC_BY)))
    gated = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"), F.when(gate, F.col("text")).alias("gated"))
    s = F.col("s")
    words = gated.select("doc_id", "n_words", F.when(F.col("gated").isNotNull(), folded(F.col("gated"))).alias("s"))
    phrase = F.lit(" (?:" + "|".join(BASE) + ")(?= )")
    looked = words.select(
        "doc_id", "n_words", "s",
        F.when(s.isNotNull(), F.regexp_extract_all(s, phrase, F.lit(0))).alias("base"), F.when(s.isNotNull(), F.split(s, phrase)).alias("between"),
        F.when(s.isNotNull(), kept_in_blocks(s)).alias("kept"),
    )
    n = F.coalesce(F.size("base"), F.lit(0))
    base_labels = F.array_compact(F.array(*[F.when(F.contains(s, F.lit(f" {p} ")), F.lit(x)) for p, x in BASE.items()]))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("kept", lambda d: d["x"]))))
    after = spaces(F.element_at("between", -1)) - 1
    return looked.select(
        "doc_id", "n_words", F.when(n > 0, n).otherwise(0).cast("long").alias("n_base"),
        F.when(n > 0, spaces(F.element_at("between", 1))).cast("long").alias("first_word"),
        F.when(n > 0, F.col("n_words") - after - spaces(F.element_at("base", -1))).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(base_labels), ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["c"])), F.when(n > 0, F.lit(0.5)), F.lit(0.0)).cast("double").alias("score"), "kept",
    )
