"""Licence scan with ordered signature rules.

A text is folded to words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single blanks, so line breaks and punctuation
cannot split a match. A rule is a regex with keywords, a label and a priority. One Aho-Corasick pass finds the keywords;
only rules of which a keyword stands in the text run. Detections are ordered by priority, then length, then place; one that
lies inside the interval of a detection before it is suppressed. The labels of base phrases are never suppressed.

Rules come in three layers: signatures of licence texts written out below, notices built from the table of licences
(licensed under, SPDX identifier, named with a version, named), and Creative Commons variants.

Defined results: null and empty texts have no words, no labels, score 0 and null places; overlapping base places all
count; repeated rows and null ids get a row each; a table without rows gives none; a text of any length is taken whole, in
time that grows with its length; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import whole_id

# The phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, names as they read after folding, and versions.
LICENSES = [
    ("apache", ["apache", "apache software"], ["1 0", "1 1", "2 0"]),
    ("mit", ["mit", "expat"], []),
    ("bsd", ["bsd", "berkeley software distribution"], ["2 clause", "3 clause", "4 clause"]),
    ("isc", ["isc"], []),
    ("gpl", ["gpl", "gnu gpl", "gnu general public"], ["1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", ["lgpl", "gnu lesser general public", "gnu library general public"], ["2", "2 1", "3", "3 0"]),
    ("agpl", ["agpl", "gnu affero general public"], ["3", "3 0"]),
    ("gfdl", ["gfdl", "gnu free documentation"], ["1 1", "1 2", "1 3"]),
    ("mpl", ["mpl", "mozilla public"], ["1 0", "1 1", "2 0"]),
    ("epl", ["epl", "eclipse public"], ["1 0", "2 0"]),
    ("cddl", ["cddl", "common development and distribution"], ["1 0", "1 1"]),
    ("cpl", ["common public"], ["1 0"]),
    ("eupl", ["eupl", "european union public"], ["1 1", "1 2"]),
    ("cecill", ["cecill"], ["1 0", "2 0", "2 1"]),
    ("artistic", ["artistic"], ["1 0", "2 0"]),
    ("boost", ["boost software", "bsl"], ["1 0"]),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public"], ["2"]),
    ("ofl", ["sil open font", "ofl"], ["1 0", "1 1"]),
    ("ms-pl", ["ms pl", "microsoft public"], []),
    ("ms-rl", ["ms rl", "microsoft reciprocal"], []),
    ("odbl", ["odbl", "open database"], ["1 0"]),
    ("pddl", ["pddl", "public domain dedication and"], ["1 0"]),
    ("psf", ["psf", "python software foundation"], ["2"]),
    ("php", ["php"], ["3 0", "3 01"]),
    ("ruby", ["ruby"], []),
    ("postgresql", ["postgresql"], []),
    ("openssl", ["openssl"], []),
    ("osl", ["osl", "open software"], ["1 0", "2 1", "3 0"]),
    ("afl", ["afl", "academic free"], ["2 1", "3 0"]),
    ("ecl", ["educational community"], ["1 0", "2 0"]),
    ("ncsa", ["ncsa", "university of illinois"], []),
    ("upl", ["universal permissive"], ["1 0"]),
    ("bsl", ["business source"], ["1 1"]),
    ("sspl", ["sspl", "server side public"], ["1"]),
    ("elastic", ["elastic"], ["2 0"]),
    ("vim", ["vim"], []),
    ("w3c", ["w3c software"], []),
    ("ibm-pl", ["ibm public"], ["1 0"]),
    ("apsl", ["apple public source"], ["1 0", "2 0"]),
    ("spl", ["sun public"], ["1 0"]),
    ("qpl", ["q public", "qpl"], ["1 0"]),
    ("nasa", ["nasa open source"], ["1 3"]),
    ("mulan", ["mulan psl", "mulan permissive software"], ["1", "2"]),
    ("openrail", ["openrail", "bigscience rail"], ["1 0"]),
]

#: Signatures of licence texts: label, keyword, regex over folded words.
SIGNATURES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "deal in", r"to deal in the software without restriction including without limitation the rights"),
    ("mit", "merge publish", r"use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "action of contract", r"whether in an action of contract tort or otherwise arising from"),
    ("mit", "license mit", r"license mit"),
    ("mit", "mit style", r"(?:under|with) (?:a|an) mit style licen[cs]e"),
    ("mit-0", "no attribution", r"mit no attribution"),
    ("x11", "shall not be used", r"shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "isc disclaims", r"isc disclaims all warranties with regard to this software"),
    ("0bsd", "zero clause", r"(?:bsd )?zero clause (?:bsd )?licen[cs]e"),
    ("hpnd", "supporting documentation", r"appear in supporting documentation"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd", "regents", r"the regents of the university of california"),
    ("bsd", "copyright holders and contributors", r"provided by the copyright holders and contributors as is"),
    ("bsd", "bsd style", r"bsd style licen[cs]e"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd", r"freebsd (?:copyright|licen[cs]e)"),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,120}? may be used to endorse or promote products"),
    ("bsd-3-clause", "bsd licen", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-4-clause", "acknowledgement", r"display the following acknowledgement this product includes software developed"),
    ("bsd-4-clause", "original bsd", r"original bsd licen[cs]e"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2(?: 0)?"),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0"),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "agreed to in writing", r"unless required by applicable law or agreed to in writing software"),
    ("apache-2.0", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "published by", r"as published by the free software foundation either version \d(?: \d)? of the license or"),
    ("gpl", "any later version", r"(?:at your option|or) any later version"),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", "copyleft", r"strong copyleft licen[cs]e"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "temple place", r"59 temple place suite 330 boston"),
    ("gpl", "franklin street", r"51 franklin street fifth floor boston"),
    ("gpl", "gnu org", r"www gnu org licenses(?: gpl)?"),
    ("gpl", "gplv", r"gplv(?:1|2|3)"),
    ("gpl-2.0", "june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-classpath", "classpath exception", r"classpath exception"),
    ("gpl-exception", "special exception", r"as a special exception (?:the copyright holders|you may|if you)"),
    ("gpl-linking", "linking this", r"linking this (?:library|program) statically or dynamically with other modules"),
    ("lgpl", "lesser general", r"gnu lesser general public license"),
    ("lgpl", "library general", r"gnu library general public license"),
    ("lgpl", "lgplv", r"lgplv(?:2|3)"),
    ("agpl", "affero", r"gnu affero general public license"),
    ("agpl", "remotely through", r"interacting with it remotely through a computer network"),
    ("gfdl", "free documentation", r"gnu free documentation license"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts"),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "initial developer", r"the initial developer of the original code is"),
    ("npl", "netscape public", r"netscape public licen[cs]e"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public license"),
    ("epl", "eclipse org", r"www eclipse org legal epl"),
    ("epl", "secondary licenses", r"may also be made available under the following secondary licenses"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e"),
    ("cddl", "common development", r"common development and distribution license"),
    ("cddl", "opensolaris license", r"usr src opensolaris license"),
    ("cpl", "common public", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: v?\d(?: \d)?)?"),
    ("eupl", "joinup", r"joinup ec europa eu"),
    ("cecill", "cecill", r"governed by the cecill(?: b| c)? license"),
    ("cecill", "cecill info", r"www cecill info"),
    ("artistic", "artistic", r"the (?:artistic|clarified artistic) licen[cs]e"),
    ("artistic", "same terms as perl", r"under the same terms as perl itself"),
    ("perl", "same terms", r"same terms as the perl 5 programming language"),
    ("boost", "boost", r"distributed under the boost software license"),
    ("boost", "boost org", r"www boost org license 1 0"),
    ("zlib", "as is", r"provided as is without any express or implied warranty"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "in no event will", r"in no event will the authors be held liable for any damages"),
    ("libpng", "libpng", r"this code is released under the libpng license"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "you just do", r"0 you just do what the fuck you want to"),
    ("wtfpl", "wtfpl net", r"www wtfpl net"),
    ("beerware", "beer", r"(?:buy me a beer in return|the beer ware license)"),
    ("ofl", "font software", r"the (?:original version of the )?font software"),
    ("ofl", "reserved font", r"reserved font names?"),
    ("ofl", "scripts sil", r"scripts sil org ofl"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license ms rl"),
    ("ms-eula", "microsoft software", r"microsoft software licen[cs]e terms"),
    ("odbl", "open database", r"made available under the open database license"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("psf", "python software foundation", r"python software foundation license"),
    ("psf", "beopen", r"beopen python open source license agreement"),
    ("php", "php net", r"www php net license"),
    ("php", "includes php", r"this product includes php software"),
    ("ruby", "terms of the gpl", r"either the terms of the gpl or the conditions below"),
    ("postgresql", "postgresql", r"postgresql database management system"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "ssleay", r"original ssleay licen[cs]e"),
    ("osl", "open software license", r"licensed under the open software license"),
    ("afl", "academic free", r"licensed under the academic free license"),
    ("ecl", "educational community", r"licensed under the educational community license"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license"),
    ("upl", "universal permissive", r"the universal permissive license"),
    ("upl", "larger works", r"larger works each as defined below"),
    ("bsl-1.1", "business source", r"business source license"),
    ("bsl-1.1", "change date", r"change date .{1,40}? change license"),
    ("sspl", "server side", r"server side public license"),
    ("elastic", "elastic license", r"subject to the elastic license"),
    ("elastic", "hosted or managed", r"to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause license condition"),
    ("fair-source", "fair source", r"fair source licen[cs]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict)"),
    ("vim", "vim", r"vim is charityware"),
    ("w3c", "w3c", r"w3c software (?:and document )?notice and license"),
    ("ibm-pl", "ibm public", r"ibm public license version 1 0"),
    ("apsl", "apple public", r"apple public source license"),
    ("spl", "sun public", r"sun public license"),
    ("sissl", "sun industry", r"sun industry standards source license"),
    ("qpl", "q public", r"the q public license"),
    ("nasa", "nasa", r"nasa open source agreement"),
    ("mulan", "mulan", r"licensed under mulan psl v2"),
    ("openrail", "openrail", r"(?:creativeml|bigscience|bigcode) openrail"),
    ("llama", "llama", r"llama \d(?: \d)? community license"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("curl", "daniel stenberg", r"copyright (?:.{1,40}? )?daniel stenberg"),
    ("icu", "unicode", r"unicode license agreement data files and software"),
    ("unicode", "unicode", r"unicode inc license agreement"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"the freetype project license"),
    ("imagemagick", "imagemagick", r"imagemagick studio llc"),
    ("jasper", "jasper", r"jasper license version 2 0"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("leptonica", "leptonica", r"leptonica license"),
    ("lucent", "lucent", r"lucent public license"),
    ("lppl", "latex project", r"latex project public license"),
    ("naumen", "naumen", r"naumen public license"),
    ("nokia", "nokia", r"nokia open source license"),
    ("ntp", "ntp", r"ntp license"),
    ("oldap", "openldap", r"the openldap public license"),
    ("oclc", "oclc", r"oclc research public license"),
    ("opengroup", "open group", r"the open group test suite license"),
    ("phorum", "phorum", r"phorum license"),
    ("plexus", "plexus", r"plexus classworlds license"),
    ("python-cnri", "cnri", r"cnri open source (?:gpl compatible )?license agreement"),
    ("rpl", "reciprocal public", r"reciprocal public license"),
    ("ripple", "ripple", r"ripple labs inc"),
    ("rpsl", "realnetworks", r"realnetworks public source license"),
    ("saxpath", "saxpath", r"saxpath license"),
    ("sgi-b", "sgi free", r"sgi free software license b"),
    ("sleepycat", "sleepycat", r"the sleepycat license"),
    ("sql-blessing", "may you do good", r"may you do good and not evil"),
    ("tcl", "the authors hereby", r"the authors hereby grant permission to use copy modify distribute and license this software"),
    ("vostrom", "vostrom", r"vostrom public license"),
    ("watcom", "sybase", r"sybase open watcom public license"),
    ("x-net", "x net", r"x net license"),
    ("xinetd", "xinetd", r"xinetd license"),
    ("zend", "zend", r"zend engine license"),
    ("zpl", "zope", r"zope public license"),
    ("aladdin", "aladdin", r"aladdin free public license"),
    ("blueoak", "blue oak", r"blue oak model license"),
    ("cpal", "common public attribution", r"common public attribution license"),
    ("cua", "cua office", r"cua office public license"),
    ("entessa", "entessa", r"entessa public license"),
    ("eudatagrid", "eu datagrid", r"eu datagrid software license"),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained"),
    ("frameworx", "frameworx", r"frameworx open license"),
    ("intel", "intel", r"intel open source license"),
    ("motosoto", "motosoto", r"motosoto open source license"),
    ("multics", "multics", r"multics license"),
    ("nethack", "nethack", r"nethack general public license"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"dedicated to the public domain"),
    ("public-domain", "copyright", r"no (?:known )?copyright (?:restrictions|protection|in the united states)"),
    ("public-domain", "work of the", r"work of the (?:united states|u s) government"),
    ("crown", "crown copyright", r"crown copyright"),
    ("ogl", "open government", r"open government licen[cs]e"),
    ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", "warranty", r"without (?:even the implied warranty|warranty of any kind)"),
    ("warranty-disclaimer", "merchantability", r"merchantability (?:and|or) fitness for a particular purpose"),
    ("warranty-disclaimer", "as is", r"(?:provided|distributed) (?:on an )?as is (?:basis|without)"),
    ("warranty-disclaimer", "consequential", r"incidental special exemplary or consequential damages"),
    ("warranty-disclaimer", "at your own risk", r"use (?:it|this software) at your own risk"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|distribution) .{0,60}?is strictly prohibited"),
    ("proprietary", "without the prior", r"without the prior written (?:permission|consent) of"),
    ("proprietary", "trade secrets", r"contains (?:the )?trade secrets"),
    ("proprietary", "reverse engineer", r"(?:may not|shall not|not to) (?:decompile disassemble or )?reverse engineer"),
    ("proprietary", "end user", r"end user licen[cs]e agreement"),
    ("proprietary", "evaluation", r"for evaluation purposes only"),
    ("proprietary", "internal use", r"for internal use only"),
    ("proprietary", "not for", r"not for (?:redistribution|resale|commercial use)"),
    ("proprietary", "non transferable", r"non exclusive non transferable licen[cs]e"),
    ("proprietary", "reproduced", r"no part of this .{1,40}? may be reproduced"),
    ("proprietary", "for personal", r"for personal (?:and )?non commercial use only"),
    ("terms", "terms of", r"(?:subject to|by using .{1,40}? agree to) (?:the|our) terms of (?:use|service)"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", "copyright", r"copyright (?:notice|holders?|owners?)"),
    ("copyright", "rights reserved", r"(?:some|no) rights reserved"),
    ("copyright", "licensed material", r"licensed material"),
    ("trademark", "registered trademark", r"(?:is a|are) registered trademarks? of"),
    ("trademark", "respective owners", r"property of their respective owners"),
    ("dual", "dual licensed", r"dual licensed under"),
    ("dual", "either licen", r"(?:under|of) either licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "waived all copyright", r"has waived all copyright and related"),
    ("cc", "creativecommons org", r"creativecommons org (?:licenses|publicdomain) [a-z]+(?: [a-z]{2})*(?: \d \d)?"),
    ("cc", "creative commons", r"creative commons (?:license|licence|licensed)"),
    ("cc", "share alike", r"(?:attribution )?share alike (?:\d \d )?(?:unported|international|generic)"),
    ("cc", "attribution non", r"attribution non ?commercial (?:\d \d )?(?:unported|international|generic)"),
    ("spdx", "spdx", r"spdx license identifier"),
]

#: Creative Commons: variant after "cc" or "creative commons", and label.
COMMONS = [("by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:atives|s)"), ("by sa", "attribution share ?alike"), ("by", "attribution")]


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str


def rules() -> list[Rule]:
    """Every rule; a lower priority number goes first. A match holds one of its keywords at the start of a word."""
    found = [Rule(label, 10, (keyword,), regex) for label, keyword, regex in SIGNATURES]
    for short, full in COMMONS:
        label = f"cc-{short.replace(' ', '-')}"
        found += [Rule(label, 20, (f"cc {short}",), rf"cc {short}(?: \d \d)?"), Rule(label, 20, ("creative commons",), rf"creative commons {full}(?: \d \d)?")]
    for label, names, versions in LICENSES:
        name, word = "|".join(sorted(map(re.escape, names), key=len, reverse=True)), r"licen[cs]e"
        for own in names:
            found.append(Rule(label, 30, (own,), rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{re.escape(own)}(?: {word})?"))
            found.append(Rule(label, 60, (own,), rf"{re.escape(own)} {word}"))
        found.append(Rule(label, 25, ("license identifier",), rf"license identifier (?:{name})(?: \d+)*"))
        for version in versions:
            found.append(Rule(f"{label}-{version.replace(' ', '.').replace('.clause', '-clause')}", 40, tuple(names), rf"(?:{name})(?: {word})?(?: version| v)? {version}(?: {word})?"))
    return found


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


@lru_cache(maxsize=1)
def _compiled():
    every = rules()
    keywords = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(every):
        for word in rule.keywords:
            by_word.setdefault(f" {word}", []).append(i)
    for word, own in by_word.items():
        keywords.add_word(word, own)
    keywords.make_automaton()
    return every, [re.compile(f" (?:{r.regex})(?= )") for r in every], keywords


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that no earlier one (priority, length, place, label) contains.

    The kept ones that no other contains form a staircase, starts and ends both rising, so one search decides.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        low = at - 1 if at and starts[at - 1] == d.start else at
        high = bisect_right(ends, d.end, low)
        starts[low:high], ends[low:high] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def scan(raw: bytes) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words, base places (word, label), and detections as word intervals."""
    words = raw.translate(textkit.NORM).split()
    folded = b" ".join([b"", *words, b""])
    text = folded.decode("latin-1")
    every, regexes, keywords = _compiled()
    due = {i for _, own in keywords.iter(text) for i in own}
    base, spans = [], []
    for phrase, label in BASE.items():
        at = text.find(f" {phrase} ")
        while at >= 0:
            base.append((at, label))
            at = text.find(f" {phrase} ", at + 1)
    for i in sorted(due):
        spans += [(*m.span(), i) for m in regexes[i].finditer(text)]
    if not base and not spans:
        return len(words), [], []
    # a word's number is the number of blanks before it
    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
    places = np.searchsorted(blanks, [at for at, _ in base]).tolist()
    starts, ends = (np.searchsorted(blanks, [x[k] for x in spans]).tolist() for k in (0, 1))
    found = [Detection(a, b, every[i].label, every[i].priority) for a, b, (_, _, i) in zip(starts, ends, spans, strict=True)]
    return len(words), sorted(zip(places, (label for _, label in base), strict=True)), suppress(found)


def _scan(batches):
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])
    schema = pa.schema([
        ("_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(interval)),
    ])
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for raw in textkit.texts(batch.column("_text")):
            n, base, found = scan(raw)
            best = min((d.priority for d in found), default=100)
            score = max(1 - best / 100, 0.5 * bool(base))
            own = {x for _, x in base}
            row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {d.label for d in found})), score, [d._asdict() for d in found])
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        yield textkit.output(schema, [batch.column("_id"), *columns])


_OUT = "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: long, end: long, label: string, priority: int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (word intervals)."""
    rows = docs.select(whole_id(docs, id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_scan, _OUT).withColumnRenamed("_id", id_col)
