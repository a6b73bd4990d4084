"""License detection by ordered signature rules.

A text becomes a line of words (ASCII letters lower-cased, digits and everything
beyond ASCII kept, all else a separator).  Three base phrases are found wherever
their words stand consecutively.  Beside them run a few hundred signature rules: the
product of hand-written license names and hand-written contexts, and sentences from
license bodies and notices.  A rule is tried
only where all its keywords are among the text's words; it searches the whole line.
Every match of a rule contains its keywords (one of each ``a|b``), so none is lost.

Detections overlap: "licensed under the GNU GPL version 3" holds a notice, a name and
a base phrase.  They are taken by priority, then length, then place; a detection
whose interval lies within one already taken is suppressed.  Base phrases are never
suppressed.  ``score`` is the chance that at least one taken detection or base phrase
is right, from the rules' confidences.

Null and empty texts, and texts without words, give no words, no detections, empty
labels and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that do not belong to words become spaces, A-Z become a-z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Base phrases and their labels (fixed values of the contract).
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Keyword (or alternatives), label and pattern of a license's name, in words of the folded line.
NAMES = (
    ("mit", "mit", r"(?:expat )?mit(?: x11)?(?: style)?(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("apache", "apache-2.0", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? 2(?: 0)?"),
    ("apache", "apache-1.1", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? 1 1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: (?:version |v )?[123](?: 0)?)?"),
    ("gplv2", "gpl-2.0", r"gplv2"),
    ("gplv3", "gpl-3.0", r"gplv3"),
    ("general", "gpl-2.0", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version |v )?2(?: 0)?"),
    ("general", "gpl-3.0", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version |v )?3(?: 0)?"),
    ("general", "gpl", r"(?:gnu )?general public licen[cs]e"),
    ("lesser", "lgpl", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version |v )?[23](?: [01])?)?"),
    ("library", "lgpl-2.0", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: (?:version |v )?[23](?: [01])?)?"),
    ("affero", "agpl-3.0", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    ("agpl", "agpl-3.0", r"(?:gnu )?agpl(?: (?:version |v )?3(?: 0)?)?"),
    ("documentation", "gfdl", r"(?:gnu )?free documentation licen[cs]e"),
    ("bsd|freebsd", "bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd", "bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mozilla", "mpl", r"mozilla public licen[cs]e(?: (?:version |v )?[12](?: [01])?)?"),
    ("mpl", "mpl", r"mpl (?:version |v )?[12](?: [01])?"),
    ("eclipse", "epl", r"eclipse public licen[cs]e(?: (?:version |v )?[12](?: 0)?)?"),
    ("epl", "epl", r"epl (?:version |v )?[12](?: 0)?"),
    ("boost", "bsl-1.0", r"boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: (?:version |v )?[12](?: 0)?)?"),
    ("python", "psf", r"python(?: software foundation)? licen[cs]e"),
    ("cddl", "cddl", r"cddl(?: (?:version |v )?1(?: [01])?)?"),
    ("development", "cddl", r"common development and distribution licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: (?:version |v )?1(?: [12])?)?"),
    ("european", "eupl", r"european union public licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ofl", "ofl-1.1", r"(?:sil )?ofl(?: 1 1)?"),
    ("font", "ofl-1.1", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1(?: [01])?)?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("database", "odbl", r"open database licen[cs]e"),
    ("cc0", "cc0-1.0", r"(?:cc )?cc0(?: 1 0)?"),
    ("zero", "cc0-1.0", r"creative commons zero(?: v?1 0)?"),
    ("cc", "cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc", "cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc", "cc-by-nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc", "cc-by-sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc", "cc-by-nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc", "cc-by", r"cc by(?: [1-4] [05])?"),
    ("commons", "cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("commons", "cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("commons", "cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("commons", "cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("commons", "cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("commons", "cc-by", r"creative commons attribution(?: [1-4] [05])?"),
    ("public", "public-domain", r"public domain"),
)

#: Context: kind, priority, confidence, keyword beside the name's (or none), pattern.
CONTEXTS = (
    ("spdx", 60, 0.99, "spdx", r"spdx licen[cs]e identifier {name}"),
    ("notice", 50, 0.97, "under", r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?{name}(?: licen[cs]e)?(?: version [0-9])?"),
    ("terms", 40, 0.9, "terms", r"(?:subject to|under) (?:the )?terms (?:and conditions )?of (?:the )?{name}"),
    ("by", 40, 0.9, "by", r"(?:licen[cs]ed|governed|covered|protected) by (?:the )?{name}"),
    ("field", 30, 0.85, "license|licence", r"licen[cs]e (?:is |type )?(?:the )?{name}"),
    ("name", 10, 0.6, None, r"{name}"),
)

#: Rules that do not come from a name: keyword, label, priority, confidence, pattern.
SINGLE = (
    ("reserved", "reserved", 20, 0.7, r"all rights reserved"),
    ("copyright", "copyright", 5, 0.3, r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("proprietary", "proprietary", 20, 0.8, r"proprietary and confidential"),
    ("permission", "mit", 45, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission", "isc", 45, 0.9, r"permission to use copy modify and or distribute this software for any purpose"),
    ("redistribution", "bsd", 45, 0.9, r"redistribution and use in source and binary forms with or without modification"),
    ("unencumbered", "unlicense", 45, 0.95, r"free and unencumbered software released into the public domain"),
    # Sentences from the bodies and notices of licenses.
    ("anyone", "unlicense", 45, 0.9, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("noninfringement", "mit", 44, 0.8, r"without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("portions", "mit", 45, 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("organization", "bsl-1.0", 46, 0.95, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("retain", "bsd", 45, 0.9, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("reproduce", "bsd", 45, 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("endorse", "bsd-3-clause", 45, 0.95, r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software"),
    ("advertising", "bsd-4-clause", 45, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("compliance", "apache-2.0", 45, 0.9, r"you may not use this file except in compliance with the license"),
    ("unless", "apache-2.0", 45, 0.9, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("program", "gpl", 45, 0.97, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("hope", "gpl", 44, 0.8, r"distributed in the hope that it will be useful but without any warranty"),
    ("verbatim", "gpl", 44, 0.8, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("library", "lgpl", 46, 0.97, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("remotely", "agpl-3.0", 45, 0.9, r"if your software can interact with users remotely through a computer network"),
    ("document", "gfdl", 46, 0.97, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("form", "mpl", 46, 0.97, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("contents", "mpl", 46, 0.97, r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("accompanying", "epl", 46, 0.97, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("altered", "zlib", 45, 0.95, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("origin", "zlib", 45, 0.9, r"the origin of this software must not be misrepresented"),
    ("font", "ofl-1.1", 46, 0.97, r"this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("openssl", "openssl", 45, 0.9, r"this product includes software developed by the openssl project"),
    ("indicate", "cc-by", 45, 0.8, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("contributions", "cc-by-sa", 45, 0.85, r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("modified", "cc-by-nd", 45, 0.85, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("waived", "cc0-1.0", 45, 0.85, r"waived all copyright and related or neighboring rights"),
    ("derivative", "proprietary", 40, 0.5, r"no part of this (?:work|document|software|publication) may be reproduced(?: [^ ]+){1,12} derivative works"),
)

#: Names that are ordinary words count as a license only within a context.
WORDLIKE = {"mit", "public-domain", "unlicense"}
BASE_CONFIDENCE = 0.5


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: frozenset[tuple[bytes, ...]]  # each with its alternatives
    pattern: re.Pattern[bytes]


class Detection(NamedTuple):
    label: str
    first: int
    last: int
    priority: int
    confidence: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules."""

    def rule(label, priority, confidence, keywords, pattern):
        return Rule(label, priority, confidence, frozenset(tuple(k.encode().split(b"|")) for k in keywords if k), re.compile(f"(?<= ){pattern}(?= )".encode()))

    made = [
        rule(label, priority, confidence, {keyword, extra}, context.format(name=f"(?:{name})"))
        for keyword, label, name in NAMES
        for kind, priority, confidence, extra, context in CONTEXTS
        if kind != "name" or label not in WORDLIKE
    ]
    made += [rule(label, priority, confidence, {keyword}, pattern) for keyword, label, priority, confidence, pattern in SINGLE]
    return tuple(made)


@lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[Rule]]:
    """Rules by one of their keywords, and by each of its alternatives."""
    found: dict[bytes, list[Rule]] = {}
    for r in rules():
        for k in min(r.keywords, key=lambda k: (k[0] in (b"under", b"by", b"terms", b"license"), k)):
            found.setdefault(k, []).append(r)
    return found


def _spans(line: bytes, pattern: re.Pattern[bytes]) -> Iterator[tuple[int, int]]:
    """First and last word of every match, overlapping ones included."""
    at, counted, before = 0, 0, 0
    while found := pattern.search(line, at):
        before += line.count(b" ", counted, found.start())
        counted = found.start()
        yield before - 1, before - 1 + line.count(b" ", found.start(), found.end())
        at = found.start() + 1


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Detections that lie within none of higher rank.

    The farthest end of the taken ones, by their starts, is kept in a tree of prefix
    maxima, so that a text with ``n`` detections takes ``n log n`` steps.
    """
    place = {first: i for i, first in enumerate(sorted({d.first for d in found}), 1)}
    farthest = [-1] * (len(place) + 1)
    taken: list[Detection] = []
    for d in sorted(set(found), key=lambda d: (-d.priority, d.first - d.last, d.first, d.label)):
        at, end = place[d.first], -1
        while at:
            end = max(end, farthest[at])
            at &= at - 1
        if end >= d.last:
            continue
        taken.append(d)
        at = place[d.first]
        while at < len(farthest):
            farthest[at] = max(farthest[at], d.last)
            at += at & -at
    return taken


_BASE = [(re.compile(f"(?<= ){phrase}(?= )".encode()), label) for phrase, label in BASE.items()]


def scan_text(text: str | None) -> tuple[int, list[Detection], list[Detection]]:
    """Number of words, base places and taken detections of one text."""
    words = (text or "").encode().translate(_FOLD).split()
    line = b" " + b" ".join(words) + b" "
    base = [Detection(label, *span, 0, BASE_CONFIDENCE) for pattern, label in _BASE for span in _spans(line, pattern)]
    gates = _by_keyword()
    present = gates.keys() & set(words) if len(words) < len(gates) else {k for k in gates if b" " + k + b" " in line}
    found = []
    for gate in sorted(present):
        for r in gates[gate]:
            if all(any(b" " + k + b" " in line for k in either) for either in r.keywords):
                found += [Detection(r.label, *span, r.priority, r.confidence) for span in _spans(line, r.pattern)]
    return len(words), sorted(base, key=lambda d: (d.first, d.last)), sorted(unsuppressed(found), key=lambda d: (d.first, d.last))


_PLACE = "label string, first int, last int, priority int, confidence double"
SCAN = f"n_words bigint, base array<struct<{_PLACE}>>, detections array<struct<{_PLACE}>>, score double"


def scanned(text: Column) -> Column:
    """Struct of the words, base places, detections and score of a text."""
    place = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("priority", pa.int32()), ("confidence", pa.float64())])

    @F.arrow_udf(f"struct<{SCAN.replace(', ', ',').replace(' ', ':').replace('array<struct<', 'array<struct<')}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [scan_text(text.as_py()) for text in batch]
            doubt = []
            for _, base, found in rows:
                rest = 1.0
                for d in base + found:
                    rest *= 1 - d.confidence
                doubt.append(1 - rest)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[d._asdict() for d in base] for _, base, _ in rows], pa.list_(place)),
                    pa.array([[d._asdict() for d in found] for _, _, found in rows], pa.list_(place)),
                    pa.array(doubt, pa.float64()),
                ],
                ["n_words", "base", "detections", "score"],
            )

    return scan(text.cast("string"))
