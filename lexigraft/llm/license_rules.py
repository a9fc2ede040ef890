"""License scan by ordered signature rules.

Each rule is a regular expression over the lower-cased text with a priority and
a weight. There are two sorts: signatures, sentences of license texts, headers
and notices word by word, whatever stands between the words (so comment marks
and line ends don't matter), and names in frames such as "licensed under ...".
A rule is tried if the text, with one space for any white space, holds its
keywords, which every match does. A match that lies within one of a smaller
priority number, or within a longer one of the same, is dropped, so "licensed
under the apache license, version 2.0" is one detection. Four base phrases are
counted besides, word by word. All of it is linear in a text's matches, but for
a sort.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import counts, slices

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, SPDX id, keywords one of which is in every match, and the ways to write the name (regular expressions, lower case, one space for any white space).
NAMES = (
    ("mit", "MIT", "mit|expat licen", r"mit license|mit licence|expat license|mit"),
    ("apache-2.0", "Apache-2.0", "apache", r"apache license,? (?:version |v\.? ?)?2(?:\.0)?|apache[- ]2(?:\.0)?"),
    ("apache-1.1", "Apache-1.1", "apache", r"apache (?:software )?license,? (?:version |v\.? ?)?1\.1"),
    ("apache", "Apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("gpl-2.0", "GPL-2.0", "gnu general public|gpl", r"gnu general public license,? (?:version |v\.? ?)2(?:\.0)?|gnu gpl ?v?2|gpl[- ]?v?2(?:\.0)?"),
    ("gpl-3.0", "GPL-3.0", "gnu general public|gpl", r"gnu general public license,? (?:version |v\.? ?)3(?:\.0)?|gnu gpl ?v?3|gpl[- ]?v?3(?:\.0)?"),
    ("gpl", "GPL", "gnu general public|gpl", r"gnu general public licen[sc]e|gnu gpl|gpl"),
    ("lgpl-2.1", "LGPL-2.1", "general public|lgpl", r"gnu (?:lesser|library) general public license,? (?:version |v\.? ?)2\.1|lgpl[- ]?v?2\.1"),
    ("lgpl-3.0", "LGPL-3.0", "general public|lgpl", r"gnu lesser general public license,? (?:version |v\.? ?)3(?:\.0)?|lgpl[- ]?v?3(?:\.0)?"),
    ("lgpl", "LGPL", "general public|lgpl", r"gnu (?:lesser|library) general public license|lgpl"),
    ("agpl-3.0", "AGPL-3.0", "gnu affero|agpl", r"gnu affero general public license(?:,? (?:version |v\.? ?)3(?:\.0)?)?|agpl[- ]?v?3(?:\.0)?|agpl"),
    ("bsd-2-clause", "BSD-2-Clause", "bsd", r"(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd(?: license)?|bsd[- ]2[- ]clause(?: license)?"),
    ("bsd-3-clause", "BSD-3-Clause", "bsd", r"(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd(?: license)?|bsd[- ]3[- ]clause(?: license)?"),
    ("bsd-4-clause", "BSD-4-Clause", "bsd", r"(?:original|4[- ]clause) bsd(?: license)?|bsd[- ]4[- ]clause(?: license)?"),
    ("bsd", "BSD", "bsd", r"bsd[- ]style license|bsd licen[sc]e"),
    ("mpl-2.0", "MPL-2.0", "mozilla public|mpl2|mpl 2|mpl-2", r"mozilla public license,? (?:version |v\.? ?)?2(?:\.0)?|mpl[- ]?2(?:\.0)?"),
    ("mpl-1.1", "MPL-1.1", "mozilla public|mpl1|mpl 1|mpl-1", r"mozilla public license,? (?:version |v\.? ?)?1\.1|mpl[- ]?1\.1"),
    ("mpl", "MPL", "mozilla public", r"mozilla public licen[sc]e"),
    ("epl-1.0", "EPL-1.0", "eclipse public|epl1|epl 1|epl-1", r"eclipse public license,?(?: -)? (?:version |v\.? ?)?1(?:\.0)?|epl[- ]?1(?:\.0)?"),
    ("epl-2.0", "EPL-2.0", "eclipse public|epl2|epl 2|epl-2", r"eclipse public license,?(?: -)? (?:version |v\.? ?)?2(?:\.0)?|epl[- ]?2(?:\.0)?"),
    ("cddl-1.0", "CDDL-1.0", "common development and|cddl", r"common development and distribution license(?:,? (?:version |v\.? ?)?1(?:\.0)?)?|cddl"),
    ("cpl-1.0", "CPL-1.0", "common public", r"common public license(?:,? (?:version |v\.? ?)?1(?:\.0)?)?"),
    ("isc", "ISC", "isc licen", r"isc licen[sc]e"),
    ("zlib", "Zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("unlicense", "Unlicense", "unlicense", r"the unlicense|unlicense"),
    ("wtfpl", "WTFPL", "what the fuck|wtfpl", r"do what the fuck you want to public license|wtfpl"),
    ("bsl-1.0", "BSL-1.0", "boost software", r"boost software license(?:,?(?: -)? (?:version )?1\.0)?"),
    ("artistic-2.0", "Artistic-2.0", "artistic license", r"artistic license(?:,? (?:version )?2\.0)?"),
    ("afl-3.0", "AFL-3.0", "academic free", r"academic free license(?:,? (?:version |v\.? ?)?3(?:\.0)?)?"),
    ("osl-3.0", "OSL-3.0", "open software license", r"open software license(?:,? (?:version |v\.? ?)?3(?:\.0)?)?"),
    ("eupl-1.2", "EUPL-1.2", "european union public|eupl", r"european union public licen[sc]e(?:,? (?:version |v\.? ?)?1\.2)?|eupl"),
    ("ms-pl", "MS-PL", "microsoft public", r"microsoft public license"),
    ("ms-rl", "MS-RL", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("postgresql", "PostgreSQL", "postgresql licen", r"postgresql licen[sc]e"),
    ("python-2.0", "Python-2.0", "python software foundation|psf license", r"python software foundation license(?:,? version 2)?|psf license"),
    ("php-3.01", "PHP-3.01", "php license", r"php license(?:,? version 3\.01)?"),
    ("openssl", "OpenSSL", "openssl license", r"openssl license"),
    ("ncsa", "NCSA", "ncsa", r"university of illinois/ncsa open source license|ncsa license"),
    ("ofl-1.1", "OFL-1.1", "open font license", r"sil open font license(?:,? (?:version )?1\.1)?"),
    ("odbl-1.0", "ODbL-1.0", "open database license", r"open (?:data commons open )?database license(?:,? v?1\.0)?"),
    ("odc-by-1.0", "ODC-By-1.0", "open data commons", r"open data commons attribution license(?:,? v?1\.0)?"),
    ("gfdl", "GFDL", "free documentation license", r"gnu free documentation license(?:,? version 1\.[123])?"),
    ("cc0-1.0", "CC0-1.0", "cc0|creative commons zero", r"cc0(?:[- ]1\.0)?(?: universal)?|creative commons zero"),
    ("cc-by-nc-nd", "CC-BY-NC-ND", "cc by|cc-by|creative commons attribution", r"cc[- ]by[- ]nc[- ]nd(?: [1-4]\.[05])?|creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: [1-4]\.[05])?"),
    ("cc-by-nc-sa", "CC-BY-NC-SA", "cc by|cc-by|creative commons attribution", r"cc[- ]by[- ]nc[- ]sa(?: [1-4]\.[05])?|creative commons attribution[- ]non-?commercial[- ]share-?alike(?: [1-4]\.[05])?"),
    ("cc-by-nc", "CC-BY-NC", "cc by|cc-by|creative commons attribution", r"cc[- ]by[- ]nc(?: [1-4]\.[05])?|creative commons attribution[- ]non-?commercial(?: [1-4]\.[05])?"),
    ("cc-by-nd", "CC-BY-ND", "cc by|cc-by|creative commons attribution", r"cc[- ]by[- ]nd(?: [1-4]\.[05])?|creative commons attribution[- ]no-?deriv(?:ative)?s?(?: [1-4]\.[05])?"),
    ("cc-by-sa", "CC-BY-SA", "cc by|cc-by|creative commons attribution", r"cc[- ]by[- ]sa(?: [1-4]\.[05])?|creative commons attribution[- ]share-?alike(?: [1-4]\.[05])?"),
    ("cc-by", "CC-BY", "cc by|cc-by|creative commons attribution", r"cc[- ]by(?: [1-4]\.[05])?|creative commons attribution(?: [1-4]\.[05])?"),
    ("public-domain", "LicenseRef-public-domain", "public domain", r"public domain"),
    ("proprietary", "LicenseRef-proprietary", "all rights reserved", r"all rights reserved"),
)

#: Kind, priority (smaller first), weight, keywords one of which is in the text of every match, pattern around a name.
FRAMES = (
    ("spdx", 0, 1.0, "spdx-license-identifier:", r"spdx-license-identifier: {id}(?:-only|-or-later|\+)?(?:-[1-4]\.[05])?"),
    ("granted", 2, 0.95, " under ", r"(?:re)?(?:licen[sc]ed|released|distributed|available|published|provided|made available) (?:to you )?under (?:the )?(?:terms of )?(?:the |a )?(?:{name})(?: licen[sc]e)?"),
    ("governed", 3, 0.9, "to the |by the |see the |of the ", r"(?:subject to|governed by|covered by|see|terms of) the (?:{name})(?: licen[sc]e)?"),
    ("field", 4, 0.85, "license:|license :|license=|license =|licence:|licence :|licence=|licence =", r"licen[sc]e ?[:=] ?[\"'\(]?(?:{name})"),
    ("named", 5, 0.6, " licen| for details| for more details", r"(?:{name}) licen[sc]e|the (?:{name})(?= for (?:more )?details)"),
    ("bare", 6, 0.4, "", r"(?:{name})"),
)
#: Label and a sentence of the license, as words; a bar parts words either of which may stand there, a question mark follows a word that may be missing.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("isc", "permission to use copy modify and|or or? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license at http|https www apache org licenses license 2 0"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3.0", "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "when we speak of free software we are referring to freedom not price"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-2.1", "under the terms of the gnu lesser|library general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "you should have received a copy of the gnu lesser|library general public license along with this library"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license agreement"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("python-2.0", "psf is making python available to licensee on an as is basis"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "this source file is subject to version 3 01 of the php license"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("eupl-1.2", "licensed under the eupl version 1 2"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "creative commons corporation is not a law firm and does not provide legal services"),
    ("odbl-1.0", "this database is made available under the open database license"),
    ("public-domain", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("public-domain", "has been placed in|into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means"),
)
SIGNATURE_PRIORITY, SIGNATURE_WEIGHT = 1, 0.97
#: Names that are ordinary words when no frame stands around them.
NO_BARE = {"mit", "gpl", "public-domain", "unlicense"}

_JOIN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_GAP = _JOIN.decode()
_EDGE = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
BASE_PATTERNS = [(re.compile(_EDGE[0] + _JOIN.join(w.encode() for w in p.split()) + _EDGE[1]), [w.encode() for w in p.split()], label) for p, label in BASE.items()]

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER_TEXT = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    weight: float
    name_keywords: tuple[bytes, ...]
    frame_keywords: tuple[bytes, ...]
    pattern: re.Pattern


def _spaced(pattern: str) -> str:
    """The pattern with any white space for a space: at least one for ' ' and as '[- ]', none or some for ' ?'."""
    return re.sub(r"\[- \]| \??", lambda m: {"[- ]": r"(?:-|\s+)", " ?": r"\s*", " ": r"\s+"}[m.group()], pattern)


def signature(label: str, sentence: str) -> Rule:
    """The rule of a sentence; its keywords are the longest word that every match holds."""
    words = sentence.split()
    pattern = "".join(("" if i == 0 else _GAP) + f"(?:{w})" if not w.endswith("?") else f"(?:{_GAP}{w[:-1]})?" for i, w in enumerate(words))
    sure = max((w for w in words if w.isalnum()), key=len)
    return Rule(label, "text", SIGNATURE_PRIORITY, SIGNATURE_WEIGHT, (sure.encode(),), (b"",), re.compile(_EDGE[0] + pattern.encode("latin-1") + _EDGE[1]))


def rules() -> list[Rule]:
    """Every signature, and every name in every frame, in order of priority."""
    out = [signature(*s) for s in SIGNATURES]
    either = lambda keywords: tuple(k.encode() for k in keywords.split("|"))
    for kind, priority, weight, around, frame in FRAMES:
        for label, spdx, keywords, name in NAMES:
            if kind == "bare" and label in NO_BARE or kind == "spdx" and label in ("apache", "gpl", "bsd", "mpl"):
                continue
            text = _spaced(frame.replace("{id}", re.escape(spdx.lower())).replace("{name}", name))
            need = "" if kind == "spdx" else keywords
            out.append(Rule(label, kind, priority, weight, either(need), either(around), re.compile(_EDGE[0] + text.encode() + _EDGE[1])))
    return sorted(out, key=lambda r: r.priority)


class Gate:
    """Which rules can match a text at all."""

    def __init__(self, ordered: list[Rule]) -> None:
        groups: dict[tuple, list[tuple[int, Rule]]] = {}
        for i, r in enumerate(ordered):
            groups.setdefault((r.name_keywords, r.frame_keywords), []).append((i, r))
        self.groups: dict[tuple, list] = {}
        for (names, frames), members in groups.items():
            self.groups.setdefault(names, []).append((frames, members))

    def open(self, low: bytes) -> list[Rule]:
        """The rules, in their order, whose keywords are in a lower-cased text."""
        flat = b" ".join(low.split())
        framed: dict[tuple, bool] = {}
        found = []
        for names, around in self.groups.items():
            if not any(k in flat for k in names):
                continue
            for frames, members in around:
                if frames not in framed:
                    framed[frames] = any(k in flat for k in frames)
                if framed[frames]:
                    found += members
        return [r for _, r in sorted(found, key=lambda f: f[0])]


def detect(low: bytes, ordered: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Detections in a lower-cased text, by place; none lies within one of a smaller priority number or a longer one of its own.

    Whoever lies within a match that was itself dropped lies within the one that
    dropped it, so each priority needs only the greatest end so far of the
    matches that begin before.
    """
    levels: dict[int, list[tuple[int, int, str, Rule]]] = {}
    for r in ordered:
        levels.setdefault(r.priority, []).extend((m.start(), -m.end(), r.label, r) for m in r.pattern.finditer(low))
    taken: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for priority in sorted(levels):
        before, furthest = len(taken), -1
        for start, minus_end, _, rule in sorted(levels[priority], key=lambda f: f[:3]):
            end = -minus_end
            at = bisect_right(starts, start) - 1
            if end > furthest and (at < 0 or ends[at] < end):
                taken.append((start, end, rule))
            furthest = max(furthest, end)
        if len(taken) > before:
            taken.sort(key=lambda f: f[:2])
            starts, ends = [f[0] for f in taken], list(accumulate((f[1] for f in taken), max))
    return taken


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, detections, score.

    detections holds (label, kind, first byte, end byte) of the lower-cased
    text; score is the greatest weight of a rule that holds, 0.5 for a base
    phrase alone and 0 for nothing. docs needs doc_id and text; other columns
    don't matter; a null text counts as empty. An empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(rules())
        spans = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(1)):
                letter = _WORD[data]
                begin = letter.copy()
                begin[1:] &= ~letter[:-1]
                inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
                begin[inner] = letter[inner]
                n_words = counts(begin, offsets)
                begun = np.concatenate([[0], np.cumsum(begin)])
                rows = [(0, None, None, "", "", [], 0.0)] * (end - start)
                whole = data.tobytes().translate(_LOWER_TEXT)
                for row in range(end - start):
                    lo, hi = int(offsets[row]), int(offsets[row + 1])
                    low = whole[lo:hi]
                    base = [(m.start(), label) for pattern, needed, label in BASE_PATTERNS if all(w in low for w in needed) for m in pattern.finditer(low)]
                    taken = detect(low, gate.open(low))
                    if not base and not taken:
                        continue
                    at = [int(begun[lo + s] - begun[lo]) for s, _ in base]
                    base_labels = sorted({label for _, label in base})
                    labels = sorted({*base_labels, *(r.label for _, _, r in taken)})
                    score = max([0.5 * bool(base), *(r.weight for _, _, r in taken)])
                    rows[row] = (len(base), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), [{"label": r.label, "kind": r.kind, "start": s, "end": e} for s, e, r in taken], score)
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(n_words), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, detections array<struct<label: string, kind: string, start: bigint, end: bigint>>, score double"
    return docs.mapInArrow(each, schema)
