"""Signature table of the licence scan.

Hand-written names of licences, as patterns over lower-cased words joined by
single blanks, times a few phrasings, beside the rules of ``license_rules``. Each signature carries a keyword that a
text must hold before the pattern is tried (every match of the pattern has a
word that begins with it), and a level: lower levels win
over higher ones where one interval holds the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from reportlake.llm.license_rules import rule_rows

_V = r"(?: version)?"

#: label, keyword, pattern of the name (with its version).
NAMES: tuple[tuple[str, str, str], ...] = (
    ("mit", "mit", r"mit(?: expat)?"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)"),
    ("x11", "x11", r"(?:mit )?x11"),
    ("isc", "isc", r"isc"),
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|bsd 0 clause)"),
    ("bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd)"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?" + _V + r" v?1 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?" + _V + r" v?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?" + _V + r" v?2(?: 0)?"),
    ("apache-2.0", "asl", r"asl v?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license" + _V + r" v?1(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license" + _V + r" v?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license" + _V + r" v?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl" + _V + r" ?v?2(?: 0)?(?: only)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl" + _V + r" ?v?3(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl" + _V + r" ?v?2(?: 0)?(?: or later| or any later version)"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl" + _V + r" ?v?3(?: 0)?(?: or later| or any later version)"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl" + _V + r" ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl" + _V + r" ?v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl" + _V + r" ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license" + _V + r" v?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license" + _V + r" v?3(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license(?:" + _V + r" v?2(?: 0)?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?:" + _V + r" v?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl" + _V + r" ?v?3(?: 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?:" + _V + r" v?1(?: [0-3])?)?"),
    ("mpl-1.0", "mozilla", r"mozilla public license" + _V + r" v?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license" + _V + r" v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license" + _V + r" v?2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl" + _V + r" ?v?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license" + _V + r" v?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license" + _V + r" v?2(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?:" + _V + r" v?1(?: 0)?)?"),
    ("cddl-1.0", "common", r"common development and distribution license(?:" + _V + r" v?1(?: 0)?)?"),
    ("cpl-1.0", "common", r"common public license(?:" + _V + r" v?1(?: 0)?)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?:" + _V + r" v?1(?: [12])?)?"),
    ("artistic-1.0", "artistic", r"artistic(?: license)?" + _V + r" v?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?" + _V + r" v?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software license(?:" + _V + r" v?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("openssl", "openssl", r"openssl"),
    ("php-3.01", "php", r"php(?: license)?" + _V + r" v?3(?: 0| 01)?"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("python-2.0", "psf", r"psf"),
    ("ruby", "ruby", r"ruby"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?:" + _V + r" v?1(?: 1)?)?"),
    ("odbl-1.0", "odbl", r"odbl(?:" + _V + r" v?1(?: 0)?)?"),
    ("odbl-1.0", "database", r"open database license(?:" + _V + r" v?1(?: 0)?)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution license"),
    ("pddl-1.0", "public", r"public domain dedication and license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] 0)?"),
)

#: Phrasings around a name: level, cue (a word they all hold), words before, words after.
PHRASINGS: tuple[tuple[int, str, str, str], ...] = (
    (0, "spdx", r"spdx license identifier ", r""),
    (1, "under", r"(?:licensed|released|distributed|available|published|provided|offered|covered|issued)"
        r"(?: [^ ]+){0,4}? under (?:the )?(?:terms of (?:the )?)?", r"(?: licen[cs]e)?(?: agreement)?"),
    (1, "terms", r"(?:subject to|governed by|according to|in accordance with) the terms of (?:the )?",
     r"(?: licen[cs]e)?"),
    (2, "licen", r"(?:the )?", r" licen[cs]e"),
    (2, "licen", r"licen[cs]e (?:is )?(?:the )?", r""),
)

#: Signatures that are no licence names: level, label, keyword, pattern.
NOTICES: tuple[tuple[int, str, str, str], ...] = (
    (1, "proprietary", "proprietary", r"proprietary and confidential"),
    (1, "proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction)"),
    (1, "proprietary", "prohibited", r"(?:copying|redistribution|reproduction) (?:is )?(?:strictly )?prohibited"),
    (1, "proprietary", "permission", r"without (?:the )?(?:prior|express) written permission"),
    (1, "public-domain", "public", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    (2, "public-domain", "public", r"public domain"),
    (1, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "isc", "permission", r"permission to use copy modify and or distribute this software"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms"),
    (1, "apache-2.0", "apache", r"(?:https? )?www apache org licenses license 2 0"),
    (1, "mit", "opensource", r"opensource org licenses mit"),
    (1, "gpl", "gnu", r"(?:https? )?(?:www )?gnu org licenses"),
    (1, "mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    (1, "cc-by", "creativecommons", r"creativecommons org licenses by [1-4] 0"),
    (1, "cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] 0"),
    (1, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] 0"),
    (1, "cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    (3, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    (3, "license-notice", "license", r"(?:see|read) (?:the )?license(?: file)?(?: for (?:more )?(?:details|information))"),
    (3, "license-notice", "under", r"(?:licensed|released|distributed) under(?: the)?(?: terms of)?"),
)

#: Phrases of the contract and their labels (fixed values).
BASE: tuple[tuple[str, str, str], ...] = (
    ("cc-by", "cc", "cc by"),
    ("gpl", "general", "general public license"),
    ("reserved", "reserved", "all rights reserved"),
)

BASE_LEVEL = 4
#: How sure a detection of each level is.
SCORES = (1.0, 0.9, 0.8, 0.7, 0.6)


@dataclass(frozen=True)
class Signature:
    rule: int
    level: int
    label: str
    keyword: str
    cue: str
    pattern: str


def signatures() -> tuple[Signature, ...]:
    """All signatures in order: notices, rules, names by phrasing, contract phrases."""
    rows = [(level, label, key, key, pattern) for level, label, key, pattern in NOTICES]
    rows += rule_rows()
    for level, cue, before, after in PHRASINGS:
        rows += [(level, label, key, cue, before + name + after) for label, key, name in NAMES]
    rows += [(BASE_LEVEL, label, key, key, phrase) for label, key, phrase in BASE]
    return tuple(Signature(i, *r) for i, r in enumerate(rows))
