"""Signature rules for license texts, in order of rank.

A rule is matched against the words of a text, lower-cased and joined by single spaces, so
punctuation and line ends do not matter: "CC BY-NC 4.0" reads "cc by nc 4 0". Each rule names
the keyword without which it cannot match; its first word has to be a whole word of every match. Rank 3 is a full statement, an address or an
identifier with its version; 2 a name with its version; 1 a bare name or a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    rank: int


# Names and versions of public licenses.
# label, keyword, name, short identifier, versions
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?", "apache", "1.0 1.1 2.0"),
    ("gpl", "general public", r"(?:gnu )?general public", "gpl", "1 2 3 1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "gpl", "1 2 3 1.0 2.0 3.0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", "lgpl", "2.1 3 3.0"),
    ("lgpl", "library general", r"(?:gnu )?library general public", "lgpl", "2 2.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "agpl", "1 3 1.0 3.0"),
    ("mpl", "mozilla", r"mozilla public", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public", "epl", "1.0 2.0"),
    ("cddl", "common development", r"common development and distribution", "cddl", "1.0 1.1"),
    ("cpl", "common public", r"common public", "cpl", "1.0"),
    ("eupl", "european union", r"european union public", "eupl", "1.0 1.1 1.2"),
    ("osl", "open software", r"open software", "osl", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", r"artistic", "artistic", "1.0 2.0"),
    ("bsl", "boost software", r"boost software", "bsl", "1.0"),
    ("ofl", "open font", r"(?:sil )?open font", "ofl", "1.0 1.1"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "gfdl", "1.1 1.2 1.3"),
    ("psf", "python software", r"python software foundation", "psf", "2.0"),
    ("php", "php", r"php", "php", "3.0 3.01"),
    ("zpl", "zope public", r"zope public", "zpl", "1.1 2.0 2.1"),
    ("ms-pl", "microsoft public", r"microsoft public", "ms pl", "1.0"),
    ("odbl", "open database", r"(?:odc )?open database", "odbl", "1.0"),
]
# Short identifiers that name a license without a version or the word license beside them.
ACRONYMS = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "gfdl", "odbl")
# Names and short forms of the Creative Commons licenses, and their versions.
COMMONS = [
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nd", "attribution no ?deriv(?:ative|atives|s)?", "by nd"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|atives|s)?", "by nc nd"),
]
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Licenses without versions, and phrases of their texts.
SINGLE = [
    Rule("mit", "mit license", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license", 3),
    Rule("mit", "mit license", r"(?:the )?mit license", 2),
    Rule("mit", "spdx", r"spdx license identifier mit", 3),
    Rule("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 3),
    Rule("x11", "x11 license", r"x11 license", 2),
    Rule("isc", "isc license", r"isc license", 2),
    Rule("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 3),
    Rule("bsd", "bsd license", r"(?:under (?:the )?)?bsd license", 2),
    Rule("bsd-2-clause", "bsd", r"bsd 2 clause(?: license)?|simplified bsd(?: license)?", 3),
    Rule("bsd-2-clause", "freebsd license", r"freebsd license", 3),
    Rule("bsd-3-clause", "bsd", r"bsd 3 clause(?: license)?|(?:new|modified|revised) bsd(?: license)?", 3),
    Rule("bsd-4-clause", "bsd", r"bsd 4 clause(?: license)?|original bsd(?: license)?", 3),
    Rule("0bsd", "0bsd", r"0bsd", 2),
    Rule("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 3),
    Rule("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 2),
    Rule("zlib", "as is", r"this software is provided as is without any express or implied warranty", 2),
    Rule("unlicense", "unlicense", r"(?:the )?unlicense", 2),
    Rule("unlicense", "public domain", r"free and unencumbered software released into the public domain", 3),
    Rule("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|to|into) the public domain", 3),
    Rule("public-domain", "public domain", r"public domain", 1),
    Rule("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 3),
    Rule("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero(?: 1 0)?", 3),
    Rule("wtfpl", "wtfpl", r"wtfpl", 2),
    Rule("beerware", "beer ware", r"beer ware license", 2),
    Rule("proprietary", "proprietary", r"proprietary and confidential", 3),
    Rule("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction)(?: of this (?:file|software|work))?", 2),
    Rule("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 2),
    Rule("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 2),
    Rule("copyright", "copyright", r"copyright", 1),
    Rule("license", "licensed under", r"licensed under", 1),
    Rule("license", "license terms", r"(?:subject to|see) (?:the )?license terms", 1),
]


def _version(version: str) -> str:
    """`2.0` as words, with the zero that is often left out."""
    whole, _, part = version.partition(".")
    if not part:
        return whole
    return f"{whole}(?: {part})?" if part == "0" else f"{whole} {part}"


def _family(label: str, keyword: str, name: str, short: str, versions: str) -> list[Rule]:
    rules = [Rule(label, keyword, name + " licen[cs]e", 1)]
    for version in versions.split():
        own, words = f"{label}-{version}", _version(version)
        rules += [
            Rule(own, keyword, rf"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?{name} licen[cs]e (?:version |v ?){words}", 3),
            Rule(own, keyword, rf"{name}(?: licen[cs]e)? (?:version |v ?)?{words}", 2),
            Rule(own, "spdx", rf"spdx license identifier {short} {version.replace('.', ' ')}(?: only| or later)?", 3),
        ]
        # names of programs, as in apache2 and php3, are no license without the v
        for glued in (f"{short}v{words}", f"{short}{words}") if short in ACRONYMS else (f"{short}v{words}",):
            rules.append(Rule(own, glued.split("(")[0], glued, 2))
        rules.append(Rule(own, short, rf"{short}(?: licen[cs]e)? (?:version |v ?)?{words}", 2))
    rules.append(Rule(label, short, rf"{short}(?: licen[cs]e)?" if short in ACRONYMS else rf"{short} licen[cs]e", 1))
    return rules


def _commons(label: str, name: str, short: str) -> list[Rule]:
    rules = [Rule(label, "creative commons", rf"creative commons {name}", 1), Rule(label, "cc by", rf"cc {short}", 1)]
    for version in COMMONS_VERSIONS.split():
        words = version.replace(".", " ")
        rules += [
            Rule(f"{label}-{version}", "creative commons", rf"creative commons {name} {words}(?: international| unported)?", 3),
            Rule(f"{label}-{version}", "cc by", rf"cc {short} {words}", 2),
            Rule(f"{label}-{version}", "creativecommons", rf"creativecommons org licenses {short} {words}", 3),
        ]
    return rules


def all_rules() -> list[Rule]:
    """Every rule; of equal spans and ranks the earlier rule holds."""
    return [
        *SINGLE,
        *(rule for family in COMMONS for rule in _commons(*family)),
        *(rule for family in FAMILIES for rule in _family(*family)),
    ]
