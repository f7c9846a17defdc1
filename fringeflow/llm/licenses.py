"""License scans by sentence rules, DataFrame operations only.

A text is cut into sentences, which are normalised: A-Z lower-cased, everything but letters, digits and non-ASCII
characters a single space. Known sentences have identifiers: sentences of public licences, and notices that name one
("released under the ...", an SPDX line), which are known by the name, whatever the verb. The identifiers of a text's
known sentences, in order, are matched against the licence rules, each an ordered list of identifiers; other sentences
between two known ones break no rule, a known one out of place does. Everything is evaluated row by row; nothing is
shuffled.

A sentence may run over several lines: a known one starts and ends at a stop mark, a blank line, a bullet or any line
break, and a single line break inside it, with or without comment marks, is a space. Of two that start together the
longer one counts. The rules also see the sequence of single lines, in which no sentence runs over a line break.

Every rule has a sentence that holds one of the ANCHORS. A text with none of them has no known sentence: it is not
cut at all.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|[\x0A-\x0D]+"
JUNK = r"[^a-z0-9\x0A\x{80}-\x{10FFFF}]+"
BREAK = r"\x0D\x0A?|[\x0B\x0C]"
END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)"
BULLET = r"(?<![^\x0A])[^a-z0-9\x0A\x{80}-\x{10FFFF}]*(?:[\x{2022}\x{2023}\x{25A0}-\x{25FF}\x{B7}\x{2013}\x{2014}]|\(?[a-z0-9]{1,4}\))[\x20\x09]+"
SPDX = r"spdx-license-identifier:[\x20\x09]*"
ID = r"([a-z0-9.+-]+)"
ANCHORS = ("licens", "licenc", "redistribut", "permission", "unencumbered", r"under\W+(?:the\W+|a\W+)?(?:terms|gnu|[al]?gpl|mit|cc|creative|apache|mpl|mozilla|wtfpl|eupl|eclipse)")  # patterns
ANCHORED = "|".join((*ANCHORS, "free software"))  # what every known sentence holds

# fixed values: sentences of public licences, as they are printed, and their identifiers
TEXTS = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-notice2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "apache2-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-use": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "gpl-free": "This program is free software",
    "lgpl-free": "This library is free software",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gpl2-only": "version 2 of the License",
    "gpl3-only": "version 3 of the License",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version",
    "lgpl21-later": "either version 2.1 of the License, or (at your option) any later version",
    "gpl3-later": "either version 3 of the License, or (at your option) any later version",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "everyone": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names2": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "ofl-header": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "artistic2-title": "The Artistic License 2.0",
}


def normal(text: str) -> str:
    """A sentence as the scan sees it."""
    return re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip()


SENTENCES = {normal(v): k for k, v in TEXTS.items()}

# fixed values: licences (by SPDX identifier) and the names that notices give them
NAMES = {
    "MIT": ("MIT license", "MIT licence", "MIT", "Expat license", "MIT/X11 license"), "Apache-1.0": ("Apache License, Version 1.0",),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2.0", "Apache License v2.0", "Apache Software License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "ISC": ("ISC license",), "MPL-1.1": ("Mozilla Public License Version 1.1", "MPL 1.1"), "Unlicense": ("Unlicense",), "Zlib": ("zlib license",), "WTFPL": ("WTFPL",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal license"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"), "Artistic-2.0": ("Artistic License 2.0", "Artistic License Version 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "EUPL-1.2": ("EUPL 1.2", "European Union Public Licence 1.2"), "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "ODbL-1.0": ("Open Database License",), "PSF-2.0": ("Python Software Foundation License",), "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
}
SHORT_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERBS = (
    r"(?:(?:th(?:is|e)|our|all) (?:work|project|software|file|code|source code|program|package|library|repository|document|content|dataset|data|text|book|page|article|site|material|module)s? (?:is|are) )?"
    r"(?:(?:free software|open source|dual)? ?)?(?:released|licen[sc]ed|distributed|available|made available|provided|published|covered|use of this source code is governed)(?: by| to you)? under "
    r"(?:the |a )?(?:terms(?: and conditions)? of )?(?:the |a )?"
)
TAILS = r"(?: the license| see (?:the )?licen[sc]e(?: file| txt| md)?(?: for (?:details|more information|more details))?)"


def _names() -> tuple[dict[str, str], dict[str, str]]:
    """Names and SPDX identifiers of licences, as `under NAME` and `spdx NAME`, with the notices' identifiers; and what these stand for."""
    every = {k: list(v) for k, v in NAMES.items()}
    for short, long in SHORT_NAMES.items():
        for v in ("1.0", "2.0", "2.1", "3.0"):
            n = v.removesuffix(".0")
            every[f"{short}-{v}"] = [f"{long} version {n}", f"{long} v{n}", f"{long} {v}", f"{long} version {v}", f"{long} v{v}", f"GNU {short} v{n}", f"GNU {short} version {n}", f"{short} v{n}", f"{short}v{n}", f"{short} {v}", f"{short}-{v}"]
            every[f"{short}-{v}-or-later"] = [f"{long} version {n} or later", f"{long} version {n} or any later version", f"{long} v{n} or later", f"{short}v{n} or later", f"{short}v{n}+", f"GNU {short} v{n} or later"]
    for short, long in COMMONS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = {"4.0": " International", "3.0": " Unported", "2.5": " Generic", "2.0": " Generic"}.get(v, "")
            name = f"Creative Commons {long} {v}"
            every[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"CC-{short} {v}", name, f"{name} License", f"{name}{kind}", f"{name}{kind} License", f"{name}{kind} Licence"]
    out = {}
    for spdx, names in every.items():
        for name in names:
            out.setdefault(f"under {normal(name)}", f"{spdx.lower()}-name")
        out[f"spdx {normal(spdx)}"] = f"{spdx.lower()}-name"
        if "GPL" in spdx and not spdx.endswith("later"):
            out[f"spdx {normal(spdx)} only"] = f"{spdx.lower()}-name"
    return out, {f"{spdx.lower()}-name": spdx for spdx in every}


KNOWN_NAMES, SPELLED = _names()
# fixed values: licences and the ordered sentences that grant them; a notice that names a licence is a rule of its own
GRANTS = (
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-copy")), ("Apache-2.0", ("apache2-title",)), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names2")),
    ("GPL-2.0", ("gpl-free", "gpl-terms", "gpl2-only")), ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-later")), ("GPL-3.0", ("gpl-free", "gpl-terms", "gpl3-only")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl3-later")), ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl21-later")), ("LGPL-3.0-or-later", ("lgpl-terms", "gpl3-later")),
    ("AGPL-3.0-or-later", ("agpl-terms", "gpl3-later")), ("GPL-2.0", ("gpl2-title", "everyone")), ("GPL-3.0", ("gpl3-title", "everyone")), ("LGPL-2.1", ("lgpl21-title", "everyone")),
    ("LGPL-3.0", ("lgpl3-title", "everyone")), ("AGPL-3.0", ("agpl3-title", "everyone")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-grant", "mit-notice2")), ("MIT-0", ("mit0-grant",)),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant2",)), ("0BSD", ("0bsd-grant",)), ("MPL-2.0", ("mpl2-header",)), ("MPL-2.0", ("mpl2-title",)), ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",)), ("WTFPL", ("wtfpl-title",)), ("OFL-1.1", ("ofl-header",)), ("Artistic-2.0", ("artistic2-title",)),
)
# where the terms and the version stand in one sentence
for _kind in ("gpl", "lgpl", "agpl"):
    for _version in ("gpl2", "lgpl21", "gpl3"):
        SENTENCES[f"{normal(TEXTS[f'{_kind}-terms'])} {normal(TEXTS[f'{_version}-later'])}"] = f"{_kind}-terms-{_version}-later"
    for _version in ("gpl2", "gpl3"):
        SENTENCES[f"{normal(TEXTS[f'{_kind}-terms'])} {normal(TEXTS[f'{_version}-only'])}"] = f"{_kind}-terms-{_version}-only"
_ONE = {"gpl2": "2.0", "lgpl21": "2.1", "gpl3": "3.0"}
RULES = (
    *GRANTS,
    *((f"{k.upper()}-{_ONE[v]}-or-later", (f"{k}-terms-{v}-later",)) for k in ("gpl", "lgpl", "agpl") for v in _ONE),
    *((f"{k.upper()}-{_ONE[v]}", (f"{k}-terms-{v}-only",)) for k in ("gpl", "lgpl", "agpl") for v in ("gpl2", "gpl3")),
)


def _prepared(text: Column) -> Column:
    """A-Z lower-cased; SPDX lines without their colon, one for each licence of an expression of up to three."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for _ in range(2):
        t = F.regexp_replace(t, rf"{SPDX}\(?{ID}\)?[\x20\x09]+(?:or|and)[\x20\x09]+\(?{ID}", "spdx-license-identifier: $1\nspdx-license-identifier: $2")
    return F.regexp_replace(t, SPDX, "spdx-license-identifier ")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text in order, blank ones included."""
    t = F.regexp_replace(_prepared(text), STOP, "\n")
    return F.transform(F.split(F.regexp_replace(t, JUNK, " "), "\n"), lambda s: F.trim(s))


def _canonical(sentence: Column) -> Column:
    """Notices that name a licence by the name alone."""
    s = F.regexp_replace(sentence, f"^{VERBS}(.+?){TAILS}?$", "under $1")
    return F.regexp_replace(s, "^spdx license identifier ", "spdx ")


def _identified(found: Column, known: dict[str, str]) -> Column:
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    names = F.from_json(F.lit(json.dumps(KNOWN_NAMES)), "map<string,string>")
    return F.filter(F.transform(found, lambda s: F.coalesce(F.element_at(table, s), F.element_at(names, _canonical(s)))), lambda x: x.isNotNull())


def line_sequence(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text that stand on one line, in order."""
    return _identified(F.filter(sentences(text), lambda s: F.rlike(s, F.lit(ANCHORED))), known)


def wrapped(text: Column) -> Column:
    """A normalised text: one line break where a line ends inside a sentence, more where the sentence ends too."""
    t = F.regexp_replace(_prepared(text), BREAK, "\n")
    t = F.regexp_replace(F.regexp_replace(t, BULLET, "\n"), END, "\n\n")
    return F.regexp_replace(F.regexp_replace(t, JUNK, " "), r"\x20?\x0A\x20?|^\x20|\x20$", "\n")


def known_sequence(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    spaced = lambda p: p.replace(" ", r"[\x20\x0A]")
    under = "|".join(re.escape(k[6:]).replace(r"\ ", " ") for k in sorted(KNOWN_NAMES, key=len, reverse=True) if k.startswith("under "))
    spdx = "|".join(re.escape(k[5:]).replace(r"\ ", " ") for k in sorted(KNOWN_NAMES, key=len, reverse=True) if k.startswith("spdx "))
    any_of = [*sorted(known, key=len, reverse=True), f"{VERBS}(?:{under}){TAILS}?", f"spdx license identifier (?:{spdx})"]
    found = F.regexp_extract_all(wrapped(text), F.lit(rf"(?<![^\x0A])(?:{spaced('|'.join(any_of))})(?![^\x0A])"), F.lit(0))
    return _identified(F.transform(found, lambda s: F.translate(s, "\n", " ")), known)


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_known (known sentences), sequence (their identifiers), licenses (sorted, comma-separated) of every row.

    A text with no licence has an empty string in licenses; a null or empty text has no sentence, an empty table no
    row; rows that repeat are scanned each, texts of any length whole, other columns are not read. Where one rule holds
    the start of a longer one both names are given.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text")
    none = F.array().cast("array<string>")
    may = F.rlike(F.coalesce(text, F.lit("")), F.lit("(?i)" + "|".join(ANCHORS)))
    both = F.when(may, F.struct(known_sequence(text, known).alias("ids"), line_sequence(text, known).alias("cut"))).otherwise(F.struct(none.alias("ids"), none.alias("cut")))
    rows = docs.select(doc_id, both.alias("b"))
    rows = rows.select("doc_id", F.size("b.ids").cast("long").alias("n_known"), F.array_join("b.ids", " ").alias("sequence"), F.array_join("b.cut", " ").alias("cut"), F.concat("b.ids", "b.cut").alias("all"))
    line = F.concat(F.lit(" "), F.col("sequence"), F.lit(" | "), F.col("cut"), F.lit(" "))
    spelled = F.from_json(F.lit(json.dumps(SPELLED)), "map<string,string>")
    named = F.filter(F.transform("all", lambda x: F.element_at(spelled, x)), lambda x: x.isNotNull())
    by_rule = F.array_compact(F.array(*(F.when(F.contains(line, F.lit(" " + " ".join(seq) + " ")), F.lit(name)) for name, seq in rules)))
    names = F.when(F.size("all") == 0, none).otherwise(F.array_sort(F.array_distinct(F.concat(by_rule, named))))
    return rows.select("doc_id", "n_known", "sequence", F.array_join(names, ",").alias("licenses"))


def scan_sql(known: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same rows by DuckDB, where no known sentence runs over a line break."""

    def table(d: dict[str, str]) -> str:
        keys, values = (", ".join(f"'{x}'" for x in xs) for xs in (d, d.values()))
        return f"map([{keys}], [{values}])"

    tests = ", ".join(f"CASE WHEN contains(' ' || sequence || ' ', ' {' '.join(seq)} ') THEN '{name}' END" for name, seq in rules)
    two = rf"'{SPDX}\(?{ID}\)?[\x20\x09]+(?:or|and)[\x20\x09]+\(?{ID}', 'spdx-license-identifier: \1' || chr(10) || 'spdx-license-identifier: \2', 'g'"
    anchored = f"regexp_matches(coalesce(text, ''), '(?i){'|'.join(ANCHORS)}')"
    return f"""
WITH l AS (SELECT doc_id, CASE WHEN {anchored} THEN translate(text, '{UPPER}', '{LOWER}') ELSE '' END AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, {two}), {two}), '{SPDX}', 'spdx-license-identifier ', 'g') AS t FROM l),
t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '{STOP}', chr(10), 'g'), '{JUNK}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '{ANCHORED}')) AS s FROM p),
s AS (SELECT doc_id, list_filter(list_transform(s, lambda x: coalesce(element_at({table(known)}, x)[1],
  element_at({table(KNOWN_NAMES)}, regexp_replace(regexp_replace(x, '^{VERBS}(.+?){TAILS}?$', 'under \\1'), '^spdx license identifier ', 'spdx '))[1])), lambda x: x IS NOT NULL) AS ids FROM t),
q AS (SELECT doc_id, ids, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ' '), '') AS sequence FROM s)
SELECT doc_id, n_known, sequence, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter([{tests}], lambda x: x IS NOT NULL),
  list_filter(list_transform(ids, lambda x: element_at({table(SPELLED)}, x)[1]), lambda x: x IS NOT NULL)))), ','), '') AS licenses FROM q
"""
