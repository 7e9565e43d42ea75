r"""Licence scans by sentence-rule recognition, in DataFrame expressions only (operator 6).

A text is cut into sentences (at . ! ? before white space or the end, and at line ends unless the next line goes on in
lower case), sentences are normalised (A-Z lower-cased, other runs than a-z 0-9 to one space) and looked up among known
licence sentences. The sequence of identifiers, with a mark for every unknown sentence in between, is matched against
ordered rules: each rule takes its identifier sequence wherever it occurs, and what it took is gone for later rules.

Known passages of licence texts (PASSAGES, and long sentences) are found first, word by word, whatever stands between the
words: line breaks, blank lines, comment marks. Each is put on a line of its own, so the cut gives it as one sentence. A
sentence that begins with one of the usual openings (OPENING) and goes on with a licence's name (NAMES) is known too.

Only texts with one of STEM_PARTS (its first word) or an opening are cut; every known sentence holds one (asserted on import),
so none is missed.

Edge cases: null and empty texts have no sentences; null ids and repeated rows are judged alike; texts of any length are read
whole; a part that two rules could take goes to the first of them; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import let

#: Known sentences, normalised, by identifier.
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_ref2": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc_by_nc4_ref": "licensed under cc by nc 4 0",
    "cc_by4_ref": "licensed under cc by 4 0",
    "bsd_redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "rights": "all rights reserved under copyright",
}
#: Ordered rules: licence and the identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ["apache2_ref", "apache2_comply"]),
    ("Apache-2.0", ["apache2_ref"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_ref"]),
    ("MIT", ["mit_ref2"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4_ref"]),
    ("CC-BY-4.0", ["cc_by4_ref"]),
    ("BSD", ["bsd_redistribute"]),
    ("Proprietary", ["rights"]),
]
#: Passages of canonical texts; '*' stands for up to 12 words.
_free = "this * is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_gnu = [("gpl", "GPL", "general public license", ("2", "3")), ("lgpl", "LGPL", "lesser general public license", ("2 1", "3")), ("agpl", "AGPL", "affero general public license", ("3",))]
PASSAGES = {
    "mit_grant": SENTENCES["mit_grant"],
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache2_header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2_title": "apache license version 2 0 january 2004",
    "mpl2_header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl_free": SENTENCES["gpl_free"],
    **{f"{k}{v.replace(' ', '')}_free": _free.format(name, v) for k, _, name, vs in _gnu for v in vs},
    "gpl2_title": "gnu general public license version 2 june 1991",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "bsd_redistribute": SENTENCES["bsd_redistribute"],
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_endorse": "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense_text": "this is free and unencumbered software released into the public domain",
    "wtfpl_title": "do what the fuck you want to public license",
    "mpl2_title": "mozilla public license version 2 0",
    "epl2_header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "eupl_title": "european union public licence v 1 2",
    "ofl_header": "this font software is licensed under the sil open font license version 1 1",
    "artistic2_title": "the artistic license 2 0",
    "postgres_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    **{f"cc_{'_'.join(k.split())}4_title": f"creative commons {long} 4 0 international" for k, long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"))},
    "cc0_title": "cc0 1 0 universal",
}
OPENING = (
    r"^(?:spdx license identifier |(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:dual )?"
    r"(?:licensed|released|distributed|published|provided|made available|available) under (?:the |a |an )?(?:terms of (?:the |a |an )?)?)"
)
#: Names after an opening, normalised, by identifier and licence.
NAMES = {
    "mit_name": ("MIT", ["mit", "mit license", "mit licence", "expat license"]),
    "apache2_name": ("Apache-2.0", ["apache 2 0", "apache license 2 0", "apache 2 0 license", "apache license version 2 0", "apache license v2 0"]),
    "bsd2_name": ("BSD-2-Clause", ["bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license"]),
    "bsd3_name": ("BSD-3-Clause", ["bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"]),
    "isc_name": ("ISC", ["isc", "isc license"]),
    "mpl2_name": ("MPL-2.0", ["mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0"]),
    "cc0_name": ("CC0-1.0", ["cc0 1 0", "cc0 1 0 universal"]),
    "unlicense_name": ("Unlicense", ["unlicense"]),
    **{
        f"cc_{'_'.join(k.split())}4_name": (f"CC-{'-'.join(k.upper().split())}-4.0", [f"cc {k} 4 0", f"creative commons {long} 4 0 international license"])
        for k, long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
    },
    **{
        f"{k}{v.replace(' ', '')}_{end}_name": (f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}-{full}", [x for n in (v, v + " 0") for x in ((f"{k} {n} {full.replace('-', ' ')}", *(f"gnu {name} {w}{n}{tail}" for w in ("version ", "v", "")), *((f"{k} {n}", f"{k}v{n}") if end == "only" else ())))])
        for k, short, name, vs in _gnu for v in vs for end, full, tail in (("only", "only", ""), ("later", "or-later", " or later"))
    },
}
#: Rules of the passages and names, after the first ones.
MORE_RULES = [
    ("Apache-2.0", ["apache2_header"]), ("Apache-2.0", ["apache2_title"]), ("ISC", ["isc_grant"]), ("MPL-2.0", ["mpl2_header"]),
    *((f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}-or-later", [f"{k}{v.replace(' ', '')}_free"]) for k, short, _, vs in _gnu for v in vs),
    ("Zlib", ["zlib_grant"]), ("BSL-1.0", ["boost_grant"]), ("Unlicense", ["unlicense_text"]), ("WTFPL", ["wtfpl_title"]), ("MPL-2.0", ["mpl2_title"]), ("EPL-2.0", ["epl2_header"]),
    ("EUPL-1.2", ["eupl_title"]), ("OFL-1.1", ["ofl_header"]), ("Artistic-2.0", ["artistic2_title"]), ("PostgreSQL", ["postgres_grant"]), ("CC0-1.0", ["cc0_title"]),
    *((f"CC-{'-'.join(k.upper().split())}-4.0", [f"cc_{'_'.join(k.split())}4_title"]) for k in ("by", "by sa", "by nc", "by nd")),
    ("GPL-2.0", ["gpl2_title"]), ("GPL-3.0", ["gpl3_title"]), ("LGPL-3.0", ["lgpl3_title"]), ("AGPL-3.0", ["agpl3_title"]),
    *((licence, [i]) for i, (licence, _) in NAMES.items()),
]
#: Rules that must come before the one for their first sentence alone.
BSD_RULES = [
    ("BSD-4-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_advertise"]),
    ("BSD-3-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary"]),
]
ALL_RULES = [*RULES[:-2], *BSD_RULES, *RULES[-2:], *MORE_RULES]
#: Parts of words, one of which every known sentence holds; the advertising clause only counts after bsd_redistribute.
STEM_PARTS = ["license", "licence", "copyright", "permission", "redistribut", "unencumbered", "creative commons", "cc0"]
STEMS = "|".join(STEM_PARTS)
CUT = r"[.!?]+(?=\s|$)|\n(?![a-z])"
#: What else an opening may have; it's looked for only where "under" occurs.
OPENED = r"(?i)(?:released|distributed|published|provided|available)\s+under"
assert all(re.search(STEMS, s) for s in [*SENTENCES.values(), *(p for i, p in PASSAGES.items() if i != "bsd_advertise")])
_plain = {i: " ".join(p.replace("*", " ").split()) for i, p in PASSAGES.items()}
_known_ids = {s: i for i, s in [*_plain.items(), *SENTENCES.items()]}
_name_ids = {n: i for i, (_, names) in NAMES.items() for n in names}


def _passage(p: str) -> str:
    """A pattern of the words of a passage with anything but letters and digits between them, and a list number before it."""
    gap, words = "[^A-Za-z0-9]+", p.split()
    out = "".join("(?:[A-Za-z0-9]+[^A-Za-z0-9]+){0,12}?" if w == "*" else w + (gap if k + 1 < len(words) else "") for k, w in enumerate(words))
    return rf"(?i)(?:(?<=\s|^)\(?[0-9a-d][.)]\s+)?(?<![A-Za-z0-9]){out}(?![A-Za-z0-9])"


def identifiers(text: Column) -> Column:
    """Identifiers of the sentences of a text, in order; '-' for one or more unknown sentences."""
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = lambda x: F.btrim(F.regexp_replace(lower(x), "[^a-z0-9]+", " "))
    lined = F.regexp_replace(text, r"(?i)(SPDX-License-Identifier:[^\n]*)", "\n# $1\n#")
    # a passage is searched for only where its longest word occurs
    known = F.array(*(F.struct(F.lit(max(p.split(), key=len)).alias("word"), F.lit(_passage(p)).alias("p"), F.lit(f"\n# {_plain[i]}\n#").alias("to")) for i, p in PASSAGES.items()))
    found = lambda low: F.aggregate(known, lined, lambda t, p: F.when(F.contains(low, p["word"]), F.regexp_replace(t, p["p"], p["to"])).otherwise(t))
    lined = let(F.lower(text), found)

    def find(known: dict[str, str], x: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, known)), x)
        return F.get(F.array(*map(F.lit, known.values())), F.nullif(at, F.lit(0)).cast("int") - 1)

    cut = F.filter(F.transform(F.split(lined, CUT), norm), lambda x: x != "")
    name = lambda x: F.when(x.rlike(OPENING), find(_name_ids, F.regexp_replace(x, OPENING, "")))
    got = F.transform(cut, lambda x: F.coalesce(find(_known_ids, x), name(x), F.lit("-")))
    gate = let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in [x.split()[0] for x in STEM_PARTS])) | (F.contains(low, F.lit("under")) & text.rlike(OPENED)))
    return F.when(gate, got).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences of the rules that took a part of an identifier sequence, in the order of the rules, each once."""
    rules = F.array(*(F.struct(F.lit(n).alias("n"), F.lit("".join(f" {i} " for i in seq)).alias("seq")) for n, seq in ALL_RULES))
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        hit = F.when(F.contains(acc["left"], r["seq"]), F.concat(acc["out"], F.array(r["n"]))).otherwise(acc["out"])
        return F.struct(F.replace(acc["left"], r["seq"], F.lit(" * ")).alias("left"), hit.alias("out"))

    return F.array_distinct(F.aggregate(rules, start, step, lambda a: a["out"]))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known licence sentences), sentence_ids and licences (comma-joined) of every whole text."""
    d = docs.select("doc_id", identifiers(F.coalesce("text", F.lit(""))).alias("all")).select("doc_id", "all", F.filter("all", lambda x: x != "-").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, F.array_join(licences(F.col("all")), ",")).otherwise("").alias("licences"))


_known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
#: The ordered rules over the identifiers that the SQL knows, a step each: a hit takes its sequence away from later rules.
_sql_rules = [(name, "".join(f" {i} " for i in seq)) for name, seq in ALL_RULES if set(seq) <= SENTENCES.keys()]
_steps = ",\n".join(f"r{k + 1} AS (SELECT n, replace(seq, '{seq}', ' * ') AS seq, CASE WHEN contains(seq, '{seq}') AND NOT list_contains(got, '{name}') THEN list_append(got, '{name}') ELSE got END AS got FROM r{k})" for k, (name, seq) in enumerate(_sql_rules))
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
known(id, s) AS (VALUES {_known}),
-- RE2 has no look-ahead: ends are marked first; a line break before a-z isn't an end
x AS (SELECT n, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE regexp_matches(t, '(?i){STEMS}')),
j AS (SELECT n, string_agg(CASE WHEN i = 1 THEN '' WHEN regexp_matches(l, '^[a-z]') THEN chr(10) ELSE chr(1) END || l, '' ORDER BY i) AS t FROM x GROUP BY n),
c AS (SELECT n, unnest(string_split_regex(t, '[.!?]+[\s\x01]|[.!?]+$|\x01')) AS s, generate_subscripts(string_split_regex(t, '[.!?]+[\s\x01]|[.!?]+$|\x01'), 1) AS i FROM j),
w AS (SELECT n, i, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s FROM c),
m AS (SELECT w.n, w.i, known.id FROM w LEFT JOIN known USING (s) WHERE w.s <> ''),
f AS (SELECT n, count(id) AS n_sentences, string_agg(id, ',' ORDER BY i) AS sentence_ids, ' ' || string_agg(coalesce(id, '-'), '  ' ORDER BY i) || ' ' AS seq FROM m GROUP BY n),
r0 AS (SELECT n, seq, CAST([] AS VARCHAR[]) AS got FROM f),
{_steps}
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(got, ','), '') AS licences
FROM d LEFT JOIN f USING (n) LEFT JOIN r{len(_sql_rules)} USING (n)
"""
