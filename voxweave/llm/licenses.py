"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into pieces at line ends and marks, each is normalised (lower case, runs of other characters
than letters and digits to one blank), and runs of pieces that make up a known licence sentence become its
identifier: notices are wrapped at any word and have marks inside their sentences. The sequence of identifiers
is matched against ordered rules. Sentences that are not known stand between without breaking a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier (fixed values from the public licence notices).
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.title": "the mit license mit",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache.licensed": "licensed under the apache license version 2 0",
    "apache.licensed_the": "licensed under the apache license version 2 0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd.allow": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync.licensed": "licensed under cc by nc 4 0",
    "ccby.licensed": "licensed under cc by 4 0",
    "ccbysa.licensed": "licensed under cc by sa 4 0",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl2.only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl21.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc.permit": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.permit_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
}
#: Rules: licence, and identifiers that must come in this order among the known sentences of a text; others may stand between.
RULES = (
    ("MIT", ("mit.released",)), ("MIT", ("mit.licensed",)), ("MIT", ("mit.grant", "mit.notice", "mit.warranty")), ("MIT", ("mit.title", "mit.grant")),
    ("Apache-2.0", ("apache.licensed",)), ("Apache-2.0", ("apache.licensed_the", "apache.comply", "apache.copy")), ("Apache-2.0", ("apache.licensed_the", "apache.comply")),
    ("GPL-3.0", ("gpl3.work",)), ("GPL-3.0-or-later", ("gpl.free", "gpl.hope")), ("GPL-2.0-or-later", ("gpl2.free", "gpl.hope")),
    ("BSD-2-Clause", ("bsd.allow", "bsd.source", "bsd.binary")), ("BSD-3-Clause", ("bsd.allow", "bsd.source", "bsd.binary", "bsd.names")),
    ("CC-BY-NC-4.0", ("ccbync.licensed",)), ("CC-BY-4.0", ("ccby.licensed",)), ("CC-BY-SA-4.0", ("ccbysa.licensed",)), ("MPL-2.0", ("mpl2.form",)),
    ("GPL-2.0-only", ("gpl2.only",)), ("LGPL-2.1-or-later", ("lgpl21.free", "lgpl21.hope")), ("LGPL-3.0-or-later", ("lgpl3.free", "gpl.hope")), ("AGPL-3.0-or-later", ("agpl3.free", "gpl.hope")),
    ("ISC", ("isc.permit",)), ("ISC", ("isc.permit_and",)), ("Unlicense", ("unlicense.free",)),
)
#: The line that names a licence by its identifier is a known sentence and a rule for each.
for _name in sorted({n for n, _ in RULES}):
    SENTENCES[f"spdx.{_name.lower()}"] = "spdx license identifier " + _name.lower().replace("-", " ").replace(".", " ")
    RULES += ((_name, (f"spdx.{_name.lower()}",)),)
#: A rule that a longer one includes.
INCLUDED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Every known sentence has one of these words; texts without any need no cutting.
ANCHORS = ("licen", "permission", "copyright", "warrant", "redistribut", "unencumbered")
END = r"[\n\r]+|[.!?;:]+([ \t\n\r]+|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def in_order(rule: tuple[str, ...]) -> str:
    """The pattern of a rule over identifiers that stand between commas."""
    return "," + "(?:[^,]+,)*".join(i.replace(".", "[.]") + "," for i in rule)


#: Where pieces begin, a known sentence over one or more of them, the longest first.
KNOWN = "\x01(?:" + "|".join(s.replace(" ", "[ \x01]") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + ")(?=\x01)"


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order. They begin and end where pieces do; "2.0" does not end a piece."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    flat = F.regexp_replace(F.regexp_replace(low, END, "\x01"), "[^a-z0-9\x01]+", " ")
    flat = F.regexp_replace(F.concat(F.lit("\x01"), flat, F.lit("\x01")), " *\x01[ \x01]*", "\x01")
    known = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() for x in (s, k)))
    found = F.transform(F.regexp_extract_all(flat, F.lit(KNOWN), F.lit(0)), lambda s: known[F.trim(F.translate(s, "\x01", " "))])
    return F.when(low.rlike("|".join(ANCHORS)), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences (known ones), sentence_ids and licenses, both comma-joined.

    licenses are sorted, each once. Null, empty and other texts without known sentences have 0, "" and "".
    Repeated rows give repeated results. Very long texts are read whole. An empty table gives no rows; other columns are not read.
    """
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    row = F.concat(F.lit(","), F.concat_ws(",", "ids"), F.lit(","))
    hit = {name: None for name in dict(RULES)}
    for name, rule in RULES:
        own = F.col("row").rlike(in_order(rule))
        hit[name] = own if hit[name] is None else hit[name] | own
    hit |= {a: hit[a] & ~hit[b] for a, b in INCLUDED.items()}
    names = F.concat_ws(",", *(F.when(hit[n], F.lit(n)) for n in sorted(hit)))
    return ids.withColumn("row", row).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(",", "ids").alias("sentence_ids"), names.alias("licenses"))


def oracle() -> str:
    """The same in DuckDB. Its patterns cannot look ahead, so each piece has marks of its own on both sides."""
    known = "map([" + ", ".join(f"'{s}'" for s in SENTENCES.values()) + "], [" + ", ".join(f"'{k}'" for k in SENTENCES) + "])"
    pieces = r"\x01(?:" + "|".join(s.replace(" ", r"(?: |\x01\x01)") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")\x01"
    hit: dict[str, str] = {}
    for name, rule in RULES:
        own = f"regexp_matches(r, '{in_order(rule)}')"
        hit[name] = f"{hit[name]} or {own}" if name in hit else own
    hit |= {a: f"({hit[a]}) and not ({hit[b]})" for a, b in INCLUDED.items()}
    names = ", ".join(f"case when {hit[n]} then '{n}' end" for n in sorted(hit))
    return rf"""
with low as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents),
flat as (select doc_id, t, regexp_replace(regexp_replace(t, '{END}', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g') f from low),
cut as (select doc_id, t, regexp_replace(regexp_replace(chr(1) || f || chr(1), ' *\x01[ \x01]*', chr(1), 'g'), '\x01', chr(1) || chr(1), 'g') f from flat),
found as (select doc_id, case when regexp_matches(t, '{"|".join(ANCHORS)}') then regexp_extract_all(f, '{pieces}') else [] end m from cut),
ids as (select doc_id, list_transform(m, lambda s: {known}[trim(regexp_replace(s, '\x01+', ' ', 'g'))]) l from found),
rows as (select doc_id, len(l) n, array_to_string(l, ',') s, ',' || array_to_string(l, ',') || ',' r from ids)
select doc_id, cast(n as bigint) n_sentences, s sentence_ids, concat_ws(',', {names}) licenses from rows"""
