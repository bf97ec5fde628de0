"""License scans by sentence rules.

A text is cut into pieces, each is normalised (case, punctuation, comment signs, spelling), and runs of adjacent pieces are
looked up among the known licence sentences, which gives them an identifier; sentences with a name or a year in them have a pattern, and
sentences that refer to a licence by one of its NAMED names, whatever stands around it, and SPDX expressions, which may join several, have
an identifier for each licence. The
sequence of a document's identifiers is then matched against ordered rules: each rule that holds replaces its part of
the sequence by a licence, so that longer rules must stand before the shorter ones they contain. What no rule takes
is reported by its identifier. All of it is DataFrame expressions on single rows: nothing is shuffled, and texts
without any licence word are not cut at all.

Defined results: null and empty texts have no sentences and no licences; repeated licences are listed once, in order of
their first place; every row gives a row, repeated rows and null ids too; further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

# Public licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache_ref",
    "licensed under the apache license version 2 0 the license": "apache_ref",
    "you may not use this file except in compliance with the license": "apache_compliance",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_permission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_pre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_permission",
    "licensed under cc by nc 4 0": "cc_by_nc4_ref",
    "licensed under cc by 4 0": "cc_by4_ref",
    "licensed under cc by sa 4 0": "cc_by_sa4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by4_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4_ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "this is free and unencumbered software released into the public domain": "unlicense_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "lgpl2_later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl_warranty",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "see the gnu affero general public license for more details": "agpl_see",
    "distributed under the boost software license version 1 0": "bsl1_ref",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_permission",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "zero_bsd_permission",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0": "epl2_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1_ref",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_ref",
    "the contents of this file are subject to the terms of the common development and distribution license": "cddl_ref",
    "use of this source code is governed by a bsd style license that can be found in the license file": "bsd_style_ref",
    "use of this source code is governed by an mit style license that can be found in the license file": "mit_style_ref",
}
# Licence identifiers of the SPDX list, which expressions name, and the names by which prose refers to them, normalised.
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
    BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
    GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
    LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby
    SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1 Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note""".split()
NAMED = {
    "mit license": "MIT", "mit": "MIT", "x11 license": "X11", "expat license": "MIT", "isc license": "ISC", "zlib license": "Zlib", "unlicense": "Unlicense", "wtfpl": "WTFPL",
    "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache 2 0": "Apache-2.0", "apache license version 1 1": "Apache-1.1",
    "bsd 2 clause license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "bsd 4 clause license": "BSD-4-Clause",
    "boost software license version 1 0": "BSL-1.0", "boost software license": "BSL-1.0", "postgresql license": "PostgreSQL", "python software foundation license": "PSF-2.0", "php license version 3 01": "PHP-3.01",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license v2 0": "GPL-2.0", "gnu gpl version 2": "GPL-2.0", "gplv2": "GPL-2.0", "gpl v2": "GPL-2.0", "gpl version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0", "gnu general public license v3 0": "GPL-3.0", "gnu gpl version 3": "GPL-3.0", "gplv3": "GPL-3.0", "gpl v3": "GPL-3.0", "gpl version 3": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1", "gnu lgpl version 2 1": "LGPL-2.1", "lgplv2 1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "lgplv3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "agplv3": "AGPL-3.0", "server side public license version 1": "SSPL-1.0",
    "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mozilla public license v 2 0": "MPL-2.0", "mozilla public license version 1 1": "MPL-1.1",
    "eclipse public license version 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license v2 0": "EPL-2.0", "eclipse public license version 1 0": "EPL-1.0", "european union public license 1 2": "EUPL-1.2",
    "common development and distribution license version 1 0": "CDDL-1.0", "academic free license version 3 0": "AFL-3.0", "open software license version 3 0": "OSL-3.0", "artistic license 2 0": "Artistic-2.0", "microsoft public license": "MS-PL",
    "sil open font license version 1 1": "OFL-1.1", "open database license": "ODbL-1.0", "universal permissive license": "UPL-1.0", "mulan psl v2": "MulanPSL-2.0", "blue oak model license 1 0 0": "BlueOak-1.0.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0", "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0", "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
    "creative commons attribution noncommercial sharealike 4 0 international license": "CC-BY-NC-SA-4.0", "creative commons attribution noderivatives 4 0 international license": "CC-BY-ND-4.0", "creative commons zero v1 0 universal": "CC0-1.0", "cc0 1 0": "CC0-1.0",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc by 3 0": "CC-BY-3.0", "cc by sa 3 0": "CC-BY-SA-3.0",
}
# Sentences with free parts: a pattern of the whole normalised sentence.
PATTERNS = (
    ("^(3 )?neither the name of .{1,200} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$", "bsd_endorse"),
    ("^this software is provided by .{1,200} as is and any express or implied warranties including but not limited to .{1,200} are disclaimed$", "bsd_warranty"),
    ("^copyright (c )?[0-9]{4}.{0,200}$", "copyright"),
)
#: Those of them that are long enough to be wrapped.
WRAPPED = ("bsd_endorse", "bsd_warranty")
# Ordered rules: identifiers in a row and what they amount to.
RULES = (
    ("bsd_pre bsd_source bsd_binary bsd_endorse bsd_warranty", "BSD-3-Clause"),
    ("bsd_pre bsd_source bsd_binary bsd_endorse", "BSD-3-Clause"),
    ("bsd_pre bsd_source bsd_binary bsd_warranty", "BSD-2-Clause"),
    ("bsd_pre bsd_source bsd_binary", "BSD-2-Clause"),
    ("mit_permission mit_notice mit_warranty", "MIT"),
    ("mit_permission mit_notice", "MIT"),
    ("isc_permission", "ISC"),
    ("apache_ref apache_compliance apache_copy apache_warranty apache_see", "Apache-2.0"),
    ("apache_ref apache_compliance apache_copy", "Apache-2.0"),
    ("gpl3_later gpl_warranty gpl_see", "GPL-3.0-or-later"),
    ("gpl2_later gpl_warranty gpl_see", "GPL-2.0-or-later"),
    ("agpl3_later gpl_warranty agpl_see", "AGPL-3.0-or-later"),
    ("agpl3_later gpl_warranty", "AGPL-3.0-or-later"),
    ("lgpl21_later lgpl_warranty lgpl_see", "LGPL-2.1-or-later"),
    ("lgpl21_later", "LGPL-2.1-or-later"),
    ("agpl3_later", "AGPL-3.0-or-later"),
    ("gpl3_later", "GPL-3.0-or-later"),
    ("gpl2_later", "GPL-2.0-or-later"),
    ("gpl3_ref", "GPL-3.0"),
    ("gpl2_ref", "GPL-2.0"),
    ("apache_ref", "Apache-2.0"),
    ("mit_ref", "MIT"),
    ("cc_by_nc4_ref", "CC-BY-NC-4.0"),
    ("cc_by_sa4_ref", "CC-BY-SA-4.0"),
    ("cc_by4_ref", "CC-BY-4.0"),
    ("mpl2_ref", "MPL-2.0"),
    ("unlicense_ref", "Unlicense"),
    ("gpl2_only gpl_warranty gpl_see", "GPL-2.0-only"),
    ("gpl3_only gpl_warranty gpl_see", "GPL-3.0-only"),
    ("lgpl3_later lgpl_warranty lgpl_see", "LGPL-3.0-or-later"),
    ("gpl2_only", "GPL-2.0-only"),
    ("gpl3_only", "GPL-3.0-only"),
    ("lgpl3_later", "LGPL-3.0-or-later"),
    ("lgpl2_later", "LGPL-2.0-or-later"),
    ("bsl1_ref", "BSL-1.0"),
    ("zlib_permission", "Zlib"),
    ("zero_bsd_permission", "0BSD"),
    ("epl2_ref", "EPL-2.0"),
    ("epl1_ref", "EPL-1.0"),
    ("cc0_ref", "CC0-1.0"),
    ("cddl_ref", "CDDL-1.0"),
)
#: Every known sentence has one of these.
WORDS = ("licen", "permi", "copyright", "warrant", "redistribut", "public domain", "software", "disclaimed")
#: Where sentences end: a sentence's stop before white space, a semicolon, or a blank or bulleted line.
STOP = r"[.!?;]+(?:\s+|$)|\n\s*\n|\n\s*(?:[*#/-]+|[0-9]+[.)])\s+|[.!?:;]\n"


def normalise(sentence: Column) -> Column:
    s = lower_ascii(sentence)
    s = F.regexp_replace(s, "licence", "license")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def identifier(s: Column) -> Column:
    """The identifier of a normalised sentence, null if it is not known."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    out = F.try_element_at(known, s)
    by_pattern = F.lit(None).cast("string")
    for pattern, name in reversed(PATTERNS):
        by_pattern = F.when(s.rlike(pattern), F.lit(name)).otherwise(by_pattern)
    return F.coalesce(out, by_pattern)


#: A line that starts with a capital starts a sentence; an SPDX tag is one.
LINE = r"\n(\s*[A-Z\"'])"
_ID = r"(?:\(\s*)*[a-z0-9.+-]+(?:\s*\))*"
SPDX = rf"(?i)(spdx-license-identifier)\s*:\s*({_ID}(?:\s+(?:and|or|with)\s+{_ID})*)"
#: A sentence that says under what something is licensed, with words before and behind: its second group is the name.
REFERENCE = r"^(?:.{0,120} )?(licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(" + "|".join(sorted(NAMED, key=lambda n: (-len(n), n))) + r")(?: .{0,120})?$"
#: What stands between an expression's identifiers. A plus behind one means or later.
BETWEEN = " (?:and|or|with) "


def spdx_names() -> dict[str, str]:
    """Identifiers as they are normalised in an expression, and what is reported for them."""
    slug = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip().replace(" or later", " orlater")
    return {slug(x): f"spdx={x}" for x in SPDX_IDS}


def _prepared(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, SPDX, "\n\n$1 $2\n\n"), LINE, ". $1")


def expression_ids(s: Column) -> Column:
    """The identifiers of an SPDX expression, normalised; one that is not on the list by its words."""
    known = F.create_map(*[F.lit(x) for kv in spdx_names().items() for x in kv])
    rest = F.regexp_replace(F.substring(s, len(TAG) + 1, 10_000), " or later", " orlater")
    return F.transform(F.split(rest, BETWEEN), lambda i: F.coalesce(F.try_element_at(known, i), F.concat(F.lit("spdx:"), F.regexp_replace(F.regexp_replace(i, " orlater", " or later"), " ", "-"))))


def reference(s: Column) -> Column:
    """The identifier of a licence that a sentence refers to by name, null without one."""
    named = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k, f"ref={v}")])
    return F.when(s.contains(" under "), F.try_element_at(named, F.regexp_extract(s, REFERENCE, 2)))


#: How an SPDX tag begins, normalised.
TAG = "spdx license identifier "


GAP = r"(?: |\| \|)"


def run_patterns() -> list[tuple[str, str]]:
    """A pattern of each known sentence over the pieces of a text, "|a b| |c|", and its identifier; the longest first. Stops,
    comment signs and capitals at a line's start cut sentences in their published form, so any gap may be a cut."""
    out = [(r"\|" + known.replace(" ", GAP) + r"\|", SENTENCES[known]) for known in sorted(SENTENCES, key=lambda k: (-len(k), k))]
    for pattern, name in PATTERNS:
        if name in WRAPPED:
            body = pattern[1:-1].replace("(3 )?", "@").replace(".{1,200}", "[^=]{1,200}?").replace(" ", GAP).replace("@", "(?:3 )?")
            out.append((r"\|" + body + r"\|", name))
    return out


def runs(seq: Column) -> Column:
    """A text's pieces with every run of them that makes up a known sentence replaced by = and its identifier."""
    for pattern, name in run_patterns():
        seq = F.regexp_replace(seq, pattern, f"|={name}|")
    return seq


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (that have an identifier), sentence_ids (in order, by spaces)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = lower_ascii(text)
    likely = F.lit(False)
    for w in WORDS:
        likely |= low.contains(w)
    pieces = F.filter(F.transform(F.split(_prepared(text), STOP), normalise), lambda s: s != "")
    named = F.split(runs(F.concat(F.lit("|"), F.array_join(pieces, "| |"), F.lit("|"))), r"\|(?: \|)?")
    one = lambda s: F.array(F.when(s.startswith("="), F.substring(s, 2, 100)).otherwise(F.coalesce(identifier(s), reference(s))))
    ids = F.filter(F.flatten(F.transform(named, lambda s: F.when(s.startswith(TAG), expression_ids(s)).otherwise(one(s)))), lambda i: i.isNotNull())
    found = F.when(likely, ids).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", found.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"))


def rule_patterns() -> list[tuple[str, str]]:
    """Patterns over identifiers, each between spaces, and what they become; a copyright line may stand inside a licence. What is named as
    it is reported comes last."""
    gap = "(?:  copyright)*  "
    return [(f" {ids.replace(' ', gap)} ", f" ={licence} ") for ids, licence in RULES] + [(" (?:spdx|ref)=", " =")]


def match_rules(identified: DataFrame) -> DataFrame:
    """Adds licenses (by commas) and unmatched (identifiers by commas)."""
    seq = F.concat(F.lit("  "), F.regexp_replace("sentence_ids", " ", "  "), F.lit("  "))
    for pattern, licence in rule_patterns():
        seq = F.regexp_replace(seq, pattern, licence)
    parts = F.filter(F.split(seq, " +"), lambda x: x != "")
    names = F.array_distinct(F.transform(F.filter(parts, lambda x: x.startswith("=")), lambda x: F.substring(x, 2, 100)))
    rest = F.filter(parts, lambda x: ~x.startswith("="))
    return identified.select("*", F.array_join(names, ",").alias("licenses"), F.array_join(rest, ",").alias("unmatched"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, unmatched of every row."""
    return match_rules(identify(docs))


def oracle_sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = lambda x: f"translate({x}, '{upper}', '{upper.lower()}')"
    likely = " or ".join(f"contains({low('t')}, {quote(w)})" for w in WORDS)
    prepared = f"regexp_replace(regexp_replace(t, {quote(SPDX)}, E'\\n\\n\\\\1 \\\\2\\n\\n', 'g'), {quote(LINE)}, '. \\1', 'g')"
    normal = f"trim(regexp_replace(replace({low('x')}, 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))"
    known = " ".join(f"when s = {quote(k)} then {quote(v)}" for k, v in SENTENCES.items())
    known += " " + " ".join(f"when regexp_matches(s, {quote(k)}) then {quote(v)}" for k, v in PATTERNS)
    named = "'|' || array_to_string(ps, '| |') || '|'"
    for pattern, name in run_patterns():
        named = f"regexp_replace({named}, {quote(pattern)}, {quote(f'|={name}|')}, 'g')"
    seq = "'  ' || replace(sentence_ids, ' ', '  ') || '  '"
    for pattern, licence in rule_patterns():
        seq = f"regexp_replace({seq}, {quote(pattern)}, {quote(licence)}, 'g')"
    rest = f"replace(s[{len(TAG) + 1}:], ' or later', ' orlater')"
    spdx = f"list_transform(string_split_regex({rest}, {quote(BETWEEN)}), lambda i: coalesce(case i {' '.join(f'when {quote(k)} then {quote(v)}' for k, v in spdx_names().items())} end, 'spdx:' || replace(replace(i, ' orlater', ' or later'), ' ', '-')))"
    named_by = f"case regexp_extract(s, {quote(REFERENCE)}, 2) {' '.join(f'when {quote(k)} then {quote(f"ref={v}")}' for k, v in NAMED.items())} end"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from {documents}),
m as (select doc_id, case when {likely} then list_filter(list_transform(regexp_split_to_array({prepared}, {quote(STOP)}), lambda x: {normal}), lambda x: x <> '') else [] end as ps from d),
n as (select doc_id, case when len(ps) > 0 then string_split_regex({named}, '\\|(?: \\|)?') else [] end as ss from m),
i as (select doc_id, list_filter(flatten(list_transform(ss, lambda s: case when starts_with(s, {quote(TAG)}) then {spdx} when s[1] = '=' then [s[2:]] else [case {known} when contains(s, ' under ') then {named_by} end] end)), lambda v: v is not null) as ids from n),
q as (select doc_id, cast(len(ids) as bigint) as n_sentences, coalesce(array_to_string(ids, ' '), '') as sentence_ids from i),
r as (select *, list_filter(string_split_regex({seq}, ' +'), lambda v: v <> '') as parts from q),
l as (select *, list_transform(list_filter(parts, lambda v: v[1] = '='), lambda v: v[2:]) as ls from r)
select doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_transform(list_filter(list_zip(ls, range(1, len(ls) + 1)), lambda z: list_position(ls, z[1]) = z[2]), lambda z: z[1]), ','), '') as licenses,
  coalesce(array_to_string(list_filter(parts, lambda v: v[1] <> '='), ','), '') as unmatched
from l"""
