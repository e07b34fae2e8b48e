"""Operator 2: licence scans by sentence rules, with DataFrame functions only.

A text is normalised to lower-case words, single line breaks and sentence ends, and cut into sentences. Known licence
sentences have short identifiers; a document becomes the sequence of the identifiers that it holds, in order. A sentence runs
from the start of a line or sentence to the end of one, over any number of wrapped lines; a notice may also have other words
before it in its sentence, if none of them denies it. A licence rule is an ordered sequence of identifiers (others may stand
between them); a licence is reported if its rule matches.

Documents without any word that known sentences have are passed over by one regular expression, and so are the other sentences
of those that have one: the sentences' patterns meet what is left only. All is a projection over one scan: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, each with its identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "ap_notice",
    "licensed under the apache license version 2 0 the license": "ap_notice",
    "you may not use this file except in compliance with the license": "ap_comply",
    "you may obtain a copy of the license at": "ap_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ap_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "ap_see",
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_keep",
    "the software is provided as is without warranty of any kind express or implied": "mit_as_is",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 3": "gpl3_notice",
    "this work is licensed under the gnu general public license version 2": "gpl2_notice",
    "licensed under the gnu general public license version 2": "gpl2_notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "licensed under the gnu lesser general public license version 3": "lgpl3_notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_notice",
    "licensed under cc by 4 0": "cc_by",
    "licensed under cc by sa 4 0": "cc_by_sa",
    "licensed under cc by nc 4 0": "cc_by_nc",
    "licensed under cc by nd 4 0": "cc_by_nd",
    "licensed under cc by nc sa 4 0": "cc_by_nc_sa",
    "licensed under cc by nc nd 4 0": "cc_by_nc_nd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa",
    "this work is dedicated to the public domain": "public_domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Titles of licence texts, further notices, and machine-readable lines, each with its identifier.
FURTHER = {
    "apache license version 2 0 january 2004": "ap_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "creative commons legal code cc0 1 0 universal": "cc0_title",
    "licensed under cc0 1 0": "cc0",
    "licensed under cc by 3 0": "cc_by3",
    "licensed under cc by sa 3 0": "cc_by_sa3",
    "this work is licensed under a creative commons attribution 3 0 unported license": "cc_by3",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21_notice",
    "licensed under the gnu affero general public license version 3": "agpl3_notice",
    "licensed under the isc license": "isc_notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "spdx license identifier mit": "spdx_mit",
    "spdx license identifier apache 2 0": "spdx_apache",
    "spdx license identifier bsd 2 clause": "spdx_bsd2",
    "spdx license identifier bsd 3 clause": "spdx_bsd3",
    "spdx license identifier isc": "spdx_isc",
    "spdx license identifier gpl 2 0 only": "spdx_gpl2",
    "spdx license identifier gpl 2 0 or later": "spdx_gpl2",
    "spdx license identifier gpl 3 0 only": "spdx_gpl3",
    "spdx license identifier gpl 3 0 or later": "spdx_gpl3",
    "spdx license identifier lgpl 2 1 or later": "spdx_lgpl21",
    "spdx license identifier mpl 2 0": "spdx_mpl2",
    "spdx license identifier cc0 1 0": "spdx_cc0",
}
# Licence, kind, and the identifier that tells it, for those.
FURTHER_RULES = tuple(
    (name, kind, (i,))
    for name, kind, ids in (
        ("AGPL-3.0", "copyleft", "agpl3_title agpl3_notice agpl3_free"),
        ("Apache-2.0", "permissive", "ap_title spdx_apache"),
        ("BSD-2-Clause", "permissive", "spdx_bsd2"),
        ("BSD-3-Clause", "permissive", "spdx_bsd3"),
        ("CC-BY-3.0", "permissive", "cc_by3"),
        ("CC-BY-SA-3.0", "copyleft", "cc_by_sa3"),
        ("CC0-1.0", "permissive", "cc0_title cc0 spdx_cc0"),
        ("GPL-2.0", "copyleft", "gpl2_title spdx_gpl2"),
        ("GPL-3.0", "copyleft", "gpl3_title spdx_gpl3"),
        ("ISC", "permissive", "isc_notice isc_grant spdx_isc"),
        ("LGPL-2.1", "copyleft", "lgpl21_title lgpl21_notice lgpl21_free spdx_lgpl21"),
        ("LGPL-3.0", "copyleft", "lgpl3_title"),
        ("MIT", "permissive", "spdx_mit"),
        ("MPL-2.0", "copyleft", "spdx_mpl2"),
    )
    for i in ids.split()
)
# Licence, kind, and the ordered identifiers of its rule.
RULES = (
    ("Apache-2.0", "permissive", ("ap_notice",)),
    ("Apache-2.0", "permissive", ("ap_comply", "ap_copy", "ap_as_is")),
    ("BSD-2-Clause", "permissive", ("bsd_source", "bsd_binary")),
    ("BSD-3-Clause", "permissive", ("bsd_source", "bsd_binary", "bsd_name")),
    ("CC-BY-4.0", "permissive", ("cc_by",)),
    ("CC-BY-NC-4.0", "restricted", ("cc_by_nc",)),
    ("CC-BY-NC-ND-4.0", "restricted", ("cc_by_nc_nd",)),
    ("CC-BY-NC-SA-4.0", "restricted", ("cc_by_nc_sa",)),
    ("CC-BY-ND-4.0", "restricted", ("cc_by_nd",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa",)),
    ("GPL-2.0", "copyleft", ("gpl2_notice",)),
    ("GPL-3.0", "copyleft", ("gpl3_notice",)),
    ("GPL", "copyleft", ("gpl_free", "gpl_hope")),
    ("LGPL-3.0", "copyleft", ("lgpl3_notice",)),
    ("MIT", "permissive", ("mit_notice",)),
    ("MIT", "permissive", ("mit_grant", "mit_keep", "mit_as_is")),
    ("MPL-2.0", "copyleft", ("mpl2_notice",)),
    ("Public-Domain", "permissive", ("public_domain",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("All-Rights-Reserved", "restricted", ("reserved",)),
)
#: Each known sentence has one of these words.
WORDS = ("licen[sc]e", "copyright", "permission", "warrant", "redistribut", "public domain", "rights reserved", "neither the name", "legal code")
# Whole sentences of the licence texts where SENTENCES has a shortened one, pieces as sentence ends cut them,
# and further wordings.
WHOLE_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit_keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "neither the name of": "bsd_neither",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_nor",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_free",
    "either version 2 of the license or at your option any later version": "gpl2_either",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_free",
    "is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
}
#: Of these, sentences that begin with words of the licensed work's own, and ones that others follow.
AFTER_WORDS = ("is distributed in the hope", "nor the names of")
BEFORE_WORDS = ("neither the name of",)
# Rules over those.
WHOLE_RULES = (
    ("BSD-3-Clause", "permissive", ("bsd_source", "bsd_binary", "bsd_neither", "bsd_nor")),
    ("GPL", "copyleft", ("gpl2_free", "gpl_hope")),
    ("GPL", "copyleft", ("gpl3_free", "gpl_hope")),
    ("GPL-2.0", "copyleft", ("gpl_free", "gpl2_either", "gpl_hope")),
    ("GPL-2.0", "copyleft", ("gpl2_free", "gpl_hope")),
    ("GPL-3.0", "copyleft", ("gpl3_free", "gpl_hope")),
    ("LGPL-3.0", "copyleft", ("lgpl3_free", "gpl_hope")),
)
#: Words before a notice, in its sentence, that deny it ("not only" does not).
DENIALS = r"not(?!\sonly) never no nor neither cannot without nothing none unless if whether isn wasn aren weren don doesn longer previously formerly"
#: What may follow a notice in its sentence: where the licence is found.
POINTERS = "(?: (?:please )?see (?:the )?(?:accompanying )?licen[sc]e(?: md| txt)?(?: file)?(?: for (?:more |further |full )?(?:details|information))?)?"
#: An identifier's first words may follow what stands before them in a sentence ("copyright 2020 x. all rights reserved").
SENTENCE_END = r"([.!?;:])[ \t\r]+"


def rule_pattern(identifiers: tuple[str, ...]) -> str:
    """A regular expression over ' id id id ' for the identifiers in this order."""
    return ".*".join(f" {re.escape(i)} " for i in identifiers)


def normalised(text: Column) -> Column:
    """Lower-case words with single spaces; a line break within a paragraph is one newline, each end of a sentence or paragraph an E."""
    # "v. 2.0" ends no sentence, nor does the colon of a machine-readable line
    numbered = F.regexp_replace(F.lower(text), r"\bv[.](?=[ \t\r\n]+[0-9])", "v")
    numbered = F.regexp_replace(numbered, r"\b(spdx-license-identifier):", "$1")
    ended = F.regexp_replace(numbered, r"[.!?;:](?=[ \t\r\n]|\z)", "E")
    words = F.regexp_replace(F.regexp_replace(ended, r"[^a-z0-9E\n]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(words, r"[ \n]*(?:E|\n\n)[ \nE]*", "E"))


UNDER = "(?:licensed|released|distributed|published|available|provided) under (?:the terms of )?(?:(?:the|a|an) )?"


def sentence_patterns() -> list[tuple[str, str]]:
    """(identifier, regular expression that finds its sentences in a normalised text), in the order to apply them.

    A space stands for a space, a line break, or the mark of a space behind a denial.
    """
    notices = {ids[0] for _, _, ids in (*RULES, *FURTHER_RULES) if len(ids) == 1}
    found: dict[str, list[str]] = {}
    objects: dict[str, list[str]] = {}
    for sentence, i in sorted({**SENTENCES, **FURTHER, **WHOLE_SENTENCES}.items(), key=lambda x: -len(x[0])):
        if i in notices:
            sentence = re.sub(r"licen[sc]e\b", "licen[sc]e", sentence)
            # one wording of what licenses stands for the others
            if m := re.match("(?:this work is )?(?:licensed|released) under (?:(?:the|a) )?", sentence):
                objects.setdefault(i, []).append(sentence[m.end() :])
                sentence = UNDER + sentence[m.end() :]
        found.setdefault(i, []).append(sentence)
    starts, ends = "(?<![a-z0-9 _])", "(?![a-z0-9 _])"
    out = []
    for i, sentences in found.items():
        body = "(?:" + "|".join(dict.fromkeys(sentences)) + ")"
        if i in notices:
            # a plain space stands before any denial only
            whole = f"(?:{starts}|(?<=[ ])){body}(?={POINTERS}{ends}| (?:or|and) (?:(?:the|a) )?[a-z0-9])"
        elif any(s.startswith(AFTER_WORDS) for s in sentences):
            whole = f"(?<![a-z0-9]){body}(?:{ends}|(?= https?(?![a-z0-9])))"
        elif any(s.startswith(BEFORE_WORDS) for s in sentences):
            whole = f"{starts}(?:(?:[0-9]{{1,2}}|[a-h]|[ivx]{{1,4}}) )?{body}(?![a-z0-9])"
        else:
            # the label of a list's item may stand before
            whole = f"{starts}(?:(?:[0-9]{{1,2}}|[a-h]|[ivx]{{1,4}}) )?{body}(?:{ends}|(?= https?(?![a-z0-9])))"
        out.append((i, wrapping(whole)))
    # "the one or the other": what follows a notice that has been found
    out += [(i, wrapping(f"(?<=@E) (?:or|and) (?:(?:the|a) )?(?:{'|'.join(dict.fromkeys(names))})(?={POINTERS}{ends})")) for i, names in objects.items()]
    return out


def wrapping(pattern: str) -> str:
    """The pattern with each space outside character classes also met by a line break or a marked space."""
    return "".join(x if x.startswith("[") else x.replace(" ", "[ \\n_]") for x in re.split(r"(\[[^\]]*\])", pattern))


def identifiers(text: Column) -> Column:
    """The identifiers of the text's known sentences, in order."""
    anchors = "|".join(w.replace(" ", "[ \\n]") for w in WORDS)
    sentences = F.filter(F.split(normalised(text), "E"), lambda s: s.rlike(anchors))
    # behind a denial spaces are marked, so that a notice there is none unless it starts a line
    denial = f"(?<![a-z0-9])(?:{'|'.join(DENIALS.split())})(?![a-z0-9])"

    def marked_behind(s: Column) -> Column:
        at = F.regexp_instr(s, F.lit(denial))
        return F.when(at > 0, F.concat(s.substr(F.lit(1), at - 1), F.translate(s.substr(at, F.length(s)), " ", "_"))).otherwise(s)

    marked = F.array_join(F.transform(sentences, marked_behind), "E")
    for i, pattern in sentence_patterns():
        marked = F.regexp_replace(marked, pattern, f"E@{i}@E")
    present = F.lower(text).rlike("|".join(w.replace(" ", r"\s+") for w in WORDS))
    return F.when(present, F.regexp_extract_all(marked, F.lit("@([a-z0-9_]+)@"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_known, the identifier ``sequence``, ``licences`` (sorted, comma-joined) and the strictest ``kind``.

    ``kind`` is restricted, copyleft, permissive or none. A null or empty text has no sentences. Repeated rows give repeated
    results, texts are read whole, other columns are ignored, an empty table gives an empty one.
    """
    rows = docs.select(docs[key].alias("key"), identifiers(F.coalesce(docs[text], F.lit(""))).alias("ids"))
    # each identifier with a space of its own on both sides, so that neighbours do not share one
    rows = rows.withColumn("line", F.array_join(F.transform("ids", lambda i: F.concat(F.lit(" "), i, F.lit(" "))), ""))
    met = F.array(*[F.when(F.col("line").rlike(rule_pattern(ids)), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, ids in (*RULES, *FURTHER_RULES, *WHOLE_RULES)])
    rows = rows.withColumn("met", F.array_compact(met))
    kinds = F.col("met.kind")
    strictest = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in ("restricted", "copyleft", "permissive")], F.lit("none"))
    return rows.select(
        F.col("key").alias(key),
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", " ").alias("sequence"),
        F.array_join(F.array_sort(F.array_distinct("met.name")), ",").alias("licences"),
        strictest.alias("kind"),
    )


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle() -> str:
    """DuckDB SQL: the same sentences and rules as joined tables."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"('{n}', '{k}', '{rule_pattern(ids)}')" for n, k, ids in RULES)
    return rf"""
with known(s, id) as (values {known}),
rule(name, kind, pattern) as (values {rules}),
doc as (select row_number() over () r, doc_id, regexp_replace(coalesce(text, ''), '\b([Vv])[.]([ \t\r\n]+[0-9])', '\1\2', 'g') text from documents),
part as (select r, unnest(string_split_regex(regexp_replace(text, '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), '\n+')) s, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), '\n+'), 1) i from doc),
hit as (select r, i, id from part join known on trim(regexp_replace(lower(part.s), '[^a-z0-9]+', ' ', 'g')) = known.s),
line as (select r, count(*) n, string_agg(id, ' ' order by i) seq, string_agg(' ' || id || ' ', '' order by i) line from hit group by r),
met as (select distinct r, name, kind from line join rule on regexp_matches(line, pattern)),
all_met as (select r, string_agg(distinct name, ',' order by name) licences, case when bool_or(kind = 'restricted') then 'restricted' when bool_or(kind = 'copyleft') then 'copyleft' else 'permissive' end kind from met group by r)
select doc_id, coalesce(n, 0) n_known, coalesce(seq, '') as sequence, coalesce(licences, '') licences, coalesce(kind, 'none') kind
from doc left join line using (r) left join all_met using (r)"""
