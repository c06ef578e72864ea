"""Licence recognition by sentence rules, in DataFrame functions only.

Lines lose what stands before their first letter or digit, such as comment marks, and a text is cut into sentences:
at sentence ends that white space follows, and at paragraph breaks (lines that are empty then). A sentence may
run over several lines, so wrapped licence texts and commented headers are found at any width. Sentences
are brought to normal form (letters and digits in lower case, one space between). Known licence
sentences become identifiers; a sentence that is not known as a whole gives those of its lines that are. The document's
sequence of identifiers is then matched against the rules: a rule is an ordered list of
identifiers that must follow one another, others in between allowed. Where one matched rule's identifiers
are, in order, part of another licence's matched rule, only the longer one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as their authors word them, in normal form (lower case, letters and
# digits, one space between).
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-title-abbreviated": "the mit license mit",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-title": "apache license",
    "apache-version": "version 2 0 january 2004",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-long": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-copy-at": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "version-3": "version 3 29 june 2007",
    "version-3-november": "version 3 19 november 2007",
    "version-2": "version 2 june 1991",
    "version-2-1": "version 2 1 february 1999",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "free-program": "this program is free software",
    "free-library": "this library is free software",
    "terms-gpl3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "terms-gpl2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "terms-gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "terms-agpl3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "terms-lgpl3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "terms-lgpl21": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "either-3": "either version 3 of the license or at your option any later version",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2-1": "either version 2 1 of the license or at your option any later version",
    "terms-gpl": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "terms-agpl": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "terms-lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync-short": "licensed under cc by nc 4 0",
    "ccby-short": "licensed under cc by 4 0",
    "ccbysa-short": "licensed under cc by sa 4 0",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-start": "this source code form is subject to the terms of the mozilla public license v",
    "all-rights": "all rights reserved",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
RULES = {
    "MIT": [["mit-release"], ["mit-licensed"], ["mit-title", "mit-grant"], ["mit-title-short", "mit-grant"], ["mit-title-abbreviated", "mit-grant"], ["mit-grant", "mit-notice"], ["mit-grant", "mit-notice", "mit-warranty"]],
    "ISC": [["isc-title", "isc-grant"], ["isc-grant", "isc-warranty"]],
    "Apache-2.0": [["apache-short"], ["apache-title", "apache-version"], ["apache-long", "apache-use"], ["apache-long", "apache-use", "apache-copy"], ["apache-long", "apache-use", "apache-copy-at"]],
    "GPL-2.0-only": [["gpl2-only"], ["free-program", "terms-gpl2-only"], ["gpl-title", "version-2"]],
    "GPL-2.0-or-later": [["gpl2-free"], ["free-program", "terms-gpl2"], ["free-program", "terms-gpl", "either-2"]],
    "GPL-3.0-only": [["gpl3-work"], ["gpl-title", "version-3"]],
    "GPL-3.0-or-later": [["gpl-free"], ["gpl-free", "gpl-hope"], ["free-program", "terms-gpl3"], ["free-program", "terms-gpl", "either-3"]],
    "AGPL-3.0-only": [["agpl-title", "version-3-november"]],
    "AGPL-3.0-or-later": [["agpl-free"], ["free-program", "terms-agpl3"], ["free-program", "terms-agpl", "either-3"]],
    "LGPL-2.1-only": [["lgpl-title", "version-2-1"]],
    "LGPL-2.1-or-later": [["lgpl21-free"], ["free-library", "terms-lgpl21"], ["free-library", "terms-lgpl", "either-2-1"]],
    "LGPL-3.0-only": [["lgpl-title", "version-3"]],
    "LGPL-3.0-or-later": [["lgpl3-free"], ["free-library", "terms-lgpl3"], ["free-library", "terms-lgpl", "either-3"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]],
    "CC-BY-NC-4.0": [["ccbync-short"]],
    "CC-BY-4.0": [["ccby-short"]],
    "CC-BY-SA-4.0": [["ccbysa-short"]],
    "MPL-2.0": [["mpl2-form"], ["mpl2-start"]],
    "Unlicense": [["public-domain"]],
    "all-rights-reserved": [["all-rights"]],
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What is not a letter or digit at the start of a line, breaks between paragraphs, sentence ends, and the mark put at either.
_START = "(^|\n)[^A-Za-z0-9\n]+"
_PARAGRAPH = "\n\n+"
_END = "([.!?;:])[ \t\r\n]+"
_MARK = "\x01"


def _plain(s: Column) -> Column:
    """Normal form of a piece of text."""
    return F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences in order, their lines inside them still apart."""
    started = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), _START, "$1")
    marked = F.regexp_replace(F.regexp_replace(started, _PARAGRAPH, _MARK), _END, f"$1{_MARK}")
    return F.filter(F.split(marked, _MARK), lambda s: s.rlike("[A-Za-z0-9]"))


def _follows(ids: Column, rule: list[str]) -> Column:
    """Whether the identifiers of the rule occur in this order: a fold that counts how many were met."""
    steps = F.array(*[F.lit(x) for x in rule])
    met = F.aggregate(ids, F.lit(0), lambda n, x: F.when((n < len(rule)) & (x == F.get(steps, n)), n + 1).otherwise(n))
    return met == len(rule)


def _part_of(short: list[str], long: list[str]) -> bool:
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def longer_rules(name: str, rule: list[str]) -> list[list[str]]:
    """Rules of other licences that hold a rule's identifiers in order, and more."""
    return [r for other, rules in RULES.items() for r in rules if other != name and _part_of(rule, r)]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, n_license_sentences, sentence_ids, licenses`` of every whole text.

    ``sentence_ids`` is the ordered sequence, ``licenses`` the sorted names of matched rules, both joined by
    commas, empty where there are none. Null text counts as empty. Texts of any length are read whole. Repeated rows give
    a row each; extra columns are not read; an empty table gives no rows.
    """
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, name)])
    named = lambda s: F.try_element_at(known, _plain(s))
    with_sentences = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    whole = F.transform("s", lambda s: F.struct(named(s).alias("id"), s.alias("s")))
    lines = lambda x: F.filter(F.transform(F.split(x["s"], "\n"), named), lambda i: i.isNotNull())
    ids = F.flatten(F.transform(whole, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).when(x["s"].contains("\n"), lines(x)).otherwise(F.array().cast("array<string>"))))
    found = with_sentences.select("doc_id", F.size("s").cast("long").alias("n_sentences"), ids.alias("ids"))
    names = []
    for name, rules in sorted(RULES.items()):
        hit = [_follows(F.col("ids"), r) & ~F.greatest(*[_follows(F.col("ids"), x) for x in longer_rules(name, r)], F.lit(False), F.lit(False)) for r in rules]
        names.append(F.when(F.greatest(*hit, F.lit(False)), F.lit(name)))
    return found.select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_license_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("ids") > 0, F.array_join(F.array(*names), ",")).otherwise("").alias("licenses"),
    )


def scan_sql() -> str:
    """DuckDB SQL of :func:`scan`."""
    lit = lambda s: "'" + s + "'"
    known = "MAP {" + ", ".join(f"{lit(s)}: {lit(n)}" for n, s in SENTENCES.items()) + "}"
    # With fewer identifiers than rules, an ordered match is a LIKE on the joined sequence.
    def like(rule):
        return "(',' || array_to_string(ids, ',,') || ',') LIKE '%" + "%".join(f",{x}," for x in rule) + "%'"

    def case(name, rules):
        hits = " OR ".join(f"({like(r)}" + "".join(f" AND NOT {like(x)}" for x in longer_rules(name, r)) + ")" for r in rules)
        return f"CASE WHEN {hits} THEN {lit(name)} END"

    names = ", ".join(case(n, rules) for n, rules in sorted(RULES.items()))
    started = "regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '(^|\\n)[^A-Za-z0-9\\n]+', '\\1', 'g')"
    marked = f"regexp_replace(regexp_replace({started}, '\\n\\n+', chr(1), 'g'), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g')"
    plain = lambda s: f"trim(regexp_replace(translate({s}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH cut AS (SELECT doc_id, list_filter(string_split({marked}, chr(1)), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS s FROM documents),
named AS (SELECT doc_id, len(s) AS n_sentences, flatten(list_transform(s, lambda x: CASE WHEN {known}[{plain('x')}] IS NOT NULL THEN [{known}[{plain('x')}]]
    ELSE list_filter(list_transform(string_split(x, chr(10)), lambda l: {known}[{plain('l')}]), lambda i: i IS NOT NULL) END)) AS ids FROM cut)
SELECT doc_id, n_sentences, len(ids) AS n_license_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  CASE WHEN len(ids) > 0 THEN concat_ws(',', {names}) ELSE '' END AS licenses
FROM named"""
