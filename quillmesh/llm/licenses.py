"""Licence scans by sentence rules.

A text is cut into sentences: they end at . ; ! or ? before white space and at blank lines, so a
sentence may be wrapped over lines. Lines are looked at by themselves as well, as a notice often is a line without a
full stop. Each is normalised (letters and digits in lower case, everything else one space) and looked
up among known licence sentences. The identifiers found, in text order, form the document's
sequence. Licence rules, tried in order, each name a sequence of identifiers; a rule matches
wherever its identifiers stand one after another in what earlier rules have left.

Everything is a Spark expression. A cheap test for words of which every known sentence has
one leaves out texts that cannot match; it loses none, as it is derived from the
sentences themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised: fixed values. An identifier may have several wordings.
NOTICES = {
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "apache license version 2 0 january 2004": "apache2",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at": "apache-copy",
    "http www apache org licenses license 2 0": "apache-url",
    "https www apache org licenses license 2 0": "apache-url",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "the mit license mit": "mit",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "either version 3 of the license or at your option any later version": "v3-or-later",
    "either version 2 of the license or at your option any later version": "v2-or-later",
    "either version 2 1 of the license or at your option any later version": "v2.1-or-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "distributed under the boost software license version 1 0": "boost",
    "all rights reserved": "reserved",
}
#: Short identifiers of public licences that a line may name: fixed values.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
#: How a notice of the Eclipse licence names it and where it is found: fixed values.
EPL_TERMS = "this program and the accompanying materials are made available under the terms of the eclipse public license {name} which {where}"
EPL_NAMES = ("2 0", "v2 0", "v 2 0")
EPL_WHERE = ("is available at https www eclipse org legal epl 2 0", "is available at http www eclipse org legal epl 2 0", "accompanies this distribution and is available at https www eclipse org legal epl 2 0")
#: Kinds and versions of the Creative Commons licences, and the ways in which a work names one: fixed values.
CC_KINDS = {
    "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}
CC_VERSIONS = ("3.0", "4.0")
CC_WAYS = (
    "licensed under cc {short} {version}", "this work is licensed under cc {short} {version}", "licensed under a creative commons {long} {version} international license",
    "this work is licensed under a creative commons {long} {version} international license", "this work is licensed under the creative commons {long} {version} international license",
)
#: Names of the GNU licences, how what they cover is called, and the notice in one sentence with its version: fixed values.
GNU_NAMES = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
GNU_WORKS = ("program", "library", "file", "software")
GNU_TERMS = "you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
GNU_VERSIONS = ("2", "2.1", "3")


def _words(version: str) -> str:
    return version.replace(".", " ")


def _known() -> dict[str, str]:
    """All known sentences with their identifiers."""
    out = dict(NOTICES)
    for (short, long), version, way in product(CC_KINDS.items(), CC_VERSIONS, CC_WAYS):
        out[way.format(short=short, long=long, version=_words(version))] = f"cc-{short.replace(' ', '-')}-{version}"
    for name in SPDX:
        out["spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")] = f"spdx-{name.lower()}"
    for name, where in product(EPL_NAMES, EPL_WHERE):
        out[EPL_TERMS.format(name=name, where=where)] = "epl2"
    for work in GNU_WORKS:
        out[f"this {work} is free software"] = "gnu-free"
    for kind, name in GNU_NAMES.items():
        terms = GNU_TERMS.format(name=name)
        out[terms] = f"{kind}-notice"
        out[f"this program is free software you can redistribute it and or modify it under the terms of the {name}"] = f"{kind}-notice"
        for work, version in product(GNU_WORKS, GNU_VERSIONS):
            out[f"this {work} is free software {terms} either version {_words(version)} of the license or at your option any later version"] = f"{kind}{version}-or-later"
            out[f"this {work} is free software {terms} version {_words(version)}"] = f"{kind}{version}-only"
            out[f"{terms} either version {_words(version)} of the license or at your option any later version"] = f"{kind}{version}-or-later"
            out[f"{terms} version {_words(version)}"] = f"{kind}{version}-only"
            numbered = GNU_TERMS.format(name=f"{name} version {_words(version)}")
            out[numbered] = out[f"this {work} is free software {numbered}"] = f"{kind}{version}-only"
    return out


SENTENCES = _known()


@dataclass(frozen=True)
class Rule:
    """alone: the licence counts only where no other is found."""

    license: str
    sequence: tuple[str, ...]
    alone: bool = False


def _rules() -> tuple[Rule, ...]:
    """In order: longer sequences before the single sentences they are made of."""
    gnu = {"gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL"}
    full = lambda v: v if "." in v else f"{v}.0"
    out = [Rule("Apache-2.0", ("apache2", "apache-use", "apache-copy")), Rule("Apache-2.0", ("apache2", "apache-use"))]
    out += [Rule("MIT", ("mit", "mit-grant", "mit-condition")), Rule("MIT", ("mit-grant", "mit-condition"))]
    out += [Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")), Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), Rule("BSD", ("bsd-grant", "bsd-source"))]
    out += [Rule(name, (f"spdx-{name.lower()}",)) for name in SPDX]
    for kind, version in product(gnu, GNU_VERSIONS):
        later = f"v{version}-or-later"
        out += [Rule(f"{gnu[kind]}-{full(version)}-or-later", x) for x in (("gnu-free", f"{kind}-notice", later), (f"{kind}-notice", later), ("gnu-free", f"{kind}{version}-or-later"), (f"{kind}{version}-or-later",))]
        out += [Rule(f"{gnu[kind]}-{full(version)}-only", x) for x in (("gnu-free", f"{kind}{version}-only"), (f"{kind}{version}-only",))]
    out += [Rule("Apache-2.0", ("apache2",)), Rule("Apache-2.0", ("apache-copy", "apache-url")), Rule("Apache-2.0", ("apache-url",)), Rule("EPL-2.0", ("epl2",)), Rule("GPL-3.0-only", ("gpl3",)), Rule("GPL-2.0-only", ("gpl2",))]
    out += [Rule(gnu[kind], (f"{kind}-notice",)) for kind in gnu]
    out += [Rule("MIT", ("mit",)), Rule("MIT", ("mit-grant",)), Rule("ISC", ("isc-grant",)), Rule("MPL-2.0", ("mpl2",)), Rule("Unlicense", ("unlicense",)), Rule("CC0-1.0", ("cc0",)), Rule("BSL-1.0", ("boost",))]
    out += [Rule(f"CC-{short.replace(' ', '-').upper()}-{version}", (f"cc-{short.replace(' ', '-')}-{version}",)) for short, version in product(reversed(CC_KINDS), CC_VERSIONS)]
    return (*out, Rule("BSD", ("bsd-grant",)), Rule("Proprietary", ("reserved",), alone=True))


RULES = _rules()

#: A mark that texts do not hold; it is set where a sentence ends: after its stop, and at a line of nothing but comment signs.
_MARK = "\x01"
_STOP, _BLANK = r"([.;!?]+)([ \t\f\r\n]|\z)", r"(\n[ \t\r*/#;-]*)(\n)"


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def signs(sentences: dict[str, str]) -> list[str]:
    """A few long words so that every sentence holds one: always the word that most of the sentences left hold."""
    left, out = set(sentences), []
    words = {w for s in sentences for w in s.split() if len(w) >= 7} | {max(s.split(), key=len) for s in sentences}
    while left:
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w), w))
        out.append(best)
        left = {s for s in left if best not in s}
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _units(text: Column) -> Column:
    """array<struct<at, nr, key>>: lines and sentences, normalised, with the line on which their first word stands."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("at"), F.lit(-1).alias("nr"), normalise(s).alias("key")))
    marked = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), _STOP, f"$1{_MARK}$2"), _BLANK, f"$1{_MARK}$2")
    parts = F.transform(F.split(marked, _MARK), lambda s, i: F.struct(s.alias("s"), i.alias("nr")))
    ends = lambda s: F.size(F.split(s, "\n")) - 1
    # Lines before each part, as a running sum.
    start = F.struct(F.lit(0).alias("line"), F.array().cast("array<int>").alias("seen"))
    before = lambda all_: F.reduce(all_, start, lambda x, p: F.struct((x["line"] + ends(p["s"])).alias("line"), F.array_append(x["seen"], x["line"]).alias("seen")))["seen"]
    head = lambda s: F.regexp_extract(s, r"^[^A-Za-z0-9]*", 0)
    placed = lambda p, line: F.struct((line + ends(head(p["s"]))).alias("at"), p["nr"].alias("nr"), normalise(p["s"]).alias("key"))
    return F.concat(lines, _once(parts, lambda all_: F.zip_with(all_, before(all_), placed)))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """array<struct<at, id>>: known sentences of a text with the line on which they begin, from 0, in text order."""
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    low = F.lower(text)
    some = reduce(or_, (F.contains(low, F.lit(word)) for word in signs(sentences)))
    # Units that cannot be known are left out before the map is searched.
    near = F.array_sort(F.filter(_units(text), lambda s: s["key"].isin(list(sentences))))
    found = F.transform(near, lambda s: F.struct(s["at"].alias("at"), F.element_at(known, s["key"]).alias("id")))
    # A line that is a sentence is listed once.
    alone = _once(found, lambda all_: F.filter(all_, lambda s, i: (i == 0) | ~F.get(all_, i - 1).eqNullSafe(s)))
    none = F.array().cast("array<struct<at:int,id:string>>")
    return F.when(some, alone).otherwise(none)


def match_rules(ids: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Licences of a sequence of identifiers (array<string>), in the order of the rules.

    The sequence is a string of bracketed identifiers, so that a rule is a plain substring;
    what a rule matches is cut out and leaves a mark over which no later rule reaches.
    """
    rest = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    steps = F.array(*(F.struct(F.lit(r.license).alias("license"), F.lit("".join(f"<{x}>" for x in r.sequence)).alias("pattern")) for r in rules))
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    hit = lambda x, r: F.contains(x["rest"], r["pattern"])
    tried = F.reduce(steps, start, lambda x, r: F.when(hit(x, r), F.struct(F.replace(x["rest"], r["pattern"], F.lit("|")).alias("rest"), F.array_append(x["found"], r["license"]).alias("found"))).otherwise(x))
    alone = list({r.license for r in rules if r.alone})
    others = lambda all_: F.filter(all_, lambda x: ~x.isin(alone)) if alone else all_
    named = _once(tried["found"], lambda all_: F.when(F.size(others(all_)) > 0, others(all_)).otherwise(all_))
    return F.when(F.size(ids) > 0, named).otherwise(F.array().cast("array<string>"))


def scan_licenses(df: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with license_sentences (array of at, id) and licenses (array<string>).

    Null and empty texts have neither. A licence named twice is listed once. Columns of
    these names in df are replaced; others pass through.
    """
    found = df.withColumn("license_sentences", sentence_ids(F.coalesce(F.col(text), F.lit("")), sentences))
    ids = F.transform("license_sentences", lambda s: s["id"])
    return found.withColumn("licenses", F.array_distinct(match_rules(ids, rules)))
