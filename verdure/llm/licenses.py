"""License scans by ordered signature rules (DataFrame functions only).

Texts are lower-cased (A-Z) and reduced to words joined by one space. A rule runs only in texts that hold the literals
which its regex cannot match without; they are read off the regex, so that no match is lost. A text's words open rules: only
rules of which it has a word that such a literal cannot do without are looked at further. Every match is an interval of words. An interval that
lies in another of the same or a higher priority is suppressed (of equal intervals of one priority the first rule's
stays); what is left gives the labels and the score.

NULL, empty and literal-free texts have no detections and score 0. Repeated rows repeat their result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from re import _constants as _c
from re import _parser as _p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import along, ascii_lower, let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Literals of fewer characters tell nothing; a regex's literals stay within so many alternatives.
LEAST, MOST = 3, 16
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, pattern of the name). Hand-written names of license families, over normalised words.
FAMILIES = (
    ("gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", r"(?:gnu )?lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", r"(?:gnu )?agpl"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e"),
    ("apache", r"apache(?: software)?(?: foundation)?"),
    ("mit", r"(?:mit|expat)"),
    ("x11", r"x11"),
    ("bsd", r"(?:new |modified |simplified |revised )?bsd"),
    ("bsd-2-clause", r"bsd 2 clause"),
    ("bsd-3-clause", r"bsd 3 clause"),
    ("isc", r"isc"),
    ("mpl", r"mozilla public"),
    ("mpl", r"mpl"),
    ("epl", r"eclipse public"),
    ("cddl", r"common development and distribution"),
    ("cpl", r"common public"),
    ("eupl", r"(?:european union public|eupl)"),
    ("artistic", r"artistic"),
    ("boost", r"boost software"),
    ("zlib", r"zlib(?: libpng)?"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)"),
    ("cc0", r"(?:creative commons zero|cc0)"),
    ("cc-by", r"(?:creative commons attribution|cc by)"),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)"),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv[a-z]*|cc by nd)"),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)"),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)"),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv[a-z]*|cc by nc nd)"),
    ("odbl", r"(?:open database|odbl)"),
    ("odc-by", r"(?:open data commons attribution|odc by)"),
    ("ofl", r"(?:sil )?open font"),
    ("psf", r"python(?: software foundation)?"),
    ("ruby", r"ruby"),
    ("php", r"php"),
    ("w3c", r"w3c(?: software)?(?: notice)?(?: and)?"),
    ("openssl", r"openssl"),
    ("postgresql", r"postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("afl", r"academic free"),
    ("osl", r"open software"),
    ("ms-pl", r"microsoft public"),
    ("ms-rl", r"microsoft reciprocal"),
    ("bsl", r"business source"),
    ("sspl", r"server side public"),
    ("elastic", r"elastic"),
    ("proprietary", r"proprietary"),
)
#: Repeats take all they can and give nothing back, so that the regex engine needs no depth for them and none ends early; each
#: turn ends with its word.
_END = r"(?= |$)"
_NUMBERS = rf"(?: v?[0-9]+{_END})"
#: (form, priority, confidence): how a text names a license; {n} is the family's name.
FORMS = (
    (rf" spdx licen[sc]e identifier {{n}}(?:(?: only| or later| [0-9]+){_END})*+", 3, 1.0),
    (rf" licen[sc]ed under (?:the |an? )?(?:terms of )?(?:the )?{{n}}(?: licen[sc]e)?(?: version)?{_NUMBERS}*+", 3, 0.95),
    (rf" (?:released|distributed|available|published|provided) under (?:the |an? )?(?:terms of )?(?:the )?{{n}}(?: licen[sc]e)?(?: version)?{_NUMBERS}*+", 3, 0.9),
    (rf" (?:terms|conditions) of (?:the |an? )?{{n}}(?: licen[sc]e)?(?: version)?{_NUMBERS}*+", 2, 0.8),
    (rf" {{n}} licen[sc]e version{_NUMBERS}++", 2, 0.85),
    (r" {n} licen[sc]e", 1, 0.7),
    (rf" {{n}}{_NUMBERS}++(?: international| unported)?", 1, 0.6),
)
#: Families whose name with a number is a product's version and no license.
PRODUCTS = ("psf", "ruby", "php", "openssl", "postgresql", "x11", "w3c", "elastic")
#: Hand-written rules beside the families: (label, regex, priority, confidence). Sentences of the licenses'
#: own texts and notices, normalised; they outrank names, as a notice says which license holds and not only that one is named.
_HOLDER = r"(?: (?!nor the names of its )[^ ]+)++"
SINGLE = (
    ("public-domain", r" (?:(?:released|placed|is|are) )*+(?:in |into )?(?:the )?public domain", 1, 0.6),
    ("copyright", rf" copyright(?: c)?(?: [0-9]{{4}}{_END})++", 0, 0.3),
    ("copyright", r" all rights reserved", 0, 0.4),
    ("mit", r" permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("mit", r" the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 4, 0.95),
    ("mit", r" the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 4, 0.7),
    ("json", r" the software shall be used for good not evil", 4, 1.0),
    ("ncsa", r" to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute", 4, 0.9),
    ("bsd", r" redistribution and use in source and binary forms", 3, 1.0),
    ("bsd", r" redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 4, 0.9),
    ("bsd", r" redistributions in binary form must reproduce the above copyright notice", 4, 0.9),
    ("bsd", r" this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties", 4, 0.8),
    ("bsd-3-clause", r" neither the names? of" + _HOLDER + r" nor the names of its contributors may be used to endorse or promote products", 4, 1.0),
    ("bsd-4-clause", r" all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 1.0),
    ("isc", r" permission to use copy modify and or distribute this software for any purpose", 3, 1.0),
    ("isc", r" permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 4, 1.0),
    ("postgresql", r" permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 4, 1.0),
    ("apache", r" you may not use this file except in compliance with the license", 4, 0.95),
    ("apache", r" unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, 0.9),
    ("apache", r" www apache org licenses license 2 0", 4, 1.0),
    ("gpl", r" under the terms of the gnu general public licen[sc]e as published by the free software foundation", 4, 1.0),
    ("gpl", r" this program is free software you can redistribute it and or modify it", 4, 0.9),
    ("gpl", r" this program is distributed in the hope that it will be useful but without any warranty", 4, 0.9),
    ("gpl", r" you should have received a copy of the gnu general public licen[sc]e", 4, 1.0),
    ("gpl", r" either version [23] of the licen[sc]e or at your option any later version", 4, 0.9),
    ("lgpl", r" under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation", 4, 1.0),
    ("lgpl", r" this library is free software you can redistribute it and or modify it", 4, 0.9),
    ("lgpl", r" you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 4, 1.0),
    ("agpl", r" under the terms of the gnu affero general public licen[sc]e", 4, 1.0),
    ("agpl", r" you should have received a copy of the gnu affero general public licen[sc]e", 4, 1.0),
    ("gfdl", r" permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 4, 1.0),
    ("mpl", r" this source code form is subject to the terms of the mozilla public licen[sc]e", 4, 1.0),
    ("mpl", r" if a copy of the mpl was not distributed with this file you can obtain one at", 4, 1.0),
    ("epl", r" this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 4, 1.0),
    ("cddl", r" the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 4, 1.0),
    ("boost", r" permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 1.0),
    ("zlib", r" the origin of this software must not be misrepresented you must not claim that you wrote the original software", 4, 1.0),
    ("zlib", r" altered source versions must be plainly marked as such", 4, 1.0),
    ("zlib", r" this software is provided as is without any express or implied warranty in no event will the authors? be held liable", 4, 0.9),
    ("unlicense", r" this is free and unencumbered software released into the public domain", 4, 1.0),
    ("wtfpl", r" everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 4, 1.0),
    ("cc0", r" has waived all copyright and related or neighbou?ring rights", 4, 1.0),
    ("cc-by", r" this work is licen[sc]ed under (?:a|the) creative commons attribution (?:[1-4] [0-9] )?(?:international |unported |generic )?licen[sc]e", 4, 1.0),
    ("cc-by-sa", r" this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [0-9] )?(?:international |unported |generic )?licen[sc]e", 4, 1.0),
    ("cc-by-nc", r" this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] [0-9] )?(?:international |unported |generic )?licen[sc]e", 4, 1.0),
    ("ofl", r" this font software is licen[sc]ed under the sil open font licen[sc]e", 4, 1.0),
    ("artistic", r" under the same terms as perl itself", 4, 0.8),
    ("psf", r" this licen[sc]e agreement is between the python software foundation", 4, 1.0),
    ("openssl", r" this product includes software developed by the openssl project for use in the openssl toolkit", 4, 1.0),
    ("ms-pl", r" this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 4, 0.9),
    ("sspl", r" if you make the functionality of the program or a modified version available to third parties as a service", 4, 1.0),
    ("elastic", r" you may not provide the software to third parties as a hosted or managed service", 4, 1.0),
    ("commons-clause", r" the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software", 4, 1.0),
    ("gpl-or-later", r" gpl(?: v?[0-9]+(?= |$))*+ or later", 4, 0.9),
    ("gpl-or-later", r" gnu general public licen[sc]e(?: version)? v?[0-9]+ or (?:any )?later", 4, 0.9),
    ("gpl-or-later", r" either version [23] of the licen[sc]e or at your option any later version", 5, 0.9),
    ("lgpl-or-later", r" lgpl(?: v?[0-9]+(?= |$))*+ or later", 4, 0.9),
    ("classpath-exception", r" classpath exception", 4, 0.9),
    ("classpath-exception", r" gives you permission to link this library with independent modules to produce an executable", 4, 1.0),
    ("gcc-exception", r" gcc runtime library exception", 4, 0.9),
    ("llvm-exception", r" llvm exceptions?", 4, 0.9),
    ("font-exception", r" with font exception", 4, 0.9),
    ("linking-exception", r" as a special exception(?: the)?(?: copyright holders?)?(?: of this (?:library|program))? gives? (?:you )?permission to link", 4, 0.9),
    ("mit", r" opensource org licenses mit", 4, 1.0),
    ("bsd-2-clause", r" opensource org licenses bsd 2 clause", 4, 1.0),
    ("bsd-3-clause", r" opensource org licenses bsd 3 clause", 4, 1.0),
    ("gpl", r" gnu org licenses (?:old licenses )?gpl", 4, 1.0),
    ("lgpl", r" gnu org licenses (?:old licenses )?lgpl", 4, 1.0),
    ("agpl", r" gnu org licenses agpl", 4, 1.0),
    ("mpl", r" mozilla org (?:en us )?mpl [0-9]", 4, 1.0),
    ("epl", r" eclipse org legal epl", 4, 1.0),
    ("boost", r" boost org license 1 0", 4, 1.0),
    ("ofl", r" scripts sil org ofl", 4, 1.0),
    ("unlicense", r" unlicense org", 4, 1.0),
    ("cc0", r" creativecommons org publicdomain zero", 4, 1.0),
    ("cc-by", r" creativecommons org licenses by [0-9]", 4, 1.0),
    ("cc-by-sa", r" creativecommons org licenses by sa [0-9]", 4, 1.0),
    ("cc-by-nc", r" creativecommons org licenses by nc [0-9]", 4, 1.0),
    ("cc-by-nd", r" creativecommons org licenses by nd [0-9]", 4, 1.0),
    ("cc-by-nc-sa", r" creativecommons org licenses by nc sa [0-9]", 4, 1.0),
    ("cc-by-nc-nd", r" creativecommons org licenses by nc nd [0-9]", 4, 1.0),
    ("no-license", r" no licen[sc]e(?: is| or right is)? (?:hereby )?(?:granted|given|provided)", 4, 0.8),
    ("no-license", r" not (?:be )?licen[sc]ed (?:for|to) (?:use|any)", 4, 0.6),
    ("beerware", r" if we meet some day and you think this stuff is worth it you can buy me a beer", 4, 1.0),
    ("proprietary", r" unauthori[sz]ed copying of this (?:file|document|software) via any medium is strictly prohibited", 4, 1.0),
    ("proprietary", r" (?:proprietary and confidential|confidential and proprietary)", 4, 0.8),
    ("proprietary", r" may not be (?:copied|reproduced|distributed|disclosed)(?: or (?:copied|reproduced|distributed|disclosed))*+ without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", 4, 0.8),
)


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    regex: str
    priority: int
    confidence: float
    needs: tuple[tuple[str, ...], ...]


def default_rules() -> tuple[Rule, ...]:
    """Every family in every form, then the single rules: hundreds of signatures from three hand-written lists."""
    #: In every form a space leads the name and, beyond the match, follows it.
    named = [(label, form.replace("{n}", name), p, c, needed(form.replace("{n}", "[^ ]+"), f" {name} ")) for form, p, c in FORMS for label, name in FAMILIES if form != FORMS[-1][0] or label not in PRODUCTS]
    return tuple(Rule(n, *r) for n, r in enumerate(named + [(*r, needed(r[1] + " ")) for r in SINGLE]))


def _groups(items) -> list[set[str]]:
    """Sets of literals, of each of which every match of a parsed regex holds one."""
    groups: list[set[str]] = []

    def flush(run: set[str]) -> None:
        least = {s for s in run if not any(o != s and o in s for o in run)}
        if min(map(len, least)) >= LEAST:
            groups.append(least)

    def exact(items) -> set[str] | None:
        """All strings of a part if they are few, else None."""
        out = {""}
        for op, arg in items:
            if op is _c.LITERAL:
                more = {chr(arg)}
            elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
                more = {chr(a) for _, a in arg}
            elif op is _c.SUBPATTERN:
                more = exact(arg[3])
            elif op is _c.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is _c.MAX_REPEAT and arg[:2] == (0, 1):
                more = exact(arg[2])
                more = more and more | {""}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            op, arg = item
            more = exact([item])
            if more is not None and len(run) * len(more) <= MOST:
                run = {a + b for a in run for b in more}
                run = {s for s in run if not any(o != s and s.endswith(o) for o in run)}
                continue
            flush(run)
            run = more or {""}
            if more is None and op is _c.SUBPATTERN:
                walk(arg[3])
            elif more is None and op is _c.BRANCH:
                parts = [_groups(x) for x in arg[1]]
                if all(parts):
                    groups.append({s for p in parts for s in max(p, key=lambda g: min(map(len, g)))})
            elif more is None and op is _c.MAX_REPEAT and arg[0]:
                walk(arg[2])
        flush(run)

    walk(items)
    return groups


def needed(*regexes: str) -> tuple[tuple[str, ...], ...]:
    """Groups of literals read off regexes: what matches them all holds at least one literal of each group."""
    return tuple(tuple(sorted(g)) for g in dict.fromkeys(frozenset(g) for r in regexes for g in _groups(_p.parse(r))))


def _whole(literal: str) -> list[str]:
    """Words that stand whole in a literal, so that every text that holds it has them among its words."""
    return [w for w in literal.split(" ")[1:-1] if w]


def gates(rules: tuple[Rule, ...]) -> tuple[dict[str, list[int]], list[int]]:
    """Places of rules by word, and of rules that no words tell of. A text that a rule matches has one of the rule's words.

    Of a rule's groups of literals that one is taken whose words the fewest rules share."""
    shared = Counter(w for r in rules for w in {w for g in r.needs for s in g for w in _whole(s)})
    by_word: dict[str, list[int]] = {}
    always = []
    for n, r in enumerate(rules):
        told = [{min(_whole(s), key=lambda w: (shared[w], -len(w))) for s in g} for g in r.needs if all(map(_whole, g))]
        if not told:
            always.append(n)
            continue
        for w in min(told, key=lambda ws: sum(shared[w] for w in ws)):
            by_word.setdefault(w, []).append(n)
    return by_word, always


def normalised(text: Column) -> Column:
    """Words joined, led and ended by one space; one space where there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), NOT_WORD, " ")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _word_spans(text: Column, regex: Column) -> Column:
    """Word intervals (start, end) of a regex that begins with a space; its matches end before the next one."""
    rx = F.concat(regex, F.lit("(?= )"))
    found = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.split(text, rx, -1).alias("between"))

    def walk(b: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + _spaces(b["between"][i])
            end = start + _spaces(b["m"][i])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

        return along(F.size(b["m"]), "struct<start:int,end:int>", add)

    return let(found, walk)


def _rule_literals(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.struct(F.lit(r.order).alias("o"), F.lit(r.label).alias("label"), F.lit(r.regex).alias("rx"), F.array(*[F.array(*map(F.lit, g)) for g in r.needs]).cast("array<array<string>>").alias("needs"), F.lit(r.priority).alias("p"), F.lit(r.confidence).alias("c")) for r in rules])


def _survivors(found: Column, levels: int) -> Column:
    """Struct of distinct labels, count and best confidence of intervals that no earlier one of their or a higher priority holds.

    Sorted by start, longest first, an interval lies in another exactly if a running maximum of ends reaches its own."""
    zero = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        held = F.exists(F.sequence(d["p"], F.lit(levels - 1)), lambda k: acc["ends"][k] >= d["end"])
        ends = F.transform(acc["ends"], lambda x, k: F.when(k == d["p"], F.greatest(x, d["end"])).otherwise(x))
        return F.struct(
            ends.alias("ends"),
            F.when(held, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            (acc["n"] + F.when(held, 0).otherwise(1)).alias("n"),
            F.when(held, acc["best"]).otherwise(F.greatest(acc["best"], d["c"])).alias("best"),
        )

    return F.aggregate(found, zero, step)


def detect(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """docs with ``__base`` (label, start, end), ``__found`` (all detections by position) and ``__kept`` (survivors)."""
    rules = default_rules() if rules is None else rules
    levels = max(r.priority for r in rules) + 1
    rows = docs.withColumn("__t", normalised(F.col("text")))
    t = F.col("__t")
    span = "struct<start:int,neg:int,np:int,o:int,end:int,p:int,label:string,c:double>"
    none_base = F.array().cast("array<struct<start:int,end:int,label:string>>")
    by_word, always = gates(rules)

    def places(phrase: str, label: str) -> Column:
        named = F.transform(_word_spans(t, F.lit(f" {phrase}")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains(t, F.lit(f" {phrase} ")), named).otherwise(none_base)

    base = F.concat(*[places(p, label) for p, label in PHRASES.items()])

    def run(r: Column) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), (-r["p"]).alias("np"), r["o"].alias("o"), s["end"].alias("end"), r["p"].alias("p"), r["label"].alias("label"), r["c"].alias("c"))
        return F.transform(_word_spans(t, r["rx"]), one)

    places_of = lambda ns: F.array(*map(F.lit, ns)).cast("array<int>")
    told = places_of(always)
    if by_word:
        words = F.array_distinct(F.filter(F.split(t, " "), lambda w: w.isin(list(by_word))))
        rules_of = F.map_from_arrays(F.array(*map(F.lit, by_word)), F.array(*map(places_of, by_word.values())))
        told = F.array_distinct(F.concat(told, F.flatten(F.transform(words, lambda w: F.element_at(rules_of, w)))))
    asked = F.transform(told, lambda n: F.get(_rule_literals(rules), n))
    opened = F.filter(asked, lambda r: F.forall(r["needs"], lambda g: F.exists(g, lambda s: F.contains(t, s))))
    rows = rows.withColumn("__base", base).withColumn("__found", F.array_sort(F.flatten(F.transform(opened, run))).cast(f"array<{span}>"))
    return rows.withColumn("__kept", _survivors(F.col("__found"), levels))


def scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per document: word count, base places, labels and score."""
    rows = detect(docs.select("doc_id", "text"), rules)
    base = F.col("__base")
    labels = F.array_distinct(F.transform(base, lambda s: s["label"]))
    return rows.select(
        "doc_id",
        (_spaces(F.col("__t")) - 1).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("__kept")["labels"])), ",").alias("labels"),
        F.greatest(F.when(F.size(base) > 0, F.lit(0.7)).otherwise(F.lit(0.0)), F.col("__kept")["best"]).alias("score"),
        F.col("__kept")["n"].cast("long").alias("n_detections"),
    )
