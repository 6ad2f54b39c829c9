import re

from corpus import documents, frame, result

from verdure.llm import licenses


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    padded = "".join(f" {x}" for x in w) + " "
    for r in licenses.default_rules():
        for m in re.finditer(r.regex + "(?= )", padded):
            start = padded[: m.start()].count(" ")
            found.append((start, start + m.group().count(" "), r))
    kept = []
    for n, (s, e, r) in enumerate(found):
        holds = lambda o: o[0] <= s and o[1] >= e and (o[2].priority > r.priority or o[2].priority == r.priority and ((o[0], o[1]) != (s, e) or o[2].order < r.order))  # noqa: E731, B023
        if not any(holds(o) for k, o in enumerate(found) if k != n):
            kept.append(r)
    base = sorted({x for _, x in places})
    at = [i for i, _ in places]
    return {
        "n_words": len(w), "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(r.label for r in kept)})),
        "score": max([0.0, *(0.7 for _ in places[:1]), *(r.confidence for r in kept)]), "n_detections": len(kept),
    }


def test_scan_equals_brute_force(spark):
    got = result(licenses.scan(frame(spark)))
    want = sorted(({"doc_id": r[0], **brute(r[1])} for r in documents()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
    assert got == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["labels"] == "apache,cc-by,cc-by-nc,mit" and by_id[10]["n_base"] == 5
    assert by_id[16]["labels"] == "gpl,mit" and by_id[4]["score"] == 0.0


def test_hundreds_of_rules_and_empty_table(spark):
    assert len(licenses.default_rules()) > 350 and len(licenses.SINGLE) > 50
    assert licenses.scan(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_runs_of_numbers(spark):
    text = "licensed under the mit license version " + "1 " * 60_000 + " copyright " + "2020 " * 60_000 + "cc by " * 20_000
    row = licenses.scan(frame(spark, [(1, text, "en", "a", 0)])).first()
    assert row["n_base"] == 20_001 and row["first_word"] == 3 and "mit" in row["labels"]


#: Texts that a list of common keywords would pass over, with the label each must get.
RARE = (
    ("Released under Apache-2.0.", "apache"),
    ("distributed under the terms of the MPL 2.0", "mpl"),
    ("BSD 3-Clause", None),
    ("bsd 3 clause 2", "bsd-3-clause"),
    ("available under isc", "isc"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("Creative Commons Attribution NonCommercial ShareAlike 4.0", "cc-by-nc-sa"),
    ("creative commons attribution no derivatives 4 0", "cc-by-nd"),
    ("creative commons attribution non commercial no derivs 3 0 unported", "cc-by-nc-nd"),
    ("published under expat", "mit"),
    ("the terms of wtfpl", "wtfpl"),
    ("Copyright (c) 2019 2020 Somebody", "copyright"),
    ("released under apache" + " x" * 50, "apache"),
    ("Copyright (c) " + " ".join(str(1990 + k) for k in range(30)) + " Somebody", "copyright"),
    ("apache license version 2x", "apache"),
    ("licensed under gpl 2 or later 3x", "gpl"),
    ("Neither the name of the Société Générale of Applied and Theoretical Research in Nine Far Away Towns nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("gpl 2 or later with classpath exception", "classpath-exception"),
    ("see https://opensource.org/licenses/MIT and http://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"),
    ("No license is granted", "no-license"),
)


def test_texts_without_common_keywords(spark):
    rows = [(n, text, "en", "a", 0) for n, (text, _) in enumerate(RARE)]
    got = result(licenses.scan(frame(spark, rows)))
    assert got == [{"doc_id": n, **brute(text)} for n, (text, _) in enumerate(RARE)]
    for row, (text, label) in zip(got, RARE):
        assert label is None or label in row["labels"].split(",") and row["score"] > 0, text


def test_versions_of_products_are_no_licenses(spark):
    rows = [(0, "ruby 3; php 8; python 3; x11 7", "en", "a", 0), (1, "you need a commercial license for that", "en", "a", 0), (2, "under the PHP license", "en", "a", 0)]
    assert [r["labels"] for r in result(licenses.scan(frame(spark, rows)))] == ["", "", "php"]


def test_needed_literals_hold_in_every_match():
    for r in licenses.default_rules():
        assert r.needs and all(g and min(map(len, g)) >= licenses.LEAST for g in r.needs), r.regex
        for text in samples(r.regex):
            padded = text + " "
            assert re.fullmatch(r.regex, text) and all(any(k in padded for k in g) for g in r.needs), (text, r)


def test_words_of_a_text_open_its_rules_and_few_others():
    rules = licenses.default_rules()
    by_word, always = licenses.gates(rules)
    assert len(always) < 5 and max(map(len, by_word.values())) < len(rules) / 4
    for n, r in enumerate(rules):
        for text in samples(r.regex):
            assert n in always or any(n in by_word.get(w, ()) for w in text.split(" ")), (text, r)
    prose = "the house of the king and the river is in a valley for it was on that hill with all of us"
    assert len({n for w in prose.split() for n in by_word.get(w, ())}) < 20


def test_rules_without_whole_words_are_always_tried(spark):
    rules = tuple(licenses.Rule(n, label, rx, 0, 0.5, licenses.needed(rx)) for n, (label, rx) in enumerate([("odd", r" [^ ]*cense[a-z]*"), ("any", r" x[0-9]")]))
    assert licenses.gates(rules) == ({}, [0, 1])
    got = result(licenses.scan(frame(spark, [(1, "a Sublicensee x1", "en", "a", 0), (2, "none", "en", "a", 0)]), rules))
    assert [r["labels"] for r in got] == ["any,odd", ""]


def samples(regex, n=12):
    """Random strings that a regex matches."""
    import random
    from re import _constants as c
    from re import _parser

    def one(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                o, a = rng.choice(arg)
                out += chr(a if o is c.LITERAL else rng.randint(*a))
            elif op is c.SUBPATTERN:
                out += one(arg[3])
            elif op is c.BRANCH:
                out += one(rng.choice(arg[1]))
            elif op is c.NOT_LITERAL:
                out += "k"
            elif op in (c.ASSERT, c.ASSERT_NOT):
                continue
            elif op in (c.MAX_REPEAT, c.POSSESSIVE_REPEAT):
                out += "".join(one(arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
            else:
                raise ValueError(op)
        return out

    rng = random.Random(regex)
    return [one(_parser.parse(regex)) for _ in range(n)]
