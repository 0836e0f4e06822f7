import re

from chainlens.llm import license_texts, licenses
from tests.llm.common import COLUMNS, frame, lower, prose

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
TEXTS = [None, "", "...", "CC BY", "cc-by-nc, cc by", "general public license general public license", "general public licenses",
         "All rights reserved. all RIGHTS\nreserved", "This work is licensed under the GNU General Public License, version 3.",
         "Licensed under the Apache License, Version 2.0.", "Licensed under Apache, Version 2.0", "Released under the MIT License.",
         "Licensed under CC BY-NC 4.0.", "égeneral public license ccé by", "a" * 3000 + " cc_by", prose(20_000, 1) + " cc by",
         "Copyright (c) 2020 Some Body. All rights reserved", "copyright " + "x " * 20 + "all rights reserved",
         "Licensed under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"]


def test_base_equals_brute_force(spark):
    got = licenses.scan(frame(spark, list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(TEXTS[r.doc_id] or ""))
        hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        places = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score == 1) == bool(r.labels)


def test_templates(spark):
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(frame(spark, list(enumerate(TEXTS)))).collect()}
    want = {8: {"gpl", "gpl-notice"}, 9: {"apache-2.0"}, 10: {""}, 11: {"mit"}, 12: {"cc-by", "cc-by-nc"},
            16: {"reserved", "copyright"}, 17: {"reserved"}, 18: {"gpl", "gpl-notice"}}
    for i, labels in want.items():
        assert got[i] == labels, TEXTS[i]


def expand(parts):
    """All word sequences of a template, wildcards as None."""
    out = [[]]
    for p in parts:
        if isinstance(p, str):
            out = [o + [p] for o in out]
        elif isinstance(p, tuple):
            out = [o + [None] * k for o in out for k in range(p[0], p[1] + 1)]
        else:
            out = out + [o + e for o in out for e in expand(p)]
    return out


def test_automaton_equals_expansion():
    template = "a [[ b [[ c ]] ]] {{0..2}} d [[ e ]]"
    forms = expand(["a", ["b", ["c"]], (0, 2), "d", ["e"]])
    machine = licenses.compile_templates({"t": template})
    import itertools
    for n in range(1, 7):
        for text in itertools.product("abcde", repeat=n):
            want = any(len(f) <= n and all(x is None or x == y for x, y in zip(f, text)) for f in forms)
            labels, share = machine.run([w.encode() for w in text], 0)
            assert (labels == {"t"}) == want and (share == 1.0) == want


def plain(template, chosen="one", optional=False):
    """A text of the template: replaceable regions as their fewest words, optional ones all or none."""
    out, depth = [], 0
    for p in re.findall(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+", template):
        depth += (p == "[[") - (p == "]]")
        if p in ("[[", "]]") or depth and not optional:
            continue
        out += [chosen] * int(p[2:].split(".")[0]) if p.startswith("{{") else [p]
    return out


def test_whole_license_texts(spark):
    rows, want = [], {}
    for label, template in license_texts.WHOLE_TEXTS.items():
        for optional in (False, True):
            text = plain(template, optional=optional)
            want[len(rows)] = (label, True)
            rows.append((len(rows), prose(30, 5) + "\n" + "\n// ".join(text).upper() + "\n" + prose(30, 6)))
        text = plain(template)
        # each tenth mandatory word changed, one at a time, and the text cut short
        fixed = [i for i, w in enumerate(text) if w != "one" and re.search("[A-Za-z]", w)]
        for i in fixed[1::10] + fixed[-1:]:
            want[len(rows)] = (label, False)
            rows.append((len(rows), " ".join(text[:i] + ["qqq"] + text[i + 1:])))
        want[len(rows)] = (label, False)
        rows.append((len(rows), " ".join(text[:len(text) // 2])))
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, (label, found) in want.items():
        labels = set(got[d].labels.split(","))
        assert (label in labels) == found, (label, rows[d][1])
        assert not labels & set(license_texts.WHOLE_TEXTS) - {label} or label.startswith(("lgpl", "gpl")), (label, labels)


def test_share_of_a_whole_text():
    words = plain(license_texts.WHOLE_TEXTS["mit-text"])
    tokens = licenses.tokens(" ".join(words))
    machine = licenses.compile_templates({"mit-text": license_texts.WHOLE_TEXTS["mit-text"]})
    shares = [machine.run(tokens[:n], 0)[1] for n in range(1, len(tokens) + 1)]
    assert shares == sorted(shares) and shares[-1] == 1 and shares[-2] < 1
    mandatory = len(tokens) - 2     # two words are the licensor's
    assert shares[19] == 20 / mandatory


def test_empty_and_repeated(spark):
    assert licenses.scan(spark.createDataFrame([], COLUMNS)).count() == 0
    assert licenses.scan(frame(spark, [(None, "cc by"), (1, "cc by"), (1, "cc by")])).filter("labels = 'cc-by'").count() == 3
