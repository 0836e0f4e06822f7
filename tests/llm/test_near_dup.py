import os
import random

import numpy as np

from chainlens.llm import near_dup
from chainlens.llm.links import linked_components
from chainlens.llm.shingles import Circulant, shingle_set
from tests.llm.common import COLUMNS, frame, prose, shingles, words


def edited(text, n, seed):
    """``text`` with ``n`` words replaced."""
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: (len(s), first[find(i)], d == first[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def rows_of_edits():
    rows = []
    for base in range(6):
        text = prose(220, base)
        rows += [(100 * base + k, edited(text, n, 100 * base + k)) for k, n in enumerate([0, 1, 2, 3, 5, 6, 8, 12, 20])]
        rows += [(100 * base + 50, text), (100 * base + 51, text.upper()), (100 * base + 52, text.replace(" ", " \n\t"))]
    # a chain: each links with the next one only
    w = prose(400, 99).split(" ")
    rows += [(1000 + k, " ".join(w[12 * k:12 * k + 160])) for k in range(12)]
    # a common passage that makes no link
    line = prose(100, 77)
    rows += [(2000 + k, line + " " + prose(60, 3000 + k)) for k in range(40)]
    rows += [(3000, "one two"), (3001, "One  two"), (3002, "one"), (3003, "a b c d e"), (3004, "a b c d e")]
    rows += [(3010, None), (3011, ""), (3012, " \n ")]
    return rows


def test_components_equal_brute_force(spark):
    rows = rows_of_edits()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark, frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_stage_keeps_one_of_each(spark):
    rows = rows_of_edits()
    docs = frame(spark, rows)
    out = near_dup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, v in brute(rows).items() if v[2])


def test_empty_null_and_repeated_ids(spark):
    assert near_dup.near_duplicates(spark, spark.createDataFrame([], COLUMNS)).count() == 0
    text = prose(50, 5)
    got = near_dup.near_duplicates(spark, frame(spark, [(None, text), (3, text), (3, text), (3, prose(50, 6))])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, 3, False), (3, 3, True), (3, 3, True), (3, 3, True)]


def test_circulant_signature_estimates_similarity():
    a, b = shingle_set(prose(400, 1)), shingle_set(edited(prose(400, 1), 12, 4))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    m = Circulant(1024, 4)
    guess = float((m.signature(a) == m.signature(b)).mean())
    assert abs(guess - truth) < 0.06
    # a coordinate is the minimum of one run of the permutation, shifted by one per coordinate
    assert m.signature(a)[5] == min(m.runs[p][5] for p in m.place(a))


def test_rounds_are_exact_for_any_bucket(spark):
    """All members in one bucket: hubs, peeling and the last comparison find every link."""
    rows = rows_of_edits()
    sets = {i: shingle_set(t) for i, (_, t) in enumerate(rows) if len(shingle_set(t))}
    least = min(map(len, sets.values()))
    members = spark.createDataFrame([(1, i, len(s), least) for i, s in sets.items()], "bkey long, node long, n int, least int")
    grams = spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)]) for i, s in sets.items()], "node long, grams array<long>")
    comp = {r.node: r.comp for r in linked_components(spark, members, grams, 75).collect()}
    want = brute(rows)
    groups = {}
    for i in sets:
        groups.setdefault(comp.get(i, i), set()).add(rows[i][0])
    expected = {}
    for i in sets:
        expected.setdefault(want[rows[i][0]][1], set()).add(rows[i][0])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_stage_judges_rows_and_not_ids(spark):
    one, two, three, four = (prose(60, 4100 + i) for i in range(4))
    near = " ".join(["changed", *words(three)[1:]])
    rows = [(1, one), (5, one), (5, two), (7, three), (7, near), (None, three), (None, four), (None, four), (None, prose(60, 4200))]
    got = sorted((r.doc_id or 0, r.text) for r in near_dup.stage(spark, frame(spark, rows), "").collect())
    stays = [x for x in got if x[0] == 7]
    assert len(stays) == 1 and stays[0][1] in (three, near)
    assert [x for x in got if x[0] != 7] == sorted([(0, four), (0, prose(60, 4200)), (1, one), (5, two)])


def test_the_stage_leaves_no_table_that_nobody_reads(spark, monkeypatch):
    from chainlens.llm import scratch
    made = []
    path = scratch.scratch_path
    monkeypatch.setattr(scratch, "scratch_path", lambda s, name: made.append(path(s, name)) or made[-1])
    got = near_dup.stage(spark, frame(spark, rows_of_edits()), "")
    left = {os.path.basename(p).split("-")[1] for p in made if os.path.exists(p)}
    assert any("sets" in p for p in made) and not left & {"signed", "sets", "members", "shared", "copies", "extra"}
    assert got.count() > 0
