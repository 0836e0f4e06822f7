import hashlib
import random
import re

from chainlens.llm import secrets
from tests.llm.common import COLUMNS, frame, prose, save

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out)


def told(found):
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in found)


def rand(n, seed, chars="0123456789abcdef"):
    return "".join(random.Random(seed).choice(chars) for _ in range(n))


TEXTS = [None, "", "nothing here", "password=abcdefgh", "PASSWORD = 'short'", "token=secret=abcdefgh12 api_key: abcdefgh",
         "token = api_key: abcdefgh", "apikey:\"x\" ApiKey=\"longer.value/9\"", "ünïcödé " * 50 + "passwd: " + rand(18, 1),
         "AKIA" + "A" * 11, "AKIA" + "A" * 12, "AKIAAKIA" + "B" * 9, rand(31, 2), rand(32, 3), rand(40, 4) + "g" + rand(32, 5),
         "🙂 secret=" + rand(40, 6) + " 🙂 " + rand(33, 7), "password password=12345678password=87654321", "ſecret=abcdefgh toKen=abcdefgh",
         prose(20_000, 8) + " token='" + rand(20, 9) + "' " + prose(50, 10)]


def test_base_spans_equal_brute_force(spark):
    got = secrets.scan(frame(spark, list(enumerate(TEXTS)))).select("doc.doc_id", secrets._told("base").alias("told"), "base").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.told == told(spans(TEXTS[r.doc_id])), TEXTS[r.doc_id]


def test_query_columns(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    for r in secrets.op6_secrets(spark, save(frame(spark, rows), tmp_path)).collect():
        found = spans(TEXTS[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in found) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(told(found).encode()).hexdigest()
        assert set(told(found).split(",")) <= set(r.spans.split(","))


def test_markov_adds_random_strings_only(spark):
    prefix = "key material "
    rows = [(i, f"{prose(40, i)} token={rand(24, i)} {prose(40, 500 + i)}") for i in range(150)]
    rows += [(1000 + i, prefix + rand(24, 9000 + i) + " " + prose(30, 2000 + i)) for i in range(40)]
    rows += [(3000, "internationalization counterrevolutionaries " + " ".join("abcdefghijklmnop"[i % 9:] * 2 for i in range(5)))]
    got = {r.doc_id: [x for x in r.spans if x.k == 3] for r in secrets.scan(frame(spark, rows)).select("doc.doc_id", "spans").collect()}
    assert all(not got[i] for i in range(150)) and not got[3000]
    hit = [i for i in range(40) if [(x.s, x.e) for x in got[1000 + i]] == [(len(prefix), len(prefix) + 24)]]
    assert len(hit) >= 38


def test_empty_table_and_no_sample(spark):
    assert secrets.scan(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = secrets.scan(frame(spark, [(1, prose(50, 1)), (1, prose(50, 1)), (None, None)])).collect()
    assert len(rows) == 3 and all(r.spans == [] for r in rows)


def test_many_hits_in_one_text(spark):
    """100,000 hits: work in proportion to them, and the same spans as by a loop."""
    r = random.Random(11)
    kinds = [lambda i: f"token={rand(10, i)}", lambda i: "AKIA" + rand(13, i, "ABCDEFGHIJ0123456789"), lambda i: rand(33, i),
             lambda i: f"secret: {rand(9, i)}+{rand(20, i, 'xyzXYZ01289qQ')}/{rand(12, i)}", lambda i: rand(24, i, "abcxyzXYZ0189kKqQ")]
    text = " ".join(kinds[r.randrange(5)](i) for i in range(100_000))
    small = [(i, f"{prose(30, i)} token={rand(24, i)}") for i in range(20)]
    rows = secrets.scan(frame(spark, [(1000, text), *small])).filter("doc.doc_id = 1000").select("base", "spans").collect()
    assert [(x.s, x.k, x.e) for x in rows[0].base] == spans(text)
    assert len(rows[0].base) > 70_000
    assert [(x.s, x.k, x.e) for x in rows[0].spans if x.k < 3] == spans(text)
    taken = sorted((x.s, x.e) for x in rows[0].spans if x.k == 3)
    hard = sorted((s, e) for s, _, e in spans(text))
    every = sorted([(*x, 1) for x in taken] + [(*x, 0) for x in hard])
    assert all(a[1] <= b[0] for a, b in zip(every, every[1:]) if a[2] or b[2])


def test_score_and_overlap_equal_brute_force(spark):
    """Markov spans by a loop: trained counts, mean ratios, and no overlap with a base span."""
    rows = [(i, f"{prose(20, i)} token={rand(24, i)} {rand(20, 70 + i, 'abcxyzXYZ0189')} {'internationalizations' * (i % 3)}") for i in range(60)]
    rows += [(100, "password=" + rand(30, 1) + "/" + rand(30, 2) + " x" + rand(40, 3, "abcdef0189") + "zz" + rand(20, 4, "qwertyQ9"))]
    docs = frame(spark, rows)
    ratios = secrets.train(docs)
    at = {c: i for i, c in enumerate(secrets.ALPHABET)}
    for r in secrets.scan(docs).select("doc.doc_id", "spans").collect():
        text, want = dict(rows)[r.doc_id], []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            pairs = [ratios[at[a] * secrets.SIZE + at[b]] for a, b in zip(m[0], m[0][1:])]
            score = sum(round(p, 6) for p in pairs) / len(pairs)
            if score > secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, _, e in spans(text)):
                want.append((m.start(), 3, m.end()))
        assert [(x.s, x.k, x.e) for x in r.spans if x.k == 3] == want
