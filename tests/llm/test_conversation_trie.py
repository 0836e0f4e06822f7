import hashlib
import re
import zlib

import pytest

from chainlens.llm import conversation_trie as C

COLUMNS = "conv_id long, turn long, role string, text string, key string, row long, node long, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], COLUMNS)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, digest(*t[2:])))] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def by_hand(convs):
    """Rows of the contract from all prefixes of all conversations."""
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[:-1] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ended = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved,
                    hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(n, longest=6):
    """Conversations that share openings, some of them equal, some within others."""
    rows = []
    for c in range(n):
        for t in range(1 + (c * 7) % longest):
            said = f"turn {t} of {c % 3 if t < 3 else c % 5}  \n"
            rows.append((c, t, ["user", "assistant", None][(t + (c % 4 == 3)) % 3], said if t % 4 != 3 else None))
    return rows


def got(spark, rows, group):
    return sorted(map(tuple, C.trie(spark, C.rebuilt(spark, frame(spark, rows)), group).collect()), key=str)


@pytest.mark.parametrize("group", [0, 4, 1000])
def test_equals_all_prefixes(spark, group):
    """Level by level, mixed, and in one block."""
    rows = talk(60)
    assert got(spark, rows, group) == by_hand(rebuilt(rows))


def test_deep_and_hot(spark, monkeypatch):
    """Two conversations of 70 turns that part at the end, and one opening that a third of all have."""
    rows = [(c, t, "user", f"deep {t}" if t < 68 or c == 300 else f"other {t}") for c in (300, 320) for t in range(70)]
    rows += [(c, 0, "system", "you are helpful") for c in range(400, 520)] + [(c, 1, "user", f"q {c % 40}") for c in range(400, 520)]
    rows += talk(40)
    monkeypatch.setattr(C, "RUN", 7)
    levels = []
    inner = C._peel_level
    monkeypatch.setattr(C, "_peel_level", lambda r, d: levels.append(d) or inner(r, d))
    assert got(spark, rows, 16) == by_hand(rebuilt(rows))
    assert len(levels) < 8          # not one for each of 70 levels


def test_query(spark, tmp_path):
    rows = talk(50)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, C.op11_conversation_trie(spark, str(tmp_path)).collect()), key=str) == by_hand(rebuilt(rows))


def test_odd_rows(spark):
    rows = talk(45) + [(7, 1, "user", "a tie"), (7, 1, "user", "another"), (7, 1, "user", "a tie"), (8, None, "user", "first"),
                       (8, None, None, None), (None, 0, "user", "no id"), (-5, 0, "user", "minus"), (-20, 0, "user", "minus"),
                       (901, 0, "user", "gone"), (903, 0, "", "empty role " * 20_000), (904, 0, "us", "erx"), (905, 0, "user", "x")]
    assert got(spark, rows, 4) == by_hand(rebuilt(rows))
    empty = C.trie(spark, C.rebuilt(spark, frame(spark, rows[:0])))
    assert empty.count() == 0 and "ends_sha256" in empty.columns
    turnless = [(c, 0, "user", "x") for c in range(1, 20)]      # all lose their turn, but for those with h = 0
    assert got(spark, turnless, 512) == by_hand(rebuilt(turnless))


def test_ids_of_a_node_are_hashed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(C, "RUN", 3)
    ids = [*range(95, 131), -4, 7]
    convs = spark.createDataFrame([(c, 1, bytes([c % 2]) * 16, [2]) for c in ids], "conv_id long, depth int, chain binary, words array<int>")
    found = {bytes(r.key): r.ends_sha256 for r in C.ends(spark, convs).collect()}
    for k in (0, 1):
        told = ",".join(str(c) for c in sorted(ids) if c % 2 == k)
        assert found[bytes([k]) * 16] == hashlib.sha256(told.encode()).hexdigest()
