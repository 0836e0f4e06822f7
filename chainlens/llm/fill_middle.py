"""Fill-in-middle transformation by repeated-capture matching (operator 13).

A text is a run of units.  One match of ``(unit)*`` by the ``regex`` library keeps every repetition
of its group, so ``match.ends(1)`` holds all unit ends: its length is the number of units, and both
cuts are entries of it.  The cuts are drawn from a SHA-256 of seed and id, so reruns agree.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
prefix ``<M>`` middle, ``plain`` the text itself.  A text that spells a sentinel stays plain, so a
sentinel in the other forms is always one of ours and :func:`restored` gives back the text.

A match needs memory in proportion to its units (about 130 bytes each), so a text of more than
``BLOCK`` characters is matched ``BLOCK`` units at a time, each match where the last one ended.
Units are taken left to right, greedily; for such units this gives the same ends.

Defined cases: a null text counts as empty; an empty text, and one that the units don't cover, is
plain (the latter with the number of units before the gap).  A null ``doc_id`` draws as the empty
string.  Rows that repeat an id are cut each, by the same draws.  An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import table

#: The contract's sentinels, seed and shares (of 100).
P, S, M = "<P>", "<S>", "<M>"
SEED, CHANGED, SPM = "1", 90, 20
CODE_POINT = "."
BLOCK = 1 << 20

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Cutter:
    """Cuts texts into units of one pattern."""

    def __init__(self, unit: str = CODE_POINT, block: int = BLOCK):
        if regex.fullmatch(unit, "", regex.DOTALL):
            raise ValueError(f"a unit must not be empty: {unit!r}")
        self.block = block
        self.whole = regex.compile(f"({unit})*", regex.DOTALL)
        self.some = regex.compile(f"({unit}){{0,{block}}}", regex.DOTALL)

    def ends(self, text: str) -> list[int]:
        """Ends of the units of ``text``; the last is ``len(text)`` if the units cover it."""
        if len(text) <= self.block:
            match = self.whole.fullmatch(text) or self.whole.match(text)
            return match.ends(1)
        ends: list[int] = []
        while got := self.some.match(text, ends[-1] if ends else 0).ends(1):
            ends += got
        return ends

    def transform(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(n, form, prefix_chars, middle_chars, output) of one document."""
        ends = self.ends(text)
        n = len(ends)
        draw = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(draw[i:i + 8], 16) for i in range(0, 32, 8))
        if not n or ends[-1] != len(text) or h3 % 100 >= CHANGED or P in text or S in text or M in text:
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < SPM:
            return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
        return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """One row per row of ``docs`` with the columns of ``OUT``; the cuts fall between units."""
    Cutter(unit)      # an empty unit fails here, not in a task

    def cut(batches):
        cutter = Cutter(unit)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [cutter.transform(i, t.as_py() or "") for i, t in zip(ids, b.column(1))]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(cut, OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from ``output`` and ``form`` alone."""
    def part(text: Column, sentinel: str, k: int) -> Column:
        return F.split_part(text, F.lit(sentinel), F.lit(k))

    out = F.col(output)
    middle = part(out, M, 2)
    psm = F.concat(part(part(out, S, 1), P, 2), middle, part(part(out, S, 2), M, 1))
    spm = F.concat(part(part(out, P, 2), M, 1), middle, part(part(out, P, 1), S, 2))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {"op13_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS k1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS k2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(k1, k2) AS a, greatest(k1, k2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""}
