"""License scans by template-markup matching (operator 9).

A template is license wording with markup: ``[[ ... ]]`` encloses an optional region (regions
nest) and ``{{lo..hi}}`` a replaceable one of that many words.  Templates compile to token
automata, which run side by side as the states of one.  A text carries a license where its
words, from some place on, spell every mandatory word of a template in order, optional regions
whole or not at all.  The base phrases are templates without markup.
``license_texts.py`` holds whole license texts and notices: one with a changed or missing
mandatory word, or its first sentence alone, gets no label of it, only its share as ``score``.

Each whole text is cut into words in one pass.  A place is a candidate if the word there starts
some template; only those places run the automaton, so a text without such words costs one
scan.

``score`` is the largest share of a template's mandatory words that one place spells in order
from its start, in [0, 1]: 1 where a template matches.

Defined cases: null and empty texts have no words, no labels, null positions and score 0.
Overlapping and repeated matches all count.  Repeated rows are judged alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chainlens.llm.license_texts import WHOLE_TEXTS
from chainlens.llm.scratch import table

#: The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: How texts refer to a license without its wording, with markup for what may be
#: left out or replaced.
REFERENCES = {
    "apache-2.0": "licensed under the apache license [[ , ]] version 2 0 [[ the license ]]",
    "mit": "[[ released ]] under the mit license",
    "gpl-notice": "licensed under the [[ terms of the ]] [[ gnu ]] general public license [[ as published by the free "
                  "software foundation ]] [[ either ]] version {{1..1}} [[ of the license ]]",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "cc-by-nc": "licensed under [[ a ]] cc by nc [[ {{1..2}} ]]",
    "cc-by-sa": "cc by sa",
    "cc-by-nd": "cc by nd",
    "cc-text": "licensed under [[ a ]] creative commons attribution [[ noncommercial ]] [[ sharealike ]] "
               "[[ noderivatives ]] {{0..4}} license",
    "mpl-2.0": "subject to the terms of the mozilla public license [[ v ]] [[ version ]] 2 0",
    "copyright": "copyright [[ c ]] {{1..8}} all rights reserved",
}
TEMPLATES = REFERENCES | WHOLE_TEXTS

#: Lower-case letters, digits and every byte of a character beyond ASCII are word bytes.
_SPACED = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+")

OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
       "score double")


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


class Automaton:
    """States with word arcs, free arcs and wildcard arcs; several templates in one."""

    def __init__(self):
        self.arcs: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[list[int]] = [[]]
        self.final: dict[int, str] = {}
        self.done: list[float] = [0.0]     # share of the template's mandatory words behind a state

    def state(self) -> int:
        for rows in (self.arcs, self.free, self.any):
            rows.append({} if rows is self.arcs else [])
        self.done.append(0.0)
        return len(self.arcs) - 1

    def add(self, label: str, template: str) -> None:
        parts = _MARKUP.findall(template.lower())
        depth = needed = 0
        for p in parts:
            depth += (p == "[[") - (p == "]]")
            needed += len(tokens(p)) if depth == 0 and not p.startswith("{{") else 0
        at, opened, seen = self.state(), [], 0
        self.free[0].append(at)
        for p in parts:
            if p == "[[":
                opened.append(at)
                new = self.state()
                self.free[at].append(new)
            elif p == "]]":
                new = self.state()
                self.free[at].append(new)
                self.free[opened.pop()].append(new)
            elif p.startswith("{{"):
                low, high = map(int, p[2:-2].split(".."))
                new = at
                ends = [at] if low == 0 else []
                for k in range(1, high + 1):
                    step = self.state()
                    self.any[new].append(step)
                    self.done[step] = seen / needed
                    new = step
                    if k >= low:
                        ends.append(step)
                new = self.state()
                for e in ends:
                    self.free[e].append(new)
            else:
                for word in tokens(p):
                    new = self.state()
                    self.arcs[at].setdefault(word, []).append(new)
                    seen += not opened
                    self.done[new] = min(seen / needed, 1.0)
                    at = new
                continue
            self.done[new] = min(seen / needed, 1.0)
            at = new
        self.final[at] = label

    def closed(self, states) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def starts(self) -> frozenset[bytes]:
        return frozenset(w for s in self.closed([0]) for w in self.arcs[s])

    def run(self, words: list[bytes], at: int) -> tuple[set[str], float]:
        """Labels of the templates matched from word ``at``, and the largest share spelled."""
        now, labels, share = self.closed([0]), set(), 0.0
        for i in range(at, len(words)):
            nxt = set()
            for s in now:
                nxt.update(self.arcs[s].get(words[i], ()))
                nxt.update(self.any[s])
            if not nxt:
                break
            now = self.closed(nxt)
            for s in now:
                if s in self.final:
                    labels.add(self.final[s])
                share = max(share, self.done[s])
        return labels, (1.0 if labels else min(share, 0.999))


def compile_templates(templates: dict[str, str]) -> Automaton:
    a = Automaton()
    for label, template in templates.items():
        a.add(label, template)
    return a


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of ``docs`` with the columns of ``OUT``."""
    def find(batches):
        machine = compile_templates({f"=base {phrase}": phrase for phrase in base} | templates)
        starts = machine.starts()
        for b in batches:
            out = [[] for _ in range(7)]
            for text in b.column(1):
                words = tokens(text.as_py())
                places, labels, own, share = [], set(), set(), 0.0
                if not starts.isdisjoint(words):
                    for i, w in enumerate(words):
                        if w in starts:
                            found, part = machine.run(words, i)
                            share = max(share, part)
                            for label in found:
                                if label.startswith("=base "):
                                    places.append(i)
                                    own.add(base[label[6:]])
                                else:
                                    labels.add(label)
                for column, v in zip(out, (len(words), len(places), min(places, default=None), max(places, default=None),
                                           ",".join(sorted(own)), ",".join(sorted(own | labels)), share)):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(find, OUT)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLE: dict[str, str] = {}
