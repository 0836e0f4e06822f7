"""Token counts by dynamic programming shared over a trie (operator 3).

A text's pre-tokens are its words, each with the vocabulary's word mark in front.  A pre-token
is cut into the pieces with the largest sum of unigram scores (ties: fewer pieces).  The best
score of a word's first k characters depends on these alone, so distinct pre-tokens are put in
a trie and the forward step runs once per node: words that share a prefix share its scores.  A
terminal stores its number of pieces; a document's count is the sum over its words.

Each task keeps one trie and starts anew beyond ``MAX_NODES`` nodes, which changes no count.
Nothing is shuffled.

Scores: the vocabulary is a public one, never trained here.  Its pieces come in order of
frequency, so a piece's score is Zipf's log probability of its rank.  A character that is no
piece costs one piece per UTF-8 byte at ``BYTE_PENALTY`` below the rarest piece.

Defined cases: null and empty texts have 0 words, 0 tokens and score 0.  Words of more than
``LONG_WORD`` characters are counted the same way but not kept in the trie.  Repeated rows count
alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chainlens.llm.scratch import table

MARK = "▁"
MAX_NODES = 600_000     # about 200 MB of a task
LONG_WORD = 256
BYTE_PENALTY = 10.0


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece model file, without its control and byte pieces."""
    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or P.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scale = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - scale for r, p in enumerate(pieces)}


class Trie(dict):
    """Maps a word to (pieces, score); missing words are inserted.

    A node is a dict of its children; under the empty key it holds the best score and minus the
    number of pieces of the prefix that leads to it.  ``endings`` is a trie of the vocabulary read
    backwards, so a step looks only at pieces that the prefix ends in.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        super().__init__()
        self.max_nodes = max_nodes
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.endings: dict = {}
        for piece, score in scores.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.steps = 0
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.nodes, self.root = 1, {"": (0.0, 0)}

    def step(self, s: str, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -pieces) of the first ``end`` characters from those of shorter prefixes."""
        self.steps += 1
        start = end - 1
        node = self.endings.get(s[start])
        if node is None or "" not in node:      # no piece of its own: its bytes
            size = len(s[start].encode("utf-8", "surrogatepass"))
            top, pieces = best[start]
            top, pieces = top + size * self.byte, pieces - size
        else:
            top, pieces = float("-inf"), 0
        while node is not None:
            v = node.get("")
            if v is not None:
                score, n = best[start]
                score += v
                if score > top or score == top and n - 1 > pieces:
                    top, pieces = score, n - 1
            if not start:
                break
            start -= 1
            node = node.get(s[start])
        return top, pieces

    def __missing__(self, word: str) -> tuple[int, float]:
        s = MARK + word
        best = [(0.0, 0)]
        if len(word) > LONG_WORD:
            for end in range(1, len(s) + 1):
                best.append(self.step(s, end, best))
            return -best[-1][1], best[-1][0]
        if self.nodes > self.max_nodes:
            self.clear()
        node = self.root
        for end, c in enumerate(s, 1):
            child = node.get(c)
            if child is None:
                child = node[c] = {"": self.step(s, end, best)}
                self.nodes += 1
            node = child
            best.append(node[""])
        score, pieces = node[""]
        out = self[word] = (-pieces, score)
        return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) for every row of ``docs``.

    The vocabulary (a file of fixed size) is read on the driver and sent to the tasks.
    """
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def count(batches):
        trie = Trie(shared.value)
        gc.disable()      # the trie has no cycles, and its nodes would be walked again and again
        try:
            for b in batches:
                n_words, n_tokens, scores = [], [], []
                for text in b.column(1):
                    got = list(map(trie.__getitem__, WORD.findall(text.as_py() or "")))
                    pieces, best = zip(*got) if got else ((), ())
                    n_words.append(len(got))
                    n_tokens.append(sum(pieces))
                    scores.append(round(math.fsum(best), 6))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()),
                                                  pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"])
        finally:
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, score double")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}
