import public_tokenizers as P

from chainlens.llm import token_counts as T
from tests.llm.common import COLUMNS, frame, prose, words

SCORES = T.vocabulary()
TEXTS = [None, "", " ", "a", "hello world hello", "日本語 🙂🙂 naïve", "x" * 400, "the theory then there thereby", prose(2000, 1), "<0x41> <unk> ▁▁"]


def best(word):
    """The plain dynamic programme over one word."""
    s, byte = T.MARK + word, min(SCORES.values()) - T.BYTE_PENALTY
    table = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        options = [(table[k][0] + SCORES[s[k:end]], table[k][1] - 1) for k in range(end) if s[k:end] in SCORES]
        if s[end - 1] not in SCORES:
            size = len(s[end - 1].encode())
            options.append((table[end - 1][0] + size * byte, table[end - 1][1] - size))
        table.append(max(options))
    return -table[-1][1], table[-1][0]


def test_counts_equal_brute_force(spark):
    got = T.count_tokens(spark, frame(spark, list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = [best(w) for w in words(TEXTS[r.doc_id])]
        assert (r.n_words, r.n_tokens) == (len(want), sum(n for n, _ in want))
        assert abs(r.score - sum(s for _, s in want)) < 1e-4


def test_prefixes_are_computed_once():
    trie = T.Trie(SCORES)
    for w in ["there", "thereby", "there", "then", "thereof"]:
        trie[w]
    prefixes = {(T.MARK + w)[:k] for w in ["there", "thereby", "then", "thereof"] for k in range(1, len(w) + 2)}
    assert trie.steps == len(prefixes) == trie.nodes - 1


def test_a_small_trie_counts_alike():
    ws = words(prose(500, 3))
    small, large = T.Trie(SCORES, max_nodes=50), T.Trie(SCORES)
    assert [small[w] for w in ws] == [large[w] for w in ws]


def test_empty_and_repeated(spark):
    assert T.count_tokens(spark, spark.createDataFrame([], COLUMNS)).count() == 0
    rows = T.count_tokens(spark, frame(spark, [(None, "a b"), (1, "a b"), (1, "a b")])).collect()
    assert len({(r.n_words, r.n_tokens, r.score) for r in rows}) == 1
    assert T.vocabulary(P.path("piece_bpe_32k.model")) == SCORES
