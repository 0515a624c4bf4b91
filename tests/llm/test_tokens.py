import random

import public_tokenizers

from obsengine.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, scores, unknown):
    """Best (score, -tokens) over all ways to cut the word."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        found = [(best[i - 1][0] + unknown * size, best[i - 1][1] - size)]
        found += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        best.append(max(found))
    return -best[-1][1]


def test_shared_prefixes_count_as_each_word_alone():
    rng = random.Random(0)
    scores = tokens.rank_scores(["a", "b", "ab", "aba", "bb", "abab", "c"])
    words = {"".join(rng.choices("abcdé", k=rng.randint(0, 9))) for _ in range(600)}
    want = {w: plain(w, scores, -20.0) for w in words}
    trie = tokens.Trie(scores, -20.0)
    assert {w: trie.count(w, "") for w in words} == want
    small = tokens.Trie(scores, -20.0, 50)  # starts afresh again and again
    assert all(small.total([w, w]) == 2 * plain(tokens.MARK + w, scores, -20.0) for w in words)


def test_prefixes_are_scored_once():
    trie = tokens.Trie(tokens.rank_scores(["a", "b", "ab"]), -20.0)
    for words in (["abab", "abaa"], ["abab", "abba", "ab"], ["abaab"]):
        trie.total(words)
    assert len(trie.best) == 1 + len({(tokens.MARK + w)[:i] for w in ("abab", "abaa", "abba", "ab", "abaab") for i in range(1, 7)} )


def test_whole_texts(spark):
    scores = tokens.rank_scores(tokens.pieces(PATH))
    texts = [None, "", "  ", "the cat sat", "the the the", "naïve 日本 ☃", "word " * 30000, "tab\tand\nline"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "the cat sat", 1), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    got = tokens.token_counts(docs, PATH).collect()
    alone = lambda t: sum(plain(tokens.MARK + w, scores, -20.0) for w in (t or "").split())
    known = {i: (len((t or "").split()), alone(t if i != 6 else "word") * (30000 if i == 6 else 1)) for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_pretokens, r.n_tokens) == known[r.doc_id]
    assert tokens.token_counts(docs.limit(0), PATH).collect() == []


def test_no_word_outgrows_the_trie():
    rng = random.Random(2)
    scores = tokens.rank_scores(["a", "b", "ab", "aba", "bb", "abab", "c"])
    trie, words = tokens.Trie(scores, -20.0, 40), ["".join(rng.choices("abc☃", k=n)) for n in (5, 39, 38, 40, 3000, 7, 3000, 30, 20)]
    for w in words:
        assert trie.total([w]) == plain(tokens.MARK + w, scores, -20.0)
        assert len(trie.best) <= 40 and len(trie.done) <= 20
