"""Token counts under a unigram model, by dynamic programming that words with a common beginning share.

The pre-tokens that a worker hasn't seen are put in a trie that it keeps: a node holds the forward score of its prefix,
so a prefix is scored once however many words and batches share it, and a terminal's number of tokens on the best path
is kept with its word. The vocabulary is a public tokenizer's; its pieces' log-probabilities follow from their ranks.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for the space before a word
NODES = 1_000_000  # of a trie, some 150 bytes each; beyond them it starts afresh
_kept: dict[tuple[str, float, float], Trie] = {}


def rank_scores(pieces: list[str], exponent: float = 1.0) -> dict[str, float]:
    """Log-probabilities that fall with a piece's rank as Zipf's law says: `-exponent * ln(rank + 2)`, less their sum."""
    raw = {p: -exponent * math.log(i + 2) for i, p in reversed(list(enumerate(pieces)))}
    total = math.log(sum(map(math.exp, raw.values())))
    return {p: s - total for p, s in raw.items()}


def pieces(path: str) -> list[str]:
    """A vocabulary's own pieces by rank, without those for control, bytes and the unknown."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Trie:
    """The number of tokens on words' best paths; of equal scores the path with fewer tokens counts.

    A character outside the vocabulary counts a token for each of its UTF-8 bytes, each at the score `unknown`.
    """

    def __init__(self, scores: dict[str, float], unknown: float, nodes: int = NODES) -> None:
        self.scores, self.unknown, self.most, self.longest = scores, unknown, nodes, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.best, self.tokens, self.done = array("d", [0.0]), array("q", [0]), {}

    def count(self, word: str, mark: str = MARK) -> int:
        """Tokens of the mark and the word. A trie that the word would fill starts afresh; a word of more signs than a
        trie has nodes is scored beside it."""
        said, path = mark + word, [0]
        for c in said:
            node = self.child.get(path[-1] << 21 | ord(c))
            if node is None:
                break
            path.append(node)
        if len(self.best) + len(said) + 1 - len(path) > self.most:
            self.clear()
            path = [0]
            if len(said) >= self.most:
                return self._beside(said)
        child, best, tokens = self.child, self.best, self.tokens
        get, unknown, longest = self.scores.get, self.unknown, self.longest
        for i in range(len(path), len(said) + 1):
            above, size = path[-1], len(said[i - 1].encode("utf-8", "surrogatepass"))
            top, least = best[above] + unknown * size, tokens[above] + size
            for j in range(max(0, i - longest), i):
                s = get(said[j:i])
                if s is not None and ((s := s + best[path[j]]) > top or s == top and tokens[path[j]] < least - 1):
                    top, least = s, tokens[path[j]] + 1
            child[above << 21 | ord(said[i - 1])] = len(best)
            path.append(len(best))
            best.append(top)
            tokens.append(least)
        self.done[word] = found = tokens[path[-1]]
        return found

    def _beside(self, said: str) -> int:
        """The same scores with the last positions' alone in memory."""
        get, unknown, longest = self.scores.get, self.unknown, self.longest
        last = deque([(0.0, 0)], maxlen=longest)  # the best score and its tokens up to each of the positions before
        for i in range(1, len(said) + 1):
            size = len(said[i - 1].encode("utf-8", "surrogatepass"))
            top, least = last[-1][0] + unknown * size, last[-1][1] + size
            for j, (score, n) in enumerate(last, i - len(last)):
                s = get(said[j:i])
                if s is not None and ((s := s + score) > top or s == top and n < least - 1):
                    top, least = s, n + 1
            last.append((top, least))
        return last[-1][1]

    def total(self, words: list[str]) -> int:
        out = 0
        for w in words:
            n = self.done.get(w)
            out += self.count(w) if n is None else n
            if len(self.done) > self.most // 2:
                self.clear()
        return out


def _trie(path: str, exponent: float, unknown: float) -> Trie:
    if (path, exponent, unknown) not in _kept:
        _kept[path, exponent, unknown] = Trie(rank_scores(pieces(path), exponent), unknown)
    return _kept[path, exponent, unknown]


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", exponent: float = 1.0, unknown: float = -20.0) -> DataFrame:
    """`(doc_id, n_pretokens, n_tokens)` of every whole text, a row for each row.

    Pre-tokens are what white space parts, each with the mark of a space before it. Null and empty texts have none.
    Repeated rows are counted each, null doc_ids are kept, other columns are left aside whatever their names, and an
    empty table gives an empty result. Nothing is shuffled: a worker keeps one trie for its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(vocabulary, exponent, unknown)
        for batch in batches:
            n, found = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").split()
                n.append(len(words))
                found.append(trie.total(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
