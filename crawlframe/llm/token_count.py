"""Token counts by a unigram model, with dynamic programming shared along a trie.

Distinct pre-tokens are inserted in a trie. A node's best segmentation score
depends on the path to it alone, so it is computed once for all pre-tokens
that share the prefix; a node where a pre-token ends stores its token count.
A text's count is the sum over its pre-tokens.

Pre-tokens are words [^\\x20\\x09-\\x0D]+ after the vocabulary's word mark. The
vocabulary is a public one and isn't trained; it lists pieces by rank, and a
piece of rank r has the log-probability -ln(r + 2) - ln(ln(n)), by Zipf's law.
A character that no piece covers costs one token for each of its UTF-8 bytes.
Ties go to fewer tokens.

The trie is built for each batch of texts, for the pre-tokens whose counts the
worker doesn't remember; both are bounded.

Defined cases: null, empty and blank texts have no tokens; repeated rows are
each counted; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import arrow_batches

MARK = "▁"
#: Log-probability of one UTF-8 byte that no piece covers: under any piece.
BYTE = -20.0
#: Counts that a worker remembers, and pre-tokens in one trie.
MEMORY = 1_000_000
TRIE_WORDS = 50_000


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    listed = list(pieces)
    norm = math.log(max(math.e, math.log(max(3, len(listed)))))
    scores: dict[str, float] = {}
    for rank, piece in enumerate(listed):
        scores.setdefault(piece, -math.log(rank + 2) - norm)
    return scores


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))
    ]


class Vocabulary:
    """Pieces as a trie of characters: node -> {character: node}, and the score of a node that ends a piece."""

    def __init__(self, scores: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.score.append(None)
                at = self.next[at][c]
            self.score[at] = score


class Trie:
    """Distinct pre-tokens; each node holds (score, tokens, bytes) of the best segmentation of its path, and the pieces still open there.

    An open piece is a node of the vocabulary with the result of the path before the piece.
    """

    __slots__ = ("vocabulary", "children", "best", "open")

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        self.open: list[list[tuple[int, tuple[float, int, int]]]] = [[(0, self.best[0])]]

    def _grow(self, parent: int, c: str) -> int:
        following, score = self.vocabulary.next, self.vocabulary.score
        before = self.best[parent]
        width = len(c.encode("utf-8", "surrogatepass"))
        best = (before[0] + BYTE * width, before[1] + width, before[2] + width)
        still = []
        for at, start in self.open[parent]:
            to = following[at].get(c)
            if to is None:
                continue
            if following[to]:
                still.append((to, start))
            own = score[to]
            if own is not None:
                value = start[0] + own
                if value > best[0] or (value == best[0] and start[1] + 1 < best[1]):
                    best = (value, start[1] + 1, start[2])
        still.append((0, best))
        node = len(self.best)
        self.children.append({})
        self.best.append(best)
        self.open.append(still)
        self.children[parent][c] = node
        return node

    def insert(self, word: str) -> tuple[int, int]:
        """Tokens of word, and those of them that are single bytes."""
        at = 0
        for c in word:
            to = self.children[at].get(c)
            at = self._grow(at, c) if to is None else to
        return self.best[at][1:]


class Counter:
    """Counts of pre-tokens. The memory has a young and an old half: what is used moves to the young one."""

    def __init__(self, scores: dict[str, float], memory: int = MEMORY):
        self.vocabulary = Vocabulary(scores)
        self.half = memory // 2
        self.young: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}

    def learn(self, wanted: set[str]) -> None:
        """Have all of wanted in the young half."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        missing = wanted.difference(self.young)
        again = {w: self.old[w] for w in missing if w in self.old}
        self.young.update(again)
        new = sorted(missing.difference(again))
        for at in range(0, len(new), TRIE_WORDS):
            trie = Trie(self.vocabulary)
            for word in new[at : at + TRIE_WORDS]:
                self.young[word] = trie.insert(MARK + word)


_counters: dict[str, Counter] = {}


def count(docs: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, n_byte_tokens), one for each of docs."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        if model not in _counters:
            _counters[model] = Counter(zipf_scores(load_pieces(model)))
        counter = _counters[model]
        for batch in batches:
            split = [[w.decode() for w in (t.as_py() or b"").split()] for t in batch.column(1)]
            gc.disable()  # many tuples and no cycles
            try:
                counter.learn(set(chain.from_iterable(split)))
            finally:
                gc.enable()
            of = counter.young.__getitem__
            sums = [(len(words), *map(sum, zip(*map(of, words), strict=True))) if words else (0, 0, 0) for words in split]
            columns = list(zip(*sums, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_tokens", "n_byte_tokens"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_byte_tokens bigint")
