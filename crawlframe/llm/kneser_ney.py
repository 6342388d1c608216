"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

1. Trusted text: labelled rows of good quality that aren't toxic. The model is
   fitted on all of them, each whole, but those of one fold of HELD (by a hash
   of the id), from which the limits come: a text that the model was fitted on
   has too low a perplexity to tell anything of others.
2. Trigrams are dealt to shards by a hash of the middle word, so that a shard
   has the contexts and the lower orders of its trigrams too. One run over the
   trusted texts tells what a shard can't know of the model by itself
   (`Levels`): the discounts, and unigram counts, which are held by every task
   for the HOT most connected words and sent with the pair of words for others.
3. The trigrams of all documents meet the trusted ones in the same shards, which
   give each text's sum of log-probabilities over all words of its whole text.
   The documents are read once in each of up to PASSES passes, each of which
   deals the trigrams of its own shards; its shuffle files go before the next
   begins. A middle word that would be too much for one shard is split by the
   word before it, or its trusted trigrams go to each of several shards.
   Words are compared by hashes of 64 bits, texts for their sums too.
4. For each language, the limit is a quantile of the perplexities of all
   trusted rows that the model wasn't fitted on, times a margin; documents
   above it go. A short text's mean strays further, so that its limit has
   SPREAD / sqrt(words + 1) besides, on the log scale.

Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased; a text is framed by one start and
one end. Words that the model lacks are one unknown word, whose probability is
the uniform share of the unigram level.

Defined cases: null, empty and blank texts have no perplexity and are dropped;
a language without enough trusted rows (LEAST_ROWS) takes the limit over all
languages; a null language is one of its own; without any trusted row all
texts with words are kept; repeated rows are each scored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import LOWER_BYTES, arrow_batches, key_filter, materialise, maybe_in, tidy

QUANTILE, MARGIN = 0.99, 1.25
LEAST_ROWS = 30
#: One in so many trusted rows is never fitted on.
HELD = 4
SPREAD = 8.0

_START, _END, _UNKNOWN = 0, 1, 2
_FIRST = 3
_SHIFT = np.int64(21)  # bits of a word's number


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_BYTES).split() if text else []


def _ngrams(trusted: DataFrame) -> DataFrame:
    """Rows (w1, w2, w3, c) of trigrams, with empty binary for the start and a line end for the end of a text."""

    def run(batches):
        for batch in tidy(batches):
            rows: dict[tuple, int] = {}
            for text in batch.column(0):
                framed = [b"", b"", *_words(text.as_py()), b"\n"]
                for gram in zip(framed, framed[1:], framed[2:], strict=False):
                    rows[gram] = rows.get(gram, 0) + 1
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.binary()) for c in columns), pa.array(list(rows.values()), pa.int64())],
                names=["w1", "w2", "w3", "c"],
            )

    counted = trusted.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "w1 binary, w2 binary, w3 binary, c bigint"
    )
    # dealt by context, so that its sums need no other shuffle
    return counted.repartition("w1", "w2").groupBy("w1", "w2", "w3").agg(F.sum("c").alias("c"))


def discounts(histogram: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (histogram.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.1), limit - 0.05) for d, limit in ((d1, 1), (d2, 2), (d3, 3)))


def _fitted(grams: DataFrame) -> tuple[float, float, float]:
    return discounts({r["c"]: r["count"] for r in grams.where("c <= 4").groupBy("c").count().collect()})


def _discount(d1: float, d2: float, d3: float) -> Column:
    return F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)


def _level(grams: DataFrame, context: list[str], word: str) -> DataFrame:
    """(context, word, share, weight): the discounted share of the word in its context and what the context leaves."""
    discount = _discount(*_fitted(grams))
    of_context = grams.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(discount).alias("left"))
    joined = grams.join(of_context, context) if context else grams.crossJoin(F.broadcast(of_context))  # one row of sums
    return joined.select(
        *context, word, ((F.col("c") - discount) / F.col("total")).alias("share"), (F.col("left") / F.col("total")).alias("weight"), "c"
    )


class Model:
    """Arrays by order: sorted keys with discounted shares; contexts with weights. Words are numbered by the unigram table."""

    def __init__(self, tri: pa.Table, bi: pa.Table, uni: pa.Table):
        listed = uni.column("w3").combine_chunks()
        self.vocabulary = {w: k + _FIRST for k, w in enumerate(listed.to_pylist())}
        self.vocabulary[b"\n"] = _END
        size = len(listed) + _FIRST
        if size > 1 << int(_SHIFT):
            raise ValueError(f"{size} words are too many for keys of {_SHIFT} bits a word")

        def numbers(column: pa.ChunkedArray) -> np.ndarray:
            at = pc.fill_null(pc.index_in(column.combine_chunks(), value_set=listed), -_FIRST).to_numpy(zero_copy_only=False)
            coded = at.astype(np.int64) + _FIRST  # the start is no unigram: 0
            return np.where(coded == ends, _END, coded)

        found = pc.index(listed, pa.scalar(b"\n", pa.binary())).as_py()
        ends = found + _FIRST if found >= 0 else -1
        value = lambda table, name: table.column(name).to_numpy()
        left = value(uni, "weight")[0] if len(uni) else 1.0
        #: Unigram probabilities by number; what the discounts leave goes to all words and the unknown one alike.
        self.uni = np.full(size, left / (len(listed) + 1))
        np.add.at(self.uni, numbers(uni.column("w3")), value(uni, "share"))
        a = numbers(bi.column("w2"))
        self.bi, self.bi_context = self._table(a, numbers(bi.column("w3")), value(bi, "share"), value(bi, "weight"))
        ab = numbers(tri.column("w1")) << _SHIFT | numbers(tri.column("w2"))
        self.tri, self.tri_context = self._table(ab, numbers(tri.column("w3")), value(tri, "share"), value(tri, "weight"))

    @staticmethod
    def _table(context: np.ndarray, word: np.ndarray, share: np.ndarray, weight: np.ndarray):
        keys = context << _SHIFT | word
        order = np.argsort(keys)
        contexts, first = np.unique(context, return_index=True)
        return (keys[order], share[order]), (contexts, weight[first])

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        own, values = table
        if not len(own):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, values[at], missing)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of each word of the text and of its end."""
        get = self.vocabulary.get
        n = np.array([_START, _START, *(get(w, _UNKNOWN) for w in words), _END], np.int64)
        a, b, c = n[:-2], n[1:-1], n[2:]
        ab, bc = a << _SHIFT | b, b << _SHIFT | c
        p = self.uni[c]
        p = self._look(self.bi, bc, 0.0) + self._look(self.bi_context, b, 1.0) * p
        return self._look(self.tri, a << (2 * _SHIFT) | bc, 0.0) + self._look(self.tri_context, ab, 1.0) * p


def _orders(trusted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three orders (context, word, share, weight) of trusted (text)."""
    arrow_batches(trusted.sparkSession)  # a worker counts a batch at a time
    of = Window.partitionBy("w1", "w2")
    sums = {"total": F.sum("c"), "n1": F.count_if(F.col("c") == 1), "n2": F.count_if(F.col("c") == 2), "n3": F.count_if(F.col("c") > 2)}
    tri = materialise(_ngrams(trusted).select("*", *(x.over(of).alias(n) for n, x in sums.items())), "trigrams")
    d = _fitted(tri)
    left = sum((F.col(f"n{k}") * x for k, x in enumerate(d, 1)), F.lit(0.0))
    # continuation counts: in how many contexts an n-gram of a lower order stands; those at a text's start keep their counts
    bi = (
        tri.groupBy("w2", "w3").agg(F.count("*").alias("n"), F.sum("c").alias("t"))
        .select("w2", "w3", F.when(F.length("w2") == 0, F.col("t")).otherwise(F.col("n")).alias("c"))
    )
    bi = materialise(bi, "bigrams")
    uni = bi.groupBy("w3").agg(F.count("*").alias("c"))
    return (
        tri.select("w1", "w2", "w3", ((F.col("c") - _discount(*d)) / F.col("total")).alias("share"), (left / F.col("total")).alias("weight"), "c"),
        materialise(_level(bi, ["w2"], "w3"), "level"),
        materialise(_level(uni, [], "w3"), "level"),
    )


def fit(trusted: DataFrame) -> Model:
    """The model in one process: for small samples, and what the joins are held against."""
    return Model(*(level.toArrow() for level in _orders(trusted)))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


_MIXER = np.uint64(0x9E3779B97F4A7C15)


def keys(*words: np.ndarray) -> np.ndarray:
    """One key for each n-gram of hashed words; n-grams of different orders have different ones."""
    mixed = words[0] ^ np.uint64(len(words))
    for k, w in enumerate(words):
        if k:
            mixed ^= w
        mixed *= _MIXER
        mixed ^= mixed >> np.uint64(29)
    return mixed


#: Tokens to a shard, which a worker holds; a word or pair with more than a quarter of that in all texts is dealt to several shards.
SHARD = 1 << 21
#: Times that all texts are read, each time for the shards of one pass: so that a pass's share of the tokens is on disk, not all of them.
PASSES = 6
#: Tokens below which one pass does.
PASS_TOKENS = 1 << 22
#: Words at most whose unigram counts every task holds.
HOT = 1 << 18
#: One in so many rows tells the number of tokens and the frequent words, which decide how rows are dealt and nothing else.
SAMPLE = 16
#: Tokens that a task gathers before it sends them, and that a shard scores at once.
CHUNK, BLOCK = 1 << 20, 1 << 19

_S, _E = hashes([b"", b"\n"])  # the start and the end of a text, as no word is
_TRAIN, _TEXT, _SEEN, _PAIR = range(4)
_DEALT = "shard int, kind int, words binary, a binary, b binary, c binary, n binary, docs binary"


def _coded(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of k, and of each element the place of its value."""
    coded = pa.array(k.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def _grouped(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of k sorted, of each element the place of its value, and of each value an element."""
    order = np.argsort(k)
    own = k[order]
    new = np.ones(len(k), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.empty(len(k), np.int64)
    at[order] = np.cumsum(new) - 1
    return own[new], at, order[new]


class Table:
    """Values by key (distinct, hashed): the keys sorted, and where those with the same first bits begin, so that a key is found in a step or two."""

    def __init__(self, own: np.ndarray, values: np.ndarray, missing):
        order = np.argsort(own)
        own, self.size = own[order], len(own)
        #: A key that isn't there has place -1, the last of the values.
        self.values = np.concatenate((values[order], np.array(missing, values.dtype).reshape(1, *values.shape[1:])))
        bits = self.size.bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount((own >> self.shift).view(np.int64), minlength=1 << bits)))).astype(np.int32)
        self.own = np.append(own, np.uint64((1 << 64) - 1))

    def find(self, k: np.ndarray) -> np.ndarray:
        """The place of each of k, or -1."""
        at = self.begin[(k >> self.shift).view(np.int64)]
        less = np.flatnonzero(self.own[at] < k)
        while len(less):
            at[less] += 1
            less = less[self.own[at[less]] < k[less]]
        at[(self.own[at] != k) | (at == self.size)] = -1
        return at

    def of(self, k: np.ndarray) -> np.ndarray:
        """The value of each of k."""
        return self.values[self.find(k)]


def _find(own: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each of k in own, or -1."""
    at = pc.index_in(pa.array(k.view(np.int64)), value_set=pa.array(own.view(np.int64)))
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False)


def _of(own: np.ndarray, values: np.ndarray, k: np.ndarray, missing) -> np.ndarray:
    """The value of each of k, which own may have."""
    if not len(own):
        return np.full(len(k), missing, values.dtype)
    at = _find(own, k)
    return np.where(at >= 0, values[at], values.dtype.type(missing))


def _pack(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return np.int64(raw.size).tobytes() + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind) -> np.ndarray:
    size = int(np.frombuffer(packed[:8], np.int64)[0])
    raw = np.frombuffer(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_EIGHTS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes up to which words are hashed side by side, eight bytes a step.
_SHORT = 64


#: What the hash of a word of so many bytes begins with.
_BEGUN = keys(keys(np.arange(_SHORT + 1, dtype=np.uint64)) ^ np.uint64(3)) ^ np.uint64(1)


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z lower-cased, apart by white space; where in them each word begins and how long it is; how many words each text has."""
    if not len(texts):
        none = np.empty(0, np.int64)
        return np.empty(8, np.uint8), none, none, none
    lowered = pc.ascii_lower((pc.fill_null(texts, b"") if texts.null_count else texts).view(pa.string()))
    _, offsets, data = lowered.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, lowered.offset * 4)
    given = np.frombuffer(data or b"", np.uint8)
    starts = offsets - offsets[0] + np.arange(1, len(texts) + 2)  # a space before each text and after the last
    raw = np.full(starts[-1] + 8, 32, np.uint8)  # and eight bytes from each byte on
    for lo, hi, at in zip(offsets.tolist(), offsets[1:].tolist(), starts.tolist(), strict=False):
        raw[at : at + hi - lo] = given[lo:hi]
    white = (raw - np.uint8(9) < 5) | (raw == 32)
    edges = np.flatnonzero(white[1:] != white[:-1])
    edges += 1
    begin = edges[::2].copy()
    return raw, begin, edges[1::2] - begin, np.diff(np.searchsorted(begin, starts))


def _hashed(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the words, which begin so in raw and are so long (none empty)."""
    eights = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))  # the eight bytes from each byte on
    # each step gives keys(what is hashed so far, the next eight bytes); half of the first depends on the size alone
    h = keys(_BEGUN[np.minimum(size, _SHORT)] ^ (eights[begin] & _EIGHTS[np.minimum(size, 8)]))
    at = np.arange(len(size))
    for done in range(8, _SHORT, 8):
        at = np.flatnonzero(size > done) if done == 8 else at[size[at] > done]
        if not len(at):
            break
        h[at] = keys(h[at], eights[begin[at] + done] & _EIGHTS[np.minimum(size[at] - done, 8)])
    for k in np.flatnonzero(size > _SHORT):
        h[k] = xxhash.xxh3_64_intdigest(raw[begin[k] : begin[k] + size[k]].tobytes())
    return h


def _framed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of each text as start, start, its words, end, one text after another; of each text the places of its first start and its end."""
    raw, begin, size, sizes = _cut(texts)
    ends = np.cumsum(sizes + 3) - 1
    first = ends - sizes - 2
    h = np.empty(ends[-1] + 1 if len(ends) else 0, np.uint64)
    inside = np.ones(len(h), bool)
    for k, frame in ((first, _S), (first + 1, _S), (ends, _E)):
        inside[k] = False
        h[k] = frame
    h[inside] = _hashed(raw, begin, size)
    return h, first, ends


def _around(framed: tuple[np.ndarray, ...], some: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text's row, place, a, b, c) of each trigram, or of those whose middle is one of `some` (true or false by place)."""
    h, first, ends = framed
    middle = np.ones(len(h), bool) if some is None else some
    middle[first] = middle[ends] = False
    at = np.flatnonzero(middle)
    doc = np.repeat(np.arange(len(first)), np.diff(np.searchsorted(at, np.append(first, len(h)))))
    return doc, at, h[at - 1], h[at], h[at + 1]


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(text's row, a, b, c) of each trigram."""
    doc, _, a, b, c = _around(_framed(texts))
    return doc, a, b, c


class Deal:
    """Which shard has which trigrams: those of one middle word are together, as contexts and lower orders of a trigram share it.

    A word that the model has very often is split by the word before it; any other
    very frequent word or pair is spread: its texts' rows are dealt at random and
    its trusted ones go to each of its shards.
    """

    def __init__(self, shards: int, split: dict[int, int], spread: dict[int, int], pairs: dict[int, int]):
        self.shards = shards
        few = lambda x, own: np.array([min(x.get(k, 1), shards) for k in own], np.int64)
        words = [*split, *spread]
        self.words, self.parts, self.wide = np.array(words, np.uint64), few(split, words), few(spread, words)
        #: A pair is no more frequent than its words, so that only pairs of self.words are here.
        self.pairs = np.array(list(pairs), np.uint64), few(pairs, pairs)
        self.most = max([1, *self.pairs[1]])
        self.begins = np.zeros(1 << 16, bool)  # the first bits of self.words
        self.begins[(self.words >> np.uint64(48)).view(np.int64)] = True

    def _base(self, b: np.ndarray) -> np.ndarray:
        return ((keys(b) >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).view(np.int64)

    def near(self, b: np.ndarray, passes: int, now: int) -> np.ndarray:
        """Whether a trigram with this middle may be in a shard of pass `now`; a plain word's is told by the word alone."""
        if passes == 1:
            return np.ones(len(b), bool)
        return (np.arange(self.shards) % passes == now)[self._base(b)] | self.begins[(b >> np.uint64(48)).view(np.int64)]

    def place(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each trigram the first of its shards, and how many it has."""
        shard, wide = self._base(b), np.ones(len(b), np.int64)
        if len(self.words):
            which = _find(self.words, b)
            at = np.flatnonzero(which >= 0)
            a, b, which = a[at], b[at], which[at]
            shard[at] = (shard[at] + (keys(a) % self.parts[which].astype(np.uint64)).astype(np.int64)) % self.shards
            wide[at] = np.maximum(self.wide[which], _of(*self.pairs, keys(a, b), 1))
        return shard, wide

    def reach(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the first of the shards that may have it as the middle one, and how many there are."""
        wide = _of(self.words, self.parts - 1 + np.maximum(self.wide, self.most), b, 1)
        return self._base(b), np.minimum(wide, self.shards)


def _find_any(own: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _find(own, k) >= 0 if len(own) else np.zeros(len(k), bool)


def _everywhere(shard: np.ndarray, wide: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each of the shards of each row: its place and its shard."""
    at = np.repeat(np.arange(len(shard)), wide)
    return at, (shard[at] + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)) % shards


def _sent(shard: np.ndarray, kind: int, passes: int, abc=None, pair=None, n=None, docs=None):
    """Record batches of _DEALT, a row for each shard: words coded by the shard's own table."""
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        at = order[lo:hi]
        row = {"shard": int(shard[lo]) // passes, "kind": kind, "words": None, "a": None, "docs": None}
        if abc is not None:
            table, coded = _coded(np.concatenate([x[at] for x in abc]))
            coded = coded.astype(np.uint16 if len(table) < 1 << 16 else np.uint32)
            row |= {"words": _pack(table)} | {k: _pack(x) for k, x in zip("abc", np.split(coded, 3), strict=True)}
        else:
            row |= {k: _pack(x[at]) for k, x in zip("bc", pair, strict=True)}
        if docs is None:
            row["n"] = _pack(n[at])
        else:
            text = n[at]  # in order: how many trigrams each text has is enough
            new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            row |= {"n": _pack(np.diff(np.append(new, len(text))).astype(np.uint32)), "docs": _pack(docs[text[new]])}
        names = _DEALT.replace(",", "").split()[::2]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(names, types, strict=True)], names=names)


def _received(row: dict) -> tuple[np.ndarray, ...]:
    """(a, b, c) of a row with trigrams."""
    table = _unpack(row["words"], np.uint64)
    return tuple(table[_unpack(row[k], np.uint16 if len(table) < 1 << 16 else np.uint32)] for k in "abc")


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kind) for k, kind in enumerate(kinds)]


def _counted(a, b, c, n) -> tuple[np.ndarray, ...]:
    """The distinct trigrams with the sums of n."""
    _, at, first = _grouped(keys(a, b, c))
    return a[first], b[first], c[first], np.bincount(at, n, len(first)).astype(np.int64)


def _deal_trusted(trusted: DataFrame, deal: Deal, passes: int, now: int) -> DataFrame:
    """The trigrams of texts (text) with their counts, dealt to the shards of pass `now`."""
    shared = trusted.sparkSession.sparkContext.broadcast(deal)
    chunk = CHUNK

    def run(batches):
        dealt, kept, held = shared.value, [], 0

        def send():
            a, b, c, n = _counted(*_joined([(*x, np.ones(len(x[0]), np.int64)) for x in kept], (np.uint64,) * 3 + (np.int64,)))
            at, shard = _everywhere(*dealt.place(a, b), dealt.shards)
            mine = shard % passes == now
            at, shard = at[mine], shard[mine]
            yield from _sent(shard, _TRAIN, passes, abc=(a[at], b[at], c[at]), n=n[at])

        for batch in tidy(batches):
            framed = _framed(batch.column(0))
            _, _, a, b, c = _around(framed, dealt.near(framed[0], passes, now))
            if passes > 1:
                shard, wide = dealt.place(a, b)
                mine = np.flatnonzero((shard % passes == now) | (wide > 1))
                a, b, c = a[mine], b[mine], c[mine]
            kept.append((a, b, c))
            held += len(a)
            if held >= chunk:
                yield from send()
                kept, held = [], 0
        yield from send()

    return trusted.mapInArrow(run, _DEALT)


def _deal_texts(docs: DataFrame, deal: Deal, passes: int, now: int) -> DataFrame:
    """The trigrams of texts (text) with the texts' hashes, dealt to the shards of pass `now`."""
    shared = docs.sparkSession.sparkContext.broadcast(deal)
    chunk = CHUNK

    def run(batches):
        dealt, kept, names, held, rows = shared.value, [], [], 0, 0
        send = lambda: _sent(
            *_joined([x[:1] for x in kept], (np.int64,)), _TEXT, passes,
            abc=_joined([x[1:4] for x in kept], (np.uint64,) * 3), n=_joined([x[4:] for x in kept], (np.int64,))[0], docs=_joined([(x,) for x in names], (np.uint64,))[0],
        )
        for batch in tidy(batches):
            framed = _framed(batch.column(0))
            doc, at, a, b, c = _around(framed, dealt.near(framed[0], passes, now))
            shard, wide = dealt.place(a, b)
            shard = (shard + at % wide) % dealt.shards  # alike in each pass
            mine = np.flatnonzero(shard % passes == now)
            kept.append((shard[mine], a[mine], b[mine], c[mine], doc[mine] + rows))
            names.append(_names(batch.column(0)))
            held, rows = held + len(mine), rows + batch.num_rows
            if held >= chunk:
                yield from send()
                kept, names, held, rows = [], [], 0, 0
        yield from send()

    return docs.mapInArrow(run, _DEALT)


def _names(texts: pa.Array) -> np.ndarray:
    """A hash of each text; the score of a text is of its content alone."""
    return hashes([x or b"" for x in texts.to_pylist()])


def _deal_pairs(pairs: DataFrame, kind: int, deal: Deal, passes: int, now: int) -> DataFrame:
    """Rows (w, v, n) of word pairs, dealt to the shards that may have w as the middle word."""
    shared = pairs.sparkSession.sparkContext.broadcast(deal)
    chunk = CHUNK

    def run(batches):
        dealt, kept, held = shared.value, [], 0
        send = lambda: _sent(
            *_joined([x[:1] for x in kept], (np.int64,)), kind, passes,
            pair=_joined([x[1:3] for x in kept], (np.uint64,) * 2), n=_joined([x[3:] for x in kept], (np.int64,))[0],
        )
        for batch in tidy(batches):
            w, v, n = (x.to_numpy() for x in batch.columns)
            w, v = w.view(np.uint64), v.view(np.uint64)
            at, shard = _everywhere(*dealt.reach(w), dealt.shards)
            mine = shard % passes == now
            at = at[mine]
            kept.append((shard[mine], w[at], v[at], n[at]))
            held += len(at)
            if held >= chunk:
                yield from send()
                kept, held = [], 0
        yield from send()

    return pairs.select("w", "v", "n").mapInArrow(run, _DEALT)


def _frequent(texts: DataFrame) -> tuple[int, dict[int, int], dict[int, int]]:
    """About how many tokens the texts have, and the words and pairs with very many, by a sample."""
    arrow_batches(texts.sparkSession)

    def run(batches):
        for batch in tidy(batches):
            _, a, b, _ = _trigrams(batch.column(0))
            rows = [(0, np.zeros(1, np.uint64), np.array([len(b)]))]
            for kind, k in ((1, b), (2, keys(a, b))):
                own, at = _coded(k)
                n = np.bincount(at, minlength=len(own))
                many = n > len(b) >> 13
                rows.append((kind, own[many], n[many]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*((np.full(len(k), kind, np.int32), k.view(np.int64), n) for kind, k, n in rows), strict=True)], names=["kind", "k", "n"]
            )

    part = texts.where(F.monotonically_increasing_id() % SAMPLE == 0).mapInArrow(run, "kind int, k bigint, n bigint")
    found = part.groupBy("kind", "k").agg((F.sum("n") * SAMPLE).alias("n")).where(f"kind = 0 OR n > {SHARD // 4}").collect()
    words, pairs = ({r["k"] % (1 << 64): 1 + 4 * r["n"] // SHARD for r in found if r["kind"] == kind} for kind in (1, 2))
    return sum(r["n"] for r in found if r["kind"] == 0), words, pairs


def _shards(tokens: int, passes: int) -> int:
    """Shards of a pass: as many as hold its tokens, some at least where there is work for several tasks."""
    return max(1, -(-tokens // (passes * SHARD)), min(8, tokens // 50_000))


def _settled(df: DataFrame, name: str) -> DataFrame:
    """materialise, after which the shuffle files go at once and not when the driver next collects its garbage."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return materialise(df, name)
    finally:
        spark.conf.set(setting, before)


def _remove(*tables: DataFrame) -> None:
    """Delete the files of materialised tables."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _off(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))


class Levels:
    """What a shard can't tell of the model by itself.

    texts: the trusted ones. d: the discounts by order. words: how many words the unigram
    level has, and the sum of their counts. often: hashes and unigram counts of the
    words that every task holds. split: words dealt to several shards, by number of
    shards. seen: (w, v, n), the unigram counts n of other words v than those of
    `often`, by the words w before them, where over 1. pairs: (w, v, n), the bigram
    counts of `split`.
    """

    def __init__(self, trusted: DataFrame):
        arrow_batches(trusted.sparkSession)
        self.texts = _settled(trusted.select(F.col("text").cast("binary").alias("text")), "trusted")
        tokens, self.split, _ = _frequent(self.texts)
        least = max(2, -(-tokens // HOT)) if HOT else 1 << 62
        shards = _shards(2 * tokens, 1)  # what is counted takes more memory than what is scored
        dealt = _deal_trusted(self.texts, Deal(shards, self.split, {}, {}), 1, 0).repartitionById(shards, "shard")
        told = _settled(dealt.mapInArrow(_tally(np.array(list(self.split), np.uint64), least), "kind int, w bigint, v bigint, n bigint"), "told")
        counts: dict[int, dict[int, int]] = {k: {} for k in range(4)}
        for r in told.where("kind = 0").groupBy("w", "v").agg(F.sum("n").alias("n")).collect():
            counts[r["w"]][r["v"]] = r["n"]
        often = told.where("kind = 1").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
        hashed, n = often.column("w").to_numpy().view(np.uint64), often.column("n").to_numpy()
        self.seen = told.where("kind = 2")
        self.pairs = _settled(told.where("kind = 3").groupBy("w", "v").agg(F.sum("n").alias("n")), "pairs")
        end = int(np.array(_E).view(np.int64))
        for r in self.pairs.where("n <= 4").groupBy("n").count().collect():
            counts[2][r["n"]] = counts[2].get(r["n"], 0) + r["count"]
        ends = counts[0].get(0, 0) + self.pairs.where(F.col("v") == end).count()
        if ends:
            hashed, n = np.append(hashed, _E), np.append(n, ends)
        self.often = hashed, n
        # of the words that are in several shards, and of the end, no shard has counted the unigram
        late = n[_find_any(np.array([*self.split, _E], np.uint64), hashed)]
        for x in late[late <= 4].tolist():
            counts[1][x] = counts[1].get(x, 0) + 1
        size, total = counts[0].get(1, 0) + len(late), counts[0].get(2, 0) + int(late.sum())
        self.d = [(), *(discounts(counts[k]) for k in (1, 2, 3))]
        self.total = max(total, 1)
        ones, twos = counts[1].get(1, 0), counts[1].get(2, 0)
        left = sum(x * y for x, y in zip((ones, twos, size - ones - twos), self.d[1], strict=True)) / total if total else 1.0
        self.unknown = left / (size + 1)
        self._told = told

    def drop(self) -> None:
        """Delete the files; the tables are gone then."""
        _remove(self.texts, self._told, self.pairs)


def levels(trusted: DataFrame) -> Levels:
    """The three orders of all of trusted (text)."""
    return Levels(trusted)


def _tally(split: np.ndarray, least: int):
    """What a shard of the trusted trigrams tells, rows (kind, w, v, n).

    0: counts of counts by order w and count v; at w = 0 the pairs before the end, the words and the sum of their counts.
    1: unigram counts of words that every task is to hold. 2: those of others, by the words before. 3: bigram counts of split words.
    """

    def run(batches):
        rows = [r for batch in tidy(batches) for r in batch.to_pylist()]
        a, b, c, n = _counted(*_joined([(*_received(r), _unpack(r["n"], np.int64)) for r in rows], (np.uint64,) * 3 + (np.int64,)))
        out = []

        def say(kind, w, v, n):
            w, v = (np.asarray(x, np.uint64).view(np.int64) for x in (w, v))
            out.append((np.full(len(n), kind, np.int32), np.broadcast_to(w, len(n)), np.broadcast_to(v, len(n)), np.asarray(n, np.int64)))

        def classes(order, n):
            for k in (1, 2, 3, 4):
                say(0, order, k, [np.count_nonzero(n == k)])

        classes(3, n)
        _, at, first = _grouped(keys(b, c))
        w, v = b[first], c[first]
        n = np.where(w == _S, np.bincount(at, n, len(first)), np.bincount(at, minlength=len(first))).astype(np.int64)
        many = _find_any(split, w)
        say(3, w[many], v[many], n[many])
        classes(2, n[~many])
        say(0, 0, 0, [np.count_nonzero(v[~many] == _E)])
        _, _, first = _grouped(keys(a, b))
        first = first[b[first] != _S]
        before, word = a[first], b[first]
        own, at, _ = _grouped(word)
        n = np.bincount(at, minlength=len(own))
        many = _find_any(split, own)
        classes(1, n[~many])
        say(0, 0, 1, [np.count_nonzero(~many)])
        say(0, 0, 2, [n[~many].sum()])
        held = many | (n >= least)
        say(1, own[held], 0, n[held])
        here = (~held & (n > 1))[at]
        say(2, before[here], word[here], n[at[here]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["kind", "w", "v", "n"])

    return run


def _sums(model: Levels):
    """Of a shard's rows (name, s): what its trigrams add to the log-probability of each text.

    A trigram a b c adds ln(p(c | a b) / p(c)), which needs p(c) only if the model has b c, and ln p(b),
    as each word of a text stands once in the middle; only the end's p comes with c.
    """
    d, total, unknown = model.d, model.total, model.unknown
    shared = model.texts.sparkSession.sparkContext.broadcast((*model.often, np.array(list(model.split), np.uint64)))
    block = BLOCK

    def p1(n):
        return np.where(n > 0, (n - _off(n, d[1])) / total, 0.0) + unknown

    def run(batches):
        rows = {k: [] for k in range(4)}
        for batch in tidy(batches):
            for r in batch.to_pylist():
                rows[r["kind"]].append(r)
        often, often_n, split = shared.value
        ta, tb, tc, tn = _counted(*_joined([(*_received(r), _unpack(r["n"], np.int64)) for r in rows[_TRAIN]], (np.uint64,) * 3 + (np.int64,)))
        pair = lambda kind: _joined([(_unpack(r["b"], np.uint64), _unpack(r["c"], np.uint64), _unpack(r["n"], np.int64)) for r in rows[kind]], (np.uint64,) * 2 + (np.int64,))
        # trigrams and their contexts
        contexts, at, first = _grouped(keys(ta, tb))
        sums = np.bincount(at, tn, len(first))
        share3 = Table(keys(ta, tb, tc), (tn - _off(tn, d[3])) / sums[at], 0.0)
        weight3 = Table(contexts, np.bincount(at, _off(tn, d[3]), len(first)) / sums, 1.0)
        # words before a word: its unigram count
        at = first[tb[first] != _S]
        own, at, _ = _grouped(tb[at])
        own_n = Table(own, np.bincount(at, minlength=len(own)), 0)
        often_n = Table(often, often_n, 0)
        # bigrams and their contexts
        two, at, first = _grouped(keys(tb, tc))
        w, v = tb[first], tc[first]
        n = np.where(w == _S, np.bincount(at, tn, len(first)), np.bincount(at, minlength=len(first)))
        here = ~_find_any(split, w)
        pw, pv, pn = pair(_PAIR)
        w, v, n, two = np.concatenate((w[here], pw)), np.concatenate((v[here], pv)), np.concatenate((n[here], pn)), np.concatenate((two[here], keys(pw, pv)))
        middles, at, _ = _grouped(w)
        sums = np.bincount(at, n, len(middles))
        share2 = (n - _off(n, d[2])) / sums[at]
        left2 = np.bincount(at, _off(n, d[2]), len(middles)) / sums
        sw, sv, sn = pair(_SEEN)
        last = often_n.of(v)
        low2 = p1(np.where(last > 0, last, Table(keys(sw, sv), sn, 1).of(two)))
        p2 = Table(two, np.stack((share2 + left2[at] * low2, np.log(low2)), 1), (1.0, 0.0))
        weight2 = Table(middles, left2, 1.0)
        ends = np.log(p1(often_n.of(np.array([_E]))))[0]

        def texts():
            """(a, b, c, place of the text's name) and the names of some rows after others, so that a worker holds BLOCK tokens."""
            some, names, held, base = [], [], 0, 0
            for r in rows[_TEXT]:
                names.append(_unpack(r["docs"], np.uint64))
                some.append((*_received(r), np.repeat(np.arange(len(names[-1])) + base, _unpack(r["n"], np.uint32))))
                held, base = held + len(some[-1][0]), base + len(names[-1])
                if held >= block:
                    yield _joined(some, (np.uint64,) * 3 + (np.int64,)), np.concatenate(names)
                    some, names, held, base = [], [], 0, 0
            if some:
                yield _joined(some, (np.uint64,) * 3 + (np.int64,)), np.concatenate(names)

        for (a, b, c, doc), names in texts():
            # what is of the middle word alone is looked up once for each distinct one
            words, word = _coded(b)
            n = often_n.of(words)
            middle = np.where(words == _S, 0.0, np.log(p1(np.where(n > 0, n, own_n.of(words)))))
            at = p2.find(keys(b, c))
            known = np.flatnonzero(at >= 0)
            at = at[known]
            # against p(c) where the model lacks b c
            p = weight2.of(words)[word]
            p[known] = p2.values[at, 0]
            context = weight3.find(keys(a, b))
            p *= weight3.values[context]
            both = known[context[known] >= 0]  # the model has a b c only if it has a b and b c
            p[both] += share3.of(keys(a[both], b[both], c[both]))
            s = np.log(p) + middle[word]
            s[known] -= p2.values[at, 1]
            s[c == _E] += ends
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(doc, s, len(names)))], names=["name", "s"])

    return run


def _score(docs: DataFrame, model: Levels) -> DataFrame:
    """docs (doc_id, lang, text) without text, with n_words and ln_perplexity.

    The trigrams of all texts meet the model's in shards, by the middle word: a pass deals those of its
    shards and adds up what they give each text, and its files go before the next begins.
    """
    spark = docs.sparkSession
    arrow_batches(spark)

    def heads(batches):
        for batch in tidy(batches):
            sizes = _cut(batch.column(2))[3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(_names(batch.column(2)).view(np.int64))],
                names=[*batch.schema.names[:2], "n_words", "name"],
            )

    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:2])
    each = materialise(docs.mapInArrow(heads, f"{schema}, n_words bigint, name bigint"), "heads")
    texts = docs.select("text")
    tokens, words, pairs = _frequent(texts)
    passes = min(PASSES, 1 + tokens // PASS_TOKENS)
    shards = _shards(tokens, passes)
    split = {k: max(v, words.get(k, 1)) for k, v in model.split.items()}
    deal = Deal(passes * shards, split, {k: v for k, v in words.items() if k not in split}, pairs)
    parts = []
    for now in range(passes):
        dealt = _deal_trusted(model.texts, deal, passes, now).unionAll(_deal_texts(texts, deal, passes, now))
        dealt = dealt.unionAll(_deal_pairs(model.seen, _SEEN, deal, passes, now)).unionAll(_deal_pairs(model.pairs, _PAIR, deal, passes, now))
        sums = dealt.repartitionById(shards, "shard").mapInArrow(_sums(model), "name bigint, s double")
        parts.append(_settled(sums.groupBy("name").agg(F.sum("s").alias("s")), "sums"))
    sums = reduce(DataFrame.unionAll, parts).groupBy("name").agg(F.sum("s").alias("s"))
    # copies of a text have added to one sum
    copies = each.groupBy("name").agg(F.count("*").alias("copies"))
    scored = each.join(copies.join(sums.hint("merge"), "name").hint("merge"), "name", "left")
    log_probability = F.col("s") / F.col("copies")
    return scored.select(
        "doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, -log_probability / (F.col("n_words") + 1)).alias("ln_perplexity")
    )


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Rows (doc_id, lang, n_words, ln_perplexity, ln_limit, kept), one for each of docs."""
    fitted = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) != 0
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint")).distinct()
    fit_for = good.where(fitted)
    # a filter first, so that few other texts are shuffled; the join is exact
    texts = maybe_in(docs.select(F.col("doc_id").cast("bigint"), "text").where(fitted), key_filter(fit_for, "doc_id"), "doc_id")
    trusted = texts.join(fit_for.hint("merge"), "doc_id", "left_semi")
    model = levels(trusted.select("text"))
    # labels meet the scores, so that no text is shuffled
    each = _score(docs.select(F.col("doc_id").cast("bigint"), "lang", F.col("text").cast("binary").alias("text")), model)
    marks = good.select("doc_id", F.lit(True).alias("trusted"), fitted.alias("fitted"))
    scored = _settled(
        each.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("trusted", "fitted")}), "scored"
    )
    model.drop()
    held = scored.where("trusted AND NOT fitted AND ln_perplexity IS NOT NULL")
    high = (F.percentile_approx("ln_perplexity", quantile, 10_000) + float(np.log(margin))).alias("own")
    limits = held.groupBy("lang").agg(high, F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
    overall = held.agg(high.alias("overall"))  # one row
    l, s = F.broadcast(limits).alias("l"), scored.alias("s")  # a row for each language  # noqa: E741
    limit = F.coalesce("l.own", "overall") + SPREAD / F.sqrt(F.col("s.n_words") + 1)
    return (
        s.join(l, F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").crossJoin(F.broadcast(overall))
        .select(
            "s.doc_id", "s.lang", "s.n_words", "s.ln_perplexity", limit.alias("ln_limit"),
            (F.col("s.ln_perplexity").isNotNull() & F.coalesce(F.col("s.ln_perplexity") <= limit, F.lit(True))).alias("kept"),
        )
    )
