"""Benchmark decontamination with a generalised suffix automaton.

The test items, normalised to words, are built into a suffix automaton; the
words of each document are streamed through it, and the length of the longest
match that ends at each word is tracked. A match at least as long as a window
marks its words as hit.

Normalisation: A-Z becomes a-z, words are runs of ASCII digits, letters and
any non-ASCII characters. In UTF-8 all bytes of a non-ASCII character are over
0x7F, so the work is done on bytes.

Defined cases: a null text has no words; an item without words has no window;
an item shorter than a window is one window; equal items are all reported; a
repeated row gets its own result; a null item id counts as the empty string;
with an empty benchmark nothing is hit. Column names that start with
``__dc_`` are reserved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import arrow_batches, tidy

WINDOW = 13
#: Words of items in one automaton (about 100 MB of Python objects). A larger benchmark is matched in blocks.
BLOCK_WORDS = 100_000

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.items = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in coded:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        #: The state with the last `window` words of a match, for states that are long enough.
        self.tail = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= window:
                above = self.link[state]
                self.tail[state] = self.tail[above] if self.length[above] >= window else state
        self.windows: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(coded):
            state = size = 0
            for symbol in sequence:
                state, size = self.step(state, size, symbol)
                if size >= window:
                    self.windows.setdefault(self.tail[state], set()).add(k)
            if 0 < len(sequence) < window:
                short.setdefault(state, []).append((size, k))
        #: Short items that end a match, by state: own ones and those of all shorter suffixes.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            found = short.get(state, []) + self.short.get(self.link[state], [])
            if found:
                self.short[state] = found
        sizes = [min(len(s), window) for s in coded if s]
        self.least = min(sizes, default=0)
        v = max(1, len(self.vocabulary))
        pairs = {a * v + b for s in coded for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            there = self.next[last][symbol]
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, there, symbol)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at][symbol]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(at, there, symbol)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, at: int, there: int, symbol: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[there]))
        self.link[copy] = self.link[there]
        self.link[there] = copy
        while at >= 0 and self.next[at].get(symbol) == there:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, size: int, symbol: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        edges = self.next
        while symbol not in edges[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            size = self.length[state]
        return edges[state][symbol], size + 1

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal stretches whose adjacent words are adjacent in some item; a match never leaves one."""
        known = codes >= 0
        if self.least <= 1:
            good = known
            edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
            yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
            return
        if len(codes) < self.least or not len(self.pairs):
            return
        both = np.flatnonzero(known[:-1] & known[1:])
        if not len(both):
            return
        key = codes[both] * len(self.vocabulary) + codes[both + 1]
        at = np.searchsorted(self.pairs, key)
        both = both[self.pairs[np.minimum(at, len(self.pairs) - 1)] == key]
        if len(both) < self.least - 1:
            return
        cut = np.flatnonzero(np.diff(both) > 1)
        first, last = both[np.concatenate(([0], cut + 1))], both[np.concatenate((cut, [len(both) - 1]))] + 2
        enough = last - first >= self.least
        yield from zip(first[enough].tolist(), last[enough].tolist(), strict=True)

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of word positions, as merged half-open spans, and the items with a window there."""
        if not self.least or not text:
            return [], set()
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in text], dtype=np.int64)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, stop in self.runs(codes):
            state = size = 0
            for at, symbol in enumerate(codes[start:stop].tolist(), start):
                state, size = self.step(state, size, symbol)
                reach = 0
                if size >= self.window:
                    reach = size
                    found |= self.windows.get(self.tail[state], set())
                for n, k in self.short.get(state, ()):
                    if n <= size:
                        reach = max(reach, n)
                        found.add(k)
                if reach:
                    spans.append((at + 1 - reach, at + 1))
        return merge(spans), found


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most `most` words; a longer item is cut so that each of its windows is in one piece."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    chosen = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    for name, text in chosen.toLocalIterator():
        item = words(bytes(text)) if text is not None else []
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(item) - window + 1), step):
            piece = item[at : at + step + window - 1]
            if held and held + len(piece) > most:
                yield block
                block, held = [], 0
            if piece:
                block.append((name, piece))
                held += len(piece)
    yield block


_automata: dict[int, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    """One automaton for a Python worker at a time."""
    if shared.id not in _automata:
        _automata.clear()
        _automata[shared.id] = Automaton(shared.value, window)
    return _automata[shared.id]


class _Id:
    """A broadcast with a key that is stable in the worker."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


_MARKS = T.StructType(
    [
        T.StructField("__dc_n_words", T.LongType()),
        T.StructField("__dc_n_hit", T.LongType()),
        T.StructField("__dc_spans", T.ArrayType(T.LongType())),
        T.StructField("__dc_items", T.ArrayType(T.StringType())),
    ]
)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with `__dc_n_words`, `__dc_n_hit`, `__dc_spans` (starts and ends of hit stretches, in words) and `__dc_items`.

    No shuffle: each block of the benchmark is one more map over the documents,
    whose automaton is bounded by block_words.
    """
    return _mapped(docs, benchmark, window, block_words)


def _mapped(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, last=None) -> DataFrame:
    """mark; last(batch), if given, makes rows of docs of those the last block's map has marked: a further map would be one more Python worker."""
    spark = docs.sparkSession
    arrow_batches(spark)
    marked = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in _MARKS})
    place = {name: k for k, name in enumerate(marked.columns)}
    text_at, spans_at, items_at = place["text"], place["__dc_spans"], place["__dc_items"]
    kept = len(marked.columns) - len(_MARKS)
    parts = blocks(benchmark, window, block_words)
    block, n = next(parts), 0
    while block is not None:
        after = next(parts, None)
        end = last if after is None else None
        shared = _Id(spark.sparkContext.broadcast(block), f"{id(docs)}-{n}-{spark.sparkContext.applicationId}")
        shared.id = f"{shared.broadcast._jbroadcast.id()}-{window}"

        def run(batches, shared=shared, end=end):
            automaton = _automaton(shared, window)
            for batch in tidy(batches):
                columns = {"n": [], "hit": [], "spans": [], "items": []}
                texts = batch.column(text_at).cast(pa.binary())
                before = batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist()
                for text, spans, items in zip(texts, *before, strict=True):
                    own = words(text.as_py())
                    new, found = automaton.match(own)
                    if spans:
                        new = merge([*new, *zip(spans[::2], spans[1::2], strict=True)])
                    columns["n"].append(len(own))
                    columns["hit"].append(sum(b - a for a, b in new))
                    columns["spans"].append([x for span in new for x in span])
                    columns["items"].append(sorted({automaton.items[k] for k in found} | set(items or ())))
                done = pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in range(kept)]
                    + [pa.array(columns["n"], pa.int64()), pa.array(columns["hit"], pa.int64())]
                    + [pa.array(columns["spans"], pa.list_(pa.int64())), pa.array(columns["items"], pa.list_(pa.string()))],
                    names=batch.schema.names,
                )
                yield end(done) if end else done

        marked = marked.mapInArrow(run, docs.schema if end else marked.schema)
        block, n = after, n + 1
    return marked


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: its words, hit words, items with windows in it, and whether a twentieth is hit."""
    marked = mark(docs.select("doc_id", "text"), benchmark, window)
    n, hit, items = F.col("__dc_n_words"), F.col("__dc_n_hit"), F.col("__dc_items")
    return marked.select(
        "doc_id",
        n.alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= n)).alias("contaminated"),
    )


def remove(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs without the hit stretches; a document of which more than most_coverage is hit goes as a whole.

    A stretch goes from its first word's start to its last word's end, with
    what lies between. n_chars, where there is one, is counted anew for
    documents that changed. Other columns and clean documents stay as they are.
    """
    names = docs.columns
    at = {name: k for k, name in enumerate([*names, *_MARKS.names])}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        measured = zip(batch.column(at["__dc_n_hit"]).to_pylist(), batch.column(at["__dc_n_words"]).to_pylist(), strict=True)
        batch = batch.filter(pa.array([hit <= most_coverage * n for hit, n in measured], pa.bool_()))
        texts, spans = batch.column(at["text"]), batch.column(at["__dc_spans"])
        counts = batch.column(at["n_chars"]).to_pylist() if "n_chars" in at else None
        out = []
        for k, flat in enumerate(spans.to_pylist()):
            text = texts[k].as_py()
            if flat:
                text = _without(text.encode(), flat).decode()
                if counts:
                    counts[k] = len(text)
            out.append(text)
        arrays = [batch.column(k) for k in range(len(names))]
        arrays[at["text"]] = pa.array(out, pa.string())
        if counts is not None:
            arrays[at["n_chars"]] = pa.array(counts, batch.column(at["n_chars"]).type)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return _mapped(docs, benchmark, window, block_words, cut)


def _without(text: bytes, flat: list[int]) -> bytes:
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])
