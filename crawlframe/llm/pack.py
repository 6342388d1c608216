"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

A document only matters to the packing by the lengths of its pieces, of which
there are at most `size` different ones. So the pieces are counted by length
(at most `size` rows, whatever the corpus), the counts are packed on the
driver, many equal sequences at once, and the plan - stretches of equal
lengths that go to consecutive sequences - is joined back to the ranked pieces.

Reduction (Martello and Toth's dominance): for the longest free length j, if
a set with j provably dominates all other feasible sets with j, it is fixed
for as many copies as there are. Best fit in decreasing order packs the rest.

Ranks within a length are dealt by salt, so that one length may hold any
share of all rows: counts by (length, salt) give each salt its first rank.

Defined cases: a null or empty text is the closing id alone; a document
longer than a sequence is cut into full pieces and a last shorter one; a
repeated row is packed again; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import gc
import math
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import arrow_batches, leaving, materialise

SIZE = 2048
END_ID = 0
#: Chunks of text whose ids a worker remembers within a task.
CACHE = 500_000
#: Characters of texts that are split at a time, as their chunks take a multiple of that.
SPLIT_CHARS = 1 << 20
#: Rows in a rank's sort.
RANK_ROWS = 50_000
#: Rows of a plan that may be broadcast (about 10 MB); a larger one is joined by shuffle.
PLAN_ROWS = 200_000

#: Stands between chunks that are encoded together. It is one pre-token, and one id.
_MARK = "~"


#: A run of letters that lower-case alike everywhere and that NFC leaves alone, and what often follows it.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([^A-Za-z0-9\\s\u0080-\U0010ffff'~]*)")


#: The byte-level alphabet: bytes that print stand for themselves, the others for the code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of texts as little-endian bytes, with a memory for chunks between blanks.

    The tokenizer's pre-tokens never span white space, so a text's ids are
    those of its chunks in a row; and a run of letters and the ASCII signs
    after it are two pre-tokens. The memory has a young and an old half: what
    is used moves to the young one, and the old one is dropped when that is full.
    """

    def __init__(self, path: str, memory: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.half = memory // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self._direct(_MARK)
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 else None

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, parts: list[str]) -> list[bytes]:
        """Ids of each of parts, none of which holds the mark."""
        if self.mark is None:
            return [self._direct(p) for p in parts]
        joined = f" {_MARK} ".join(parts)
        ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.mark).tolist()
        if len(cuts) != len(parts) - 1:
            return [self._direct(p) for p in parts]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def _word(self, part: str) -> bytes:
        """Ids of one pre-token that needs no normalising: it goes to the model as it is, in its byte alphabet."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_ALPHABET)
        ids = [token.id for token in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _recall(self, wanted: set[str]) -> set[str]:
        """Those of wanted that aren't in memory; the others are then in the young half."""
        missing = wanted.difference(self.young)
        again = {c: self.old[c] for c in missing if c in self.old}
        self.young.update(again)
        return missing.difference(again)

    def _learn(self, chunks: set[str]) -> None:
        young, old, tokenize = self.young, self.old, self._word
        others: list[str] = []

        def known(part: str) -> bytes:
            ids = young.get(part) or old.get(part) or tokenize(part)
            young[part] = ids
            return ids

        for c in chunks:
            if m := _SIMPLE.fullmatch(c):
                word, signs = m.groups()
                ids = known(word.lower())
                young[c] = ids + known(signs) if signs else ids
            elif _MARK in c:
                young[c] = self._direct(c)
            else:
                others.append(c)
        for at in range(0, len(others), 500):
            some = others[at : at + 500]
            young.update(zip(some, self._together(some), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        ends = list(accumulate(map(len, texts)))
        at = 0
        while at < len(texts):
            end = max(at + 1, bisect.bisect_right(ends, ends[at] - len(texts[at]) + SPLIT_CHARS))
            yield from self._encode(texts[at:end])
            at = end

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        self.young[""] = b""
        if missing := self._recall(set(chain.from_iterable(split))):
            self._learn(missing)
        look = self.young.__getitem__
        return [b"".join(map(look, chunks)) for chunks in split]


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """A row for each piece of at most size ids of each document's ids and END_ID."""
    arrow_batches(docs.sparkSession, 500)

    def run(batches):
        encoder, end = Encoder(tokenizer), END_ID.to_bytes(4, "little")  # for this task alone
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            gc.disable()  # many strings and no cycles
            try:
                coded = list(encoder.encode(texts))
            finally:
                gc.enable()
            for name, ids in zip(names, coded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(leaving(run), _PIECES)


def reduce(free: list[int], size: int) -> list[tuple[list[int], int]]:
    """Sets of lengths, with their copies, that dominate all others; they're taken out of free (counts by length).

    For the longest free j with room r = size - j beside it:

    - nothing fits beside j: j alone;
    - the longest k that fits fills r, or no two lengths fit together: {j, k};
    - at most two fit, and k is as long as any two that fit: {j, k};
    - at most two fit, and with k the longest partner b isn't shorter than the
      shorter one of any two that fit: {j, k, b}.
    """
    fixed: list[tuple[list[int], int]] = []

    def largest(most: int) -> int:
        return next((x for x in range(min(most, size), 0, -1) if free[x]), 0)

    def copies(lengths: list[int]) -> int:
        return min(free[x] // lengths.count(x) for x in set(lengths))

    def fix(lengths: list[int]) -> None:
        n = copies(lengths)
        for x in lengths:
            free[x] -= n
        fixed.append((lengths, n))

    for j in range(size, 0, -1):
        while free[j]:
            room = size - j
            free[j] -= 1  # what can stand beside one copy
            small: list[int] = []
            for x in range(1, room + 1):
                small += [x] * min(free[x], 3 - len(small))
                if len(small) == 3:
                    break
            k = largest(room)
            chosen = None
            if not small:
                chosen = [j]
            elif k == room or len(small) == 1 or small[0] + small[1] > room:
                chosen = [j, k]
            elif len(small) == 2 or sum(small) > room:
                lengths = [x for x in range(1, room + 1) if free[x]]
                best, shorter = 0, 0
                lo, hi = 0, len(lengths) - 1
                while lo <= hi:
                    a, b = lengths[lo], lengths[hi]
                    if a + b > room or (lo == hi and free[a] < 2):
                        hi -= 1
                        continue
                    best, shorter = max(best, a + b), a
                    lo += 1
                free[k] -= 1
                partner = largest(room - k)
                free[k] += 1
                if k >= best:
                    chosen = [j, k]
                elif partner and partner >= shorter:
                    chosen = [j, k, partner]
            free[j] += 1
            if chosen is None:
                break
            fix(chosen)
    return fixed


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a sequence, first sequence, offset).

    The pieces of that length with those ranks stand, so many to a sequence,
    in consecutive sequences from the first one on, from that offset on.
    """
    free = [0] * (size + 1)
    for length, n in counts.items():
        free[length] = n
    used = [0] * (size + 1)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(length: int, each: int, bins: int, first: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + each * bins, each, first, offset))
        used[length] += each * bins

    for lengths, n in reduce(free, size):
        offset = 0
        for x in lengths:
            place(x, 1, n, sequence, offset)
            offset += x
        sequence += n

    #: Open sequences by room: stretches (first, how many).
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in range(size, 0, -1):
        left = free[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, first = size, sequence
                n = -(-left // (size // length))
                sequence += n
            each = min(room // length, left)
            full = min(n, left // each)
            place(length, each, full, first, size - room)
            add(room - each * length, first, full)
            left -= each * full
            first, n = first + full, n - full
            if left and n:  # fewer than a full sequence's worth
                place(length, left, 1, first, size - room)
                add(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            add(room, first, n) if room < size else None
    return rows


_PLAN = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "lo", "hi", "each", "first", "at")])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialise(
        pieces(docs, tokenizer, size).withColumn("rid", F.monotonically_increasing_id()), "pieces"
    )
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most size rows
    salts = max(64, math.ceil(max(counts.values(), default=0) / RANK_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        salted.groupBy("length", "salt").count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    ranked = (
        salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")))
        .join(firsts, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("n") - 1)
    )
    rows = plan(counts, size)
    planned = spark.createDataFrame(rows, _PLAN)
    if len(rows) <= PLAN_ROWS:
        planned = F.broadcast(planned)
    p, r = planned.alias("p"), ranked.alias("r")
    nth = F.col("r.rank") - F.col("p.lo")
    return r.join(
        p,
        (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.hi")),
    ).select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32",
        (F.col("p.first") + F.floor(nth / F.col("p.each"))).cast("bigint").alias("sequence_id"),
        (F.col("p.at") + (nth % F.col("p.each")) * F.col("p.length")).cast("bigint").alias("offset"),
    )
