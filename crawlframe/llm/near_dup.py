"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its number of shingles, a
   digest of the shingle set and a MinHash signature. Documents of equal sets
   are one class, under its smallest doc_id; only classes go on.
2. Signatures are cut into bands. A pair with the linking similarity misses
   all bands with a chance of (1 - s**ROWS)**BANDS: 3e-6 at s = 0.8.
3. Within a bucket (classes that share a band) no pairs are listed: each class
   is held against the bucket's hub: the one whose buckets are the largest, so
   that the text of which a group's members are variants is before the
   variants, which may be linked with it alone. Only buckets that still hold
   more than one component go on, with every pair across components that the
   sizes of the sets and their marks (parity bits of the shingles) let be
   linked; no link is lost there. The rows of such a bucket are compared within
   the join, which takes the square of their number in time but not in rows.
   The rows of a large bucket, the pairs of a large hub and the copies of one
   text are split, so that none of them lands in one task.
4. A candidate's signatures are compared in batches. After each batch the pair
   goes if P(similarity >= s | matches so far) is under MISS (uniform prior).
   Survivors are verified on their full shingle sets, made again from the text.
5. Components of the links: smallest label of the neighbours, then the label's
   label, until nothing changes.

Shingles are held as 64-bit hashes of k words (xxh3), words lower-cased in A-Z.

Defined cases: a text of fewer than k words is one shingle; null, empty and
blank texts have no shingle and are linked with nothing; rows that repeat a
doc_id each go by their own text; a row without doc_id stands alone (component
null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import HOT_ROWS, LOWER_BYTES, arrow_batches, key_filter, lookup, materialise, maybe_in, tidy

BANDS, ROWS = 32, 5
#: Signature values compared between two looks at the posterior.
BATCH = 16
#: Chance to drop a pair that should be linked, at each look.
MISS = 1e-6
#: Rounds with hubs (the first by weight, further ones at random) before the pairs across components are listed.
HUB_ROUNDS = 1
#: 64-bit integers of a shingle set's mark.
MARK = 16
#: Rows of one bucket, or pairs of one hub, that a task takes; more are split.
SPLIT = 500
#: Words whose hash a worker remembers.
MEMORY = 200_000

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_words: dict[bytes, int] = {}


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of text."""
    found = text.translate(LOWER_BYTES).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(_words) > MEMORY:
        _words.clear()
    for w in set(found).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(codes) - k + 1)
    mixed = np.full(n, min(k, len(codes)), np.uint64)
    for j in range(min(k, len(codes))):
        mixed = (mixed ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _forgetting(batches):
    """batches; the words' hashes go with the task, as a worker serves other operators too."""
    yield from tidy(batches)
    _words.clear()


def signature(found: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        part = low[at : at + 512, None] * _MUL
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return least


def mark(found: np.ndarray) -> list[int]:
    """A bit for each residue of the shingles: whether the set has an odd number of that residue."""
    odd = np.bincount((found & np.uint64(64 * MARK - 1)).astype(np.int64), minlength=64 * MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the rows of signed."""
    rows = signed.reshape(len(signed), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = (key ^ rows[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


@cache
def least_matches(percent: int) -> tuple[int, ...]:
    """By number of values compared in batches: the fewest matches with which a pair may still be linked.

    With m matches of n and a uniform prior the posterior is Beta(m+1, n-m+1),
    and P(similarity >= t) is the binomial tail P(Bin(n+1, t) <= m).
    """
    t = percent / 100
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _sign(docs: DataFrame, k: int) -> DataFrame:
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in _forgetting(batches):
            out: list[list] = [[], [], []]
            for text in batch.column(1):
                found = shingles(text.as_py(), k)
                out[0].append(len(found))
                out[1].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                out[2].append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                names=["doc_id", "h", "n", "digest", "sig"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), _text_hash().alias("h"))
    return chosen.mapInArrow(run, "doc_id bigint, h bigint, n bigint, digest binary, sig binary")


def _text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("binary"))


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            sigs = b"".join(batch.column(2).to_pylist())
            keys = band_keys(np.frombuffer(sigs, np.uint32).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), BANDS)),
                    pa.array(keys.ravel()),
                ],
                names=["id", "n", "band"],
            )

    return classes.select("id", "n", "sig").mapInArrow(run, "id bigint, n bigint, band bigint")


def _texts(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Rows (id, text, mark) of the classes (digest, id, doc_id). A doc_id may repeat with other texts, so the digest decides."""

    def run(batches):
        for batch in _forgetting(batches):
            same, marks = [], []
            for text, digest in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = shingles(text.as_py(), k)
                same.append(len(found) > 0 and xxhash.xxh3_128_digest(found.tobytes()) == digest)
                if same[-1]:
                    marks.append(mark(found))
            kept = [batch.column(c).filter(pa.array(same, pa.bool_())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.list_(pa.int64()))], names=["id", "text", "mark"])

    every = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    chosen = maybe_in(every, key_filter(classes, "doc_id"), "doc_id").join(classes.select("id", "doc_id", "digest").hint("merge"), "doc_id")
    return chosen.select("id", "text", "digest").mapInArrow(run, "id bigint, text binary, mark array<bigint>").dropDuplicates(["id"])


def _cells(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))


def _parts(n: Column) -> Column:
    """Into how many parts n rows of one key are split."""
    return F.greatest(F.ceil(n / SPLIT).cast("int"), F.lit(1))


def _part(id: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id), parts).cast("int")


def _across(live: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, w) of live (band, salt, id, n, size, label) in one bucket and two components that sizes and marks let be linked.

    The bits in which two marks differ are at most the shingles that only one of
    the texts has, and linked texts have few of these. So the many variants of
    one text, which share a bucket and are too far apart to be linked, are told
    apart within the join, and no pair that can be linked is missed. At least
    one row of each pair is outside its bucket's most frequent component. Both
    sides of a bucket are dealt to cells of SPLIT by SPLIT rows, so that no
    task compares more.
    """
    by_label = live.groupBy("band", "label").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    main = by_label.groupBy("band").agg(
        F.max_by("label", F.struct("n", "label")).alias("arena"), F.sum("n").alias("every"), F.max("n").alias("most"), F.max("size").alias("size")
    )
    spread = main.select(
        "band", "arena", _parts(F.col("every")).alias("rows"), _parts(F.col("every") - F.col("most")).alias("columns"), _cells(_parts(F.col("size"))).alias("salt")
    )
    placed = live.select("band", "salt", "id", "n", "label").join(spread, ["band", "salt"])
    rows = materialise(placed.join(texts.select("id", "mark"), "id"), "live")
    left = rows.withColumn("row", _part("id", F.col("rows"))).select("band", "row", _cells(F.col("columns")).alias("column"), "id", "n", "label", "mark")
    rest = rows.where("label <> arena").withColumn("column", _part("id", F.col("columns"))).select(
        "band", _cells(F.col("rows")).alias("row"), "column", *(F.col(c).alias(to) for c, to in (("id", "a"), ("n", "m"), ("label", "la"), ("mark", "other")))
    )
    apart = reduce(add, (F.bit_count(F.get("mark", F.lit(i)).bitwiseXOR(F.get("other", F.lit(i)))) for i in range(MARK)))
    return (
        left.join(rest, ["band", "row", "column"]).where("label <> la")
        .where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        .where((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))
        .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.lit(0).cast("bigint").alias("w"))
    )


def _beside(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """Rows (a, salt, b, value, w): in each group (a, salt), which one task reads in order, first a's own value (b null), then those of its b.

    w bounds the pairs of a and says into how many groups they are dealt; a's
    value goes once to each group and not to each pair.
    """
    dealt = pairs.withColumn("salt", _part("b", (F.col("w") / SPLIT).cast("int") + 1))
    value = table.select(F.col("id"), F.col(what).alias("value"))
    own = dealt.groupBy("a", "salt").agg(F.max("w").alias("w")).join(value.withColumnRenamed("id", "a").hint("merge"), "a")
    others = dealt.join(value.withColumnRenamed("id", "b").hint("merge"), "b")
    columns = ("a", "salt", "b", "value", "w")
    every = own.withColumn("b", F.lit(None).cast("bigint")).select(*columns).unionByName(others.select(*columns))
    return every.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))


def _verify(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones (a, b) of pairs (a, b, w): pruned by posterior, then confirmed on full sets."""
    limits = least_matches(percent)

    def prune(batches):
        held = np.zeros((1, BANDS * ROWS), np.uint32)
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            first = np.array(batch.column(2).is_null())
            known = np.concatenate((held, signed))
            hub = np.maximum.accumulate(np.where(first, np.arange(1, batch.num_rows + 1), 0))
            alive = np.flatnonzero(~first)
            matches = np.zeros(batch.num_rows, np.int64)
            for step, least in enumerate(limits):
                at = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (known[hub[alive], at] == signed[alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            held = known[hub[-1]][None].copy()
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 2, 4)], names=["a", "b", "w"])

    def confirm(batches):
        own = np.empty(0, np.uint64)
        for batch in _forgetting(batches):
            linked = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = shingles(text.as_py(), k)
                if b is None:
                    own = found
                both = len(np.intersect1d(own, found, assume_unique=True))
                linked.append(b is not None and 100 * both >= percent * (len(own) + len(found) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in (0, 2)], names=["a", "b"])

    survivors = materialise(_beside(pairs, sigs, "sig").mapInArrow(prune, "a bigint, b bigint, w bigint"), "survivors")
    return _beside(survivors, texts, "text").mapInArrow(confirm, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Rows (id, label) of the ids in links (a, b): label is the smallest id that is reachable."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both, "edges")
    total = edges.count()
    degrees = materialise(edges.groupBy("b").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS), "degrees")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = (
            lookup(edges, labels.withColumnRenamed("id", "b"), "b", degrees, total)
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "labels")
        # the label's own label: chains shrink by half in each round
        up = lower.select(F.col("id").alias("label"), F.col("label").alias("up"))
        sizes = lower.groupBy("label").agg(F.count("*").alias("rows"))
        nxt = materialise(
            lookup(lower, up, "label", sizes, lower.count()).select("id", "old", F.least("label", "up").alias("label")), "labels"
        )
        labels = nxt.select("id", "label")
        if nxt.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets.
    """
    return _placed(docs, k, percent).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (doc_id, h, n, component, first), one for each row of docs; first is the hash of the component's first text."""
    signed = materialise(_sign(docs, k).withColumn("rid", F.monotonically_increasing_id()), "signed")
    grouped = (
        signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest").agg(F.min(F.struct("doc_id", "rid", "h")).alias("first"), F.count("*").alias("rows"))
    )
    members = materialise(
        grouped.select("digest", F.col("first.rid").alias("id"), F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), "rows"), "classes"
    )
    classes = signed.select(F.col("rid").alias("id"), "n", "sig").join(members.select("id").hint("merge"), "id")
    rows = materialise(_bands(classes), "bands")
    shared = materialise(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    sized = materialise(lookup(rows, shared, "band", shared.select("band", F.col("size").alias("rows")), rows.count()), "sized")
    weights = sized.groupBy("id").agg(F.sum("size").alias("weight"))
    buckets = materialise(
        sized.join(weights.hint("merge"), "id").select("band", _part("id", _parts(F.col("size"))).alias("salt"), "id", "n", "size", "weight"), "buckets"
    )
    some = materialise(buckets.select("id").distinct(), "candidates")
    signatures = maybe_in(signed.select(F.col("rid").alias("id"), "sig"), key_filter(some, "id"), "id")
    sigs = materialise(signatures.join(some.hint("merge"), "id", "left_semi"), "sigs")
    texts = materialise(_texts(docs, members.join(some, "id", "left_semi"), k), "texts")
    alike = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")

    def check(pairs: DataFrame) -> DataFrame:
        return materialise(_verify(materialise(pairs.distinct(), "pairs"), sigs, texts, k, percent), "links")

    def against(hubs: DataFrame, live: DataFrame) -> DataFrame:
        """Pairs of the live rows with their bucket's hub (band, salt, hub, m, w, hub_label), where their components differ."""
        met = live.join(hubs, ["band", "salt"]).where("id <> hub and label <> hub_label").where(alike)
        return met.select(F.col("hub").alias("a"), F.col("id").alias("b"), "w")

    live = buckets.withColumn("label", F.col("id"))
    links: list[DataFrame] = []
    labels = None
    for turn in range(HUB_ROUNDS + 1):
        if labels is not None:
            live = (
                buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            )
            ends = live.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("size").alias("size"))
            mixed = ends.where("lo <> hi").select("band", _cells(_parts(F.col("size"))).alias("salt"))
            live = materialise(live.join(mixed, ["band", "salt"], "left_semi"), "live")
            if live.isEmpty():
                break
        if turn < HUB_ROUNDS:
            first = -F.col("weight") if turn == 0 else F.xxhash64("id", "band", F.lit(turn))
            order = F.struct(first.alias("rank"), "id", "n", "label", "weight")
            hubs = live.groupBy("band").agg(F.min(order).alias("h"), F.max("size").alias("size")).select(
                "band", _cells(_parts(F.col("size"))).alias("salt"), F.col("h.id").alias("hub"), F.col("h.n").alias("m"),
                F.col("h.label").alias("hub_label"), F.col("h.weight").alias("w"),
            )
            found = check(against(hubs, live))
        else:
            found = check(_across(live, texts, percent))
        if not found.isEmpty():
            links.append(found)
            labels = components(reduce(DataFrame.unionByName, links))
        elif labels is None:
            labels = _empty(docs.sparkSession, "id bigint, label bigint")
    placed = materialise(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "placed")
    least = materialise(placed.groupBy("label").agg(F.min(F.struct("doc_id", "id", "h")).alias("least"), F.count("*").alias("rows")), "least")
    met = lookup(placed.drop("rows"), least.drop("rows"), "label", least.select("label", "rows"), placed.count())
    named = materialise(met.select("digest", F.col("least.doc_id").alias("component"), F.col("least.h").alias("first")), "named")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    counts = members.select("digest", "rows")
    return lookup(signed.select("doc_id", "h", "n", "digest"), named, "digest", counts, signed.count(), "left").select(
        "doc_id", "h", "n", component.alias("component"), "first"
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, of its smallest doc_id, with all columns; of rows that repeat a doc_id and its text, one.

    A doc_id that repeats with other texts is judged by each text. Rows without a doc_id stay.
    """
    other = (F.col("component") != F.col("doc_id")) | (F.col("first") != F.col("h"))
    placed = materialise(_placed(docs, k, percent).where(F.col("doc_id").isNotNull()).select("doc_id", F.col("h").alias("__text"), other.alias("gone")), "verdicts")
    key = ["doc_id", "__text"]
    gone = placed.where("gone").select(key).distinct()
    again = placed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    # most rows are neither dropped nor repeated: they stay without any shuffle of their texts
    touched = key_filter(materialise(gone.unionByName(again).distinct(), "touched"), *key)
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__text", _text_hash())
    keyed = named.withColumn("doc_id", F.col("doc_id").cast("bigint")) if dict(docs.dtypes)["doc_id"] != "bigint" else named
    sure = maybe_in(keyed, touched, *key, inside=False)
    left = maybe_in(keyed, touched, *key).join(gone.hint("merge"), key, "left_anti").dropDuplicates(key)
    kept = sure.unionByName(left.select(sure.columns)).select([F.col(c).cast(t) for c, t in docs.dtypes])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
