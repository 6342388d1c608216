"""Hidden Markov language model over words, trained by Baum-Welch.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end token to
a text. The HEAD most frequent training tokens are symbols of their own; all
other words are emitted through one of RARE classes (by their first and last
letters), and within a class by add-one smoothed counts:

    P(text) = P_hmm(symbols) * product over rare words of (c + 1) / (N_k + V_k + 1)

with c the word's count, N_k and V_k the tokens and distinct words of class k
in training; the 1 besides is for all unseen words, as in the base score. The
model is so a distribution over the same tokens as the base score.

Passes over the corpus:

1. counts of training words (combined in each partition, then by a shuffle);
2. coding: each document's symbols, and its rare words, are written once;
3. Baum-Welch: every pass runs the scaled forward-backward recursion over all
   training documents; expected counts are added up in each partition and sent
   once a partition, then summed. The first parameters are the symbols'
   frequencies with noise, whatever the order of the rows;
4. scoring: the scaled forward recursion gives the exact likelihood.

A worker gathers documents of GATHERED tokens and runs those of like length side
by side. Texts of any length are trained on and scored as a whole; of those of
over SEGMENT tokens, one stretch at a time is held and the recursion is carried
over its borders.

Bounds: a worker holds (HEAD + RARE) x STATES parameters and HEAD words. The
counts of rare words stay distributed and are joined by the word's 64-bit
hash; the frequent words, which would be hot keys of that join, are no part of
it. A word that training has once is never a symbol of its own.

Defined cases: a null text is empty and scored by its end token alone; rows
that repeat a doc_id are scored each; a row without doc_id has no remainder,
so that it is held out; with no training document every token is unseen.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import LOWER_BYTES, arrow_batches, materialise

STATES = 8
HEAD = 30_000
RARE = 2_048
#: Passes over all training documents; more of them hardly change the score of held-out text (README).
PASSES = 4
#: Steps between two scalings of the forward values.
RESCALE = 8
#: Steps of one text whose values are held at a time.
SEGMENT = 50_000
#: Distinct words that a worker counts before it passes them on.
FLUSH = 200_000
#: Pseudo-counts of emissions and transitions.
SMOOTH_EMIT, SMOOTH_MOVE = 0.05, 1.0
#: Tokens of the texts whose recursions run side by side, if more than one, and tokens that a worker gathers to put texts of like length together.
CELLS, GATHERED = 200_000, 1_000_000
END = b"\n"  # no word holds white space


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.translate(LOWER_BYTES).split() if text else []), END]


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[:2] + b"\n" + word[-3:]) % RARE


def held_out(doc_id: F.Column, modulus: int = 7, left: int = 2) -> F.Column:
    """crc32(doc_id as text) mod modulus is left; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == left, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, k, c) over all of docs (text), k the rare class."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    pa.array(list(map(rare_class, counts)), pa.int32()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["word", "k", "c"],
            )

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        yield out()

    chosen = docs.select(F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "word binary, k int, c bigint").groupBy("word", "k").agg(F.sum("c").alias("c"))


class _Codes(dict):
    """Symbol of each head word; others by their class, remembered up to a bound."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(head))
        self.head = len(head)
        self.most = self.head + 200_000

    def __missing__(self, word: bytes) -> int:
        code = self.head + rare_class(word)
        if len(self) < self.most:
            self[word] = code
        return code


_coders: dict[int, tuple] = {}

_CODED = (
    "held_out boolean, codes array<int>, n_tokens bigint, head_known bigint, head_score double, rare_norm double, rare array<bigint>"
)


def _encode(docs: DataFrame, head: list[bytes], scores: np.ndarray, norms: np.ndarray) -> DataFrame:
    """Each document's symbols, the sums over head words of scores, over rare ones of norms (by class), and the rare words' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast((head, scores, norms))
    key = shared._jbroadcast.id()

    def run(batches):
        if key not in _coders:
            _coders.clear()
            own = shared.value
            n = len(own[0])
            _coders[key] = _Codes(own[0]), np.concatenate((own[1], np.zeros(RARE))), np.concatenate((np.zeros(n), own[2]))
        codes_of, score_of, norm_of = _coders[key]
        for batch in batches:
            codes, rare = [], []
            sums: list[list] = [[], [], [], []]
            for text in batch.column(2):
                own = tokens(text.as_py())
                coded = np.fromiter(map(codes_of.__getitem__, own), np.int32, len(own))
                other = np.flatnonzero(coded >= codes_of.head).tolist()
                codes.append(coded)
                rare.append(np.array([xxhash.xxh64_intdigest(own[k], 42) for k in other], np.uint64).view(np.int64))
                for into, x in zip(sums, (len(own), len(own) - len(other), score_of[coded].sum(), norm_of[coded].sum()), strict=True):
                    into.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(codes, np.int32)]
                + [pa.array(x, k) for x, k in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                + [_lists(rare, np.int64)],
                names=["doc_id", *(f.split()[0] for f in _CODED.split(", "))],
            )

    chosen = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {_CODED}")


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, kind)])))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as views of its values."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class Model:
    """start (S), move (S x S), emit (symbols x S), each a distribution over its last or first axis."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(counts: np.ndarray, states: int, seed: int = 7) -> Model:
        """Symbol frequencies with noise, and states that last."""
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = (counts[:, None] + SMOOTH_EMIT) * rng.uniform(0.5, 1.5, (len(counts), states))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From expected counts."""
        start, move, emit = start + SMOOTH_MOVE, move + SMOOTH_MOVE, emit + SMOOTH_EMIT
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _blocks(coded: list[np.ndarray]):
    """Indices of texts that run side by side: of like length, longest first, up to CELLS tokens."""
    block, total = [], 0
    for k in sorted(range(len(coded)), key=lambda k: -len(coded[k])):
        if block and total + len(coded[k]) > CELLS:
            yield block
            block, total = [], 0
        block.append(k)
        total += len(coded[k])
    if block:
        yield block


def _steps(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts, longest first, by step; where each step begins; and where each text ends.

    The texts that still go on at a step are a prefix, so that the k-th symbol of a step is the k-th text's.
    """
    sizes = np.array([len(c) for c in texts])
    at = np.concatenate(([0], np.cumsum(np.searchsorted(-sizes, -np.arange(sizes[0]), side="left"))))
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = np.empty(len(step), np.intp)
    symbols[at[step] + np.repeat(np.arange(len(texts)), sizes)] = np.concatenate(texts)
    return symbols, at, at[sizes - 1] + np.arange(len(texts))


def forward(model: Model, coded: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each text by the forward recursion, scaled every RESCALE steps.

    Texts run side by side; those of over SEGMENT tokens alone, so that none is held by more than its symbols.
    """
    out = np.zeros(len(coded))
    short = []
    for k, c in enumerate(coded):
        if len(c) > SEGMENT:
            out[k] = _carry(model, c)[1]
        else:
            short.append(k)
    for of_short in _blocks([coded[k] for k in short]):
        block = [short[k] for k in of_short]
        symbols, at, ends = _steps([coded[k] for k in block])
        alpha = model.emit.take(symbols, axis=0)
        total = np.zeros(len(block))
        bounds = at.tolist()
        alpha[: bounds[1]] *= model.start
        for t in range(1, len(bounds) - 1):
            here, end = bounds[t], bounds[t + 1]
            a = alpha[here:end]
            a *= alpha[bounds[t - 1] : bounds[t - 1] + end - here] @ model.move
            if t % RESCALE == 0:
                scale = a.sum(axis=1)
                a /= scale[:, None]
                total[: end - here] += np.log(scale)
        out[block] = total + np.log(alpha[ends].sum(axis=1))
    return out


def expect(model: Model, coded: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add the expected counts of start, move and emit over texts; the log-likelihood.

    Forward values are scaled every RESCALE steps, and the backward ones by the
    same factors, so that their product is a posterior at every step.
    """
    start, move, emit = into
    states = len(model.start)
    back, moved = np.ascontiguousarray(model.move.T), np.zeros((states, states))
    log_likelihood = sum(_expect_long(model, c, into) for c in coded if len(c) > SEGMENT)
    short = [c for c in coded if len(c) <= SEGMENT]
    for block in _blocks(short):
        symbols, at, ends = _steps([short[k] for k in block])
        emitted = model.emit.take(symbols, axis=0)
        alpha, beta = np.empty_like(emitted), np.empty_like(emitted)
        bounds = at.tolist()
        np.multiply(model.start, emitted[: bounds[1]], out=alpha[: bounds[1]])
        for t in range(1, len(bounds) - 1):
            here, end = bounds[t], bounds[t + 1]
            a = alpha[here:end]
            np.matmul(alpha[bounds[t - 1] : bounds[t - 1] + end - here], model.move, out=a)
            a *= emitted[here:end]
            if t % RESCALE == 0:
                scale = a.sum(axis=1, keepdims=True)
                a /= scale
                emitted[here:end] /= scale
                log_likelihood += float(np.log(scale).sum())
        last = alpha[ends].sum(axis=1, keepdims=True)
        log_likelihood += float(np.log(last).sum())
        beta[ends] = 1 / last
        for t in range(len(bounds) - 2, 0, -1):
            here, end = bounds[t], bounds[t + 1]
            later = emitted[here:end]
            later *= beta[here:end]
            np.matmul(later, back, out=beta[bounds[t - 1] : bounds[t - 1] + end - here])
        # each step but the first against the one before
        alive = np.diff(at)
        before = np.arange(at[1], at[-1]) - np.repeat(alive[:-1], alive[1:])
        moved += alpha.take(before, axis=0).T @ emitted[at[1] :]
        alpha *= beta
        start += alpha[: at[1]].sum(axis=0)
        for s in range(states):
            emit[:, s] += np.bincount(symbols, alpha[:, s], minlength=len(emit))
    move += moved * model.move
    return log_likelihood


def _carry(model: Model, codes: np.ndarray) -> tuple[list[np.ndarray | None], float]:
    """The scaled forward values before each stretch of SEGMENT steps of one text, and its log-likelihood."""
    before: list[np.ndarray | None] = []
    log_likelihood = 0.0
    a = None
    for at in range(0, len(codes), SEGMENT):
        before.append(a)
        for symbol in codes[at : at + SEGMENT].tolist():
            a = _step(model, a, symbol)
            scale = a.sum()
            a = a / scale
            log_likelihood += float(np.log(scale))
    return before, log_likelihood


def _step(model: Model, a: np.ndarray | None, symbol: int) -> np.ndarray:
    return (model.start if a is None else a @ model.move) * model.emit[symbol]


def _expect_long(model: Model, codes: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """The same for one text of any length, holding the values of SEGMENT steps at a time.

    A first run keeps the forward values before each stretch; the stretches are
    then run again from the last to the first, and the backward values are
    carried over their borders.
    """
    start, move, emit = into
    states = len(model.start)
    before, log_likelihood = _carry(model, codes)
    beta = np.ones(states)
    for k in range(len(before) - 1, -1, -1):
        own = codes[k * SEGMENT : (k + 1) * SEGMENT]
        alpha = np.empty((len(own), states))
        a = before[k]
        for t, symbol in enumerate(own.tolist()):
            a = _step(model, a, symbol)
            a /= a.sum()
            alpha[t] = a
        for t in range(len(own) - 1, -1, -1):
            gamma = alpha[t] * beta
            gamma /= gamma.sum()
            emit[own[t]] += gamma
            earlier = alpha[t - 1] if t else before[k]
            if earlier is None:
                start += gamma
                break
            later = model.emit[own[t]] * beta
            both = earlier[:, None] * model.move * later
            move += both / both.sum()
            beta = model.move @ later
            beta /= beta.sum()
    return log_likelihood


def _gather(batches):
    """batches in lists of about GATHERED tokens; the first column holds the codes."""
    found, total = [], 0
    for batch in batches:
        found.append(batch)
        total += len(batch.column(0).flatten())
        if total >= GATHERED:
            yield found
            found, total = [], 0
    if found:
        yield found


def _pass(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One Baum-Welch pass over all of coded; the next model, and the log-likelihood under this one."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    states, symbols = len(model.start), len(model.emit)
    names = [f"s{k}" for k in range(states)]

    def run(batches):
        own = shared.value
        into = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        log_likelihood = 0.0
        for some in _gather(batches):
            log_likelihood += expect(own, [c for batch in some for c in _arrays(batch.column(0))], into)
        used = np.flatnonzero(into[2].any(axis=1))
        rows = np.vstack((into[2][used], into[1], into[0], np.full(states, log_likelihood)))
        keys = np.concatenate((used, symbols + np.arange(states + 2)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, rows.T.copy())], names=["key", *names])

    summed = coded.select("codes").mapInArrow(run, f"key bigint, {', '.join(f'{n} double' for n in names)}")
    rows = summed.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # symbols + states + 2 rows at most
    table = np.zeros((symbols + states + 2, states))
    table[rows["key"].to_numpy()] = rows[names].to_numpy()
    shared.unpersist()
    move = table[symbols : symbols + states]
    return Model.of(table[-2], move, table[:symbols]), float(table[-1, 0])


def train(coded: DataFrame, counts: np.ndarray, states: int = STATES, passes: int = PASSES) -> Model:
    """coded (codes): all training documents; counts: of each symbol in them."""
    model = Model.first(counts, states)
    for _ in range(passes):
        model, _ = _pass(coded, model)
    return model


def score(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    counted = count_words(docs.where(~F.col("held_out")))
    counts = materialise(
        counted.select(F.when(F.col("c") > 1, F.col("word")).alias("word"), F.xxhash64("word").alias("h"), "k", "c"), "counts"
    )
    powers = [F.count_if(F.col("c") >= 2**j) for j in range(1, 50)]
    total, distinct, *above = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *powers).first()
    # the highest power of two that leaves enough words: each task then sends few rows to the driver
    enough = 2 ** max((j for j, n in enumerate(above, 1) if n >= HEAD), default=1)
    top = counts.where(F.col("c") >= enough).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head, head_counts = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], float)
    in_head = F.lit(False)
    if top:
        least, last = int(top[-1]["c"]), F.lit(head[-1])
        in_head = F.coalesce((F.col("c") > least) | ((F.col("c") == least) & (F.col("word") <= last)), F.lit(False))
    rare = counts.where(~in_head)
    classes = np.zeros((RARE, 2))
    for k, n, v in rare.groupBy("k").agg(F.sum("c"), F.count("*")).collect():  # at most RARE rows
        classes[k] = n, v
    space = total + distinct + 1
    coded = materialise(
        _encode(
            docs, head, np.log10((head_counts + 1) / space), -np.log10(classes.sum(axis=1) + 1)
        ).withColumn("rid", F.monotonically_increasing_id()),
        "coded",
    )
    model = train(coded.where(~F.col("held_out")), np.concatenate((head_counts, classes[:, 0])), states, passes)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for some in _gather(batches):
            found = forward(shared.value, [c for batch in some for c in _arrays(batch.column(0))]) / np.log(10)
            parts = np.split(found, np.cumsum([batch.num_rows for batch in some])[:-1])
            for batch, part in zip(some, parts, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(part)],
                    names=[*batch.schema.names[1:], "hmm"],
                )

    kept = coded.select("codes", "rid", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "rare_norm")
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes[1:])
    scored = kept.mapInArrow(run, f"{schema}, hmm double")
    # a word that training lacks adds log10(0 + 1) = 0, so that an inner join is enough
    found = (
        coded.select("rid", F.explode("rare").alias("h"))
        .join(rare.select("h", "c"), "h")
        .groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_score"), F.count("*").alias("rare_known"))
    )
    extra = F.coalesce("rare_score", F.lit(0.0))
    unknown_or_rare = F.col("n_tokens") - F.col("head_known")
    return scored.join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + extra - unknown_or_rare * F.lit(float(np.log10(space)))).alias("base_score"),
        (F.col("hmm") + F.col("rare_norm") + extra).alias("score"),
    )
