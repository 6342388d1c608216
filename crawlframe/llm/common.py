"""What the corpus operators share: durable intermediates, Arrow batches, native text expressions."""

from __future__ import annotations

import ctypes
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.operators import store
from crawlframe.operators.store import shared_dir

#: ASCII white space, the separators of words: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

#: Rows to an Arrow batch: a batch of long texts must fit in a Python worker.
BATCH_ROWS = 500


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not the whole
    job, and fixes values such as row ids that a rerun would deal out anew.
    """
    return store.materialise(df, name, shared_dir(df.sparkSession))


#: Most keys of a table that may count as hot: those with over one in so many of its rows.
HOT_KEYS = 2_000
#: Rows of a key below which it isn't hot in any table.
HOT_ROWS = 500


def lookup(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once; a hot key's rows stay where they are.

    counts (key, rows): how many of the `total` rows a key has, for the keys with more
    than one at least. A key with over a HOT_KEYS-th of all rows is hot, so that
    there are fewer than HOT_KEYS hot ones: their part of table is broadcast.
    """
    hot = materialise(counts.where(F.col("rows") > max(total // HOT_KEYS, HOT_ROWS)).select(key), "hot")
    shuffled = table.hint("merge")  # alike at every size: a small table isn't broadcast either
    if hot.isEmpty():
        return rows.join(shuffled, key, how)
    few = F.broadcast(hot)
    beside = F.broadcast(table.join(few, key, "left_semi"))
    return rows.join(few, key, "left_semi").join(beside, key, how).unionByName(rows.join(few, key, "left_anti").join(shuffled, key, how))


#: Bits of a filter of keys, of which a broadcast takes an eighth in bytes.
FILTER_BITS = 1 << 26
_PAGE = 32_768  # bits of one bitmap of Spark's


def key_filter(keys: DataFrame, *key: str) -> DataFrame:
    """(page, bits): one bit for the hash of each key, 8 MB at most whatever the number of keys."""
    at = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    return keys.groupBy((at / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % _PAGE).alias("bits"))


def maybe_in(rows: DataFrame, found: DataFrame, *key: str, inside: bool = True) -> DataFrame:
    """The rows whose key may be (inside) or surely isn't (not inside) one of key_filter's; no shuffle.

    With very many keys the filter lets more of the others through, and costs a later join its size.
    """
    at = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    page, bit = (at / _PAGE).cast("int"), (at % _PAGE).cast("int")
    pages = F.broadcast(found.withColumnsRenamed({"page": "__page", "bits": "__bits"}))
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) > 0, F.lit(False))
    joined = rows.withColumns({"__page": page, "__bit": bit}).join(pages, "__page", "left")
    return joined.where(held if inside else ~held).select(rows.columns)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(batches):
    """batches; after the last one the worker gives the memory it has freed back to the system, as its idle time counts too."""
    yield from batches
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def leaving(run):
    """run, a map of batches, after which the worker gives back the memory that the task has freed.

    Unlike tidy it does so once what run itself holds is gone, and also where run ends early.
    Workers take turns, so that what one keeps after a task is kept by every idle worker of an executor.
    """

    def ran(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ran


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's variable isn't inlined as a column would be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The array of words [^\\x20\\x09-\\x0D]+ of text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
