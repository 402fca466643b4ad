"""Look-ups of a batch in a table that is many times larger (H5).

The exact join stays with the caller. Before it, the table's rows pass a sieve made
of the batch's keys, a bit per hash, so that only rows that may match are shuffled
and a look-up costs a scan of the key columns and not a shuffle of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sieve: at most 1,024 rows of 512 words of 64 bits, 4 MB however many keys
# there are. One key in 32 bits, so about 1 of 32 rows passes it in vain for a
# million keys; with more keys it lets more pass and is right all the same.
BUCKETS, WORDS = 1024, 512


def _place(on: list[str]) -> tuple[Column, Column, Column]:
    """Bucket, word and bit of a key."""
    h = F.xxhash64(*on)
    return (F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"),
            F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"),
            h.bitwiseAND(F.lit(63)).cast("int"))


def may_match(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``table`` whose key ``on`` is among those of ``keys``, and a few
    others. Key columns have the same types on both sides."""
    bucket, word, bit = _place(on)
    mask = F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_m")
    words = keys.select(bucket.alias("_b"), word.alias("_w"), bit.alias("_bit")).groupBy("_b", "_w").agg(mask)
    # A word is found by its place, so the words that no key is in are filled with zeros.
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)),
                        lambda w: F.struct(w.alias("_w"), F.lit(0).cast("bigint").alias("_m")))
    filled = (words.groupBy("_b").agg(F.collect_list(F.struct("_w", "_m")).alias("_l"))
              .select("_b", F.inline(F.concat("_l", every)))
              .groupBy("_b", "_w").agg(F.bit_or("_m").alias("_m")))
    sieve = (filled.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_w", "_m"))).alias("_l"))
             .select("_b", F.col("_l._m").alias("_words")))
    placed = table.select("*", bucket.alias("_tb"), word.alias("_tw"), bit.alias("_tbit"))
    hit = F.expr("shiftrightunsigned(get(_words, _tw), _tbit) & 1L") == 1
    return (placed.join(F.broadcast(sieve), (F.col("_tb") == F.col("_b")) & hit, "left_semi")
            .drop("_tb", "_tw", "_tbit"))
