"""Exact de-duplication by progressive refinement (operator 5).

Rows are grouped by the length of the normalised text, then by the hash of a
prefix, then by the full SHA-256; each level looks only at rows whose group at
the level before has several rows. The first read of the texts yields narrow
rows (length, prefix hash); :func:`drop_exact` makes full digests only for the
rows that survive both levels.

Grouping is by partial aggregates (count, smallest id), so a group holding a
third of all rows costs a row per task; the joins back are against written
tables, so that Spark sees their sizes and can split a hot key.

Defined results: a null text counts as empty; empty texts are equal to each
other; among rows of one text the smallest ``doc_id`` stays (a null id is
larger than all others); rows that agree in text and ``doc_id`` stay or go
together in :func:`exact_groups`, and :func:`drop_exact` keeps one of them. An
empty table gives an empty result. Extra columns are ignored by
:func:`exact_groups` and kept by :func:`drop_exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialise, unused

# White space as the contract lists it: space and \x09-\x0D.
WHITE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _levels(norm: Column) -> dict[str, Column]:
    return {"len": F.length(norm).cast("long"),
            "prefix": F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))}


def _full(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def _alike(rows: DataFrame, length: str, prefix: str) -> DataFrame:
    """The (length, prefix hash) pairs that several rows have; the second level
    groups only rows that passed the first."""
    several = F.col("n") > 1
    by_len = materialise(rows.groupBy(length).agg(F.count("*").alias("n"))
                         .filter(several).select(length), "exact-len")
    return materialise(
        rows.join(by_len, length, "left_semi").groupBy(length, prefix)
        .agg(F.count("*").alias("n")).filter(several).select(length, prefix), "exact-prefix")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, keep_id,
    group_size, kept, text_sha256``. The digest is a result of every row here,
    so it is made in the first read; the levels still bound what is grouped by
    it to the rows that share length and prefix hash."""
    level = _levels(F.col("norm"))
    rows = materialise(docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id", level["len"].alias("len"), level["prefix"].alias("prefix"),
        _full(F.col("norm")).alias("text_sha256")), "exact-rows")
    alike = _alike(rows, "len", "prefix")
    groups = materialise(
        rows.join(alike, ["len", "prefix"], "left_semi").groupBy("text_sha256")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .filter(F.col("n") > 1), "exact-groups")
    keep = F.when(F.col("n").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier ``doc_id`` has; all
    columns stay. Full digests are made only for rows that share length and
    prefix hash with another row; the other rows pass unhashed and ungrouped.

    Of rows that agree in text and ``doc_id`` the one with the smallest hash of
    its columns stays; of wholly equal rows, one.
    """
    length, prefix, sha, hit, order = unused(docs, "len", "prefix", "sha", "hit", "order")
    norm = normalised(F.col("text"))
    level = _levels(norm)
    own = [F.col(f"`{c}`") for c in docs.columns]
    narrow = materialise(docs.select(level["len"].alias(length), level["prefix"].alias(prefix)),
                         "exact-levels")
    alike = _alike(narrow, length, prefix).withColumn(hit, F.lit(True))
    marked = materialise(
        docs.withColumns({length: level["len"], prefix: level["prefix"]})
        .join(alike, [length, prefix], "left")
        .select(*own, F.when(F.col(hit), _full(norm)).alias(sha)), "exact-marked")
    single = marked.filter(F.col(sha).isNull()).select(*own)
    order_by = F.struct(F.col("doc_id").isNull(), F.col("doc_id"),
                        F.xxhash64(*[c.cast("string") for c in own]))
    first = (marked.filter(F.col(sha).isNotNull()).groupBy(sha)
             .agg(F.min_by(F.struct(*own), order_by).alias(order))
             .select(f"{order}.*"))
    return single.unionByName(first)
