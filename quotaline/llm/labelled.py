"""Rows to learn from: who is held out, and a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % parts


def held_out(id_: Column, parts: int, part: int) -> Column:
    """Whether a row is never learned from; rows without an id are not."""
    return F.coalesce(remainder(id_, parts) == part, F.lit(True))


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them by a hash of their id."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(id_col, F.lit("learn")), F.lit(1_000_000)) < int(1e6 * most / n))


def sampled_of_each(rows: DataFrame, id_col: str, of: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them: all of the rarer values of ``of``, equally many of each of the others.

    The driver gets a row per value. Only with more than ``most`` values some may be left out.
    """
    counts = rows.groupBy(of).count().collect()
    if sum(r["count"] for r in counts) <= most:
        return rows
    rates, left = [], most
    for k, r in enumerate(sorted(counts, key=lambda r: r["count"])):
        share = min(r["count"], left / (len(counts) - k))
        rates.append((r[of], int(1e6 * share / r["count"])))
        left -= share
    rated = F.broadcast(rows.sparkSession.createDataFrame(rates, f"of {rows.schema[of].dataType.simpleString()}, rate int"))
    drawn = F.pmod(F.xxhash64(id_col, F.lit("learn")), F.lit(1_000_000)) < F.col("rate")
    return rows.join(rated, rows[of] == rated["of"]).where(drawn).select(*rows.columns)


def texts_with(documents: DataFrame, labels: DataFrame, label_col: str, parts: int, part: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """``text`` and ``y`` of about ``most`` labelled documents that are not held out.

    The sampled labels are at most about ``most`` rows of two numbers, so they are broadcast and no text is shuffled.
    """
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("y").isNotNull())
    own = own.where(~held_out(F.col("id"), parts, part)).groupBy("id").agg(F.max("y").alias("y"))
    texts = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    return texts.join(F.broadcast(sampled(own, "id", most)), "id").select("id", "text", "y")
