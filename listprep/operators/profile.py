"""Profiles and breakdowns: what a column holds, in one pass.

Everything is a sum, a count or a least value, so that tasks reduce their own rows first and a
frequent value costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import email_domain
from ..functions.text import is_blank, strip

SAMPLES = 3
UNKNOWN = "unknown"


def character_class(value: Column) -> Column:
    """What a text is made of."""
    return (
        F.when(value.isNull(), "null")
        .when(is_blank(value), "blank")
        .when(value.rlike("^[0-9]+$"), "digits")
        .when(value.rlike("^[A-Za-z]+$"), "letters")
        .when(value.rlike("^[A-Za-z0-9]+$"), "letters and digits")
        .otherwise("other")
    )


def text_profile(df: DataFrame, value: Column, samples: int = SAMPLES) -> DataFrame:
    """Rows per length and character class, with some of the values.

    The sample does not depend on order or partitions: of the values whose digest begins with the
    same hexadecimal digit the least digest counts, and of these sixteen the ``samples`` least.
    """
    digest = F.md5(F.col("value"))
    rows = df.select(value.alias("value")).select("value", F.length("value").alias("length"), character_class(F.col("value")).alias("class"))
    least = F.min(F.struct(digest.alias("digest"), F.col("value").alias("value"))).alias("least")
    part = F.substring(digest, 1, 1).alias("part")
    per_part = rows.groupBy("length", "class", part).agg(F.count("*").alias("n_rows"), least)
    chosen = F.slice(F.array_sort(F.collect_list(F.when(F.col("least.value").isNotNull(), F.col("least")))), 1, samples)
    profile = per_part.groupBy("length", "class").agg(F.sum("n_rows").alias("n_rows"), chosen.alias("chosen"))
    texts = F.array_join(F.transform("chosen", lambda one: one["value"]), " ")
    return profile.select("length", "class", "n_rows", texts.alias("samples"))


def _breakdown(df: DataFrame, value: Column, name: str) -> DataFrame:
    kept = F.count(F.when(F.col("reject_step").isNull(), 1)).alias("n_kept")
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n_rows"), kept)


def domain_breakdown(tagged: DataFrame) -> DataFrame:
    """Records and records kept per e-mail domain (A10)."""
    with_email = tagged.filter(~is_blank(F.col("email")))
    return _breakdown(with_email, email_domain(F.col("email")), "domain")


def sales_type_breakdown(tagged: DataFrame, column: str) -> DataFrame:
    """Records and records kept per sales type (A10)."""
    kind = F.lower(strip(F.col(f"`{column}`")))
    return _breakdown(tagged, F.coalesce(F.when(kind != "", kind), F.lit(UNKNOWN)), "sales_type")


def most(breakdown: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by the value."""
    return breakdown.orderBy(F.desc("n_rows"), breakdown.columns[0]).limit(k)
