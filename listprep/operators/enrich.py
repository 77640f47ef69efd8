"""Codes joined on to the surviving records. Every join keeps the number of rows.

``broadcast`` tells whether the reference table fits a broadcast; without it the table is
measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import MISSING_DESCRIPTION, MISSING_UCC, clean_ucc, electric_flag
from ..functions.text import cell_key, match_key
from ..functions.vin import four_digit_year
from ..sources.rules import DEFAULT_CELL
from .lookup import first_per_key, fits_broadcast, lookup

SEGMENTS = ["vin13", "vin48", "vin10"]
DEFAULT_CELL_COLUMNS = (
    "vin", "vin13", "vin48", "vin10", "bodycode", "cell", "model", "trimline", "first_name",
    "last_name", "address_line1", "city", "state", "zip_code", "brand", "desc", "model_year",
)
ELECTRIC_COLUMNS = ("model", "trimline", "description")


def _segment_keys() -> dict[str, Column]:
    return {f"_{name}": match_key(F.col(name)) for name in SEGMENTS}


def _model_key(column: str) -> Column:
    return F.coalesce(match_key(F.col(column)), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row per (segments, model id): the first rule in file order."""
    keyed = rules.select(
        "ord", "cell", "brand", "desc", "modelid",
        *[expr.alias(name) for name, expr in _segment_keys().items()],
        _model_key("modelid").alias("_model"),
    )
    first = first_per_key(keyed, [*_segment_keys(), "_model"], ["ord"])
    return first.select(*_segment_keys(), "_model", F.struct("cell", "brand", "desc", "modelid").alias("_rule"))


def apply_vin_rules(
    df: DataFrame, rules: DataFrame, default_cell: str = DEFAULT_CELL, broadcast: bool | None = None
) -> DataFrame:
    """``cell``, ``brand``, ``desc`` and ``modelid`` from the VIN rules.

    A rule for the segments and the body code comes first, then one for the segments with no
    model id, then the default cell. The answer is always taken from one rule as a whole.
    """
    table = rule_table(rules)
    own = table.withColumnRenamed("_rule", "_own")
    shared = table.filter("_model = ''").select(*_segment_keys(), F.col("_rule").alias("_shared"))
    keyed = df.withColumns({**_segment_keys(), "_model": _model_key("bodycode")})
    small = fits_broadcast(rules) if broadcast is None else broadcast
    joined = lookup(keyed, flat_rule(own, "_own"), [*_segment_keys(), "_model"], small)
    joined = lookup(joined, flat_rule(shared, "_shared"), list(_segment_keys()), small, keys=keyed)

    def chosen(field: str, default: str) -> Column:
        return (
            F.when(F.col("_own_hit"), F.col(f"_own_{field}"))
            .when(F.col("_shared_hit"), F.col(f"_shared_{field}"))
            .otherwise(default)
        )

    result = joined.withColumns(
        {
            "cell": F.coalesce(chosen("cell", default_cell), F.lit(default_cell)),
            "brand": F.coalesce(chosen("brand", ""), F.lit("")),
            "desc": F.coalesce(chosen("desc", ""), F.lit("")),
            "modelid": F.coalesce(chosen("modelid", ""), F.lit("")),
        }
    )
    helpers = [n for n in joined.columns if n.startswith("_") and n not in df.columns]
    return result.drop(*helpers)


def flat_rule(table: DataFrame, name: str) -> DataFrame:
    fields = ("cell", "brand", "desc", "modelid")
    keys = [key for key in table.columns if key != name]
    return table.select(
        *keys, F.lit(True).alias(f"{name}_hit"), *[F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields]
    )


def look_up_brand(df: DataFrame, rules: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``Brand`` and ``Description`` from the first rule for the segments, whatever its model id."""
    keyed = rules.select(
        "ord", F.col("brand").alias("_brand"), F.col("desc").alias("_desc"),
        *[expr.alias(name) for name, expr in _segment_keys().items()],
    )
    first = first_per_key(keyed, list(_segment_keys()), ["ord"]).drop("ord")
    small = fits_broadcast(rules) if broadcast is None else broadcast
    joined = lookup(df.withColumns(_segment_keys()), first, list(_segment_keys()), small)
    brand, text = F.coalesce("_brand", F.lit("")), F.coalesce("_desc", F.lit(""))
    # one projection: ``Brand`` and ``brand`` are one name to Spark
    drop = {*_segment_keys(), "_brand", "_desc", "brand", "Brand", "description", "Description"}
    rest = [F.col(f"`{name}`") for name in joined.columns if name not in drop]
    return joined.select(*rest, brand.alias("Brand"), text.alias("Description"))


def default_cell_rows(df: DataFrame, default_cell: str | Column = DEFAULT_CELL) -> DataFrame:
    """Report of the rows that no rule matched; they stay in the list."""
    columns = [name for name in DEFAULT_CELL_COLUMNS if name in df.columns]
    return df.filter(F.col("cell") == default_cell).select(*columns)


def _unique_ucc(master: DataFrame, strict: bool) -> DataFrame:
    keyed = master.select(
        "ord", match_key(F.col("cell")).alias("cell"), four_digit_year(F.col("modyy")).alias("modyy"), "ucc"
    ).dropna("any", subset=["cell", "modyy"])
    if strict and not keyed.groupBy("cell", "modyy").count().filter("count > 1").isEmpty():
        raise ValueError("the UCC master has several rows for one (cell, modyy)")
    return first_per_key(keyed, ["cell", "modyy"], ["ord"]).drop("ord")


def missing_ucc_pairs(df: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct (cell, modyy) of the records that the master lacks."""
    pairs = df.select(match_key(F.col("cell")).alias("cell"), four_digit_year(F.col("modyy")).alias("modyy")).distinct()
    return pairs.join(_unique_ucc(master, False), ["cell", "modyy"], "left_anti")


def add_ucc(
    df: DataFrame, master: DataFrame, strict: bool = False, broadcast: bool | None = None
) -> DataFrame:
    """``ucc`` by (cell, modyy), ``MISSING_UCC`` where the master has none.

    Of several master rows with one key the first counts; ``strict`` raises instead.
    """
    keyed = df.withColumns({"cell": match_key(F.col("cell")), "modyy": four_digit_year(F.col("modyy"))})
    small = fits_broadcast(master) if broadcast is None else broadcast
    joined = lookup(keyed.drop("ucc"), _unique_ucc(master, strict), ["cell", "modyy"], small)
    return joined.withColumn("ucc", clean_ucc(F.col("ucc")))


def unmatched_ucc_pairs(df: DataFrame) -> DataFrame:
    """Distinct keys left without a code after ``add_ucc``."""
    return df.filter(F.col("ucc") == MISSING_UCC).select("cell", "modyy").distinct()


def unique_descriptions(master: DataFrame) -> DataFrame:
    """First description of every cell."""
    return first_per_key(master.select("ord", "cell", "description_long"), ["cell"], ["ord"]).drop("ord")


def add_description(df: DataFrame, master: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``description_long`` by cell."""
    keyed = df.withColumn("cell", cell_key(F.col("cell"))).drop("description_long")
    small = fits_broadcast(master) if broadcast is None else broadcast
    joined = lookup(keyed, unique_descriptions(master), ["cell"], small)
    return joined.withColumn("description_long", F.coalesce("description_long", F.lit(MISSING_DESCRIPTION)))


def undescribed_cells(df: DataFrame) -> DataFrame:
    return df.filter(F.col("description_long") == MISSING_DESCRIPTION).select("cell").distinct()


def add_electric(df: DataFrame, whole_words: bool = False) -> DataFrame:
    """``electric`` from the text columns present."""
    columns = [F.col(name) for name in ELECTRIC_COLUMNS if name in df.columns]
    return df.withColumn("electric", electric_flag(columns, whole_words=whole_words))


def add_listed_electric(df: DataFrame, listed: DataFrame, key: str, broadcast: bool | None = None) -> DataFrame:
    """Raise the flag of the rows whose key is in a separate list of electric vehicles."""
    marks = listed.select(F.col(key)).dropna().distinct().withColumn("_listed", F.lit(True))
    small = fits_broadcast(listed.select(key)) if broadcast is None else broadcast
    joined = lookup(df, marks, [key], small)
    return joined.withColumn("electric", F.when(F.col("_listed"), "1").otherwise(F.col("electric"))).drop("_listed")
