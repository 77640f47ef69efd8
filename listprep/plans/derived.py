"""Record and reference tables derived from the star-schema test data.

The test data holds no VINs or addresses, so the registered queries run on ``vehicle_sales``,
one row per order. The statement is plain SQL that any engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vin import clean_vin, is_vin, vin_segments
from ..operators.enrich import SEGMENTS
from ..sources.masters import description_master, exclusion_set, ucc_master
from ..sources.rules import BusinessRules, EmailRules, StateZipRules
from ..storage import materialise
from .pipeline import References, Settings

VEHICLE_SALES = """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 23 = 1 THEN 'Susan' WHEN o_orderkey % 23 = 2 THEN 'Maria' WHEN o_orderkey % 23 = 3 THEN 'Arie' ELSE concat('First', CAST(o_custkey % 97 AS STRING)) END AS first_name,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'Auto Leasing LLC' WHEN o_orderkey % 43 = 0 THEN 'Ford Club' ELSE concat(' Last', CAST(o_custkey AS STRING)) END AS last_name,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 17 = 1 THEN 'not-an-email' WHEN o_orderkey % 17 = 2 THEN concat('  User', CAST(o_custkey AS STRING), '@GMAIL.COM ') WHEN o_orderkey % 17 = 3 THEN concat('u', CAST(o_custkey AS STRING), '@yahoo.com') WHEN o_orderkey % 17 = 4 THEN 'x@test.invalid' WHEN o_orderkey % 17 = 5 THEN 'noreply@shop.com' ELSE concat('u', CAST(o_custkey AS STRING), '@outlook.com') END AS email_addr,
 CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat(CAST(o_orderkey % 4000 AS STRING), ' Main St ') ELSE concat(CAST(o_orderkey % 4000 AS STRING), ' MAIN ST') END AS address_line1,
 n_name AS city,
 CASE n_regionkey WHEN 0 THEN 'TX' WHEN 1 THEN 'ca ' WHEN 2 THEN 'MA' WHEN 3 THEN 'ZZ' ELSE 'OH' END AS state,
 CASE n_regionkey WHEN 0 THEN '78704' WHEN 1 THEN '900641234' WHEN 2 THEN '2459' WHEN 3 THEN 'K1A 0B1' ELSE '44236-1122' END AS zip_code,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'Fleet' WHEN o_orderstatus = 'F' THEN 'Lease' WHEN o_orderstatus = 'O' THEN ' Retail' ELSE 'PURCHASE' END AS veh_acq_type_cd,
 concat(CASE o_orderkey % 5 WHEN 0 THEN 'W1N' WHEN 1 THEN '4JG' WHEN 2 THEN 'SAL' WHEN 3 THEN 'SAJ' ELSE '5UX' END, upper(substr(md5(CAST(o_custkey % 8 AS STRING)),1,5)), CAST(o_orderkey % 10 AS STRING), substr('PRSTPRSTN0', CAST(o_orderkey % 10 AS INT) + 1, 1), CASE WHEN o_orderkey % 53 = 0 THEN '-' ELSE '' END, lpad(CAST(CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_orderkey END AS STRING), 7, '0'), CASE WHEN o_orderkey % 59 = 0 THEN '.0' WHEN o_orderkey % 67 = 0 THEN 'Z' ELSE '' END) AS vin,
 CASE o_orderkey % 3 WHEN 0 THEN 'X1' WHEN 1 THEN '' ELSE NULL END AS bodycode,
 CASE o_orderkey % 7 WHEN 0 THEN 'Electric Sedan' WHEN 1 THEN 'PHEV Wagon' WHEN 2 THEN 'Chevrolet' ELSE 'Sedan' END AS model,
 CASE o_orderkey % 5 WHEN 0 THEN concat(substr(CAST(o_orderdate AS STRING),1,10), '-09.36.08.000000000   ') WHEN 1 THEN concat(substr(CAST(o_orderdate AS STRING),6,2),'/',substr(CAST(o_orderdate AS STRING),9,2),'/',substr(CAST(o_orderdate AS STRING),1,4)) WHEN 2 THEN concat(substr(CAST(o_orderdate AS STRING),1,4),substr(CAST(o_orderdate AS STRING),6,2),substr(CAST(o_orderdate AS STRING),9,2)) WHEN 3 THEN substr(CAST(o_orderdate AS STRING),1,10) ELSE 'n/a' END AS purchase_date
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

EMAIL_RULES = EmailRules(domains=["test.invalid"], words=["noreply"])
STATE_ZIP_RULES = StateZipRules(
    {
        "TX": ["75", "76", "77", "78", "79"],
        "CA": ["90", "91", "92", "93", "94", "95", "96"],
        "MA": ["01", "02"],
        "OH": ["43", "44", "45"],
    }
)
BUSINESS_RULES = BusinessRules(
    indicators=["LLC", "LEASING", "CLUB"],
    manufacturers=["ford"],
    allowed=[{"name": "First25 Auto Leasing LLC", "city": "NATION_22"}, {"name": "Arie Ford Club"}],
)
SETTINGS = Settings(
    manufacturer="mercedes",
    email_rules=EMAIL_RULES,
    state_zip_rules=STATE_ZIP_RULES,
    business_rules=BUSINESS_RULES,
    check_sales_type=True,
    start_number=10_000_001,
    file_source="vehicle_sales",
)

# Tables written in this session, by application and data folder.
_sales: dict[tuple[str, str], DataFrame] = {}
_references: dict[tuple[str, str], References] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "nation")}
    # a small test file is one split; deal its rows over all cores
    cores = spark.sparkContext.defaultParallelism
    if len(tables["orders"].inputFiles()) < cores:
        tables["orders"] = tables["orders"].repartition(cores, "o_orderkey")
    return spark.sql(VEHICLE_SALES, **tables)


def vehicle_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as the table of files a job would be given, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sales:
        _sales[key] = materialise(derived_sales(spark, sf_dir), "vehicle-sales")
    return _sales[key]


def hash_number(text):
    """0 to 255 from the text, the same in every engine."""
    digest, digits = F.md5(text), F.lit("0123456789abcdef")
    return (F.position(F.substring(digest, 1, 1), digits) - 1) * 16 + F.position(F.substring(digest, 2, 1), digits) - 1


def derived_vin_rules(sales: DataFrame) -> DataFrame:
    """Rules for four in five of the segments in use, some with a second or a model-id rule."""
    vin = clean_vin(F.col("vin"))
    keys = sales.filter(is_vin(vin)).select(*[expr.alias(n) for n, expr in vin_segments(vin).items()]).distinct()
    key = F.concat(*SEGMENTS)
    code = F.upper(F.substring(F.md5(key), 3, 4))

    def rule(prefix: str, order: int, modelid: str):
        return F.struct(
            F.lit(order).alias("ord"),
            F.lit(modelid).alias("modelid"),
            F.concat(F.lit(prefix), code).alias("cell"),
            F.substring("vin13", 1, 2).alias("brand"),
            F.concat(F.lit(f"{prefix} model "), F.col("vin48")).alias("desc"),
        )

    none = F.lit(None)
    variants = F.array_compact(
        F.array(
            rule("c", 2, ""),
            F.when(F.col("h") % 7 == 0, rule("D", 3, "")).otherwise(none),
            F.when(F.col("h") % 3 == 0, rule("X", 1, "x1 ")).otherwise(none),
        )
    )
    kept = keys.withColumn("h", hash_number(key)).filter("h % 5 <> 0")
    return kept.select(*SEGMENTS, F.inline(variants)).select(
        "ord", *SEGMENTS, "modelid", "cell", "brand", "desc"
    )


def derived_ucc_rows(rules: DataFrame, default_cell: str) -> DataFrame:
    """A UCC master as it is delivered: mixed year forms, untidy cells, some keys twice."""
    cells = rules.select("cell").union(rules.sparkSession.range(1).select(F.lit(default_cell))).distinct()
    years = F.array(*[F.lit(str(year)) for year in SETTINGS.valid_years])
    pairs = cells.select("cell", F.explode(years).alias("y"))
    pairs = pairs.withColumn("h", hash_number(F.concat("cell", "y"))).filter("h % 6 <> 0")
    year = F.when(F.col("h") % 3 == 1, F.concat("y", F.lit(".0"))).when(F.col("h") % 3 == 2, F.substring("y", 3, 2))
    code = F.substring(F.translate(F.md5(F.concat("cell", "y")), "abcdef", "012345"), 1, 21)
    rows = pairs.select(
        F.concat(F.lit(" "), F.lower("cell")).alias("sra cell"),
        year.otherwise(F.col("y")).alias("year"),
        F.when(F.col("h") % 10 == 1, "").otherwise(code).alias("21 digit"),
        F.concat(F.lit("UCC "), "cell").alias("description"),
        F.explode(F.when(F.col("h") % 8 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("line"),
    )
    second = F.when(F.col("line") == 2, F.reverse("21 digit")).otherwise(F.col("21 digit"))
    return rows.withColumn("21 digit", second)


def derived_description_rows(rules: DataFrame) -> DataFrame:
    cells = rules.select("cell").distinct()
    cells = cells.withColumn("h", hash_number(F.col("cell"))).filter("h % 4 <> 0")
    lines = F.when(F.col("h") % 9 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return cells.select(F.concat("cell", F.lit(".0")).alias("Cell"), "h", F.explode(lines).alias("line")).select(
        "Cell", F.concat(F.lit(" Long text "), "Cell", F.lit(" line "), F.col("line").cast("string")).alias("Mailing Description"), "line"
    )


def exclusion_tables(sales: DataFrame) -> list[DataFrame]:
    """Two earlier lists, each under another header."""
    vin = F.lower(clean_vin(F.col("vin")))
    return [
        sales.filter("row_id % 11 = 0").select(vin.alias("USA_VIN")),
        sales.filter("row_id % 13 = 0").select(vin.alias(" VehicleID")),
    ]


def references(spark: SparkSession, sf_dir: str) -> References:
    """Reference tables, written once per session as masters are on a cluster."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _references:
        sales = vehicle_sales(spark, sf_dir)
        rules = materialise(derived_vin_rules(sales), "vin-rules")
        _references[key] = References(
            vin_rules=rules,
            ucc_master=materialise(ucc_master(derived_ucc_rows(rules, SETTINGS.default_cell), "line"), "ucc-master"),
            description_master=materialise(
                description_master(derived_description_rows(rules), "line"), "description-master"
            ),
            exclusions=materialise(exclusion_set(exclusion_tables(sales)), "exclusions"),
        )
    return _references[key]


def decode_sources(sales: DataFrame) -> dict[str, DataFrame]:
    """Three decoders' outputs over overlapping parts of the records; some contradict the others."""
    valid = sales.withColumn("vin", clean_vin(F.col("vin"))).filter(is_vin(F.col("vin")))

    def output(condition: str, changed: str) -> DataFrame:
        odd = F.col("row_id") % 19 == 0
        return valid.filter(condition).select(
            "row_id",
            "vin",
            F.when(F.col("row_id") % 4 == 1, F.lit(None)).otherwise(F.substring("vin", 1, 3)).alias("make"),
            F.when(odd, F.concat("model", F.lit(changed))).otherwise(F.col("model")).alias("model"),
            F.substring("vin", 10, 1).alias("model_year"),
        )

    return {
        "a": output("row_id % 2 = 0", ""),
        "b": output("row_id % 3 = 0", " B"),
        "c": output("row_id % 5 <= 1", " C"),
    }
