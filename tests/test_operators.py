import pytest
from pyspark.sql import functions as F

from conftest import column
from listprep.operators import dedup, enrich, lookup, numbering, panel, report, unify, validate
from listprep.sources.rules import BusinessRules, EmailRules, StateZipRules


def verdicts(df, *checks):
    screened = validate.screen(df, checks)
    return [tuple(r) for r in screened.orderBy("row_id").select("reject_step", "reject_reason").collect()]


def test_email_check(rows):
    df = rows("row_id, email", ("1", None), ("2", ""), ("3", "a@b.com"), ("4", "a@b"), ("5", "x@bad.org"), ("6", "no-reply@b.com"))
    check = validate.bad_email(F.col("email"), EmailRules(["bad.o"], ["reply"]))
    failed = ("email", "Invalid email")
    assert verdicts(df, check) == [(None, None)] * 3 + [failed] * 3


def test_geography_check(rows):
    df = rows("row_id, s, z", ("1", "MA", "02459"), ("2", "MA", "90001"), ("3", "ZZ", "02459"), ("4", None, None), ("5", "MA", None))
    checks = validate.bad_geography(F.col("s"), F.col("z"), StateZipRules({"MA": ["01", "02"]}))
    assert [reason for _, reason in verdicts(df, *checks)] == [
        None, "State/ZIP mismatch", "Invalid state code", "Invalid state code", "State/ZIP mismatch",
    ]


def test_names_that_contain_short_terms_survive(rows):
    names = ["Susan Lee", "Maria Poe", "Arie Day", "Acme LLC", "Pat Ford", "Stafford Jones", "Book Club", "Book Club"]
    data = [(str(n), name, *name.split(" "), "Boston" if n == 7 else "Ohio") for n, name in enumerate(names)]
    df = rows("row_id, name, first_name, last_name, city", *data)
    listed = BusinessRules([r"\bUSA\b", r"\bARI\b", "LLC", "CLUB"], ["Ford"], [{"name": "book club ", "city": "BOSTON"}])
    assert [step for step, _ in verdicts(df, validate.business(df, listed))] == [None] * 3 + ["business"] * 2 + [None, "business", None]


def test_literal_terms_are_not_patterns(rows):
    df = rows("row_id, name", ("1", "college town"), ("2", "xYz"))
    assert [s for s, _ in verdicts(df, validate.business(df, BusinessRules(["COLLEGE", "x.z"])))] == ["business", "business"]
    assert [s for s, _ in verdicts(df, validate.business(df, BusinessRules()))] == [None, None]


def test_earlier_verdict_stands(rows):
    df = validate.screen(rows("row_id, name, kind", ("1", " ", "x"), ("2", "n", "x"), ("3", "n", " Lease ")), [validate.blank_name(F.col("name"))])
    df = validate.screen(df, [validate.bad_sales_type(F.col("kind"))])
    assert column(df, "reject_step") == ["blank_name", "sales_type", None]
    assert validate.kept(df).count() + validate.rejected(df).count() == 3


def crowded(spark, rows=30_000):
    """A third of the rows share one address and one VIN, another third is blank."""
    part = F.col("id") % 3
    return spark.range(0, rows, numPartitions=8).select(
        F.col("id").alias("row_id"),
        F.when(part == 0, "1 Main").when(part == 2, F.concat(F.lit("s"), F.col("id") % 500)).alias("address_line1"),
        F.when(part != 1, "C").alias("city"),
        F.when(part != 1, "S").alias("state"),
        F.when(part == 0, "V").otherwise(F.concat(F.lit("v"), F.col("id") % 700)).alias("vin"),
    )


def test_crowded_addresses(spark):
    df = crowded(spark)
    first, again = dedup.split_duplicate_addresses(df)
    expected = {}
    for r in df.collect():
        expected.setdefault((r.address_line1, r.city, r.state), r.row_id)
    assert sorted(r.row_id for r in first.collect()) == sorted(expected.values())
    assert first.count() + again.count() == 30_000
    apart = dedup.split_duplicate_addresses(df, blank_is_duplicate=False)[0]
    assert apart.count() == len(expected) - 1 + 10_000


def test_crowded_vins(spark):
    df = crowded(spark)
    listed = spark.createDataFrame([("v7",), ("V",)], "vin string")
    marked = dedup.mark_duplicate_vins(df.select("row_id", "vin"), listed, [])
    counts = {r.dedup_reason: r["count"] for r in marked.groupBy("dedup_reason").count().collect()}
    vins = df.select("vin").distinct().count()
    assert counts == {None: vins - 2, "Duplicate record": 2, "Duplicate VIN in file": 30_000 - vins}


def test_no_window_in_duplicate_steps(spark):
    first, again = dedup.split_duplicate_addresses(crowded(spark))
    for df in (first, again, dedup.mark_duplicate_vins(crowded(spark), None, ["city"])):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_master_upsert(spark):
    master = spark.createDataFrame(
        [(1, "A", 2024, "u1", "d"), (2, "A", 2024, "u2", "d"), (3, "B", 2024, "u3", "d")],
        "ord bigint, cell string, modyy int, ucc string, description string",
    )
    missing = spark.createDataFrame([("C", 2025), ("B", 2024)], "cell string, modyy int")
    found = {(r.cell, r.modyy, r.ucc) for r in dedup.upsert_master(master, missing).collect()}
    assert found == {("A", 2024, "u2"), ("B", 2024, "PENDING"), ("C", 2025, "PENDING")}


RULES = (
    (0, "GLC", "KJ8AB", "S", "", "first", "b1", "d1"),
    (1, "glc ", "KJ8AB", "S", None, "second", "b2", "d2"),
    (2, "GLC", "KJ8AB", "S", " x1", "own", None, "d3"),
    (3, "EQS", "AAAAA", "R", "X1", "only own", "b4", "d4"),
    (4, "NUL", "AAAAA", "R", "", None, "b5", "d5"),
)


@pytest.fixture(scope="module")
def rules(spark):
    schema = "ord int, vin13 string, vin48 string, vin10 string, modelid string, cell string, brand string, desc string"
    return spark.createDataFrame(list(RULES), schema)


@pytest.mark.parametrize("broadcast", [None, True, False])
def test_rule_lookup(rows, rules, broadcast):
    df = rows(
        "row_id, vin13, vin48, vin10, bodycode, _c22",
        ("1", "GLC", "KJ8AB", "S", None, "u"), ("2", "GLC", "KJ8AB", "S", "X1 ", "u"), ("3", "GLC", "KJ8AB", "S", "other", "u"),
        ("4", "EQS", "AAAAA", "R", "", "u"), ("5", "EQS", "AAAAA", "R", "x1", "u"), ("6", "NUL", "AAAAA", "R", None, "u"),
        ("7", None, None, None, None, "u"),
    )
    found = enrich.apply_vin_rules(df, rules, "ZZZ", broadcast)
    assert column(found, "cell") == ["first", "own", "first", "ZZZ", "only own", "ZZZ", "ZZZ"]
    # the answer is one rule: its missing brand is not filled from another
    assert column(found, "brand") == ["b1", "", "b1", "", "b4", "b5", ""]
    assert "_c22" in found.columns and found.count() == 7
    again = enrich.look_up_brand(df, rules, broadcast)
    assert column(again, "Description") == ["d1", "d1", "d1", "d4", "d4", "d5", ""]
    assert column(enrich.default_cell_rows(found, "ZZZ").withColumn("row_id", F.col("vin13")), "vin13") == [None, "EQS", "NUL"]


def keyed(spark, n, hot, share):
    """Rows of which ``share`` percent fall on ``hot`` keys, some on none, the rest on keys of their own."""
    key = F.when(F.col("id") % 100 < share, F.concat(F.lit("hot"), F.col("id") % hot)).when(F.col("id") % 10 < 9, F.col("id").cast("string"))
    return spark.range(0, n).select(F.col("id").alias("row_id"), key.alias("k"))


@pytest.mark.parametrize("hot,share", [(1, 66), (3, 90), (1000, 66), (1, 0)])
def test_large_lookup_is_the_broadcast_lookup(spark, hot, share):
    df = keyed(spark, 20_000, hot, share)
    ref = df.select("k").distinct().dropna().filter("k NOT LIKE '%7'").withColumn("v", F.concat(F.lit("v"), "k"))
    small, large = lookup.lookup(df, ref, ["k"], True), lookup.lookup(df, ref, ["k"], False, least_hot=1)
    assert small.exceptAll(large).isEmpty() and large.count() == 20_000 and large.columns == small.columns
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert lookup.fits_broadcast(ref) and not lookup.fits_broadcast(ref, limit=10)


def test_only_hot_keys_are_salted(spark):
    found = lookup.hot_keys(keyed(spark, 20_000, 1, 66), ["k"], least=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r["_hot_k"], r["_salts"]) for r in found.collect()] == [("hot0", -(-13_200 * tasks // 20_000))]
    # a thousand keys of one size are fewer rows each than a task has
    assert lookup.hot_keys(keyed(spark, 20_000, 1000, 66), ["k"], least=1) is None
    plain = lookup.lookup(keyed(spark, 20_000, 1000, 66), keyed(spark, 10, 1, 0).select("k").distinct(), ["k"], False)
    assert "_salt" not in plain._jdf.queryExecution().analyzed().toString()
    # keys that are null are dealt as well
    nulls = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("k"))
    assert lookup.hot_keys(nulls, ["k"], least=1).first()["_salts"] == tasks


def test_lists_are_filtered_before_they_are_shuffled(spark):
    vins = spark.range(1000).select(F.concat(F.lit("V"), F.col("id")).alias("vin"))
    foreign = spark.range(200_000).select(F.concat(F.lit("F"), F.col("id")).alias("vin"), F.lit("big").alias("source"))
    own = vins.filter("vin LIKE '%5'").withColumn("source", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    near = dedup.with_bits(foreign, "vin", dedup.key_bits(vins, "vin"))
    assert near.count() < 20
    hits = dedup.exclusion_hits(vins, foreign.union(own))
    assert {tuple(r.sources) for r in hits.collect()} == {("a", "b")} and hits.count() == 100
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(vin") < plan.index("getbit")
    # a filter that is full lets all through, and the join decides
    assert dedup.exclusion_hits(vins, foreign.union(own), bits=8).count() == 100
    assert dedup.exclusion_hits(vins.limit(0), own).count() == 0


def test_ucc(spark, rows):
    master = spark.createDataFrame(
        [(1, "a1", 2025, "9"), (2, "A1 ", 2025, "8"), (3, "b", 2025, " ")], "ord bigint, cell string, modyy int, ucc string"
    )
    df = rows("row_id, cell, modyy", ("1", " a1", "2025.0"), ("2", "B", "25"), ("3", "c", "2025"), ("4", None, None))
    found = enrich.add_ucc(df, master)
    assert column(found, "ucc") == ["9", "MISSING_UCC", "MISSING_UCC", "MISSING_UCC"]
    assert {tuple(r) for r in enrich.missing_ucc_pairs(df, master).collect()} == {("C", 2025), (None, None)}
    with pytest.raises(ValueError):
        enrich.add_ucc(df, master, strict=True)


def test_descriptions(spark, rows):
    master = spark.createDataFrame([(2, "A", "late"), (1, "A", "early"), (3, "B", "")], "ord bigint, cell string, description_long string")
    df = rows("row_id, cell", ("1", " a.0"), ("2", "B"), ("3", "C"))
    found = enrich.add_description(df, master)
    assert column(found, "description_long") == ["early", "", "MISSING DESCRIPTION"]
    assert [r[0] for r in enrich.undescribed_cells(found).collect()] == ["C"]


@pytest.mark.parametrize(("partitions", "groups"), [(1, None), (4, 3), (200, 10**9), (None, 3)])
def test_numbers_do_not_depend_on_partitions(spark, partitions, groups):
    df = spark.range(0, 4000, numPartitions=7).select(
        F.col("id").alias("row_id"), (F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")
    )
    found = numbering.number_rows(df, ["k", "row_id"], start=11, group=["g"], group_name="n", groups=groups, partitions=partitions)
    got = sorted(found.collect(), key=lambda r: r.seq8)
    ordered = sorted(df.collect(), key=lambda r: (r.k, r.row_id))
    assert [(r.row_id, r.seq8) for r in got] == [(r.row_id, n) for n, r in enumerate(ordered, 11)]
    places: dict = {}
    for r in got:
        places[r.g] = places.get(r.g, 0) + 1
        assert r.n == places[r.g]


def test_exact_multiple_fills_its_panels(spark):
    df = spark.range(1, 9001).select(F.col("id").alias("panel_row"), F.lit("gmail").alias("panel"))
    sizes = report.panel_sizes(panel.with_chunks(df)).orderBy("chunk").collect()
    assert [(r.chunk, r.n_chunks, r.n_rows) for r in sizes] == [(1, 2, 4500), (2, 2, 4500)]


def test_batches(spark):
    vins = spark.range(0, 2500).select(F.concat(F.lit("v"), F.col("id") % 2100).alias("vin"))
    found = numbering.vin_batches(vins)
    assert [r["count"] for r in found.groupBy("batch").count().orderBy("batch").collect()] == [1000, 1000, 100]
    merged = numbering.merge_batches([found.filter("batch = 1"), found.filter("batch < 3"), found.filter("batch > 2").drop("batch")])
    assert merged.count() == 2100


def test_cell_report(rows):
    df = rows(
        "row_id, cell, desc, modyy, channel, vin",
        ("1", "A", "x", "2024", "email", "v"), ("2", "A ", "x", "2024", "mail", "v"), ("3", "A", None, "2024", "mail", "v"),
        ("4", "default", "y", "2024", None, "v"), ("5", None, None, "2023", "email", "v"), ("6", "A", "x", "2024", "email", None),
    )
    found = {(r.cell, r.description): (r["Year 2024 Email"], r["Year 2024 Mail"], r["Total"]) for r in report.cell_report(df).collect()}
    assert found == {("A", "x"): (1, 1, 2), ("A", "UNKNOWN"): (0, 1, 1), ("UNCODED", "Uncoded – No Cell Assigned"): (0, 0, 2)}
    assert {r.description for r in report.cell_report(df.drop("desc")).collect()} == {"UNKNOWN", "Uncoded – No Cell Assigned"}


def test_combined_reject_tables(rows):
    both = report.combine_reject_tables({"a": rows("x, y", ("1", "2")), "b": rows("x, z", ("3", "4"))})
    assert {tuple(r) for r in both.select("x", "y", "z", "rejection_source").collect()} == {("1", "2", None, "a"), ("3", None, "4", "b")}


def test_case_variants_and_guard(spark, rows):
    df = rows("a, b", ("1", None)).toDF("MO PURCH", "MO Purch")
    merged = panel.merge_case_variants(df, "MO Purch")
    assert merged.columns == ["MO Purch"] and merged.first()[0] == "1"
    guarded = panel.guard_columns(rows("email", ("e",)))
    assert guarded.first()["ucc"] == "MISSING" and guarded.columns.count("email") == 1


def test_layouts():
    assert len(panel.EMAIL_LAYOUT) == 26 and len(panel.MAIL_LAYOUT) == 25
    assert [n for n in panel.EMAIL_LAYOUT if n != "EMAIL"] == list(panel.MAIL_LAYOUT)


def test_unify(spark):
    schema = "row_id int, vin string, make string, model string, model_year string"
    a = spark.createDataFrame([(2, "v1", "late", "m", "1"), (1, "v1", None, "m", "1"), (3, None, "x", "m", "1")], schema)
    b = spark.createDataFrame([(1, "v1", "B", "other", "1"), (2, "v2", "B", "m", None)], schema)
    found = {r.vin: tuple(r)[1:] for r in unify.unify_sources({"a": a, "b": b}).collect()}
    assert found == {"v1": ("B", "m", "1"), "v2": ("B", "m", None)}
    conflicts = [tuple(r) for r in unify.source_conflicts({"a": a, "b": b}).collect()]
    assert conflicts == [("v1", "model", 2, "m", "other")]
    main = {r.vin: r.make for r in unify.merge_main_secondary(b, a.dropna(subset=["vin"])).collect()}
    assert main == {"v1": "B", "v2": "B"}
    renamed = unify.standard_source(spark.createDataFrame([("v", "M")], "`V I N` string, Mk string"), {"V I N": "vin", "Mk": "make"})
    assert renamed.columns == ["vin", "make"]
