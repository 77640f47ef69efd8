from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listprep.operators import panel, report
from listprep.plans import derived, pipeline
from listprep.sinks import files as sinks
from listprep.sinks import ordered, versions
from listprep.sources.files import scan_csv
from listprep.streaming import screen_stream


@pytest.fixture(scope="module")
def sales(spark, sf_dir):
    return derived.vehicle_sales(spark, sf_dir)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return derived.references(spark, sf_dir)


@pytest.fixture(scope="module")
def result(sales, tables):
    return pipeline.run(sales, derived.SETTINGS, tables)


def test_every_row_is_kept_or_rejected_once(sales, result):
    assert result.tagged.count() == sales.count() == result.tagged.select("row_id").distinct().count()
    assert result.final.count() + result.rejected.count() == sales.count()
    assert result.final.join(result.rejected, "row_id", "left_semi").isEmpty()
    assert result.rejected.filter("reject_reason IS NULL OR rejection_source IS NULL").isEmpty()


def test_numbers_are_contiguous(result):
    low, high, rows, different = result.final.agg(F.min("seq8"), F.max("seq8"), F.count("*"), F.countDistinct("seq8")).first()
    assert low == derived.SETTINGS.start_number and high == low + rows - 1 and different == rows


def test_reports_balance(result):
    audit = result.audit.orderBy("step_no").collect()
    assert [r.step for r in audit] == list(report.STEPS)
    assert all(r.records_before - r.rejected == r.records_after for r in audit)
    assert all(a.records_after == b.records_before for a, b in zip(audit, audit[1:]))
    assert audit[-1].records_after == result.final.count()
    assert result.reconciliation.first().status == "Match"
    text = report.markdown(result.audit, result.reconciliation, result.counts, "Acme", "06/2025", 1)
    assert "- status: Match" in text and "| geography |" in text
    assert result.cell_report.agg(F.sum("Total")).first()[0] == result.final.count()
    assert result.default_cells.count() == result.final.filter("cell = 'DEFAULT'").count()
    assert result.invalid_dates.count() == result.final.filter("purchase_date IS NULL").count() > 0


def test_panels_hold_every_email_record(result):
    assert result.panels.count() == result.final.filter("channel = 'email'").count()


@pytest.mark.parametrize("shuffle_partitions", [1, 200])
def test_same_result_for_any_partitioning(spark, sales, tables, result, shuffle_partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        mixed = sales.orderBy(F.xxhash64("row_id")).repartition(5)
        again = pipeline.tag(mixed, derived.SETTINGS, tables.exclusions)
        columns = ["row_id", "reject_step", "reject_reason", "seq8"]
        assert again.select(columns).exceptAll(result.tagged.select(columns)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark, sales, tables):
    plan = plan_of(pipeline.tag(sales, derived.SETTINGS, tables.exclusions))
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    kept = sales.sparkSession.createDataFrame([], pipeline.tag(sales, derived.SETTINGS).drop("reject_step", "reject_reason").schema)
    enriched = plan_of(pipeline.enrich_kept(kept, derived.SETTINGS, tables))
    assert enriched.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in enriched


def test_whole_rows_are_shuffled_once(spark, sales, tables):
    """Beyond broadcast size there is one exchange of whole rows, on row_id."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(pipeline.tag(sales, derived.SETTINGS, tables.exclusions))
        assert plan.count("SortMergeJoin") == 1
        assert plan.count("Exchange hashpartitioning(row_id") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_options(sales, tables):
    loose = replace(derived.SETTINGS, check_sales_type=False, blank_is_duplicate=False)
    steps = {r[0] for r in pipeline.tag(sales, loose, None).select("reject_step").distinct().collect()}
    assert "sales_type" not in steps
    strict = pipeline.tag(sales, replace(derived.SETTINGS, strict_zip=True), tables.exclusions)
    assert strict.filter("reject_step IS NULL AND state = 'OH'").isEmpty()


def test_outputs(spark, result, tmp_path):
    final = panel.final_table(result.final, "in.csv")
    path = ordered.write_final(final, str(tmp_path), "Acme Co", "06", "2025", spreadsheet_ucc=True)
    assert path.endswith("acme_co_06_2025_FINAL_OUTPUT")
    back = scan_csv(spark, path)
    assert back.count() == result.final.count()
    assert back.filter("ucc LIKE '=\"%'").count() == result.final.filter("length(ucc) = 21").count()

    email, mail = panel.split_channels(final)
    paths = ordered.write_channels(email, mail, str(tmp_path), "acme_06_2025")
    assert scan_csv(spark, paths[0]).columns == [*panel.EMAIL_LAYOUT, "CHANNEL"]
    assert scan_csv(spark, paths[0]).count() + scan_csv(spark, paths[1]).count() == result.final.count()

    ordered.write_panels(result.panels, str(tmp_path / "panels"), "acme_06_2025")
    names = sorted(p.name for p in (tmp_path / "panels").iterdir() if p.suffix == ".csv")
    assert names == [f"acme_06_2025_{n}_panel_1_of_1.csv" for n in ("gmail", "other", "yahoo_aol")]
    assert not [p for p in (tmp_path / "panels").iterdir() if p.is_dir()]
    numbers = [int(r[0]) for r in scan_csv(spark, str(tmp_path / "panels" / names[1])).select("`SEQUENCE #(8)`").collect()]
    assert numbers == sorted(numbers)

    sinks.write_rejects(result.tagged, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == result.rejected.count()
    sinks.write_counts(result.counts, str(tmp_path / "counts"))
    assert scan_csv(spark, str(tmp_path / "counts")).columns == ["Metric", "Count"]
    sinks.write_text(spark, "report", str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "report"


def test_master_versions(spark, tables, tmp_path):
    first = sinks.write_master_version(tables.ucc_master, str(tmp_path), "1")
    second = sinks.write_master_version(spark.read.parquet(first).limit(1), str(tmp_path), "2")
    assert spark.read.parquet(first).count() == tables.ucc_master.count() and spark.read.parquet(second).count() == 1


def test_stream_gives_the_single_record_verdicts(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(sales.schema).parquet(str(tmp_path / "in"))
    checked = screen_stream(arriving, derived.SETTINGS).select("row_id", "reject_step")
    job = checked.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    job.start(str(tmp_path / "out"), format="parquet").awaitTermination()
    batch = screen_stream(sales, derived.SETTINGS).select("row_id", "reject_step")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == sales.count() and found.exceptAll(batch).isEmpty()


def listed(spark, numbers, path, n_files=3):
    frame = spark.createDataFrame([(str(n), f"row {n}") for n in numbers], "n string, name string")
    frame.coalesce(1).write.options(header=True, maxRecordsPerFile=max(1, -(-len(numbers) // n_files))).csv(path)
    return path


def test_files_out_of_order_are_noticed(spark, tmp_path):
    good = listed(spark, range(5, 50), str(tmp_path / "good"))
    ordered.check_order(spark, good, "n")
    for k, numbers in enumerate(([1, 2, 4, 3, 5, 6], [1, 2, 3, 5, 6, 7], [4, 5, 6, 1, 2, 3], [1, 1, 2, 3], [1, None, 3])):
        path = listed(spark, numbers, str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError, match="out of order"):
            ordered.check_order(spark, path, "n")
    ordered.check_order(spark, listed(spark, [1, 2, 3, 5, 9, 20], str(tmp_path / "gaps")), "n", contiguous=False)
    with pytest.raises(ValueError, match="out of order"):
        ordered.check_order(spark, listed(spark, [4, 5, 6, 1, 2, 3], str(tmp_path / "back")), "n", contiguous=False)


def test_rows_written_in_order(spark, tmp_path):
    frame = spark.range(1, 20_001, numPartitions=7).select((20_001 - F.col("id")).cast("string").alias("n"))
    ordered.write_ordered(frame, str(tmp_path / "out"), "n")
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    numbers = [int(line) for part in parts for line in part.read_text().splitlines()[1:]]
    assert numbers == list(range(1, 20_001))


def test_panel_files_hold_whole_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "FILES_PER_TASK", 3)
    panels = {"gmail": 1000, "other": 950, "yahoo_aol": 1}
    rows = [(p, n, f"{p}_panel_x", 0, str(10 * n)) for p, count in panels.items() for n in range(1, count + 1)]
    frame = spark.createDataFrame(rows, "panel string, panel_row long, panel_file string, n_chunks long, `SEQUENCE #(8)` string")
    index = ordered.write_panels(frame.repartition(5), str(tmp_path / "p"), "x", 100)
    assert sorted(index.columns) == ["chunk", "n_rows", "name", "panel"]
    assert {r.panel: r.n_rows for r in index.groupBy("panel").agg(F.sum("n_rows").alias("n_rows")).collect()} == panels
    for panel_name, count in panels.items():
        of = -(-count // 100)
        for i in range(1, of + 1):
            lines = (tmp_path / "p" / f"x_{panel_name}_panel_{i}_of_{of}.csv").read_text().splitlines()
            assert [int(line) for line in lines[1:]] == [10 * n for n in range(100 * i - 99, min(100 * i, count) + 1)]


def test_counters_of_the_run_are_those_of_the_table(result):
    assert result.read == result.tagged.count()
    again = {r.metric: r.n_rows for r in report.named_counts(result.tagged, report.run_counters(result.tagged)).collect()}
    assert dict(result.counted) == again
    assert {r.metric for r in result.counts.collect()} == {*again, *report.final_counters("x")}


def test_a_row_observed_twice_is_counted_once(spark):
    from listprep.operators.counting import Counted

    written = spark.range(10)
    counted = Counted({"every": F.lit(True), "even": F.col("id") % 2 == 0})
    counted.attach(spark.range(10).union(spark.range(3))).write.format("noop").mode("overwrite").save()
    assert counted.seen("every") == 13 and counted.of(written, "every") == {"every": 10, "even": 5}


def test_report_sections(result):
    breakdowns = {"E-mail domains": result.domains, "Sales types": result.sales_types}
    text = report.markdown(result.audit, result.reconciliation, result.counts, "Acme", "06/2025", 1, breakdowns)
    numbers = {r.metric: r.n_rows for r in result.counts.collect()}
    for line in (
        f"- blank ZIP codes: {numbers['blank_zip']:,}", f"- blank names: {numbers['blank_name']:,}", f"- expected final: {result.final.count():,}",
        f"- without cell: {numbers['vin_missing_cell']:,}", f"- without description: {numbers['missing_descriptions']:,}",
        f"- e-mail records: {numbers['email_count']:,}", f"- records after: {numbers['initial_count'] - numbers['blank_name']:,}",
    ):
        assert line in text
    assert numbers["blank_zip"] > 0 and numbers["missing_descriptions"] > 0
    domains = result.domains.collect()
    assert sum(r.n_kept for r in domains) == numbers["email_count"] and all(f"- {r.domain}: {r.n_rows:,} records" in text for r in domains)
    assert "## Sales types" in text and "## Further counts" not in text
    assert sum(r.n_rows for r in result.vin_profile.collect()) == numbers["initial_count"]


def test_two_writers_of_a_master_lose_no_row(spark, tables, tmp_path):
    from listprep.operators.dedup import upsert_master

    folder, master = str(tmp_path / "master"), tables.ucc_master

    def pending(*cells):
        return spark.createDataFrame([(cell, 2025) for cell in cells], "cell string, modyy int")

    def merged(rows, *cells):
        return upsert_master(rows.withColumn("ord", F.lit(0).cast("long")), pending(*cells))

    assert versions.current_version(spark, folder) is None
    assert versions.update_master(spark, folder, lambda rows: master.select("cell", "modyy", "ucc", "description")) == 1
    seen = []

    def slow(rows):
        # the other run is first, once
        if not seen:
            versions.update_master(spark, folder, lambda other: merged(other, "NEW-A", "NEW-B"))
        seen.append(versions.current_version(spark, folder)[0])
        return merged(rows, "NEW-C")

    assert versions.update_master(spark, folder, slow) == 3 and seen == [2, 2]
    number, rows = versions.current_version(spark, folder)
    assert number == 3 and {r.cell for r in rows.filter("ucc = 'PENDING' AND cell LIKE 'NEW%'").collect()} == {"NEW-A", "NEW-B", "NEW-C"}


def test_a_manifest_has_its_content_before_its_number(spark, tmp_path):
    folder = tmp_path / "master"
    place = versions._Folder(spark, str(folder))
    assert versions.update_master(spark, str(folder), lambda _: spark.range(3)) == 1
    assert not place.create(1, "other") and place.read(1) != "other"
    # what a run that broke off has left is no version
    (folder / versions.MANIFESTS / "0a1b").write_text("")
    assert versions.update_master(spark, str(folder), lambda rows: rows.union(spark.range(4))) == 2
    assert versions.current_version(spark, str(folder))[1].count() == 7
