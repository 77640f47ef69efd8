import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from compare import connect, difference
from listprep.llm import entries
from listprep.llm.tables import table
from test_llm_neardup import brute

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    assert difference(spark, connect(SF_DIR), SF_DIR, entries.queries()[name], entries.oracle_sql()[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry_points.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_component_query_gives_those_of_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in entries.queries()["op3_minhash"](spark, SF_DIR).collect())
    assert got == brute(rows, 3, 85)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage was given and returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF_DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_keep_the_columns_and_lose_rows_only_for_a_reason(spark, stages):
    columns = table(spark, SF_DIR, "documents").columns
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == columns and after.schema["doc_id"] == before.schema["doc_id"]
        assert 0.5 * before.count() < after.count() <= before.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {r.doc_id for r in stages["toxicity"][1].collect()}
    labels = table(spark, SF_DIR, "labels").collect()
    assert np.mean([r.doc_id not in kept for r in labels if r.toxic]) > 0.85
    assert all(r.doc_id in kept for r in labels if not r.toxic)


def test_lines_are_those_of_a_plain_version(stages):
    before, after = stages["line_dedup"]
    seen, expected = set(), {}
    for row in sorted(before.collect(), key=lambda r: r.doc_id):
        lines = row.text.split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        covered = set()
        for k in range(len(filled) - 2):
            window = tuple(lines[i].strip(" ") for i in filled[k : k + 3])
            covered |= set(filled[k : k + 3]) if window in seen else set()
            seen.add(window)
        text = "\n".join(line for k, line in enumerate(lines) if k not in covered)
        if not covered or text.strip(" "):
            expected[row.doc_id] = text
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_document_of_each_component_stays(stages):
    before, after = stages["minhash"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in brute(rows, 5, 80)}


def test_documents_with_items_go(spark, stages):
    before, after = stages["decontaminate"]
    items = [r.text for r in table(spark, SF_DIR, "benchmark").collect() if len(r.text.split()) >= 12]
    kept = {r.doc_id for r in after.collect()}
    leaked = {r.doc_id for r in before.collect() if any(item in r.text for item in items)}
    assert leaked and not leaked & kept
    assert {r.doc_id for r in before.collect()} - kept <= leaked | {r.doc_id for r in before.collect() if any(item[:60] in r.text for item in items)}


def test_packed_ids_are_all_of_the_kept_documents(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_gives_the_rows_of_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF_DIR).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["packing"][1].select(*columns).collect()))


def test_stages_of_a_table_without_rows(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_stages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _version string, copy int, n_removed int"
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (3, "x\ny\nz"), (4, "x\ny\nz"), (4, "x\ny\nz"), (5, "long words " * 20000)]
    docs = spark.createDataFrame([(i, t, None, "s", None, "v", 1, 9) for i, t in rows], schema)
    for clash in ("n_removed", "N_Removed", "N_LINES", "_LINES"):
        named = docs.withColumnRenamed("n_removed", clash)
        for name, stage in corpus_pipeline.STAGES[:-1] if clash == "n_removed" else corpus_pipeline.STAGES[1:2]:
            found = stage(spark, named, SF_DIR)
            assert found.columns == named.columns, name
            kept = found.collect()
            assert {1, 2, 3, 5, None} <= {r.doc_id for r in kept}, name
            assert {r[clash] for r in kept} == {9} and {r.source for r in kept} == {"s"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= 8
