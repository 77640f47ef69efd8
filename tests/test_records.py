import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listprep.plans import catalog
from listprep.plans.catalog import small_splits
from listprep.sources import records
from listprep.sources.files import PLACE, with_row_id


def written(tmp_path, files):
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path / "in")


def rows_of(scan):
    return [tuple(r) for r in scan.records.orderBy(PLACE).drop(PLACE).collect()]


def bad(scan):
    return sorted((r.file.rsplit("/", 1)[-1], r.line_no, r.reason, r.line) for r in scan.bad_lines.collect())


def test_states_of_lines(spark):
    cases = {
        'a,b': (False, True), '"a",b': (False, True), 'a,"b': (True, False), 'a"b': (False, False), 'a,"b ""c""': (True, True),
        '"x",5" y': (False, True), 'end",z': (False, False), '""': (False, True), '"': (True, False), '': (False, True),
        'end","new': (True, True), 'a,"b"",c': (True, True), '"""': (True, False),
    }
    df = spark.createDataFrame([(line,) for line in cases], "line string")
    found = df.select("line", *records.ends_inside(F.col("line"), ",")).collect()

    def after(line, inside):
        """One character after the other."""
        start, k = not inside, 0
        while k < len(line):
            if inside:
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        k += 1
                    else:
                        inside, start = False, False
            elif line[k] == '"' and start:
                inside = True
            else:
                start = line[k] == ","
            k += 1
        return inside

    for line, opens, stays in found:
        assert (opens, stays) == (after(line, False), after(line, True)), line


def test_rows_of_lines_are_composed():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        opens, stays = (np.array([rng.random() < 0.5 for _ in range(n)]) for _ in range(2))
        for inside in (False, True):
            state, expected = inside, []
            for o, s in zip(opens, stays):
                state = bool(s if state else o)
                expected.append(state)
            assert records._composed(opens, stays, inside).tolist() == expected


@pytest.mark.parametrize("size", [400, 5000, 1 << 20])
def test_quoted_breaks_over_splits(spark, tmp_path, size):
    """Any size of splits, fields longer than several of them, each file in a character set of its own."""
    rng = random.Random(size)
    expected, files = [], {}
    for name, charset in (("a.csv", "utf-8"), ("b.csv", "latin-1"), ("c.csv", "utf-8")):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "note", "more"])
        for k in range(40):
            note = "".join(rng.choice(["é", '"', "\n", ",", "x", "\n\n", "word "]) for _ in range(rng.choice([0, 1, 3, 200])))
            row = [f"{name}{k}", note, 'a"b' if k % 5 else "z"]
            if k % 7 == 3:  # a quote inside a bare field is text
                out.write(f'{row[0]},5" pipe,x\n')
                expected.append((row[0], '5" pipe', "x"))
            else:
                writer.writerow(row)
                expected.append(tuple(value or None for value in row))
        files[name] = out.getvalue().encode(charset)
    path = written(tmp_path, files)
    with small_splits(spark, size):
        scan = records.scan_records(spark, path, quoted_breaks=True)
    assert rows_of(scan) == expected and bad(scan) == []


def test_a_quote_that_is_never_closed_takes_no_more_than_its_file(spark, tmp_path):
    path = written(tmp_path, {"a.csv": 'id,x\n1,"a\nb"\n2,"open\n3,y\n4,z\n', "b.csv": "id,x\n5,c\n"})
    with small_splits(spark, 8):
        scan = records.scan_records(spark, path, quoted_breaks=True)
    assert rows_of(scan) == [("1", "a\nb"), ("5", "c")]
    closed = records.NOT_CLOSED
    assert bad(scan) == [("a.csv", 4, closed, '2,"open'), ("a.csv", 5, closed, "3,y"), ("a.csv", 6, closed, "4,z")]


def test_line_by_line_every_open_quote_is_bad(spark, tmp_path):
    path = written(tmp_path, {"a.csv": 'id,x\r\n1,"two\r\nlines"\r\n\r\n2,a,b\r\n3,"c, d"\r\n4\r\n'})
    scan = records.scan_records(spark, path)
    assert rows_of(scan) == [('lines"', None), ("3", "c, d"), ("4", None)]
    assert bad(scan) == [("a.csv", 2, records.NOT_CLOSED, '1,"two'), ("a.csv", 5, records.TOO_MANY, "2,a,b")]


def test_every_file_has_its_own_header(spark, tmp_path):
    files = {
        "a.csv": "﻿id,VIN,zip\n1,V1,Z1\n", "b.csv": "id,zip, vin \n2,Z2,V2\n", "c.csv": "\n\nzip,id\nZ3,3\nid,zip\n",
        "d.csv": "id,vin,vin,new\n4,V4,other,N4\n5,V5,x,y,too many\n", "e.csv": "", "f.csv": "id,VIN,zip\n",
    }
    scan = records.scan_records(spark, written(tmp_path, files), ",")
    assert scan.records.columns == ["id", "VIN", "zip", "new", PLACE]
    assert rows_of(scan) == [("1", "V1", "Z1", None), ("2", "V2", "Z2", None), ("3", None, "Z3", None), ("zip", None, "id", None), ("4", "V4", None, "N4")]
    assert bad(scan) == [("d.csv", 3, records.TOO_MANY, "5,V5,x,y,too many")]


def test_too_many_kinds_of_headers_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_HEADERS", 2)
    with pytest.raises(ValueError, match="header lines"):
        records.scan_records(spark, written(tmp_path, {f"{k}.csv": f"id,c{k}\n1,2\n" for k in range(3)}))


def test_columns_by_place(spark, tmp_path):
    path = written(tmp_path, {"a.csv": '1,V1\n2,"V2\n3,V3,EXTRA\n"4","a ""b"""\n'})
    scan = records.scan_records(spark, path, ",", positions={0: "id", 1: "vin"}, optional=["more"])
    assert scan.records.columns == ["id", "vin", "col2", PLACE, "more"]
    assert rows_of(scan) == [("1", "V1", None, None), ("3", "V3", "EXTRA", None), ("4", 'a "b"', None, None)]
    assert bad(scan) == [("a.csv", 2, records.NOT_CLOSED, '2,"V2')]


def test_numbers_follow_files_and_lines(spark, tmp_path):
    files = {f"{name}.csv": "k\n" + "".join(f"{name}{n:04}\n" for n in range(count)) for name, count in (("a", 3), ("b", 900), ("c", 2))}
    path = written(tmp_path, files)
    with small_splits(spark, 500):
        numbered = with_row_id(records.scan_records(spark, path, ",").records)
        keys = [r.k for r in numbered.orderBy("row_id").collect()]
    assert numbered.columns == ["k", "row_id"] and len(keys) == 905 and keys == sorted(keys)


@pytest.mark.parametrize("quoted_breaks", [False, True])
def test_lines_of_a_file_in_parts_are_numbered_on(spark, tmp_path, quoted_breaks):
    files = {f"part-{k}": "".join(f'{n},{"V" if n % 7 else chr(34)}{n}\n' for n in range(40 * k, 40 * k + 40 - k)) for k in range(3)}
    lines = "".join(files.values()).splitlines()
    path = written(tmp_path, {name: content.replace('"', "q" if quoted_breaks else '"') for name, content in files.items()})
    with small_splits(spark, 90):
        scan = records.scan_records(spark, path, ",", quoted_breaks, positions={0: "id"}, parts=True)
    found = [(r.line_no, r.line) for r in scan.bad_lines.orderBy("line_no").collect()]
    assert found == ([] if quoted_breaks else [(k, line) for k, line in enumerate(lines, 1) if '"' in line])
    assert [r.id for r in scan.records.orderBy(PLACE).collect()] == [line.split(",")[0] for line in lines if quoted_breaks or '"' not in line]


def test_marks_and_carriage_returns_are_taken_off(spark):
    lines = ["\ufeffid\r", "a\r\r", "\ufeff\ufeffb", "c\rd", "\r", "\ufeff", "", "é\ufeff", None]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    expected = df.select(F.regexp_replace("line", "^\ufeff|\r\\z", "")).collect()
    assert df.select(records._bare(F.col("line"))).collect() == expected


def test_written_files_do_not_grow_beyond_their_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_LINES", 50)
    rows = spark.range(1000).select((1000 - F.col("id")).alias("row_id"))
    path = catalog.written_lines(rows, F.col("row_id").cast("string"), str(tmp_path / "out"), n_files=1, header="h")
    parts = [part.read_text().split() for part in sorted((tmp_path / "out").glob("part-*"))]
    assert len(parts) == 20 and all(part[0] == "h" and len(part) < 200 for part in parts)
    assert [int(n) for part in parts for n in part[1:]] == list(range(1, 1001))
    assert path == str(tmp_path / "out")


def test_files_of_any_size_are_cut_into_a_bounded_number_of_splits(spark, tmp_path, monkeypatch):
    sizes = []

    def noted(session, size):
        sizes.append(size)
        return small_splits(session, size)

    monkeypatch.setattr(catalog, "small_splits", noted)
    monkeypatch.setattr(catalog, "MANY_SPLITS", 4)
    assert catalog.quoted_line_breaks(spark, "/root/testdata/sf0.001").count() == 1500
    # 4,096 bytes each made the splits grow with the table
    assert sizes[0] > 4096
    (tmp_path / "small").write_text("x")
    assert catalog.split_bytes(spark, str(tmp_path)) == 4096


def test_keyed_rows_are_written_once(spark):
    numbered = with_row_id(spark.createDataFrame([("7",), ("8",)], "k string"), "k")
    assert numbered.inputFiles() and sorted(r.row_id for r in numbered.collect()) == [7, 8]
