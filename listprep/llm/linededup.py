"""Line dedup over windows of three consecutive lines.

Every run of three consecutive lines that are not blank is a window. A window that occurs more
than once keeps its first occurrence, in the order of ``doc_id`` (null first), the hash of the
text and the place in it; the lines of all later occurrences are removed, overlapping windows
together. Lines are compared without spaces at their ends. Blank lines stay, belong to no
window and may lie inside one.

A null text stays null and an empty one empty; a text of fewer than three lines has no window.
Rows that agree in ``doc_id`` and text are one document and are treated alike. Other columns
are kept; one named ``n_lines`` or ``n_removed``, in whatever case, is replaced by ``dedup_lines``
and kept by ``cut_lines``, which adds free names. A table without rows gives none. A text is
split by itself, whatever its length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .tables import arrow_map, free_names

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(documents: DataFrame) -> DataFrame:
    """``a``, ``b``: 128 bits of a window; ``place``: its number in its document."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("lines"))
    rows = rows.filter(F.size("lines") >= WINDOW).distinct()
    full = F.filter(F.transform("lines", lambda line: F.trim(line)), lambda line: line != "")
    rows = rows.select("doc_id", "version", full.alias("lines")).filter(F.size("lines") >= WINDOW)
    places = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    rows = rows.select("doc_id", "version", "lines", F.explode(places).alias("place"))
    window = F.slice("lines", F.col("place") + 1, WINDOW)
    return rows.select(
        "doc_id", "version", "place", F.xxhash64(window).alias("a"), F.xxhash64(F.lit(1), F.reverse(window)).alias("b")
    )


def later_windows(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``version`` and ``places`` of all windows but each one's first occurrence."""
    windows = materialise(_windows(documents), "line-windows")
    # one row per window and task leaves each task, however often the window occurs
    first = F.min(F.struct("doc_id", "version", "place")).alias("first")
    repeated = windows.groupBy("a", "b").agg(first, F.count("*").alias("n")).filter("n > 1").select("a", "b", "first")
    here = F.struct("doc_id", "version", "place")
    later = windows.join(repeated, ["a", "b"]).filter(here > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.collect_list("place").alias("places"))


def without(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without its windows at ``places``, the number of its lines and of those removed."""
    if not text:
        return text, 0, 0
    lines = text.split("\n")
    if not places:
        return text, len(lines), 0
    filled = [i for i, line in enumerate(lines) if line.strip(" ")]
    covered = {i for place in places for i in filled[place : place + WINDOW]}
    return "\n".join(line for i, line in enumerate(lines) if i not in covered), len(lines), len(covered)


def cut_lines(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """All rows and columns of ``documents`` with ``text`` rid of repeated windows, and two columns
    more under free names: the number of lines before, and of lines removed."""
    kept = documents.columns
    later = later_windows(documents.select("doc_id", "text"))
    of_id, version, held, lines, removed = free_names(documents, "_later_id", "_later_version", "_places", "_lines", "_removed")
    later = later.select(F.col("doc_id").alias(of_id), F.col("version").alias(version), F.col("places").alias(held))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(version))
    rows = documents.join(later, same, "left").drop(of_id, version)

    def per_batch(batch):
        texts, places = batch.column("text").to_pylist(), batch.column(held).to_pylist()
        text, n_lines, n_removed = zip(*map(without, texts, places))
        new = {"text": pa.array(text, batch.schema.field("text").type)}
        columns = [new.get(name, batch.column(name)) for name in kept]
        counts = [pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*kept, lines, removed])

    schema = T.StructType(list(documents.schema.fields)).add(lines, "integer").add(removed, "integer")
    return arrow_map(rows, schema, per_batch), lines, removed


def dedup_lines(documents: DataFrame) -> DataFrame:
    """All rows of ``documents`` with ``text`` rid of repeated windows, ``n_lines`` (lines before)
    and ``n_removed``."""
    cut, lines, removed = cut_lines(documents)
    kept = [F.col(f"`{name}`") for name in documents.columns if name.lower() not in ("n_lines", "n_removed")]
    return cut.select(*kept, F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed"))


#: The rows of ``dedup_lines`` in DuckDB; ``{documents}`` is the table.
SQL = """
WITH base AS (
    SELECT row_number() OVER () AS rid, * FROM {documents}
), one AS (
    SELECT DISTINCT doc_id, text FROM base WHERE text IS NOT NULL
), numbered AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS did, doc_id, text,
           string_split(text, chr(10)) AS lines FROM one
), exploded AS (
    SELECT did, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM numbered
), filled AS (
    SELECT did, trim(line, ' ') AS line, place,
           row_number() OVER (PARTITION BY did ORDER BY place) AS k
    FROM exploded WHERE trim(line, ' ') <> ''
), windows AS (
    SELECT did, k, place AS p0, lead(place, 1) OVER w AS p1, lead(place, 2) OVER w AS p2,
           line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2
    FROM filled WINDOW w AS (PARTITION BY did ORDER BY k)
), ranked AS (
    SELECT did, p0, p1, p2, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY did, k) AS rn
    FROM windows WHERE l2 IS NOT NULL
), covered AS (
    SELECT DISTINCT did, unnest([p0, p1, p2]) AS place FROM ranked WHERE rn > 1
), cleaned AS (
    SELECT e.did, string_agg(CASE WHEN c.place IS NULL THEN e.line END, chr(10) ORDER BY e.place) AS text,
           count(c.place) AS n_removed, count(*) AS n_lines
    FROM exploded e LEFT JOIN covered c USING (did, place) GROUP BY e.did
)
SELECT b.* EXCLUDE (rid, text),
       CASE WHEN b.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       CASE WHEN coalesce(b.text, '') = '' THEN 0 ELSE c.n_lines END::INTEGER AS n_lines,
       coalesce(c.n_removed, 0)::INTEGER AS n_removed
FROM base b
LEFT JOIN numbered n ON b.doc_id IS NOT DISTINCT FROM n.doc_id AND b.text = n.text
LEFT JOIN cleaned c USING (did)
"""
