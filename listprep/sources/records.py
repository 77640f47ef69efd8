"""One scan for every layout of delimited text: records, and the lines that are no record.

The raw lines are written once, each with its place in its file, so that whatever reads them
later sees the same lines under the same numbers. Files are split as Spark splits them, also
where quoted fields hold line breaks. Whether a split begins inside a field cannot be seen from
the split; but a line that begins outside a field ends inside one or not, as one that begins
inside does, and so does any row of lines. Every split notes for both cases where its records
begin and how it ends; from one row per split, in file order, follows which case it is. Records
that lie in one line, nearly all, then need no shuffle. Only the lines of the others are brought
together, by file and first line, whatever splits they are in.

The character set is decided record by record: UTF-8 where it is valid, the fallback elsewhere.
Each file has a header of its own, the first line with content; a column goes by its name, in
whatever place a file has it. All files of a scan have one delimiter.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lookup import fits_broadcast
from ..storage import materialise
from . import headers
from .files import PLACE, SPLIT_ROWS, decoded, detect_delimiter, header_line, split_header, unquoted_delimiters

#: Files with a header unlike all others that one scan takes; each is held by the driver.
MOST_HEADERS = 1000
NOT_CLOSED, TOO_MANY = "quote not closed", "too many fields"
FILE_LINES = 1 << 40
_STATES = "file string, start long, place long, line binary, opens boolean, stays boolean, before_out boolean, before_in boolean, begin_out long, begin_in long"


@dataclass(frozen=True)
class Scan:
    """``records``: text columns and ``PLACE``, a number that follows files and lines.
    ``bad_lines``: ``file``, ``line_no`` (from 1), ``reason`` and the ``line``."""

    records: DataFrame
    bad_lines: DataFrame


def scan_records(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    quoted_breaks: bool = False,
    positions: Mapping[int, str] | None = None,
    optional: Sequence[str] = (),
    fallback: str = "ISO-8859-1",
    parts: bool = False,
) -> Scan:
    """Files with a header line each (S1, S3-S5), or, with ``positions``, columns named by their
    place in files without one (S2). With ``quoted_breaks`` a record ends at a line feed outside
    quotes, else at any line end. With ``parts`` the files are one that was cut between records:
    the numbers of their lines go on through them, in the order of their names."""
    sep = sep or detect_delimiter(header_line(spark, path))
    lines = placed_lines(spark, path, sep, quoted_breaks)
    joined, unclosed = _records(lines, quoted_breaks, parts)
    text = _bare(decoded(F.col("line"), fallback))
    rows = joined.select("file", "file_no", "line_no", text.alias("line")).filter("line != ''")
    unclosed = unclosed.select("file", "line_no", F.lit(NOT_CLOSED).alias("reason"), text.alias("line"))
    if positions is None:
        named, too_many = _by_header(rows, sep)
        return Scan(named, unclosed.unionByName(too_many))
    return Scan(_by_position(rows, sep, positions, optional), unclosed)


def _bare(line: Column) -> Column:
    """Without the mark that begins a file and the carriage return that ends a line; no pattern is
    tried at every character."""
    marked = F.when(F.startswith(line, F.lit("\ufeff")), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    return F.when(F.endswith(marked, F.lit("\r")), F.left(marked, F.length(marked) - 1)).otherwise(marked)


def ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field, if it begins outside one and if inside one.

    A quote opens a field at the field's start only; doubled quotes inside are text. All loops of
    the patterns are possessive, so that the time is in proportion to the line.
    """
    s = "\\" + sep if sep != "\t" else "\\t"
    content = '[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:"{content}"[^{s}]*+|[^{s}"][^{s}]*+|){s})*+'
    opens = line.rlike(f'\\A{fields}"{content}\\z')
    stays = line.rlike(f'\\A{content}(?:"[^{s}]*+{s}{fields}"{content})?+\\z')
    quote = F.contains(line, F.lit('"'))
    return quote & opens, ~quote | stays


def placed_lines(spark: SparkSession, path: str, sep: str, quoted_breaks: bool) -> DataFrame:
    """All lines, written once: ``file``, ``start`` of the split, ``place``, and the states."""
    options = {"lineSep": "\n"} if quoted_breaks else {}
    opens, stays = ends_inside(F.col("line"), sep)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(SPLIT_ROWS - 1))
    where = {"file": F.input_file_name(), "start": F.expr("input_file_block_start()"), "place": place}
    lines = spark.read.options(**options).text(path).select(*[c.alias(n) for n, c in where.items()], F.col("value").alias("line"))
    if not quoted_breaks:
        return materialise(lines.withColumn("opens", opens), "lines")
    raw = lines.select("file", "start", "place", F.col("line").cast("binary").alias("line"), opens.alias("opens"), stays.alias("stays"))
    return materialise(raw.mapInArrow(_states, _STATES), "lines")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line, for both cases of how its split begins: whether the line begins inside a field,
    and the place where its record begins (-1: in an earlier split)."""
    split, inside, begin = None, [False, True], [-1, -1]
    for batch in batches:
        if not batch.num_rows:
            continue
        opens, stays = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("opens", "stays"))
        place = batch.column("place").to_numpy()
        file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
        code = file.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
        before = np.zeros((2, batch.num_rows), dtype=bool)
        begins = np.zeros((2, batch.num_rows), dtype=np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = (file.dictionary[int(code[a])].as_py(), int(start[a]))
            if here != split:
                split, inside, begin = here, [False, True], [-1, -1]
            for case in (0, 1):
                after = _composed(opens[a:b], stays[a:b], inside[case])
                before[case, a], before[case, a + 1 : b] = inside[case], after[:-1]
                own = np.where(before[case, a:b], -1, np.arange(a, b))
                own = np.maximum.accumulate(own)
                begins[case, a:b] = np.where(own < 0, begin[case], place[np.maximum(own, 0)])
                inside[case], begin[case] = bool(after[-1]), int(begins[case, b - 1])
        columns = [pa.array(c) for c in (*before, *begins)]
        names = ["before_out", "before_in", "begin_out", "begin_in"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def _composed(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """States after each line: a line that ends the same way in both cases sets the state, one
    that ends otherwise than it began turns it over, all others leave it."""
    sets = opens == stays
    last = np.maximum.accumulate(np.where(sets, np.arange(len(opens)), -1))
    turns = np.cumsum(opens & ~stays)
    base = np.where(last >= 0, opens[np.maximum(last, 0)], inside)
    turned = turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)
    return base ^ (turned % 2 == 1)


def split_table(lines: DataFrame, quoted_breaks: bool, parts: bool = False) -> DataFrame:
    """One row per split: the number of its file, of lines before it (in the file, or with ``parts``
    in all), and, with quoted breaks, whether it begins ``inside`` a field, the line its first record
    began on, and the line from which on the file's last record is never closed."""
    keys = ("file", "start")
    aggregates = [F.count("*").alias("n"), F.min("place").alias("first")]
    if quoted_breaks:
        last = F.max_by(F.struct("opens", "stays", "before_out", "before_in", "begin_out", "begin_in"), "place")
        aggregates.append(last.alias("last"))
    splits = lines.groupBy(*keys).agg(*aggregates)
    in_file = Window.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1) if parts else before
    # one row per split in one task
    numbered = splits.withColumns(
        {
            "file_no": F.dense_rank().over(Window.orderBy("file")).cast("long"),
            "shift": F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1,
        }
    )
    if not quoted_breaks:
        return numbered.select(*keys, "file_no", "shift")

    def after(case: str) -> Column:
        return F.when(F.col(f"last.before_{case}"), F.col("last.stays")).otherwise(F.col("last.opens"))

    ends = numbered.withColumns({"out": after("out"), "in": after("in")})
    turn, sets = F.col("out") & ~F.col("in"), F.col("out") == F.col("in")
    ends = ends.withColumn("turns", F.sum(turn.cast("int")).over(in_file))
    base = F.coalesce(F.last(F.when(sets, F.col("out")), True).over(before), F.lit(False))
    turned = F.coalesce(F.lag("turns").over(in_file), F.lit(0)) - F.coalesce(F.last(F.when(sets, F.col("turns")), True).over(before), F.lit(0))
    known = ends.withColumn("inside", base != (turned % 2 == 1))
    begin = F.when(F.col("inside"), F.col("last.begin_in")).otherwise(F.col("last.begin_out"))
    known = known.withColumns(
        {
            "ends_inside": F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")),
            "last_begin": F.when(begin >= 0, begin + F.col("shift")),
        }
    )
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.select(
        *keys,
        "file_no",
        "shift",
        "inside",
        F.last("last_begin", True).over(before).alias("carried"),
        F.when(F.last("ends_inside").over(whole), F.last("last_begin", True).over(whole)).alias("unclosed"),
    )


def _records(lines: DataFrame, quoted_breaks: bool, parts: bool) -> tuple[DataFrame, DataFrame]:
    """Records as ``file``, ``file_no``, ``line_no`` and raw ``line``, and the lines that belong to none."""
    # written, as every later pass over the lines needs it
    splits = materialise(split_table(lines, quoted_breaks, parts), "splits")
    splits = F.broadcast(splits) if fits_broadcast(splits) else splits
    keys = ["file", "start"]
    rows = lines.join(splits, keys).withColumn("line_no", F.col("place") + F.col("shift")).withColumn("line", F.col("line").cast("string"))
    found = ("file", "file_no", "line_no", "line")
    if not quoted_breaks:
        return rows.filter("NOT opens").select(*found), rows.filter("opens").select(*found)
    inside = F.when(F.col("inside"), F.col("before_in")).otherwise(F.col("before_out"))
    begin = F.when(F.col("inside"), F.col("begin_in")).otherwise(F.col("begin_out"))
    rows = rows.withColumns({"_inside": inside, "_begin": F.when(begin >= 0, begin + F.col("shift")).otherwise(F.col("carried"))})
    rows = rows.withColumn("_ends_inside", F.when(F.col("_inside"), F.col("stays")).otherwise(F.col("opens")))
    open_end = F.coalesce(F.col("line_no") >= F.col("unclosed"), F.lit(False))
    closed, unclosed = rows.filter(~open_end), rows.filter(open_end).select(*found)
    alone = ~F.col("_inside") & ~F.col("_ends_inside")
    several = closed.filter(~alone).groupBy("file", "file_no", "_begin")
    several = several.agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda part: part["line"]), "\n")
    several = several.select("file", "file_no", F.col("_begin").alias("line_no"), joined.alias("line"))
    return closed.filter(alone).select(*found).unionByName(several), unclosed


def _fields(line: Column, width: int, sep: str) -> Column:
    schema = ", ".join(f"c{place} string" for place in range(width))
    return F.from_csv(line, F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(width + 1, 20480))})


def _place() -> Column:
    return (F.col("file_no") * F.lit(FILE_LINES) + F.col("line_no")).alias(PLACE)


def _by_header(rows: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """Columns by name, and the records with more fields than their file's header."""
    census = rows.groupBy("file_no").agg(F.min("line_no").alias("header_no"), F.min_by("line", "line_no").alias("header"))
    census = materialise(census, "headers")
    kinds = census.groupBy("header").agg(F.min("file_no").alias("file_no")).orderBy("file_no").limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different header lines; are these files of one kind?")
    layouts = [headers.tidy_names(split_header(kind["header"], sep), case=None) for kind in kinds]
    kind = F.create_map(*[F.lit(x) for k, found in enumerate(kinds) for x in (found["header"], k)])
    files = census.select("file_no", "header_no", F.element_at(kind, F.col("header")).alias("kind"))
    files = F.broadcast(files) if fits_broadcast(files) else files
    rows = rows.join(files, "file_no").filter("line_no > header_no")
    width = F.element_at(F.array(*[F.lit(len(names)) for names in layouts]), F.col("kind") + 1)
    rows = rows.withColumn("_many", unquoted_delimiters(F.col("line"), sep) >= width)
    too_many = rows.filter("_many").select("file", "line_no", F.lit(TOO_MANY).alias("reason"), "line")
    parsed = rows.filter("NOT _many").withColumn("_row", _fields(F.col("line"), max(map(len, layouts)), sep))
    spelt: dict[str, str] = {}
    places: dict[str, dict[int, int]] = {}
    for k, names in enumerate(layouts):
        for place, name in enumerate(names):
            spelt.setdefault(name.lower(), name)
            # of names that repeat in a header the first
            places.setdefault(name.lower(), {}).setdefault(k, place)
    columns = [_from_kinds(places[key], len(layouts)).alias(name) for key, name in spelt.items()]
    return parsed.select(*columns, _place()), too_many


def _from_kinds(places: Mapping[int, int], kinds: int) -> Column:
    """The field of a name, which is in a place of its own under each kind of header."""
    by_place: dict[int, list[int]] = {}
    for kind, place in places.items():
        by_place.setdefault(place, []).append(kind)
    if len(by_place) == 1 and len(places) == kinds:
        return F.col(f"_row.c{next(iter(by_place))}")
    column = F.lit(None).cast("string")
    for place, of in by_place.items():
        column = F.when(F.col("kind").isin(of), F.col(f"_row.c{place}")).otherwise(column)
    return column


def _by_position(rows: DataFrame, sep: str, positions: Mapping[int, str], optional: Sequence[str]) -> DataFrame:
    """Columns by place, as many as the widest record has fields."""
    widest = rows.agg(F.max(unquoted_delimiters(F.col("line"), sep))).first()[0] or 0
    width = max(widest, *positions) + 1
    parsed = rows.withColumn("_row", _fields(F.col("line"), width, sep))
    names = [positions.get(place, f"col{place}") for place in range(width)]
    columns = [F.col(f"_row.c{place}").alias(name) for place, name in enumerate(names)]
    return headers.add_missing(parsed.select(*columns, _place()), optional)
