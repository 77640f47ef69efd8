"""Fill-in-the-middle on texts stored as independent compressed frames.

``store`` keeps a text as zstandard frames of ``FRAME`` bytes each, cut between characters. Next
to a frame stand the line ends, characters and bytes up to its end, so that the place after any
number of lines is found by a search in these counts and inside one decompressed frame.
``transform`` draws two such places, decompresses the frames they lie in, and streams the ordered
frames of prefix, middle and suffix into the frames of its output. ``restore`` finds the marks in
an output and streams its parts back in the order of the text. No step holds more than a few
decompressed frames of a text, whatever its length.

The units are lines with their line feed; what follows the last line feed is a line too. Every
row stands for itself: a repeated id or text is transformed again, to the same result. A null
text is empty and, like any empty text, plain; a null id is drawn for as if its digits were
none. A table without rows gives none. Columns beside ``doc_id`` and ``text`` are not looked at,
whatever their names. There are no ties: equal places give an empty middle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import arrow_map

FRAME = 1 << 16
LEVEL = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"

FRAMES = "array<struct<units:long,chars:long,bytes:long,data:binary>>"
STORED = f"doc_id long, frames {FRAMES}"
TRANSFORMED = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}"


@dataclass(frozen=True)
class Setting:
    """How places and forms are drawn: percentages of texts transformed and of these in SPM order."""

    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()

    def order(self, form: str) -> tuple[tuple[bytes, int], ...]:
        """Marks and numbers of the parts (prefix 0, middle 1, suffix 2) as they follow in an output."""
        before, after, last = self.marks()
        first = ((before, 0), (after, 2)) if form == PSM else ((after, 2), (before, 0))
        return (*first, (last, 1))

    def draw(self, doc_id: int | None) -> list[int]:
        drawn = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]


Frame = tuple[int, int, int, bytes]
_compressor = _decompressor = None


def _codecs():
    global _compressor, _decompressor
    if _compressor is None:
        _compressor, _decompressor = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    return _compressor, _decompressor


class FrameWriter:
    """Takes a text in pieces, gives its frames."""

    def __init__(self, size: int = FRAME):
        self.size, self.frames, self.held, self.waiting = size, [], [], 0
        self.units = self.chars = self.bytes = 0

    def write(self, piece: bytes) -> None:
        self.held.append(piece)
        self.waiting += len(piece)
        if self.waiting > self.size + 3:
            text, at = b"".join(self.held), 0
            while len(text) - at > self.size + 3:
                end = at + self.size
                while text[end] & 0xC0 == 0x80:
                    end += 1
                self._emit(text[at:end])
                at = end
            self.held, self.waiting = [text[at:]], len(text) - at

    def _emit(self, text: bytes) -> None:
        self.units += text.count(b"\n")
        self.chars += len(text.decode(errors="replace"))
        self.bytes += len(text)
        self.frames.append((self.units, self.chars, self.bytes, _codecs()[0].compress(text)))

    def close(self) -> list[Frame]:
        if self.waiting:
            self._emit(b"".join(self.held))
        self.held, self.waiting = [], 0
        return self.frames


class FrameReader:
    """A stored text; remembers the frame it decompressed last."""

    def __init__(self, frames: list[Frame]):
        self.data = [frame[3] for frame in frames]
        self.units, self.chars, self.bytes = ([0, *(frame[k] for frame in frames)] for k in range(3))
        self.at, self.text = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self.at:
            self.at, self.text = k, _codecs()[1].decompress(self.data[k])
        return self.text

    @property
    def size(self) -> int:
        return self.bytes[-1]

    def n_units(self) -> int:
        open_line = self.size and not self.frame(len(self.data) - 1).endswith(b"\n")
        return self.units[-1] + (1 if open_line else 0)

    def place(self, count: int) -> tuple[int, int]:
        """Bytes and characters of the first ``count`` units."""
        if count == 0:
            return 0, 0
        if count > self.units[-1]:
            return self.size, self.chars[-1]
        k = bisect_left(self.units, count) - 1
        text, end = self.frame(k), 0
        for _ in range(count - self.units[k]):
            end = text.index(b"\n", end) + 1
        return self.bytes[k] + end, self.chars[k] + len(text[:end].decode(errors="replace"))

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes [begin, end) frame by frame."""
        k = bisect_right(self.bytes, begin) - 1
        while begin < end:
            text, base = self.frame(k), self.bytes[k]
            yield text[begin - base : end - base]
            begin, k = self.bytes[k + 1], k + 1

    def find(self, mark: bytes, begin: int = 0) -> int:
        """The first place of ``mark`` from ``begin`` on, also across frames; -1 without one."""
        tail, at = b"", begin
        for piece in self.stream(begin, self.size):
            window = tail + piece
            found = window.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = window[len(window) - len(mark) + 1 :] if len(window) >= len(mark) else window
        return -1


def split_and_form(reader: FrameReader, doc_id: int | None, setting: Setting) -> tuple[int, str, list[tuple[int, int]]]:
    """Number of units, the form, and bytes and characters up to both places."""
    n = reader.n_units()
    h = setting.draw(doc_id)
    if reader.size == 0 or h[2] % 100 >= setting.percent or any(reader.find(mark) >= 0 for mark in setting.marks()):
        return n, PLAIN, []
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return n, SPM if h[3] % 100 < setting.spm_percent else PSM, [reader.place(low), reader.place(high)]


def rearranged(reader: FrameReader, form: str, places: list[tuple[int, int]], setting: Setting) -> Iterator[bytes]:
    """The output of a text, in pieces."""
    if form == PLAIN:
        yield from reader.stream(0, reader.size)
        return
    bounds = list(pairwise([0, places[0][0], places[1][0], reader.size]))
    for mark, part in setting.order(form):
        yield mark
        yield from reader.stream(*bounds[part])


def restored(reader: FrameReader, form: str, setting: Setting) -> Iterator[bytes]:
    """The text an output was made of, in pieces."""
    if form == PLAIN:
        yield from reader.stream(0, reader.size)
        return
    parts, begin = {}, 0
    for (mark, part), (following, _) in pairwise([*setting.order(form), (b"", 3)]):
        begin += len(mark)
        end = reader.find(following, begin) if following else reader.size
        parts[part] = (begin, end)
        begin = end
    for part in range(3):
        yield from reader.stream(*parts[part])


def _frame_lists(rows: Iterable[list[Frame]]) -> pa.Array:
    flat, first = [], [0]
    for frames in rows:
        flat += frames
        first.append(len(flat))
    columns = list(zip(*flat)) if flat else [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("units", "chars", "bytes", "data")
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def _readers(column: pa.Array) -> Iterator[FrameReader]:
    first = column.offsets.to_pylist()
    values = column.values
    units, chars, sizes = (values.field(name).to_pylist() for name in ("units", "chars", "bytes"))
    data = values.field("data")
    for a, b in pairwise(first):
        yield FrameReader([(units[k], chars[k], sizes[k], data[k].as_py()) for k in range(a, b)])


def store(documents: DataFrame, frame: int = FRAME) -> DataFrame:
    """``doc_id`` and the ``frames`` of the text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids = batch.column("text"), batch.column("doc_id")
        for i, j in words.slices(texts):
            data, start = words.text_bytes(texts.slice(i, j - i))
            kept = []
            for a, b in pairwise(start.tolist()):
                writer = FrameWriter(frame)
                for at in range(a, b, 1 << 20):
                    writer.write(data[at : min(at + (1 << 20), b)].tobytes())
                kept.append(writer.close())
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), _frame_lists(kept)], names=["doc_id", "frames"])

    return arrow_map(rows, STORED, per_batch)


def transform(stored: DataFrame, setting: Setting = Setting(), frame: int = FRAME) -> DataFrame:
    """Of every stored text: ``n`` units, the ``form``, characters of prefix and middle (null if
    plain), and the output as ``frames``."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, outputs = [], []
        for doc_id, reader in zip(batch.column("doc_id").to_pylist(), _readers(batch.column("frames"))):
            n, form, places = split_and_form(reader, doc_id, setting)
            writer = FrameWriter(frame)
            for piece in rearranged(reader, form, places, setting):
                writer.write(piece)
            outputs.append(writer.close())
            chars = (places[0][1], places[1][1] - places[0][1]) if places else (None, None)
            rows.append((doc_id, n, form, *chars))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"]
        yield pa.RecordBatch.from_arrays([*columns, _frame_lists(outputs)], names=names)

    return arrow_map(stored, TRANSFORMED, per_batch)


def _per_output(outputs: DataFrame, added: str, make: Callable[[FrameReader, str], tuple]) -> DataFrame:
    """``outputs`` with columns made of every row's frames and form in place of the frames."""
    kept = [field for field in outputs.schema.fields if field.name != "frames"]
    schema = ", ".join([f"`{field.name}` {field.dataType.simpleString()}" for field in kept] + [added])
    names = [item.split()[0] for item in added.split(", ")]

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        forms = batch.column("form").to_pylist()
        made = [make(reader, form) for reader, form in zip(_readers(batch.column("frames")), forms)]
        columns = [batch.column(field.name) for field in kept] + [pa.array(c, pa.string()) for c in zip(*made)]
        yield pa.RecordBatch.from_arrays(columns, names=[field.name for field in kept] + names)

    return arrow_map(outputs, schema, per_batch)


def texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts, in the column ``output``."""
    return _per_output(outputs, "output string", lambda reader, _: (b"".join(reader.stream(0, reader.size)).decode(),))


def restore(outputs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The texts the outputs were made of, in the column ``text``."""
    return _per_output(outputs, "text string", lambda reader, form: (b"".join(restored(reader, form, setting)).decode(),))


def _digest(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digests(outputs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """SHA-256 of every output and of the text restored from it, streamed from the frames."""
    return _per_output(
        outputs,
        "output_sha256 string, restored_sha256 string",
        lambda reader, form: (_digest(reader.stream(0, reader.size)), _digest(restored(reader, form, setting))),
    )


#: The rows of ``op11_fill_in_middle`` in DuckDB, with the default setting.
SQL = r"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
           [CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT) FOR k IN range(4)] AS h FROM base
), placed AS (
    SELECT doc_id, text, lines, h, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a,
           greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b FROM drawn
), parts AS (
    SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
           array_to_string(lines[b + 1:], '') AS suffix,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
