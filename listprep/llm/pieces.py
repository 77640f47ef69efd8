"""Ids of a SentencePiece BPE model by vectorised merge rounds, and texts from ids.

The library joins, over and over, the neighbouring symbols that make the best-scored piece, the
leftmost first. No piece has a space inside or at its end after another character, and many
other characters are neighbours in no piece; nothing crosses such places. A text falls there
into words, and every worker remembers the ids of those it has met (``tokens.Encoder``). New words are
encoded together, some thousand at a time. Their characters lie in one flat array, cut further
between characters that are neighbours in no piece. In every round each word finds its best pair rank by a segmented
minimum; all its pairs of that rank, counted from the left without overlap, are merged at once,
up to the first whose result makes a pair at least as good with a neighbour - from there on the
library would go on differently, so the rest waits for the next round. The array is compacted and
words without pairs leave it. Runs of spaces, whose pieces all have one score, are taken from
the left after their last space had its chance to join the word. Characters
without a piece become the ids of their bytes.

``decode`` joins the pieces' bytes, spaces for the marks of the model, without the space put
before every text. Ids that no text gives (unknown, broken bytes) are left to the library.

Null and empty texts have the end id alone; a table without rows gives none; every row is
encoded for itself, repeated or not. Columns beside ``doc_id`` and ``text`` are not looked at,
whatever their names. Ties of scores go to the left, as in the library. A slice of texts is half
a MB; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, words
from .tables import arrow_map

PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"
#: Ids that are decoded together.
IDS_AT_ONCE = 500_000
#: New words that are merged together, and bytes of texts in a slice.
WORDS_AT_ONCE, SLICE_BYTES = 8192, 1 << 19
NO_PAIR = np.iinfo(np.int32).max
_CHARS = 0x110000
_PROBE = "  a  b\t\né ﬁ "


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if len(keys) == 0:
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """The vocabulary as tables: symbols are piece ids, or ``n`` plus the code point of a
    character that is no piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = lib.get_piece_size()
        texts = [lib.id_to_piece(k) for k in range(n)]
        special = [lib.is_control(k) or lib.is_unknown(k) for k in range(n)]
        byte = [lib.is_byte(k) for k in range(n)]
        self.ids = {t: k for k, t in enumerate(texts) if not (special[k] or byte[k] or lib.is_unused(k))}
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        crosses = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        if crosses or lib.decode(lib.encode(_PROBE)) != _PROBE or not all(byte[k] for k in self.byte_ids.tolist()):
            raise ValueError("the model normalises texts, joins words or has no pieces for bytes")
        self._spaces()
        self._pairs([lib.get_score(k) for k in range(n)])
        self.bytes = [
            b"" if special[k] else bytes([int(t[3:5], 16)]) if byte[k] else t.replace(SPACE, " ").encode() for k, t in enumerate(texts)
        ]
        # pieces that the library writes in another way than their bytes
        self.odd = np.array([lib.is_unknown(k) or lib.is_unused(k) for k in range(n)])
        self.odd[self.byte_ids[32]] = True

    def _spaces(self) -> None:
        """The lengths of pieces of spaces alone, if these merge by themselves: they share the
        least score with no other piece, and no other piece has two spaces."""
        scores = {text: self.library.get_score(k) for text, k in self.ids.items()}
        least = min(scores.values())
        runs = {text for text in scores if set(text) == {SPACE}}
        others = [text for text in scores if text not in runs and (SPACE * 2 in text or scores[text] == least)]
        alone = SPACE in runs and not others and {scores[text] for text in runs} == {least}
        self.runs = {len(text) for text in runs} if alone else set()

    def space_pieces(self, count: int) -> list[int]:
        """Lengths of the pieces of so many spaces: all merges are equally good, so always the
        leftmost is done, and nothing is left to do before the last length found so far."""
        lengths: list[int] = []
        for _ in range(count):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                last = lengths.pop()
                lengths[-1] += last
        return lengths

    def _symbol(self, text: str) -> int | None:
        return self.ids.get(text, self.n + ord(text) if len(text) == 1 else None)

    def _pairs(self, scores: list[float]) -> None:
        order = {score: k for k, score in enumerate(sorted({scores[k] for k in self.ids.values()}, reverse=True))}
        pairs, neighbours = [], set()
        for text, k in self.ids.items():
            if len(text) == 1 or (self.runs and set(text) == {SPACE}):
                continue
            neighbours |= {(ord(a) << 21) + ord(b) for a, b in zip(text, text[1:])}
            for cut in range(1, len(text)):
                left, right = self._symbol(text[:cut]), self._symbol(text[cut:])
                if left is not None and right is not None:
                    pairs.append(((left << 21) + right, k, order[scores[k]]))
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.keys, self.made, self.rank = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.neighbours = np.array(sorted(neighbours), dtype=np.int64)
        # neighbours in ASCII, spaces for the mark, between which a text can be cut
        self.cuts = np.zeros((256, 256), dtype=bool)
        near = {(chr(32) if a == SPACE else a, chr(32) if b == SPACE else b) for text in self.ids for a, b in zip(text, text[1:])}
        for a in range(128):
            for b in range(128):
                self.cuts[a, b] = (chr(a), chr(b)) not in near
        self.cuts[32, 32] = False
        self.of_char = np.arange(self.n, self.n + _CHARS, dtype=np.int32)
        for text, k in self.ids.items():
            if len(text) == 1:
                self.of_char[ord(text)] = k

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs; ``NO_PAIR`` where they make none."""
        at, there = _lookup(self.keys, (left.astype(np.int64) << 21) + right)
        if len(self.keys) == 0:
            return np.full(len(left), NO_PAIR, dtype=np.int32), np.zeros(len(left), dtype=np.int32)
        return np.where(there, self.rank[at], NO_PAIR), self.made[at]


def merge_rounds(model: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols of all words (each not empty, ``first`` where it begins) until no pair
    remains; the symbols left, and how many each word has."""
    counts = np.diff(np.append(first, len(symbols)))
    last = np.zeros(len(symbols), dtype=bool)
    last[first + counts - 1] = True
    rank = np.full(len(symbols), NO_PAIR, dtype=np.int32)
    made = np.zeros(len(symbols), dtype=np.int32)
    inner = np.flatnonzero(~last)
    rank[inner], made[inner] = model.pair(symbols[inner], symbols[inner + 1])
    word = np.arange(len(first))
    size = np.zeros(len(first), dtype=np.int64)
    left_over: list[tuple[np.ndarray, np.ndarray]] = []
    while len(word):
        best = np.minimum.reduceat(rank, first)
        counts = np.diff(np.append(first, len(symbols)))
        done = best == NO_PAIR
        if done.any():
            size[word[done]] = counts[done]
            out = np.repeat(done, counts)
            left_over.append((np.repeat(word[done], counts[done]), symbols[out]))
            symbols, last, rank, made = symbols[~out], last[~out], rank[~out], made[~out]
            word, best, counts = word[~done], best[~done], counts[~done]
            if not len(word):
                break
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        at = np.flatnonzero(rank == np.repeat(best, counts))
        # of pairs that overlap every second one, from the left
        new = np.diff(at, prepend=-2) != 1
        chain = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - chain) % 2 == 0]
        at = at[_undisturbed(model, symbols, last, rank, made, at, first)]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols[at] = made[at]
        last[at] = last[at + 1]
        symbols, last, rank, made = symbols[keep], last[keep], rank[keep], made[keep]
        gone = np.cumsum(~keep)
        at, first = at - gone[at], first - np.where(first > 0, gone[first - 1], 0)
        begins = np.zeros(len(symbols), dtype=bool)
        begins[first] = True
        changed = np.unique(np.concatenate([at, at[~begins[at]] - 1]))
        rank[changed] = NO_PAIR
        changed = changed[~last[changed]]
        rank[changed], made[changed] = model.pair(symbols[changed], symbols[changed + 1])
    owner = np.concatenate([part[0] for part in left_over]) if left_over else np.empty(0, dtype=np.int64)
    flat = np.concatenate([part[1] for part in left_over]) if left_over else symbols
    return flat[np.argsort(owner, kind="stable")], size


def _undisturbed(model: Model, symbols, last, rank, made, at, first) -> np.ndarray:
    """Of the pairs ``at``, those up to the first of each word after which a pair at least as good
    stands beside it."""
    n = len(symbols)
    own = np.zeros(n + 2, dtype=np.int32)
    own[at] = made[at] + 1
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    result, limit = made[at], rank[at]
    disturbed = np.zeros(len(at), dtype=bool)
    # before it: a pair merged just now, or a symbol as it was
    has = np.flatnonzero(~begins[at])
    before = at[has] - 1
    merged = np.where(before > 0, own[before - 1], 0)
    left = np.where(merged > 0, merged - 1, symbols[before])
    disturbed[has] = model.pair(left, result[has])[0] <= limit[has]
    has = np.flatnonzero(~last[at + 1])
    disturbed[has] |= model.pair(result[has], symbols[at[has] + 2])[0] <= limit[has]
    if not disturbed.any():
        return np.ones(len(at), dtype=bool)
    word = np.searchsorted(first, at, side="right")
    new = np.diff(word, prepend=-1) != 0
    # disturbed pairs of the word before this one
    before = np.cumsum(disturbed) - disturbed
    return before == np.maximum.accumulate(np.where(new, before, 0))


class PieceEncoder(tokens.Encoder):
    """Ids of texts; keep one for all batches of a worker."""

    def __init__(self, path: str):
        self.model = Model(path)
        self._forget()

    def _certain(self, data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        return np.ones(len(text_start) - 1, dtype=bool)

    def _spans(self, data: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = self.model.cuts[data[:-1], data[1:]] | ((data[1:] == 32) & (data[:-1] != 32))
        cut[text_start[:-1][np.diff(text_start) > 0]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(data))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for k in range(0, len(texts), WORDS_AT_ONCE) for ids in self._encode_words(texts[k : k + WORDS_AT_ONCE])]

    def _encode_words(self, texts: list[str]) -> list[list[int]]:
        """Ids of words, each with the spaces before it."""
        model = self.model
        ahead = np.zeros(len(texts), dtype=np.int64)
        if model.runs:
            # all spaces but the last are left out for now
            ahead = np.fromiter((max(len(t) - len(t.lstrip(" ")) - 1, 0) for t in texts), np.int64, len(texts))
            texts = [t[k:] for t, k in zip(texts, ahead.tolist())]
        chars = np.frombuffer("".join(texts).replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))[:-1]])
        begins = np.zeros(len(chars), dtype=bool)
        begins[1:] = ~_lookup(model.neighbours, (chars[:-1] << 21) + chars[1:])[1]
        begins[first] = True
        cuts = np.flatnonzero(begins)
        symbols, counts = merge_rounds(model, model.of_char[chars], cuts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[np.searchsorted(cuts, np.append(first, len(chars)))].tolist()
        symbols = symbols.tolist()
        return [self._ids(symbols[a:b], k) for a, b, k in zip(bounds, bounds[1:], ahead.tolist())]

    def _ids(self, symbols: list[int], ahead: int) -> list[int]:
        model, out = self.model, []
        space = model.ids.get(SPACE)
        if ahead:
            if symbols[0] == space:
                symbols, ahead = symbols[1:], ahead + 1
            out = [model.ids[SPACE * length] for length in model.space_pieces(ahead)]
        for symbol in symbols:
            if symbol < model.n:
                out.append(symbol)
            else:
                out += model.byte_ids[list(chr(symbol - model.n).encode())].tolist()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin; the space before a text is put in here."""
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
        return super().encode(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, spaced))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        model, out = self.model, []
        strange = np.concatenate([[0], np.cumsum(model.odd[ids])])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            run = ids[a:b].tolist()
            raw = b"".join(map(model.bytes.__getitem__, run))
            try:
                text = raw.decode() if strange[a] == strange[b] else None
            except UnicodeDecodeError:
                text = None
            out.append(model.library.decode(run) if text is None else text.removeprefix(" "))
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this model."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _ids_list(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """``doc_id`` and the ``ids`` of the whole text, with the end id if there is one."""
    path = path or tokens.vocabulary_path(PIECE_BPE)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, texts = encoder(path), batch.column("text")
        for i, j in words.slices(texts, SLICE_BYTES):
            ids, first = own.encode(texts.slice(i, j - i))
            if end_id is not None:
                ids, first = np.insert(ids, first[1:], end_id), first + np.arange(len(first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), _ids_list(ids, first)], names=["doc_id", "ids"])

    return arrow_map(rows, "doc_id long, ids array<int>", per_batch)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, the ``ids`` and the ``text`` they are."""
    path = path or tokens.vocabulary_path(PIECE_BPE)

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = np.asarray(batch.column("ids").offsets)
        begin = 0
        while begin < batch.num_rows:
            # rows of some number of ids together, one row at least
            end = max(begin + 1, int(np.searchsorted(first, first[begin] + IDS_AT_ONCE, side="right")) - 1)
            some = batch.slice(begin, end - begin)
            ids = batch.column("ids").values[first[begin] : first[end]].to_numpy(zero_copy_only=False)
            texts = encoder(path).decode(ids, first[begin : end + 1] - first[begin])
            columns = [some.column("doc_id"), some.column("ids"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])
            begin = end

    return arrow_map(encoded.select("doc_id", "ids"), "doc_id long, ids array<int>, text string", per_batch)
