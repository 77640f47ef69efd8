"""Token ids of whole texts by the ``tokenizers`` library, with a memory of spans met before.

Both tokenizers used here cut a text into pieces by a pattern before they look for tokens, and
no token crosses a piece. A text is therefore cut at places where every reading of the pattern
has a boundary, and each worker has the library encode a span once, the first time it meets it.
Texts in which such places are not certain (white space other than single spaces and line
feeds, spelled-out special tokens) are encoded whole. The ids are those of the library for the
whole text in either case; the tests compare them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import words

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Spans a worker remembers (about 60 bytes each) before it starts anew.
REMEMBERED = 1_500_000
_SLOT_BITS = 22
_BATCH = 4096
#: Spans without white space of their own are encoded so many at a time, as one text with this word between them.
_JOINED, _BETWEEN = 512, "~"

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_PLAIN_WHITE = np.zeros(256, dtype=bool)
_PLAIN_WHITE[[10, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by one vocabulary file; keep one for all batches of a worker."""

    #: The id of the word between spans that are encoded as one text; none, if they are encoded apart.
    between: int | None = None

    def __init__(self, path: str, drops_white_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_white_space = drops_white_space
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        if drops_white_space and len(between) == 1:
            self.between = between[0]
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.keys = np.zeros(1 << 16, dtype=np.uint64)
        self.first = np.zeros((1 << 16) + 1, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.int32)
        self.count = 0
        self.crowded: dict[int, int] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), _BATCH):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + _BATCH], add_special_tokens=False)]
        return out

    def _encode_apart(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self._encode(spans)
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return np.fromiter((x for e in encoded for x in e), dtype=np.int32, count=int(lengths.sum())), lengths

    def _encode_joined(self, spans: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and lengths of the spans, from one text or, if they cannot be told apart in it, from its halves."""
        text = f" {_BETWEEN} ".join(spans)
        if text.count(_BETWEEN) == len(spans) - 1:
            ids = np.array(self._encode([text])[0], dtype=np.int32)
            at = np.flatnonzero(ids == self.between)
            if len(at) == len(spans) - 1:
                return [(np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)]
        half = len(spans) // 2
        return self._encode_joined(spans[:half]) + self._encode_joined(spans[half:]) if half else [self._encode_apart(spans)]

    def _encode_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans in a row and how many each has."""
        if self.between is None:
            return self._encode_apart(spans)
        parts = [part for k in range(0, len(spans), _JOINED) for part in self._encode_joined(spans[k : k + _JOINED])]
        ids, lengths = zip(*parts)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if self.count + len(keys) > REMEMBERED and self.count:
            self._forget()
        ids, lengths = self._encode_spans(texts)
        n = self.count + len(keys)
        if n > len(self.keys):
            size = max(n, 2 * len(self.keys))
            self.keys = np.concatenate([self.keys, np.zeros(size - len(self.keys), dtype=np.uint64)])
            self.first = np.concatenate([self.first, np.zeros(size + 1 - len(self.first), dtype=np.int64)])
        self.keys[self.count : n] = keys
        begin = self.first[self.count]
        self.first[self.count + 1 : n + 1] = begin + np.cumsum(lengths)
        end = int(self.first[n])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, 2 * len(self.ids)) - len(self.ids), dtype=np.int32)])
        self.ids[begin:end] = ids
        entries = np.arange(self.count, n, dtype=np.int32)
        slots = (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        free = self.slots[slots] < 0
        self.slots[slots[free]] = entries[free]
        for k in np.flatnonzero(self.slots[slots] != entries):
            self.crowded[int(keys[k])] = int(entries[k])
        self.count = n

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each hash, and the places of those without one."""
        entries = self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        missing = np.flatnonzero((entries < 0) | (self.keys[entries] != hashes))
        if len(missing) and self.crowded:
            known = [self.crowded.get(h, -1) for h in hashes[missing].tolist()]
            entries[missing] = known
            missing = missing[entries[missing] < 0]
        return entries, missing

    def _certain(self, data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Per text: whether places to cut it are certain."""
        odd = _WHITE[data] & ~_PLAIN_WHITE[data]
        a, b = data[:-1], data[1:]
        # first bytes of white space beyond ASCII, and "<|", with which special tokens begin
        odd[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd[:-1] |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        odd[:-1] |= (a == 0x3C) & (b == 0x7C)
        found = np.concatenate([[0], np.cumsum(odd)])
        return found[text_start[1:]] == found[text_start[:-1]]

    def _spans(self, data: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        white = _PLAIN_WHITE[data]
        cut = np.zeros(n + 1, dtype=bool)
        # a run of letters ends before a mark
        cut[1:n] = _LETTER[data[:-1]] & _MARK[data[1:]]
        if self.drops_white_space:
            cut[1:n] |= white[1:] != white[:-1]
        else:
            alone = np.zeros(n, dtype=bool)
            alone[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
            bounds = text_start[(text_start > 0) & (text_start < n)]
            alone[bounds] = False
            alone[bounds - 1] = False
            cut[:n] |= alone
            cut[1:] |= alone & (data == 10)
        cut[text_start[text_start < n]] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if self.drops_white_space:
            filled = ~white[start]
            start, end = start[filled], end[filled]
        return start, end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin."""
        data, text_start = words.text_bytes(texts)
        counts = np.zeros(len(texts), dtype=np.int64)
        if len(data) == 0:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        start, end = self._spans(data, text_start)
        owner_first = np.searchsorted(start, text_start)
        hashes = words.span_hashes(words.prefix_sums(data), start, end)
        certain = self._certain(data, text_start)
        if not certain.all():
            # what an uncertain text would give is not looked for
            use = np.repeat(certain, np.diff(owner_first))
            start, end, hashes = start[use], end[use], hashes[use]
            owner_first = np.concatenate([[0], np.cumsum(np.where(certain, np.diff(owner_first), 0))])
        entries, missing = self._find(hashes)
        if len(missing):
            keys, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            raw = data.tobytes()
            spans = [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())]
            before = self.count
            self._learn(keys, spans)
            if self.count == before + len(keys):
                entries[missing] = before + np.searchsorted(keys, hashes[missing])
            else:  # started anew: what it knew is gone
                keys, at = np.unique(hashes, return_index=True)
                self._forget()
                self._learn(keys, [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())])
                entries = np.searchsorted(keys, hashes).astype(np.int32)
        lengths = self.first[entries + 1] - self.first[entries]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.first[entries] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        first = ends[owner_first]
        if certain.all():
            return ids, first
        parts = []
        for k, sure in enumerate(certain.tolist()):
            if sure:
                parts.append(ids[first[k] : first[k + 1]])
            else:
                text = data[text_start[k] : text_start[k + 1]].tobytes().decode()
                parts.append(np.array(self._encode([text])[0], dtype=np.int32))
            counts[k] = len(parts[-1])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_white_space: bool) -> Encoder:
    """The worker's encoder for this vocabulary."""
    key = (path, drops_white_space)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, drops_white_space)
    return _encoders[key]
