import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from listprep.llm import codec, tokenfiles, tokens
from listprep.storage import new_path

PIECES = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "!!", "9", "12", "ß", "Ñ", "<|endoftext|>", "\r\n", "—", "\x0b",
          "\x1c", "\xa0", "ﬁ", "é", "≠", "漢字", "😀", " hello", "World", "don't", "\x85", "　", "İ", "ς"]


@pytest.mark.parametrize("name,drops", [(tokens.WORD_BPE, True), (tokens.BYTE_BPE, False)])
def test_ids_are_those_of_the_library_for_the_whole_text(name, drops):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice(["a", "B", " ", "\n", ".", "'s", "!!", "don't", " hello", "ß"]) for _ in range(12)) for _ in range(4000)]
    encoder = tokens.Encoder(tokens.vocabulary_path(name), drops)
    for part in (texts[:5000], texts[5000:], texts[:100]):
        ids, first = encoder.encode(pa.array(part))
        whole = [e.ids for e in encoder.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == whole


def test_ids_stay_right_when_the_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(tokens.vocabulary_path(tokens.WORD_BPE), True)
    for k in range(20):
        part = [f"word{k} x{j} common" for j in range(k, k + 30)]
        ids, first = encoder.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [encoder.tokenizer.encode(t).ids for t in part]


def test_new_spans_are_encoded_many_at_a_time(monkeypatch):
    spans = [f"wörd{k}x" for k in range(3000)] + ["~", "a~b", "~~", "x" * 3000, "é", "ﬁ", "\u0301a", "İς", "!!"]
    encoder = tokens.Encoder(tokens.vocabulary_path(tokens.WORD_BPE), True)
    texts = []
    encode = tokens.Encoder._encode
    monkeypatch.setattr(tokens.Encoder, "_encode", lambda self, part: texts.extend(part) or encode(self, part))
    ids, first = encoder.encode(pa.array([" ".join(spans[k::7]) for k in range(7)]))
    assert len(texts) < 100
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [encoder.tokenizer.encode(" ".join(spans[k::7])).ids for k in range(7)]


@pytest.mark.parametrize("n", [0, 1, 100, codec.BLOCK, codec.BLOCK + 1, 3 * codec.BLOCK - 7])
@pytest.mark.parametrize("kind", ["same", "any", "few"])
def test_coded_blocks_give_their_ids_back(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.full(n, 65535), "any": rng.integers(0, 65536, n), "few": rng.integers(0, 5, n) * 9000}[kind]
    blocks = codec.encode_blocks(ids)
    assert len(blocks) == -(-n // codec.BLOCK)
    assert (codec.decode_blocks(blocks, n) == ids).all()


def test_a_place_of_all_blocks_is_one_step(monkeypatch):
    places = []
    predict = codec._Models.predict
    monkeypatch.setattr(codec._Models, "predict", lambda self, n: places.append(n) or predict(self, n))
    ids = np.random.default_rng(4).integers(0, 700, 3 * codec.BLOCK)
    blocks = codec.encode_blocks(ids)
    assert len(places) == codec.PLACES < codec.BLOCK and sum(places) == len(ids)
    assert (codec.decode_blocks(blocks, len(ids)) == ids).all()
    assert len(places) == 2 * codec.PLACES


@pytest.mark.parametrize("group", [1, 2, 3])
def test_blocks_are_the_same_in_groups_of_any_size(monkeypatch, group):
    rng = np.random.default_rng(group)
    ids = rng.zipf(1.3, 4 * codec.BLOCK + 777) % 65536
    whole = codec.encode_blocks(ids)
    monkeypatch.setattr(codec, "GROUP", group)
    assert codec.encode_blocks(ids) == whole
    assert (codec.decode_blocks(whole, len(ids)) == ids).all()


@pytest.mark.parametrize("seed", range(6))
def test_ids_of_any_likelihood_come_back(seed):
    # long runs that are broken by ids never seen: the widest and the narrowest parts of a span
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(2 * codec.BLOCK + 300) < 0.1**seed, rng.integers(0, 65536, 2 * codec.BLOCK + 300), 65535)
    assert (codec.decode_blocks(codec.encode_blocks(ids), len(ids)) == ids).all()


def test_ids_take_less_space_than_by_zlib():
    rng = np.random.default_rng(9)
    follows = rng.zipf(1.2, (500, 4)) % 40000
    ids = np.where(rng.random((3000, 4)) < 0.8, follows[rng.integers(0, 500, 3000)], rng.zipf(1.2, (3000, 4)) % 40000).ravel()
    raw = codec.checked(ids)
    plain = sum(len(zlib.compress(raw[k : k + codec.BLOCK].tobytes(), 9)) for k in range(0, len(raw), codec.BLOCK))
    ours = sum(map(len, codec.encode_blocks(ids)))
    assert ours < plain


def test_lanes_that_do_not_have_a_blocks_length_are_an_error():
    blocks = codec.encode_blocks(np.arange(2 * codec.BLOCK) % 977)
    for bad in (blocks[1][:-1], blocks[1] + b"x", b"", blocks[1][:5]):
        with pytest.raises(ValueError, match="broken"):
            codec.decode_blocks([blocks[0], bad], 2 * codec.BLOCK)


def test_ids_that_do_not_fit_are_an_error():
    for ids in ([65536], [3, -1]):
        with pytest.raises(ValueError, match="65536"):
            codec.encode_blocks(np.array(ids))


def test_blocks_do_not_depend_on_each_other():
    ids = np.arange(2 * codec.BLOCK) % 977
    both = codec.encode_blocks(ids)
    assert both[1] == codec.encode_blocks(ids[codec.BLOCK :])[0]
    assert (codec.decode_blocks(both[1:], codec.BLOCK) == ids[codec.BLOCK :]).all()


def test_repeating_ids_are_coded_in_less_space():
    rng = np.random.default_rng(1)
    words_ = rng.integers(0, 40000, (50, 6))
    ids = words_[rng.integers(0, 50, 1500)].ravel()
    assert sum(map(len, codec.encode_blocks(ids))) < len(ids)


def test_a_frame_says_when_a_block_is_broken():
    ids = np.arange(5000) % 300
    frame = tokenfiles.pack_frame([7, None], np.array([4000, 1000]), ids)
    doc_ids, lengths, back = tokenfiles.unpack_frame(frame)
    assert doc_ids == [7, None] and lengths.tolist() == [4000, 1000] and (back == ids).all()
    broken = bytearray(frame)
    broken[-20] ^= 0xFF
    with pytest.raises(ValueError, match="broken"):
        tokenfiles.unpack_frame(bytes(broken))
    with pytest.raises(ValueError, match="not a frame"):
        tokenfiles.unpack_frame(b"xxxx" + frame[4:])


def read_back(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, start int")
    folder = new_path(spark, "test-token-files")
    tokenfiles.write(docs, folder, **options)
    return sorted(map(tuple, tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])


def test_files_hold_all_documents_in_order(spark):
    long = "many words " * 30000
    rows = [(9, "nine", "x", 1), (2, None, "x", 1), (5, "", None, None), (2, "two", "x", 1), (None, "no id", "x", 1), (7, long, "x", 1), (9, "nine", "x", 1)]
    got = read_back(spark, rows, frame=500)
    encoder = tokens.Encoder(tokens.vocabulary_path(tokens.WORD_BPE), True)
    at, expected = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected


def test_no_documents_give_no_rows(spark):
    assert read_back(spark, []) == []
