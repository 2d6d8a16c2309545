import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import token_files as K

from .helpers import ODD, frame, prose


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(K.tokenizer_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


TEXTS = ODD + ["x<|endoftext|> y", "don't we'll 12 34", "日本 a語  b", " lead", "trail ", "a\n b", "Ünï cödé, wörds. go! on?", "ſpecial K ǅ ɐ"]


def test_same_ids_as_the_library(library):
    encode = K.Encoder(K.tokenizer_path())
    for t in TEXTS + [prose(k, 200) for k in range(5)]:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == library(t)


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (1, 2, 127, 128, 129, 5000, 40001):
        for ids in (r.integers(0, 50000, n), np.minimum(r.zipf(1.3, n), 49999), np.full(n, 7), np.arange(n) % 50000):
            block = K.encode_block(ids.astype(np.uint32), 50257)
            assert K.decode_block(io.BytesIO(block).read).tolist() == ids.tolist()
    assert len(block) < 4 * n


def test_damage_is_found():
    block = bytearray(K.encode_block(np.arange(3000, dtype=np.uint32), 50257))
    block[len(block) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        K.decode_block(io.BytesIO(bytes(block)).read)


def test_files_against_library(spark, library, monkeypatch):
    texts = TEXTS + [prose(k, 150) for k in range(20)]
    docs = frame(spark, texts).withColumn("start", F.lit("clash"))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    got = K.token_documents(docs, K.tokenizer_path()).orderBy("start").collect()
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows, strict=True):
        ids = library(r.text) + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert K.token_documents(frame(spark, []), K.tokenizer_path()).count() == 0


def test_documents_over_blocks(spark, tmp_path, monkeypatch):
    """A document longer than a block, and blocks that end inside documents."""
    r = random.Random(1)
    name, parts = f"{tmp_path}/x.qtok", [r.randrange(1, 900) for _ in range(40)] + [K.LANES * 2]
    monkeypatch.setattr(K, "BLOCK", 5000)
    files = K.write_files(frame(spark, [" ".join(["word"] * n) for n in parts]).coalesce(1), K.tokenizer_path(), str(tmp_path / "out"))
    seen = [(i, len(x)) for f in sorted(r.file for r in files.collect()) for i, _, x in K.read_file(f)]
    assert [n for _, n in seen] == [n + 1 for n in parts] and [i for i, _ in seen] == list(range(len(parts))), name


def hard_texts(seed, n=300):
    """Texts whose runs are cut in every way: letters, digits, marks, contractions, white space of all kinds, other alphabets."""
    r = random.Random(seed)
    parts = ["a", "the", "running", "'s", "'ll", "12", "2026", ".", ",", "!?", "é", "ß", "Ünï", "\n", "\n\n", "\t", " ", "\x1c", "\x85", " ", "  ", "日本", "ɐ", "ǅ", "<|endoftext|>", "-" * 30, "q" * 300, "xyzzyx" * 60, "_", "😀", "\x00"]
    return ["".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(r.randrange(12))) for _ in range(n)]


def test_a_batch_gives_the_ids_of_each_of_its_texts(library, monkeypatch):
    encode = K.Encoder(K.tokenizer_path())
    assert encode.cuts
    texts = TEXTS + hard_texts(1)
    wanted = [library(t) + [2] for t in texts]
    for least in (K.CACHE, 5):  # what is kept may go between batches
        monkeypatch.setattr(K, "CACHE", least)
        for size in (1, 7, len(texts)):
            for k in range(0, len(texts), size):
                ids, sizes = encode.batch(pa.array(["before", *texts[k : k + size]], pa.string())[1:], np.array([2], "<u4").tobytes())
                assert sizes.tolist() == [len(x) for x in wanted[k : k + size]]
                assert ids.tolist() == [i for x in wanted[k : k + size] for i in x]
    assert encode.batch(pa.array([], pa.string()))[0].tolist() == []
    encode.forget()
    assert len(encode.number) == 1 and not len(encode.flat)


def test_merges_side_by_side_are_those_of_the_library(library):
    """Random letters join in long chains; all lengths, above and below the longest that stands in columns."""
    merges, r = K.Encoder(K.tokenizer_path()).merges, random.Random(2)
    pieces = ["".join(r.choice("aeinrst") for _ in range(r.randrange(1, 40))) for _ in range(2000)] + ["e" * n for n in (1, 2, 3, 254, 255, 256, 257, 900)] + [" in" + "the" * 150]
    flat, sizes, head = merges(pa.array(pieces, pa.string()))
    assert np.split(flat, np.cumsum(sizes)[:-1])[-1].tolist() == library(pieces[-1])
    assert flat.tolist() == [i for p in pieces for i in library(p)] and head.tolist() == [p[0] == " " for p in pieces]


def test_new_words_are_not_tokenized_one_by_one(monkeypatch):
    """A batch of new words, whose ids took a call of the library each: none is left."""
    encode = K.Encoder(K.tokenizer_path())

    def refused(*_):
        raise AssertionError("a call for one word")

    monkeypatch.setattr(encode, "encode", refused)
    words = [f"w{k:x},ünd{k}." for k in range(3000)]
    numbers = encode._numbers(words)
    assert len(set(numbers.tolist())) == len(words) and numbers.min() > 0


def test_a_step_of_all_lanes_is_coded_at_once(monkeypatch):
    """The two parts of an id took a call of the coder each."""
    calls, put = [], K.Coder.put
    monkeypatch.setattr(K.Coder, "put", lambda self, *a: calls.append(1) or put(self, *a))
    ids = np.minimum(np.random.default_rng(3).zipf(1.2, 128 * 300), 49999).astype(np.uint32)
    K.encode_block(ids, 50257)
    assert len(calls) == 128


def test_few_ids_are_searched_in_reading(monkeypatch):
    """Each id that no order foresaw was searched among the vocabulary."""
    ids, searched, search = np.minimum(np.random.default_rng(4).zipf(1.2, 128 * 300), 49999).astype(np.uint32), [], np.searchsorted
    block = K.encode_block(ids, 50257)
    monkeypatch.setattr(K.np, "searchsorted", lambda a, v, **k: searched.append(len(v)) or search(a, v, **k))
    assert K.decode_block(io.BytesIO(block).read).tolist() == ids.tolist()
    assert sum(searched) < len(ids) // 4


def test_carries_go_through_all_words_before():
    """A lane against the same code in whole numbers of any length, by intervals around the middle, which carry late and far."""
    r, bits, far = random.Random(5), 20, 0
    for _ in range(300):
        coder, low, width, given = K.Coder(1), 0, (1 << 64) - 1, 0
        for _ in range(12):
            start, size = r.choice([((1 << 19) - 1, 2), ((1 << 19) - 1, 2), ((1 << 20) - 1, 1), (1 << 19, 1 << 18), (0, 3), (r.randrange(1 << 19), 7)])
            coder.put(np.array([start], np.uint64), np.array([size], np.uint64), np.uint64(bits))
            width >>= bits
            low, width = low + start * width, width * size
            while width < 1 << 48:
                low, width, given = low << 16, width << 16, given + 1
        words, counts, _ = coder.words_by_lane()
        far += np.concatenate(coder.carries).any()
        assert counts.tolist() == [given + 4] and int.from_bytes(words.astype(">u2").tobytes()) == low
    assert far > 20


def test_letters_alone_are_not_cut(library, monkeypatch):
    """Runs of letters went through the pattern, as all others."""
    encode, seen = K.Encoder(K.tokenizer_path()), []
    cut = encode.cut
    monkeypatch.setattr(encode, "cut", lambda s: seen.append(s) or cut(s))
    text = "start Ünder ªº straße, don't ʼn xyz12 ǅungle sch\u00adön ƻ ǃ a"
    assert encode.batch(pa.array([text]))[0].tolist() == library(text)
    assert "".join(seen).split() == ["straße,", "don't", "xyz12", "sch\u00adön"]
