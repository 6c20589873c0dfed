"""Encoding and token files against the libraries on whole texts."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, frames, workspace
from tidewatch.llm.queries import BPE_JSON, MULTI_RANKS, op2_bpe, op7_frames


@pytest.fixture(scope="module")
def whole():
    """ids of a whole text, by tiktoken."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(MULTI_RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(BPE_JSON))
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]


def check_op2(rows, out, whole):
    want = {}
    for doc_id, text in rows:
        ids, data = np.array(whole(text or ""), "<u4").tobytes(), (text or "").encode()
        want.setdefault(doc_id, []).append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_encoding(spark, sf_dir, documents, whole):
    check_op2([(i, t) for i, t, _ in documents], op2_bpe(spark, sf_dir).collect(), whole)


def test_encoding_odd_rows(spark, odd_docs, folder, whole):
    check_op2([(r.doc_id, r.text) for r in odd_docs.collect()], op2_bpe(spark, folder(documents=odd_docs)).collect(), whole)


@pytest.mark.parametrize("text", ["a  b \n c d\t e", "x" * 99, "don't  stop 12 345 , é ü    b", "你好 世界 " * 9, " a b ", "<|endoftext|> a", "1 2  3\r\n 4"])
def test_cuts_keep_the_ids(text, whole, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 3)
    assert "".join(bpe.safe_pieces(text, 3)) == text
    assert [i for p in bpe.safe_pieces(text, 3) for i in whole(p)] == whole(text)


def test_any_bytes_decode(spark):
    ids = np.array([0, 1, 200], "<u4").tobytes()
    df = spark.createDataFrame([(bytearray(ids),), (None,)], "ids binary")
    out = [bytes(r.b) for r in df.select(bpe.decode(F.col("ids"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN).alias("b")).collect()]
    assert len(out[0]) >= 3 and out[1] == b""


def check_op7(rows, out, tokenizer):
    start = 0
    want = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer(text)
        want.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_files(spark, sf_dir, documents, tokenizer):
    check_op7([(i, t) for i, t, _ in documents], op7_frames(spark, sf_dir).collect(), tokenizer)


def test_token_files_odd_rows(spark, odd_docs, folder, tokenizer):
    check_op7([(r.doc_id, r.text) for r in odd_docs.collect()], op7_frames(spark, folder(documents=odd_docs)).collect(), tokenizer)


def test_no_documents(spark, odd_docs, folder):
    empty = folder(documents=odd_docs.limit(0))
    assert op2_bpe(spark, empty).count() == 0 and op7_frames(spark, empty).count() == 0


def test_only_requested_frames_are_read_and_checksums_hold(spark, odd_docs):
    where = workspace.new_path(spark, "frames-test")
    index = frames.write(odd_docs.where("doc_id <= 9").coalesce(1), where, public_tokenizers.path(BPE_JSON), frame_ids=50)
    picked = frames.read(frames.starts(index).where("id = 9"), where).collect()
    assert [r.id for r in picked] == [9]
    system, root = frames._place(where)
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(root)):
        with system.open_input_file(info.path) as source:
            table = frames.read_seek_table(source, info.size)
            assert sum(e[1] for e in table) < info.size
            with pytest.raises(ValueError):
                frames.read_frame(source, (*table[0][:3], table[0][3] ^ 1))


@pytest.mark.parametrize("text", ["a b, c.\nNext line", "a\n\nb c", "\na b", "a b\n", "a  b", "one", "a\tb c d", "x,\ny. z", "don't 'tis\n'ere", "a \nb"])
def test_token_file_cuts(text, tokenizer):
    assert "".join(frames.pieces(frames.cut(text))) == text
    check_encoder(text, tokenizer)


def check_encoder(text, tokenizer):
    encode = frames.piece_encoder(public_tokenizers.path(BPE_JSON))
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer(text)[:-1] == np.frombuffer(encode(text), "<u4").tolist()


END = "<|endoftext|>"


@pytest.mark.parametrize("text", [END, f"a {END} b", f"{END}a b", f"a b{END}", f"{END}{END}", f"a{END}{END}\n\nb c {END} ", "<|endoftext", f"<|{END}|>", f"x\n{END}\ny z, x"])
def test_added_tokens_are_what_the_library_makes_of_them(text, tokenizer):
    assert (50256 in tokenizer(text)) == (END in text)
    check_encoder(text, tokenizer)


def test_token_files_with_added_tokens(spark, folder, tokenizer):
    rows = [(1, f"a {END} b"), (2, END), (2, END), (3, None), (4, f"words {END}" * 3000), (5, f"{END} and the rest")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, frame int, file string, n long")
    check_op7(rows, op7_frames(spark, folder(documents=docs)).collect(), tokenizer)


def test_a_text_longer_than_a_frame(spark, tokenizer):
    where = workspace.new_path(spark, "frames-long")
    docs = spark.createDataFrame([(1, "a b c"), (2, "word " * 500), (3, "d")], "doc_id long, text string").coalesce(1)
    index = frames.write(docs, where, public_tokenizers.path(BPE_JSON), frame_ids=50)
    back = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in frames.read(frames.starts(index), where).collect()}
    assert back == {i: tokenizer(t) for i, t in [(1, "a b c"), (2, "word " * 500), (3, "d")]}


def test_token_files_remember_few_pieces(tokenizer, monkeypatch):
    """Groups of a few texts and generations of a few pieces give the library's ids."""
    monkeypatch.setattr(frames, "CACHE", 40)
    monkeypatch.setattr(frames, "GROUP_CHARS", 30)
    frames.encoder.cache_clear()
    words = ["a", "b,", "x\ny", "don't", "é!", "\n", "  ", "1st", " z", "中文", "##", END, "\x1c", "end."]
    draw = random.Random(7)
    texts = ["", *(" ".join(draw.choices(words, k=draw.randrange(1, 30))) for _ in range(300)), "", "last"]
    got = list(frames.encoder(public_tokenizers.path(BPE_JSON))(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer(x)[:-1] for x in texts]
    assert list(frames.encoder(public_tokenizers.path(BPE_JSON))([])) == []
    frames.encoder.cache_clear()


WHITE = " \n\t\r\x0b\x0c\x1c\x85\u00a0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000"


def test_token_file_cuts_at_odd_characters(tokenizer):
    """Keys encoded by themselves give the library's ids of the whole text."""
    draw = random.Random(11)
    parts = [*WHITE, *" \n" * 12, "a", "Don", "'s", "'re", "'", "’", ",", ".", "_", "&&&", "|", "1", "23", "é", "à", "ß", "Ġ", "«", "Â\u0085", "ა", "–", "中文", "か", "\u0301", "🙂", "\x00", "\x7f", "\u200b"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 40))) for _ in range(3000)]
    texts += [f"{x}{w}{y}{z}" for w in WHITE for x in ("", "a", "à", ".", " ") for y in " \n" for z in ("", "b", "à", "«", "か", ",", "\u2003")]
    texts += [x[::-1] for x in texts]
    assert all("".join(frames.pieces(frames.cut(x))) == x for x in texts)
    got = list(frames.encoder(public_tokenizers.path(BPE_JSON))(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer(x)[:-1] for x in texts]


def test_a_word_before_any_mark_is_encoded_once(tokenizer, monkeypatch):
    """the library gets a word once, whatever marks follow it and however small the groups are."""
    import tokenizers

    sent = 0

    class Counting:
        def __init__(self, made):
            object.__setattr__(self, "made", made)

        def __getattr__(self, name):
            return getattr(self.made, name)

        def __setattr__(self, name, value):
            setattr(self.made, name, value)

        def encode_batch_fast(self, texts, **kinds):
            nonlocal sent
            sent += sum(map(len, texts))
            return self.made.encode_batch_fast(texts, **kinds)

        @classmethod
        def from_file(cls, path):
            return cls(real.from_file(path))

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(frames, "GROUP_CHARS", 5000)
    frames.encoder.cache_clear()
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = ["".join(f" {w}{mark}" for w in words) for mark in ("", ",", ".", ";", "!", "&&&", ":", "?")]
    got = list(frames.encoder(public_tokenizers.path(BPE_JSON))(texts))
    frames.encoder.cache_clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer(x)[:-1] for x in texts]
    assert sent < 2 * sum(len(w) + 1 for w in words)


def test_texts_without_spaces_are_not_remembered(tokenizer):
    """A text that can't be cut is one key, which goes when its group is done."""
    import tracemalloc

    encode = frames.encoder(public_tokenizers.path(BPE_JSON))
    list(encode(["a", ""]))
    tracemalloc.start()
    for i in range(300):
        text = "中文" * 2000 + str(i)
        (got,) = encode([text])
        if i % 100 == 0:
            assert np.frombuffer(got, "<u4").tolist() == tokenizer(text)[:-1]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2e6


@pytest.mark.parametrize("texts", [[""], ["", ""], ["\n"], [" ", ""], ["a"], ["", "a", "\n", "b"]])
def test_few_or_empty_texts(texts, tokenizer):
    got = list(frames.encoder(public_tokenizers.path(BPE_JSON))(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer(x)[:-1] for x in texts]


def test_groups_of_texts_across_arrow_batches(spark, folder, tokenizer):
    """Each id keeps its text where a group takes in several batches."""
    rows = [(i or None, None if i % 5 == 1 else f"text {i % 90}, of\nrow {i}") for i in range(3 * workspace.BATCH_ROWS + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check_op7(rows, op7_frames(spark, folder(documents=docs)).collect(), tokenizer)
