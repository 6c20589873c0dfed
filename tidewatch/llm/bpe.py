"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before the library sees them: a single space between two characters that are not
white space always begins a new match of a byte-level pre-tokenizer pattern (white space runs, optional leading spaces
and words can neither end after nor reach across it), so encoding the pieces gives the ids of the whole text. Ids are
held packed, as little-endian unsigned 32-bit integers, which is a quarter of a long array and hashes without a copy.

Defined cases: a null text is encoded as the empty text (no ids); a null id string decodes to empty bytes; repeated
rows give repeated rows; an empty table gives an empty table. Only the named columns are read, so others never clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workspace

#: Texts of more characters than this are cut into pieces of about this many.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker; it has no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces that join to text, cut before single spaces, each the shortest of at least `size` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, rank_file: str, pattern: str) -> bytes:
    """Packed ids of one text."""
    if not text:
        return b""
    encode = encoding(rank_file, pattern).encode_ordinary
    return b"".join(np.asarray(encode(piece), dtype="<u4").tobytes() for piece in safe_pieces(text))


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """Binary column of packed ids."""

    @F.pandas_udf(T.BinaryType())
    def packed_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encode_text(x, rank_file, pattern) for x in batch], dtype=object)

    return packed_ids(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """Binary column of the bytes that packed ids stand for; they need not be valid UTF-8."""

    @F.pandas_udf(T.BinaryType())
    def raw_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            decode_bytes = encoding(rank_file, pattern).decode_bytes
            yield pd.Series([decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch], dtype=object)

    return raw_bytes(ids)


def unpack(ids: Column) -> Column:
    """Packed ids as an array<int>, by an Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def as_array(batch: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", dtype="<u4").astype("i4") for x in batch], dtype=object)

    return as_array(ids)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = True) -> DataFrame:
    """(id, columns to keep, ids packed, n_tokens, exact: whether the ids decode to the text, decoded bytes if asked for)
    of every document. One narrow stage without a shuffle, and one Python worker a task for both directions."""
    workspace.small_batches(docs.sparkSession)
    passed = docs.select(id_col, *keep, F.col(text_col).alias(workspace.fresh(docs, "_text")))
    schema = T.StructType([*passed.schema.fields[:-1], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoding(rank_file, pattern).decode_bytes
        for batch in batches:
            ids, exact, whole = [], [], []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py() or ""
                ids.append(encode_text(text, rank_file, pattern))
                data = back(np.frombuffer(ids[-1], dtype="<u4").tolist())
                exact.append(data == text.encode("utf-8", "surrogatepass"))
                whole.append(data)
            made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(exact, pa.bool_())]
            made += [pa.array(whole, pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema.names)

    return passed.mapInArrow(task, schema)
