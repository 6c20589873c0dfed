"""Token-id files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds little-endian unsigned 32-bit ids. Documents are grouped into frames of about FRAME_IDS ids; each frame is
a complete zstandard frame, so any standard tool can decompress the file, and a reader can start at any frame. The file
ends in a seek table as a skippable frame of the public seekable format: one entry per frame (compressed size,
decompressed size, low 32 bits of xxh64 of the decompressed bytes), then the number of frames, a descriptor byte and
the magic number.

Writing is one range partitioning by id and one pass. A task writes to a name of its own attempt and reports the name
with an index row per document; the index is committed as Parquet by Spark, so only files of finished tasks are named
in it, and the file of a lost or repeated attempt is never read. Readers get the index rows of a frame together, read
the seek table and that frame only, and check its checksum.

Texts are encoded as the library does without adding special tokens: an added token of the vocabulary that stands in a
text is its one id there, and parts a text into pieces that are encoded by themselves.

Defined cases: a null text is an empty document (the end id only); ids that repeat keep one row each, in the order of
hashes of text; null ids come first; a text longer than a frame fills a frame of its own, however long, and a frame may
so be larger than FRAME_IDS by its last text; an empty table gives no files and an empty result; other columns than id
and text are not read, so they never clash.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import workspace

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
CHECKSUMS = 0x80  # descriptor: entries have checksums
FRAME_IDS = 1 << 16
#: Keys that a worker remembers, in two generations, and the bytes of the longest one; together they bound its memory.
CACHE, KEY_BYTES = 1_000_000, 64
#: Characters of texts that are encoded together, the last text whole.
GROUP_CHARS = 1 << 20
SPACE = "\u0120"  # fixed value: how a byte-level vocabulary writes the byte 0x20
_WHITE, _LETTER, _MARK, _LEAD = np.zeros((4, 256), bool)  # of bytes
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LETTER[[x for x in range(128) if chr(x).isalpha()]] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True
#: White space of two and three bytes, and the bytes that it begins with.
_WHITE_2, _WHITE_3 = (
    np.array([int.from_bytes(x.encode()) for x in row], np.int32)
    for row in ("\x85\u00a0", "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, the first and last aside, where the pre-tokenizer begins a new match whatever surrounds them:
    before a single space or line feed between characters that aren't white space, and before an ASCII mark other than an
    apostrophe that follows an ASCII letter."""

    def wide(at: np.ndarray) -> np.ndarray:
        """Whether white space of two or three bytes begins there; beyond the end are zeros."""
        a, b, c = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int32) for k in range(3))
        return np.isin(a << 8 | b, _WHITE_2) | np.isin(a << 16 | b << 8 | c, _WHITE_3)

    at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    at = at[~(_WHITE[data[at - 1]] | _WHITE[data[at + 1]])]
    bad = np.zeros(len(at), bool)
    after = np.flatnonzero(_LEAD[data[at + 1]])
    bad[after] = wide(at[after] + 1)
    before = np.flatnonzero(data[at - 1] >= 128)
    for k in (2, 3):  # where no character begins k bytes before, there is a continuation byte, which begins no white space
        bad[before] |= wide(np.maximum(at[before] - k, 0))
    marks = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
    return np.concatenate([at[~bad], marks])


def cut(text: str) -> list[str]:
    """The keys of a text: what lies between its cuts."""
    data = text.encode()
    at = [0, *np.sort(cuts(np.frombuffer(data, np.uint8))).tolist(), len(data)]
    return [data[i:j].decode() for i, j in zip(at, at[1:])]


def pieces(keys: list[str]) -> list[str]:
    """The keys that `cut` gave, a line feed before a word as a piece of its own."""
    return [p for x in keys for p in (("\n", x[1:]) if x[:1] == "\n" and x[1:] else (x,))]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[Iterable[str]], Iterator[bytes]]:
    """texts -> packed ids of each, by the tokenizers library. Texts are cut where a byte-level pre-tokenizer always
    begins a new match, and the ids of each short key between cuts are remembered: words repeat, so most are encoded once.
    New keys of about GROUP_CHARS characters of text are encoded together."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    plain = not any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
    # longest first, as the library matches; with tokens that take in or ask for what surrounds them, whole texts are encoded
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added and plain else None
    own = {x: struct.pack("<I", i) for x, i in added.items()}
    # what is encoded between added tokens holds none, and looking for them there again costs a third of the time
    tokenizer.encode_special_tokens = plain
    spaced = np.zeros(tokenizer.get_vocab_size(), bool)
    spaced[[i for x, i in tokenizer.get_vocab().items() if x[0] == SPACE]] = True
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def packed(texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    (line_end,) = packed(["\n"])
    (end_id,) = struct.unpack("<I", line_end)

    def row_of(text: str) -> np.ndarray:
        (row,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(row.ids, "<u4")

    def sliced(row: np.ndarray, begins: list[int]) -> Iterator[bytes]:
        data = row.tobytes()
        return (data[4 * i : 4 * j] for i, j in zip(begins, [*begins[1:], len(row)], strict=True))

    def one_word(x: bytes) -> bool:
        text = x.decode()
        return text.split() == [text[1:]]

    def learn(new: list[bytes]) -> dict[bytes, bytes]:
        """Words without white space inside are encoded in one call: those after a space in a row, where an id that begins
        with a space begins a word, and those after a line feed in a row of their own, where it is an id of its own. Other
        keys are encoded one by one."""
        made: dict[bytes, bytes] = {}
        words, lined = ([x for x in new if x[0] == y] for y in b" \n")
        text = b"".join(words).decode()
        if text.split(" ")[1:] != text.split():  # some hold white space
            words = [x for x in words if one_word(x)]
            text = b"".join(words).decode()
        if words:
            row = row_of(text)
            made.update(zip(words, sliced(row, np.flatnonzero(spaced[row]).tolist()), strict=True))
        lined = [x for x in lined if one_word(x)]
        if lined:
            row = row_of(b"".join(lined).decode())
            made.update(zip(lined, sliced(row, np.flatnonzero(row == end_id).tolist()), strict=True))
        rest = [x for x in new if x not in made]
        made.update(zip(rest, packed([x.decode() for x in rest]), strict=True))
        return made

    def ids_of(keys: list[bytes]) -> list[bytes]:
        """ids of different keys. Of what was known, the keys met since the last change of generation stay."""
        nonlocal known, older
        new = [x for x in keys if x not in known]
        if new and 2 * (len(known) + len(new)) > CACHE:
            known, older, new = {}, known, keys
        known.update((x, older[x]) for x in new if x in older)
        made = learn([x for x in new if x not in known])
        known.update((x, ids) for x, ids in made.items() if len(x) <= KEY_BYTES)
        return [made[x] if x in made else known[x] for x in keys]

    def stretches(texts: list[str]) -> Iterator[bytes]:
        """ids of texts without added tokens. The texts' bytes, a line feed between, are cut into keys; different keys get
        their ids once, and Arrow lays these out in the order of the texts."""
        parts = [x.encode() for x in texts]
        data = b"\n".join(parts)
        sizes = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        mark = np.zeros(len(data) + 1, bool)
        mark[cuts(np.frombuffer(data, np.uint8))] = True
        mark[ends] = mark[ends - sizes] = True
        begins = np.flatnonzero(mark)
        keys = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
        made = pa.array(ids_of(keys.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(keys.indices)
        _, places, body = made.buffers()
        at = np.frombuffer(places, np.int64)
        for i, j in zip(*(at[np.searchsorted(begins, x)].tolist() for x in (ends - sizes, ends)), strict=True):
            yield body[i:j].to_pybytes() if j > i else b""

    def group(texts: list[str]) -> Iterator[bytes]:
        if added and parts is None:
            yield from packed(texts)
            return
        found = [parts.split(x) if parts and any(a in x for a in added) else [x] for x in texts]
        made = stretches([x for row in found for x in row[::2]])
        for row in found:
            yield b"".join([own[x] if i % 2 else next(made) for i, x in enumerate(row)])

    def ids(texts: Iterable[str]) -> Iterator[bytes]:
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from group(held)
                held, chars = [], 0
        yield from group(held)

    return ids


def piece_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """text -> packed ids."""
    return lambda text: next(encoder(vocabulary)([text]))


def _place(uri: str):
    """(file system, path) of a URI, in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed size, checksum) of each frame of an open file of `size` bytes."""
    source.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or not descriptor & CHECKSUMS:
        raise ValueError("the file doesn't end in a seek table with checksums")
    source.seek(size - 9 - 12 * n)
    at, out = 0, []
    for x in struct.iter_unpack("<III", source.read(12 * n)):
        out.append((at, *x))
        at += x[0]
    return out


def read_frame(source, entry: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    at, packed, plain, checksum = entry
    source.seek(at)
    data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain) if plain else b""
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"the frame at byte {at} doesn't match its checksum")
    return data


_INDEX = "id long, file string, frame int, at long, n long"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS, level: int = 3) -> DataFrame:
    """Writes token-id files in ascending order of id and returns their committed index: id, file (name within the
    folder; names sort as the ids do), frame, at (place of the first id in the frame), n (ids with the end id)."""
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark
        import xxhash
        import zstandard

        system, root = _place(folder)
        encode = encoder(vocabulary)
        name = f"{pyspark.TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.ids.zst"
        compressor = zstandard.ZstdCompressor(level=level)
        entries: list[tuple[int, int, int]] = []
        held: list[bytes] = []
        schema = pa.schema([("id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])
        rows: dict[str, list] = {k: [] for k in schema.names}
        out, at = None, 0

        def flush() -> pa.RecordBatch:
            """Writes the frame and gives the index rows of its documents."""
            nonlocal at
            plain = b"".join(held)
            packed = compressor.compress(plain)
            out.write(packed)
            entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            made = pa.RecordBatch.from_pydict(rows, schema=schema)
            held.clear()
            for x in rows.values():
                x.clear()
            at = 0
            return made

        keys: deque[int | None] = deque()  # of the texts that are being encoded

        def texts() -> Iterator[str]:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    keys.append(key.as_py())
                    yield text.as_py() or ""

        for text_ids in encode(texts()):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            ids = text_ids + end
            for k, v in zip(rows, (keys.popleft(), name, len(entries), at, len(ids) // 4), strict=True):
                rows[k].append(v)
            held.append(ids)
            at += len(ids) // 4
            if at >= frame_ids:
                yield flush()
        if out is not None:
            if held:
                yield flush()
            out.write(seek_table(entries))
            out.close()

    workspace.small_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spread = F.xxhash64("text")  # rows that share an id are still dealt over partitions
    ordered = ordered.repartitionByRange("id", spread).sortWithinPartitions("id", spread)
    return workspace.materialize(ordered.mapInArrow(task, _INDEX), "token-index")


def starts(index: DataFrame) -> DataFrame:
    """The index with start: the ids of all documents before. Files are in order of id, so a total per file (a row a
    task) gives each file's first start, and a frame's place in its file the rest."""
    frames = index.groupBy("file", "frame").agg(F.sum("n").alias("ids"))
    files = frames.groupBy("file").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    frames = frames.withColumn("frame_start", F.coalesce(F.sum("ids").over(within), F.lit(0)))
    frames = frames.join(files, "file").select("file", "frame", (F.col("file_start") + F.col("frame_start")).alias("frame_start"))
    return index.join(frames, ["file", "frame"]).withColumn("start", F.col("frame_start") + F.col("at")).drop("frame_start")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids: packed bytes) of the documents in an index or in any part of one, from the files.
    Only the frames that hold a requested document are read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        name, source, table, held = None, None, [], (None, b"")
        for batch in batches:
            for x in batch.to_pylist():
                if x["file"] != name:
                    if source is not None:
                        source.close()
                    name, path = x["file"], f"{root}/{x['file']}"
                    source, held = system.open_input_file(path), (None, b"")
                    table = read_seek_table(source, system.get_file_info(path).size)
                if held[0] != x["frame"]:
                    held = (x["frame"], read_frame(source, table[x["frame"]]))
                docs = sorted(x["docs"], key=lambda d: d["at"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([d["id"] for d in docs], pa.int64()),
                        "start": pa.array([d["start"] for d in docs], pa.int64()),
                        "n_tokens": pa.array([d["n"] for d in docs], pa.int64()),
                        "ids": pa.array([held[1][4 * d["at"] : 4 * (d["at"] + d["n"])] for d in docs], pa.binary()),
                    }
                )
        if source is not None:
            source.close()

    # A frame holds at most FRAME_IDS documents, so the list of a frame is bounded.
    frames = index.groupBy("file", "frame").agg(F.collect_list(F.struct("id", "start", "at", "n")).alias("docs"))
    return frames.sortWithinPartitions("file", "frame").mapInArrow(task, "id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes the files of docs in the shared folder and reads every document back."""
    folder = workspace.new_path(spark, "token-files")
    return read(starts(write(docs, folder, vocabulary, end_id)), folder)
