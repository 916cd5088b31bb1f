"""Token ids in length-delimited record files, with an offset index beside each.

A record is its length (8 bytes), the masked CRC-32C of these, the serialized sequence and its masked CRC-32C, all little
endian.  The sequence is an Example message (features ``doc_id`` and ``input_ids``, lists of 64-bit integers), so readers
of such files need nothing of ours.  The index holds an offset and a length (8 bytes each) for each record, so that
records can be read in any order.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import lists, new_path, sliced, written

#: Reflected polynomial of CRC-32C, and what masks a checksum.
CASTAGNOLI = 0x82F63B78
MASK = 0xA282EAD8

#: Bytes folded at once by the checksum's tables.
FOLD = 32

READ_BYTES = 1 << 20

#: Encodings that a worker keeps in each of two generations.
CACHED_WORDS = 300_000

#: A long text's words are encoded in stretches of about as many characters.
STRETCH = 1 << 20

# The steps of a tokenizer file that splitting words to pieces rests on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: How byte-level models show bytes: visible characters of Latin-1 as they are, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {byte: 256 + n for n, byte in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to a checksum from each of FOLD places, and the operator that moves a checksum by one byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CASTAGNOLI), one >> 1).astype(np.uint32)
    at = np.empty((FOLD, 256), np.uint32)
    at[FOLD - 1] = one
    for j in range(FOLD - 2, -1, -1):
        at[j] = one[at[j + 1] & 0xFF] ^ (at[j + 1] >> 8)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return at, one[bits & 0xFF] ^ (bits >> np.uint32(8))


CRC_AT, _BYTE_ON = _crc_tables()


class _Move:
    """A linear map of checksums, from the images of its 32 bits, as four tables of a byte each."""

    def __init__(self, images: np.ndarray) -> None:
        self.images = images
        self.tables = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            byte = self.tables[bit // 8]
            byte[(np.arange(256) >> (bit % 8)) & 1 == 1] ^= images[bit]

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][crc & 0xFF] ^ t[1][(crc >> 8) & 0xFF] ^ t[2][(crc >> 16) & 0xFF] ^ t[3][crc >> 24]

    def twice(self) -> _Move:
        return _Move(self(self.images))


_moves = [_Move(_BYTE_ON)]
for _ in range(FOLD.bit_length() - 1):
    _moves = [_moves[0].twice()]


def _move(level: int) -> _Move:
    """By FOLD * 2**level bytes."""
    while len(_moves) <= level:
        _moves.append(_moves[-1].twice())
    return _moves[level]


def crc32c(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each stretch of ``data``: all of them at once, blocks of FOLD bytes first, then pairs of blocks."""
    blocks = -(-lengths // FOLD)
    at = np.concatenate(([0], np.cumsum(blocks)))
    # leading zeros leave a checksum that begins at 0 as it is, so each stretch is filled up in front
    filled = np.zeros(int(at[-1]) * FOLD, np.uint8)
    for end, begin, length in zip((at[1:] * FOLD).tolist(), begins.tolist(), lengths.tolist(), strict=True):
        filled[end - length : end] = data[begin : begin + length]
    # a checksum that begins at all ones is one that begins at 0 over a text whose first four bytes are inverted
    begin = at[1:] * FOLD - lengths
    for k in range(4):
        filled[(begin + k)[lengths > k]] ^= 0xFF
    rows = filled.reshape(-1, FOLD)
    crc = np.zeros(len(rows), np.uint32)
    for j in range(FOLD):
        crc ^= CRC_AT[j].take(rows[:, j])
    level = 0
    while len(blocks) and blocks.max() > 1:
        halved = -(-blocks // 2)
        ends = np.cumsum(blocks)
        low = ends - blocks
        own = np.repeat(np.arange(len(blocks)), halved)
        order = np.arange(len(own)) - np.repeat(np.cumsum(halved) - halved, halved)
        right = ends[own] - 1 - 2 * (halved[own] - 1 - order)
        left = right - 1
        crc = crc[right] ^ np.where(left >= low[own], _move(level)(crc[np.maximum(left, 0)]), np.uint32(0))
        blocks, level = halved, level + 1
    out = np.zeros(len(lengths), np.uint32)
    out[lengths > 0] = crc
    # stretches of under four bytes leave ones that the inversion could not take in
    for row in np.flatnonzero(lengths < 4):
        one = np.uint32(0xFFFFFFFF)
        for byte in data[begins[row] : begins[row] + lengths[row]]:
            one = CRC_AT[FOLD - 1][(one ^ byte) & np.uint32(0xFF)] ^ (one >> np.uint32(8))
        out[row] = one
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def varint(value: int) -> bytes:
    value &= 2**64 - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def unpacked_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 0x80)
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        raise ValueError("a number ends within its bytes")
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - begins).max()) + 1 if len(ends) else 0):
        has = begins + k <= ends
        out[has] |= (data[(begins + k)[has]] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _feature(name: bytes, packed: bytes) -> bytes:
    """An entry of the features map: a name and a packed list of 64-bit integers."""
    return _field(1, _field(1, name) + _field(2, _field(3, _field(1, packed))))


def example(doc_id: int | None, packed_ids: bytes) -> bytes:
    """A serialized Example; a null id has no ``doc_id`` feature."""
    own = b"" if doc_id is None else _feature(b"doc_id", varint(doc_id))
    return _field(1, own + _feature(b"input_ids", packed_ids))


def _fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of the length-delimited fields of a message."""
    while at < end:
        tag, at = _number(data, at)
        if tag & 7 != 2:
            raise ValueError(f"field {tag >> 3} is not length-delimited")
        size, at = _number(data, at)
        if at + size > end:
            raise ValueError("a field ends beyond its message")
        yield tag >> 3, at, at + size
        at += size


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def features(data: bytes, begin: int, end: int) -> dict[bytes, tuple[int, int]]:
    """Where the packed integers of each feature lie."""
    out = {}
    for _, a, b in _fields(data, begin, end):
        for _, c, d in _fields(data, a, b):
            entry = {number: (x, y) for number, x, y in _fields(data, c, d)}
            lo, hi = entry[2]
            for number, x, y in _fields(data, lo, hi):
                if number != 3:
                    raise ValueError("a feature is not a list of integers")
                out[data[entry[1][0] : entry[1][1]]] = next(((u, v) for _, u, v in _fields(data, x, y)), (x, x))
    return out


class _Known(dict):
    """Packed ids of words asked for lately; ``old`` has those of the generation before."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts word by word by a tokenizer file: white space parts tokens there and is dropped, so the ids of a text
    are those of its words in order.  A word's ids are kept as packed numbers, so a text's are its words' joined.

    A word of plain letters, digits and signs is split by the tokenizer's own pattern and its pieces go to the tokenizer's
    model, which knows nothing of what stands beside them; other words go through the whole tokenizer."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        #: Pieces are made only where the file says what they rest on.
        self.by_pieces = plain_specials and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER
        self.packed = [varint(number) for number in range(self.tokenizer.get_vocab_size())]
        self.words_known = _Known(self._word)
        self.pieces_known = _Known(self._piece)

    #: str.split also parts at these, which are no white space to tokenizers.
    _SEPARATORS = re.compile("[\x1c-\x1f]")
    _WORDS = re.compile(r"[^\x20\x09-\x0D]+")
    _GAP = re.compile(r"[\x20\x09-\x0D]")
    #: Characters that are composed already, that lower case keeps single, and that are letters wherever they are letters.
    _PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ȳ]+")
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ʯ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ʯ]+")

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        packed = self.packed
        return b"".join([packed[token.id] for token in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if self.by_pieces and ((word.isascii() and word.isprintable()) or self._PLAIN.fullmatch(word)):
            pieces = self._PIECES.findall(word.lower())
            return self.pieces_known[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces_known.__getitem__, pieces))
        return b"".join([self.packed[number] for number in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def words(self, text: str) -> list[str]:
        return self._WORDS.findall(text) if self._SEPARATORS.search(text) else text.split()

    def stretches(self, text: str) -> Iterator[str]:
        """A long text in parts that end at white space."""
        at = 0
        while len(text) - at > STRETCH:
            gap = self._GAP.search(text, at + STRETCH)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        own = b"".join(b"".join(map(self.words_known.__getitem__, self.words(part))) for part in self.stretches(text))
        self.words_known.age(CACHED_WORDS)
        self.pieces_known.age(CACHED_WORDS)
        return own


@lru_cache(2)
def encoder(path: str, plain_specials: bool) -> Encoder:
    return Encoder(path, plain_specials)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def framed(sequences: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Records of these sequences one after the other, and each one's length."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    heads = lengths.astype("<u8").view(np.uint8)
    head_sums = masked(crc32c(heads, np.arange(len(sequences)) * 8, np.full(len(sequences), 8)))
    sums = masked(crc32c(np.frombuffer(b"".join(sequences), np.uint8), np.cumsum(lengths) - lengths, lengths))
    out = b"".join(struct.pack("<QI", n, a) + s + struct.pack("<I", b) for n, a, s, b in zip(lengths.tolist(), head_sums.tolist(), sequences, sums.tolist(), strict=True))
    return out, lengths + 16


def _write(folder: str, path: str, plain_specials: bool, end_id: int):
    end = varint(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = TaskContext.get(), encoder(path, plain_specials)
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, root = open_folder(folder)
        data = index = None
        n = size = total = 0
        for batch in sliced(batches):
            packed = [own.encode(text.as_py() or "") + end for text in batch["text"]]
            ids = np.count_nonzero(np.frombuffer(b"".join(packed), np.uint8) < 0x80)
            records, lengths = framed([example(d, p) for d, p in zip(batch["doc_id"].to_pylist(), packed, strict=True)])
            if data is None:
                data, index = (files.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("tfrecord", "idx"))
            data.write(records)
            index.write(np.stack([size + np.cumsum(lengths) - lengths, lengths], 1).astype("<i8").tobytes())
            n, size, total = n + batch.num_rows, size + len(records), total + int(ids)
        if data is not None:
            data.close()
            index.close()
            yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int64()), "file": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64()), "ids": pa.array([total], pa.int64())})

    return run


def write_records(docs: DataFrame, path: str, end_id: int, folder: str | None = None, plain_specials: bool = True) -> DataFrame:
    """Encodes each text of ``docs`` (doc_id, text, anything more) with the tokenizers library and writes records in
    ascending doc_id order over all files; (folder, shard, file, records, bytes, ids, start) of the files written.

    ``path`` is a tokenizer file that every executor can open, one whose tokens hold no white space; ``end_id`` is appended
    to each document; ``start`` counts the ids of the files before.  With ``plain_specials`` the strings of special tokens
    are ordinary text.  A null text counts as empty: the end id alone.  Null doc_ids come first; rows of equal doc_id are
    ordered by a hash of their texts, and rows equal in both, which are alike, are dealt over as many files as they fill.
    A table without rows writes no file.

    Files lie in ``folder``, a URI that all executors can write, by default one in the session's shared folder.  There is a
    file for each of the session's shuffle partitions, small ones merged.  A task writes under its attempt's own name, so
    an attempt that is lost leaves at most files that are not listed.  The list of files, one row each, is what one task
    sums up."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # the last key parts rows that are equal in all that counts
    dealt = rows.repartitionByRange(*keys, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*keys)
    listed = dealt.mapInArrow(_write(folder, path, plain_specials, end_id), "shard long, file string, records long, bytes long, ids long")
    listed = written(listed, "manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return listed.select(F.lit(folder).alias("folder"), "shard", "file", "records", "bytes", "ids", before.alias("start"))


def frames(data: bytes) -> list[tuple[int, int]]:
    """Places and sizes of the sequences of the whole records that ``data`` begins with."""
    out, at = [], 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + size > len(data):
            break
        out.append((at + 12, size))
        at += 16 + size
    return out


def verified(data: bytes, found: list[tuple[int, int]]) -> None:
    """Raises ValueError where a record's checksums are not those of its bytes."""
    body = np.frombuffer(data, np.uint8)
    begins, lengths = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    whole = np.frombuffer(b"".join(data[b - 4 : b] for b, _ in found), "<u4")
    ends = np.frombuffer(b"".join(data[b + n : b + n + 4] for b, n in found), "<u4")
    if (masked(crc32c(body, begins - 12, np.full(len(found), 8))) != whole).any():
        raise ValueError("checksum of a length")
    if (masked(crc32c(body, begins, lengths)) != ends).any():
        raise ValueError("checksum of a sequence")


def batches_of(stream) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Whole records of a file from its start to its end, verified; holds one block and the record that it ends in."""
    rest = b""
    while piece := stream.read(max(READ_BYTES, _missing(rest))):
        data = rest + piece
        found = frames(data)
        if found:
            verified(data, found)
            yield data, found
            last, size = found[-1]
            rest = data[last + size + 4 :]
        else:
            rest = data
        if len(rest) >= 12:
            _check_head(rest)
    if rest:
        raise ValueError("the file ends within a record")


def _check_head(data: bytes) -> None:
    """A length that is wrong would ask for as many bytes."""
    head = np.frombuffer(data, np.uint8, 8)
    if int(masked(crc32c(head, np.array([0]), np.array([8])))[0]) != int.from_bytes(data[8:12], "little"):
        raise ValueError("checksum of a length")


def _missing(rest: bytes) -> int:
    """Bytes that the record at the start of ``rest`` lacks."""
    return int.from_bytes(rest[:8], "little") + 16 - len(rest) if len(rest) >= 12 else 0


def _decoded(data: bytes, found: list[tuple[int, int]]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of documents, number of ids of each, all ids."""
    doc_ids, counts, parts = [], [], []
    for begin, size in found:
        own = features(data, begin, begin + size)
        a, b = own.get(b"doc_id", (0, 0))
        value = _number(data, a)[0] if b > a else None
        doc_ids.append(value if value is None or value < 2**63 else value - 2**64)
        parts.append(data[slice(*own[b"input_ids"])])
    body = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = np.concatenate(([0], np.cumsum(body < 0x80)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    return doc_ids, np.diff(counts[at]), unpacked_varints(body)


READ = "shard long, record long, doc_id long, start long, token_ids array<int>, ids_bytes binary"


def _rows(shard: int, first: int, start: int, data: bytes, found: list[tuple[int, int]], as_bytes: bool) -> tuple[pa.RecordBatch, int]:
    doc_ids, counts, ids = _decoded(data, found)
    starts = start + np.cumsum(counts) - counts
    n = len(found)
    if as_bytes:
        at = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int32)
        own = pa.nulls(n, pa.list_(pa.int32())), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4").tobytes())])
    else:
        own = lists(ids.astype(np.int32), counts, pa.int32()), pa.nulls(n, pa.binary())
    columns = [pa.array(np.full(n, shard)), pa.array(np.arange(first, first + n)), pa.array(doc_ids, pa.int64()), pa.array(starts), *own]
    return pa.record_batch(columns, names=["shard", "record", "doc_id", "start", "token_ids", "ids_bytes"]), int(counts.sum())


def _read(as_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, shard, file, start in zip(*(batch[k].to_pylist() for k in ("folder", "shard", "file", "start")), strict=True):
                files, root = open_folder(folder)
                record = 0
                with files.open_input_stream(f"{root}/{file}.tfrecord", compression=None) as stream:
                    for data, found in batches_of(stream):
                        rows, ids = _rows(shard, record, start, data, found, as_bytes)
                        yield rows
                        record, start = record + len(found), start + ids

    return run


def read_records(files: DataFrame, as_bytes: bool = False) -> DataFrame:
    """(shard, record, doc_id, start, token_ids, ids_bytes) of the records in the files that ``files`` (folder, shard, file,
    start) lists, each file read in one pass by a task of its own; ``start`` counts the ids of all records before.

    token_ids is an array, or null and ids_bytes has the ids as little-endian 32-bit numbers with ``as_bytes``.  What is
    not as its lengths and checksums say raises ValueError."""
    listed = files.select("folder", "shard", "file", "start")
    return listed.repartitionByRange(max(1, listed.count()), "shard").mapInArrow(_read(as_bytes), READ)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, shard, file in zip(*(batch[k].to_pylist() for k in ("folder", "shard", "file")), strict=True):
            files, root = open_folder(folder)
            with files.open_input_stream(f"{root}/{file}.idx", compression=None) as stream:
                first = 0
                while piece := stream.read(READ_BYTES):
                    places = np.frombuffer(piece, "<i8").reshape(-1, 2)
                    n = len(places)
                    yield pa.record_batch({"folder": pa.array([folder] * n), "file": pa.array([file] * n), "shard": pa.array(np.full(n, shard)), "record": pa.array(np.arange(first, first + n)), "offset": pa.array(places[:, 0]), "length": pa.array(places[:, 1])})
                    first += n


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records at their places, in the rows' order; a file is opened once for a batch and read from front to back."""
    for batch in batches:
        rows = list(zip(*(batch[k].to_pylist() for k in ("folder", "file", "shard", "record", "offset", "length")), strict=True))
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            found: list[bytes] = [b""] * len(some)
            by_file: dict[tuple[str, str], list[int]] = {}
            for k, row in enumerate(some):
                by_file.setdefault(row[:2], []).append(k)
            for (folder, file), own in by_file.items():
                files, root = open_folder(folder)
                with files.open_input_file(f"{root}/{file}.tfrecord") as opened:
                    for k in sorted(own, key=lambda k: some[k][4]):
                        found[k] = opened.read_at(some[k][5], some[k][4])
            for (*_, shard, record, _, length), data in zip(some, found, strict=True):
                if frames(data) != [(12, length - 16)]:
                    raise ValueError("the index does not lead to a record")
                verified(data, [(12, length - 16)])
                doc_ids, _, ids = _decoded(data, [(12, length - 16)])
                yield pa.record_batch({"shard": pa.array([shard]), "record": pa.array([record]), "doc_id": pa.array(doc_ids, pa.int64()), "token_ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})


def shuffled(files: DataFrame, seed: int) -> DataFrame:
    """(shard, record, doc_id, token_ids) of all records in an order that ``seed`` decides, read through the offset indexes:
    only places are sorted, each task seeks the records of its part of the order."""
    listed = files.select("folder", "shard", "file")
    places = listed.repartitionByRange(max(1, listed.count()), "shard").mapInArrow(_index, "folder string, file string, shard long, record long, offset long, length long")
    key = F.xxhash64(F.lit(seed), "shard", "record")
    ordered = places.repartitionByRange(key, "shard", "record").sortWithinPartitions(key, "shard", "record")
    return ordered.mapInArrow(_seek, "shard long, record long, doc_id long, token_ids array<int>")
