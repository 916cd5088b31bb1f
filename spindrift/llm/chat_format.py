"""Chat formatting by columnar byte assembly.

A batch of turns becomes one preallocated byte buffer: numpy computes the length of every segment (header, escaped text,
footer), cumulative offsets, and the indices that scatter the bytes, so no string is built turn by turn.

Template of a turn: ``<|`` role ``|>`` line end, text, ``</s>`` line end.  Inside roles and texts a backslash follows each
of ``<``, ``[`` and ``\\``, so none of ``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``[INST]`` and ``[/INST]`` can stand in them,
and taking every such backslash out again gives the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import lists, utf8

OPEN, CLOSE, END = b"<|", b"|>\n", b"</s>\n"
MARKED = np.zeros(256, bool)
MARKED[[ord("<"), ord("["), ord("\\")]] = True
BACKSLASH = ord("\\")
#: Text that is assembled at a time; a longer conversation has a buffer of its own.
BUFFER_BYTES = 8 << 20


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A backslash after each marked byte, and the new offsets."""
    grown = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 + MARKED[data].astype(np.int64), out=grown[1:])
    out = np.full(int(grown[-1]), BACKSLASH, np.uint8)
    out[grown[:-1]] = data
    return out, grown[offsets]


def unescape(data: np.ndarray) -> np.ndarray:
    """Takes the inserted backslashes out: in a run of backslashes every other one, from the first if ``<`` or ``[`` stands
    before the run, else from the second."""
    slash = data == BACKSLASH
    if not slash.any():
        return data
    at = np.arange(len(data))
    run_start = np.maximum.accumulate(np.where(slash & ~np.concatenate(([False], slash[:-1])), at, -1))
    before = np.where(run_start > 0, data[np.maximum(run_start - 1, 0)], 0)
    after_marked = (run_start > 0) & ((before == ord("<")) | (before == ord("[")))
    inserted = slash & ((at - run_start) % 2 == np.where(after_marked, 0, 1))
    return data[~inserted]


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Scatters rows of bytes to their places."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, turn offsets, content starts, content ends) of all turns, one after the other."""
    role, role_at = escape(*utf8(roles))
    text, text_at = escape(*utf8(texts))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    lengths = len(OPEN) + role_n + len(CLOSE) + text_n + len(END)
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    begin = at[:-1] + len(OPEN) + role_n + len(CLOSE)
    for piece, where in ((OPEN, at[:-1]), (CLOSE, begin - len(CLOSE)), (END, begin + text_n)):
        for k, byte in enumerate(piece):
            out[where + k] = byte
    _put(out, at[:-1] + len(OPEN), role, role_at)
    _put(out, begin, text, text_at)
    return out, at, begin, begin + text_n


def _starts(rows: pa.Table) -> np.ndarray:
    """Rows at which a conversation begins; a null conv_id is one of its own."""
    ids, known = pc.fill_null(rows["conv_id"], 0).to_numpy(), pc.is_valid(rows["conv_id"]).to_numpy()
    new = np.ones(rows.num_rows, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(new)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation; one that goes on in the next batch is kept until it ends."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        first = _starts(rows)
        out, at, begin, end = assemble(rows["role"].combine_chunks(), rows["text"].combine_chunks())
        if len(out) >= 2**31:
            raise ValueError("a conversation is longer than a text can be")
        bounds = np.append(first, rows.num_rows)
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at[bounds]), pa.py_buffer(out))
        # places in code points: bytes that do not continue a character
        points = np.zeros(len(out) + 1, np.int64)
        np.cumsum((out & 0xC0) != 0x80, out=points[1:])
        loss = np.flatnonzero(pc.equal(rows["role"], "assistant").to_numpy())
        own = np.searchsorted(first, loss, "right") - 1
        spans = np.stack((points[begin[loss]], points[end[loss]]), 1) - points[at[first]][own][:, None]
        return pa.record_batch({"conv_id": rows["conv_id"].combine_chunks().take(pa.array(first)), "n_turns": pa.array(np.diff(bounds)), "text": text.cast(pa.string()), "loss_spans": lists(spans.ravel(), 2 * np.bincount(own, minlength=len(first)), pa.int64())})

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= BUFFER_BYTES:
            rows = pa.concat_tables(held).combine_chunks()
            cut = int(_starts(rows)[-1])
            if cut:
                yield done(rows.slice(0, cut))
            held, size = [rows.slice(cut)], 0
    if held:
        yield done(pa.concat_tables(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text, loss_spans) for each conversation of ``turns`` (conv_id, turn, role, text, anything more).

    Turns stand by turn, null first, equal ones by role and text.  A null text or role counts as empty.  loss_spans holds
    start, end, start, end, ... in code points of text: the contents of turns whose role is ``assistant``, escapes included.
    Rows with a null conv_id make one conversation.  A conversation is one text, so it is assembled by one task.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, "conv_id long, n_turns long, text string, loss_spans array<long>")


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    plain = lambda s: unescape(np.frombuffer(s.encode(), np.uint8)).tobytes().decode()
    for turn in text.split(END.decode())[:-1]:
        role, content = turn[len(OPEN) :].split(CLOSE.decode(), 1)
        out.append((plain(role), plain(content)))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch["text"], batch["loss_spans"], strict=True):
            text, spans = text.as_py(), spans.as_py()
            turns = parse(text)
            loss = "".join(unescape(np.frombuffer(text[s:e].encode(), np.uint8)).tobytes().decode() for s, e in zip(spans[0::2], spans[1::2], strict=True))
            cols["n_turns"].append(len(turns))
            cols["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            cols["loss_chars"].append(len(loss))
            cols["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            cols["formatted_chars"].append(len(text))
        yield pa.record_batch({"conv_id": batch["conv_id"], **{k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in cols.items()}})


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what is read from the formatted texts alone: turns as parsed, and the text under the loss spans."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
