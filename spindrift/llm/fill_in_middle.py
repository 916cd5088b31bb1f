"""Fill-in-the-middle: a text's prefix, suffix and middle in another order, between sentinels.

One table over (state, class of byte) is the whole scanner: it knows UTF-8 continuation bytes, where a unit ends and how
much of a sentinel has been seen.  Its states depend on the last few bytes alone, so the state before each byte of a
slice is had by folding those bytes through the table, for all places at once.  The first pass emits what each
transition counts (a code point, a unit's end, a sentinel) and the counts decide the cuts; the second pass looks up only
where the cut units end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import all_but_text, sliced, utf8

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: What a transition counts.
CHAR, UNIT, SENTINEL = 1, 2, 4

#: Bytes scanned at once.
BLOCK = 1 << 20


class Scanner:
    """The table: ``after[state * classes + class]`` is the next state, ``emits`` at the same place what is counted.

    A state is (sentinel bytes seen, whether a unit is open, continuation bytes to come).  Class ``end`` stands for the
    end of a text and leads back to state 0.  ``unit`` is "line" (up to and with its newline) or "char"."""

    def __init__(self, sentinels: tuple[str, ...], unit: str) -> None:
        if unit not in ("line", "char"):
            raise ValueError(f"no such unit: {unit}")
        marks = [s.encode() for s in sentinels]
        if not all(marks) or any(b >= 0x80 for m in marks for b in m):
            raise ValueError("sentinels must be ASCII and not empty")
        self.unit = unit
        own = sorted({b for m in marks for b in m} | {10})
        # continuation, leads of two, three and four bytes, other ASCII, then each byte that means something by itself
        self.class_of = np.full(256, 4, np.uint8)
        self.class_of[0x80:0xC0], self.class_of[0xC0:0xE0], self.class_of[0xE0:0xF0], self.class_of[0xF0:] = 0, 1, 2, 3
        for c, byte in enumerate(own, 5):
            self.class_of[byte] = c
        self.end, self.classes = 5 + len(own), 6 + len(own)
        heads = {m[:i] for m in marks for i in range(len(m))}  # what may have been seen of a sentinel

        def step(state: tuple[bytes, bool, int], c: int) -> tuple[tuple[bytes, bool, int], int]:
            seen, is_open, due = state
            if c == self.end:
                return (b"", False, 0), UNIT if is_open else 0
            if c == 0:
                due, counts, seen = max(0, due - 1), 0, b""
            else:
                due, counts = (c if c < 4 else 0), CHAR
                seen = seen + bytes([own[c - 5]]) if c >= 5 else b""
                if any(seen.endswith(m) for m in marks):
                    counts |= SENTINEL
                while seen not in heads:
                    seen = seen[1:]
            whole = due == 0 and (unit == "char" or (c >= 5 and own[c - 5] == 10))
            return (seen, not whole, due), counts | (UNIT if whole else 0)

        states, rows = [(b"", False, 0)], []
        for state in states:
            rows.append([step(state, c) for c in range(self.classes)])
            states += [to for to, _ in dict.fromkeys(rows[-1]) if to not in states]
        self.states = len(states)
        self.after = np.array([[states.index(to) for to, _ in row] for row in rows], np.uint16).ravel()
        self.emits = np.array([[counts for _, counts in row] for row in rows], np.uint8).ravel()
        self.memory = max(3, max(map(len, marks)))

    def settles(self) -> bool:
        """Whether any ``memory`` classes lead from all states to one."""
        return all(len({self.run(s, word) for s in range(self.states)}) == 1 for word in product(range(self.classes), repeat=self.memory))

    def run(self, state: int, word: tuple[int, ...]) -> int:
        for c in word:
            state = int(self.after[state * self.classes + c])
        return state

    def scan(self, classes: np.ndarray) -> np.ndarray:
        """What the transition at each place counts.  ``classes`` begins at the start of a text."""
        out = np.empty(len(classes), np.uint8)
        led = np.concatenate((np.full(self.memory, self.end, np.uint8), classes))
        for at in range(0, len(classes), BLOCK):
            size = min(BLOCK, len(classes) - at)
            state = np.zeros(size, np.uint16)
            for k in range(self.memory):
                state = self.after.take(state * np.uint16(self.classes) + led[at + k : at + k + size])
            out[at : at + size] = self.emits.take(state * np.uint16(self.classes) + classes[at : at + size])
        return out


@lru_cache(8)
def scanner(sentinels: tuple[str, ...], unit: str) -> Scanner:
    return Scanner(sentinels, unit)


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the document's id; a null id counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _cut(seed: int, percent: int, percent_spm: int, sentinels: tuple[str, ...], unit: str):
    p_mark, s_mark, m_mark = (s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scanner(sentinels, unit)
        for batch in sliced(batches):
            body, offsets = utf8(batch["text"])
            docs = batch.num_rows
            # first pass: a text's bytes, then the class of its end
            flags = table.scan(np.insert(table.class_of[body], offsets[1:], table.end))
            begins = offsets[:-1] + np.arange(docs)
            ends = offsets[1:] + np.arange(docs)
            units = np.flatnonzero(flags & UNIT)
            first = np.searchsorted(units, begins)
            n = np.searchsorted(units, ends, "right") - first
            odd = np.flatnonzero(flags & SENTINEL)
            marked = np.searchsorted(odd, ends) > np.searchsorted(odd, begins)
            data, forms, prefix, middle, out = body.tobytes(), [], [], [], []
            for row, doc_id in enumerate(batch["doc_id"].to_pylist()):
                lo, hi = int(offsets[row]), int(offsets[row + 1])
                h1, h2, h3, h4 = draws(seed, doc_id)
                if lo == hi or marked[row] or h3 % 100 >= percent:
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    out.append(data[lo:hi])
                    continue
                a, b = sorted((h1 % (int(n[row]) + 1), h2 % (int(n[row]) + 1)))
                # second pass: where the cut units end, in bytes and in code points
                x, y = (lo if not k else min(int(units[first[row] + k - 1]) + 1 - row, hi) for k in (a, b))
                prefix.append(int(np.count_nonzero(flags[lo + row : x + row] & CHAR)))
                middle.append(int(np.count_nonzero(flags[x + row : y + row] & CHAR)))
                spm = h4 % 100 < percent_spm
                forms.append("spm" if spm else "psm")
                out.append(b"".join((s_mark, data[y:hi], p_mark, data[lo:x], m_mark, data[x:y]) if spm else (p_mark, data[lo:x], s_mark, data[y:hi], m_mark, data[x:y])))
            yield pa.record_batch({"row": batch["row"], "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(out, pa.binary()).cast(pa.string())})

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, percent_spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but text, if None) of ``docs`` (doc_id, text, anything more) with n (units), form, prefix_chars,
    middle_chars and output.

    Cuts and form follow from ``seed`` and doc_id alone, so equal rows give equal rows and reruns agree.  ``percent`` of
    the texts are transformed, ``percent_spm`` of these with the suffix first.  A text that is empty or null, or holds a
    sentinel, stays plain: its output is the text (empty for null), prefix_chars and middle_chars are null.  A null
    doc_id counts as an empty one.  An incoming column named like an added one is replaced."""
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in added and (keep is not None or c != "text")]
    packed = docs.select(all_but_text(names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = packed.mapInArrow(_cut(seed, percent, percent_spm, tuple(sentinels), unit), f"row {packed.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), *added)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from output and form alone."""
    parts = F.split(output, "|".join("".join(c if c.isalnum() else f"\\{c}" for c in s) for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
