"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of its encoding.  The table of these last
tokens is filled from left to right: of the vocabulary's tokens that end at a place, the valid one is the one that
stands with the last token before it as the merges would leave them side by side.  An append only adds entries.  After
an edit, entries are made anew from the edit on until a stretch as long as the longest token is as it was before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import lists, sliced

#: Encodings of short pieces that a worker keeps in each of two generations; of token pairs, whether they stand.
CACHED_PIECES = 200_000
CACHED_BYTES = 48
CACHED_PAIRS = 300_000


class Vocabulary:
    """Ranks of a byte-level BPE, and of each token the two that its last merge joined."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        tails: dict[bytes, set[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._merged(token, rank)):
                self.halves[rank] = parts
                self.joined[parts] = rank
                if len(token) > 2:
                    tails.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end in three bytes, longest first.
        self.tails = {tail: tuple(sorted(found, reverse=True)) for tail, found in tails.items()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _merged(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens left of ``token`` by the merges of lower rank; None if they leave another number."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], below)) < below]
            if not found:
                return None
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        The merges inside both tokens are undone, latest first.  If at some moment the pieces at the border could
        have been joined by a merge that comes before the next one inside, the border would not have stood."""
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= CACHED_PAIRS:
                self.beside.clear()
            known = self.beside[left, right] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        # (merge undone last, whether the right token's): a border merge of lower rank comes before it, and one of equal
        # rank does so if it is further left
        bound: float = float("inf")
        while True:
            border = self.joined.get((left, right))
            if border is not None and border < bound:
                return False
            l, r = self.halves.get(left), self.halves.get(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and left > right):
                bound = left  # of equal merges the left one comes first
                left = l[1]
            else:
                bound = right + 0.5
                right = r[0]


class PrefixTable:
    """Last tokens of all prefixes of a byte string, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Encodes what is appended; what was there is not looked at again but for the longest token's length."""
        self.data += data
        self._fill(len(self.last), len(self.data))

    def _fill(self, start: int, end: int) -> None:
        v, data, last = self.vocabulary, self.data, self.last
        get, beside, halves, tails = v.ranks.get, v.beside, v.halves, v.tails.get
        for stop in range(start + 1, end + 1):
            # only lengths of tokens that end as the prefix does: 2 and 1 are always tried
            for length in (*tails(data[stop - 3 : stop], ()), 2, 1) if stop > 2 else (2, 1):
                if length > stop:
                    continue
                begin = stop - length
                token = get(data[begin:stop])
                if token is None or (length > 1 and token not in halves):
                    continue
                if not begin:
                    break
                stands = beside.get((last[begin - 1], token))
                if stands or (stands is None and v.stands(last[begin - 1], token)):
                    break
            else:
                raise ValueError(f"byte {data[stop - 1]:#x} is not in the vocabulary")
            last.append(token)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts ``data`` in place of data[start:end]; returns how many entries were made anew."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        alike = 0
        for i in range(start, len(self.data)):
            if i >= start + len(data) and alike >= self.vocabulary.longest:
                self.last += old[i - shift :]
                return i - start
            self._fill(i, i + 1)
            alike = alike + 1 if i >= start + len(data) and self.last[i] == old[i - shift] else 0
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Codec:
    """Splits texts by a pattern and encodes each match on its own, as a rank file's own library does.

    Pieces are kept as decimal ids joined by a space.  Those asked for lately move to the young generation; the old one
    goes as a whole when the young one is full."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self.said = {rank: str(rank) for rank in vocabulary.bytes}
        self.bytes = {self.said[rank]: token for rank, token in vocabulary.bytes.items()}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def piece(self, text: str) -> str:
        said = self.old.get(text)
        if said is None:
            data = text.encode("utf-8", "surrogatepass")
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                said = self.said[whole]
            else:
                said = " ".join(map(self.said.__getitem__, PrefixTable(self.vocabulary, data).tokens()))
                if len(data) > CACHED_BYTES:
                    return said
        if len(self.young) >= CACHED_PIECES:
            self.old, self.young = self.young, {}
        self.young[text] = said
        return said

    def joined(self, text: str) -> str:
        """Ids as decimals, joined by one space."""
        get, piece = self.young.get, self.piece
        said = []
        for match in self.split.findall(text):
            own = get(match)
            if own is None:
                own = piece(match)
                get = self.young.get  # a new generation may have begun
            said.append(own)
        return " ".join(said)

    def encode(self, text: str) -> list[str]:
        """Ids as decimals."""
        return self.joined(text).split()

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(Vocabulary.read(path), pattern)


def _coded(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in sliced(batches):
            n, ids_sha, decoded_sha, all_ids = np.zeros(batch.num_rows, np.int64), [], [], []
            for row, text in enumerate(batch["text"]):
                said = own.joined(text.as_py() or "")
                ids = said.split(" ") if said else []
                n[row] = len(ids)
                ids_sha.append(hashlib.sha256(said.encode("ascii")).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.fromiter(map(int, ids), np.int32, len(ids)))
            token_ids = lists(np.concatenate(all_ids), n, pa.int32()) if all_ids else pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.record_batch({"row": batch["row"], "n_tokens": pa.array(n), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string()), "token_ids": token_ids})

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` (all but text, if None) of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and token_ids.

    ``path`` is a rank file that every executor can open (an installed package's data file), ``pattern`` splits texts.
    Special tokens are not looked for.  ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    bytes that the ids decode to.  A null text counts as empty: no token, digests of nothing.  token_ids is null
    unless ``with_ids``.  An incoming column named like an added one is replaced.
    """
    added = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in added and (keep is not None or c != "text")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text"))
    out = packed.mapInArrow(_coded(path, pattern, with_ids), f"row {packed.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), *added)
