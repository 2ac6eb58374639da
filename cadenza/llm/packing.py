"""Packing documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its own input split as they stream by, so nothing is shuffled
and a task that is run again gives the same pieces.  A document's full windows are cut off its
front; its remainder goes to the open window whose choice minimises the sum over levels of
(number of open windows at that level) squared, tracked in an array indexed by level.  When the
split ends, the pieces of the emptiest windows are placed in the others by the same rule, now cut to the room
there, until one window is left; that one is cut at powers of two, which need no padding.  A task holds
the ids of its open windows, which are fewer than those of its split.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm.common import small_batches

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CAPACITY, END_ID = 2048, 1
SPECIAL = "<|endoftext|>"
CACHE = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Text -> little-endian unsigned 32-bit ids of the byte-level vocabulary.

    Space-separated chunks are encoded once and remembered.  That is the library's own result
    as long as no white space precedes a space and the special string does not occur; any other
    text is encoded whole.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.exact, self.chunks = Tokenizer.from_file(vocabulary), {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        if not chunk or chunk[-1].isspace() or SPECIAL in chunk:
            return None
        return self._ids(" " + chunk)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._ids(text)
        known = self.chunks
        found = list(map(known.get, rest))
        if None in found:
            if len(known) > CACHE:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = rest[i]
                    ids = known.get(chunk)
                    if ids is None:
                        ids = self._chunk(chunk)
                        if ids is None:  # white space before a space: not cut there
                            return self._ids(text)
                        known[chunk] = ids
                    found[i] = ids
        return self._ids(first) + b"".join(found)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, ranks: str) -> Encoder:
    key = (vocabulary, ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, ranks)
    return _encoders[key]


class Packer:
    """Sum-of-squares packing of one task's pieces.  A piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, base: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next, self.out = capacity, base, []
        self.count = np.zeros(capacity + 1, np.int64)  # open windows at each level
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.placed = self.last = 0  # tokens put by the rule, and those of the last, unfilled window

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, cap = len(ids) // 4, self.capacity
        full = total // cap
        for k in range(full):
            self.emit([(doc, k * cap, ids[4 * k * cap : 4 * (k + 1) * cap], total)])
        if total > full * cap:
            self.placed += total - full * cap
            self.place((doc, full * cap, ids[4 * full * cap :], total))

    def choice(self, s: int, cut: bool) -> int:
        """The level whose choice for ``s`` tokens makes the sum of squared counts smallest; equal choices: the fullest.

        Without ``cut`` the tokens stay together and may open a window (level 0); with it, levels with less room are
        filled with a part of them, and no window is opened.
        """
        cap, count = self.capacity, self.count
        levels = np.flatnonzero(count if cut else count[: cap - s + 1])  # level 0, a new window, is never counted
        # from level h to h+s: -2N(h)+1 +2N(h+s)+1, without the second half when the window fills
        after = np.minimum(levels + s, cap)
        change = np.where(after < cap, 2 * count[after] + 1, 0) - 2 * count[levels] + 1
        fresh = 2 * count[s] + 1 if s < cap else 0
        if len(levels) and (cut or change.min() <= fresh):
            return int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])
        return 0

    def pop(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, window: list[tuple], level: int) -> None:
        if level == self.capacity:
            self.emit(window)
        else:
            self.open[level].append(window)
            self.count[level] += 1

    def place(self, piece: tuple) -> None:
        s = len(piece[2]) // 4
        h = self.choice(s, False)
        self.put([*(self.pop(h) if h else []), piece], h + s)

    def close(self) -> None:
        """Pieces of the emptiest window go where the rule says, cut to the room there, until one window is left; that one is cut at powers of two."""
        while (at := np.flatnonzero(self.count)).size:
            given = self.pop(int(at[0]))
            if not self.count.any():
                self.cut_last(given)
                return
            while given and self.count.any():
                doc, start, ids, total = given.pop()
                h = self.choice(len(ids) // 4, True)
                room = 4 * (self.capacity - h)
                self.put([*self.pop(h), (doc, start, ids[:room], total)], h + len(ids[:room]) // 4)
                if len(ids) > room:
                    given.append((doc, start + room // 4, ids[room:], total))
            if given:  # all others are full
                self.put(given, sum(len(p[2]) for p in given) // 4)

    def cut_last(self, left: list[tuple]) -> None:
        have = self.last = sum(len(p[2]) for p in left) // 4
        while have:
            room = 1 << (have.bit_length() - 1)
            have -= room
            window = []
            while room:
                doc, start, ids, total = left.pop(0)
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    left.insert(0, (doc, start + take, ids[4 * take :], total))
                room -= take
            self.emit(window)

    def rows(self) -> pa.RecordBatch:
        cols, self.out = list(zip(*self.out)) or [()] * 7, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by END_ID; a null or empty text is that one id.  Every id lies in
    exactly one piece.  sequence_id holds the task's number in its upper bits, so sequences of different
    tasks never meet.  Ids may be null or repeat; other columns are not read.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, ranks), np.array([END_ID], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, capacity)
        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, (enc.encode(text) if text else b"") + end)
            yield packer.rows()
        packer.close()
        yield packer.rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
