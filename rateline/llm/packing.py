"""Hierarchical packing of documents into token windows of several lengths.

Each task streams its rows through a buffer of bounded size. Whole windows of
the longest tier are cut from long documents at once; what remains of each is
routed to the shortest tier that holds it. The buffer is emptied longest first:
a piece opens a window of its tier, the gap is filled with the largest shorter
pieces that fit, and a last piece is cut to close it. Windows are then dealt to
step groups of about equal tokens, each with its share of every tier.

Windows are full, so none is padded. What is left at a task's end is cut into
windows of falling powers of two.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32 * 2048
BUFFER_TOKENS = 16 * STEP_TOKENS
END = 1
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of the public byte-level BPE, END after each text.

    The vocabulary is read by tiktoken, which gives the ids of the tokenizers
    library several times faster (held together by a test). Texts that contain
    the one special token's string go to that library itself.
    """

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(
            "byte_bpe_50k",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )
        self._json = public_tokenizers.path("byte_bpe_50k.json")
        self._exact = None

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _SPECIAL in text:
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._json)
            ids = np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self._fast.encode_to_numpy(text)
        return np.append(ids, np.uint32(END)).astype("<u4")


class Piece:
    """Ids ``start`` to ``start + len(ids)`` of one document; ordered by length."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def __lt__(self, other: Piece) -> bool:
        return len(self.ids) < len(other.ids)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.total),
            Piece(self.doc, self.start + at, self.ids[at:], self.total),
        )


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if t >= length)


def fill_windows(pool: list[Piece], tiers: tuple[int, ...]) -> Iterator[list[Piece]]:
    """Full windows from ``pool`` (sorted by length), which keeps what cannot fill one."""
    left = sum(map(len, pool))
    while pool and left >= tier_of(len(pool[-1]), tiers):
        window = [pool.pop()]
        gap = tier_of(len(window[0]), tiers) - len(window[0])
        while gap:
            place = bisect_right(pool, gap, key=len)
            if place:
                piece = pool.pop(place - 1)
            else:  # every piece is longer: the shortest is cut
                piece, rest = pool.pop(0).cut(gap)
                insort(pool, rest)
            window.append(piece)
            gap -= len(piece)
        left -= sum(map(len, window))
        yield window


def last_windows(pool: list[Piece], tiers: tuple[int, ...]) -> Iterator[list[Piece]]:
    """All of ``pool``, cut into windows of falling powers of two."""
    left, pool = sum(map(len, pool)), pool[::-1]
    while left:
        room = min(tiers[-1], 1 << (left.bit_length() - 1))
        left -= room
        window = []
        while room:
            piece = pool.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                pool.append(rest)
            window.append(piece)
            room -= len(piece)
        yield window


def balance(lengths: list[int], step_tokens: int) -> list[int]:
    """A step for each window: longest first, each to the step with fewest tokens so far."""
    steps = max(1, round(sum(lengths) / step_tokens))
    loads = [(0, s) for s in range(steps)]
    chosen = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, step = heapq.heappop(loads)
        chosen[i] = step
        heapq.heappush(loads, (load + lengths[i], step))
    return chosen


SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, step_id long"
)


def _emit(windows: list[list[Piece]], sequence: int, step: int, step_tokens: int):
    lengths = [sum(map(len, w)) for w in windows]
    steps = balance(lengths, step_tokens)
    rows = []
    for i, window in enumerate(windows):
        offset = 0
        for p in window:
            rows.append(
                (p.doc, p.start, len(p), p.ids.tobytes(), p.total)
                + (sequence + i, offset, lengths[i], step + steps[i])
            )
            offset += len(p)
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame, sequence + len(windows), step + max(steps, default=-1) + 1


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``; ``ids`` are little-endian 32-bit.

    A null or empty text is its END id alone. Rows with the same doc_id, or a
    null one, are packed each. sequence_id and step_id are unique over the
    output and the same when a task is run again. Other columns are left out.
    """
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder()
        sequence = step = TaskContext.get().partitionId() << 40
        pool: list[Piece] = []
        whole: list[list[Piece]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text)
                piece = Piece(None if pd.isna(doc) else int(doc), 0, ids, len(ids))
                held += len(ids)
                while len(piece) >= longest:
                    window, piece = piece.cut(longest)
                    whole.append([window])
                if len(piece):
                    pool.append(piece)
                if held >= buffer_tokens:
                    pool.sort()
                    frame, sequence, step = _emit(
                        whole + list(fill_windows(pool, tiers)), sequence, step, step_tokens
                    )
                    whole, held = [], sum(map(len, pool))
                    yield frame
        pool.sort()
        rest = whole + list(fill_windows(pool, tiers)) + list(last_windows(pool, tiers))
        if rest:
            yield _emit(rest, sequence, step, step_tokens)[0]

    return docs.select("doc_id", "text").mapInPandas(packed, SCHEMA)
