"""State in parts: records of one layout, packed, many keys to a value of a map state.

A call to the state store costs a Python worker far more than the few bytes of one key, so a
processor keeps its keys in parts and reads and writes a part at a time. A batch reads the
parts its keys belong to, and as a group of the store grows its records are dealt over more parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

#: Rows of one group that are handled at once.
CHUNK = 200_000
#: Records a part has on average, at most.
FULL = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Parts:
    """Tables of records per group, dealt over parts by the ``keys`` that all of them have."""

    def __init__(self, handle: StatefulProcessorHandle, keys: list[str], **layouts: np.dtype):
        self.keys, self.layouts = keys, [*layouts.values()]
        self.parts = handle.getMapState("parts", "part int", ", ".join(f"{n} binary" for n in layouts))
        self.size = handle.getValueState("size", "parts int, records long")

    def _deal(self, table: np.ndarray, count: int) -> np.ndarray:
        mixed = np.zeros(len(table), np.uint64)
        for key in self.keys:
            mixed = (mixed ^ table[key].astype(np.uint64)) * _MIX
        return ((mixed >> np.uint64(32)) % np.uint64(count)).astype(np.int64)

    def _unpacked(self, value: tuple) -> list[np.ndarray]:
        return [np.frombuffer(v, layout) for v, layout in zip(value, self.layouts)]

    def _joined(self, values: list[tuple]) -> list[np.ndarray]:
        tables = [self._unpacked(v) for v in values]
        return [np.concatenate([np.zeros(0, layout), *(t[i] for t in tables)]) for i, layout in enumerate(self.layouts)]

    def read(self, came: np.ndarray) -> list[np.ndarray]:
        """All records of the parts that the keys of ``came`` belong to."""
        self.count, self.records = self.size.get() if self.size.exists() else (1, 0)
        touched = np.unique(self._deal(came, self.count))
        tables = self._joined([v for part in touched if (v := self.parts.getValue((int(part),)))])
        self.held = len(tables[0])
        return tables

    def write(self, *tables: np.ndarray) -> None:
        """What stands in place of the records that were just read."""
        count, records = self.count, self.records + len(tables[0]) - self.held
        while records > count * FULL:
            count *= 2
        dealt = [self._deal(t, self.count) for t in tables]
        if count > self.count:
            touched = {int(p) for p in np.unique(dealt[0])}
            others = self._joined([v for (part,), v in list(self.parts.iterator()) if part not in touched])
            tables = tuple(np.concatenate(pair) for pair in zip(others, tables))
            self.parts.clear()
            dealt = [self._deal(t, count) for t in tables]
        for part in np.unique(dealt[0]):
            of_part = [t[d == part].tobytes() for t, d in zip(tables, dealt)]
            self.parts.updateValue((int(part),), tuple(of_part))
        self.size.update((count, records))

    def sift(self, keep) -> Iterator[list[np.ndarray]]:
        """Replace the tables of each part by what ``keep`` gives for them, and give the parts that are left."""
        records = 0
        for (part,), value in list(self.parts.iterator()):
            tables = self._unpacked(value)
            left = keep(*tables)
            if not len(left[0]):
                self.parts.removeKey((part,))
                continue
            if len(left[0]) < len(tables[0]):
                self.parts.updateValue((part,), tuple(t.tobytes() for t in left))
            records += len(left[0])
            yield left
        if records:
            self.size.update((self.size.get()[0], records))
        else:
            self.clear()

    def clear(self) -> None:
        self.parts.clear()
        self.size.clear()


def chunks(frames: Iterator[pd.DataFrame], most: int = CHUNK) -> Iterator[pd.DataFrame]:
    """The same rows in the same order, in frames of about ``most``."""
    held, rows = [], 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= most:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def records(frame: pd.DataFrame, layout: np.dtype) -> np.ndarray:
    """Columns of whole numbers as records; fields that the frame lacks are 0."""
    out = np.zeros(len(frame), layout)
    for name in layout.names:
        if name in frame:
            out[name] = frame[name].astype(layout[name])
    return out


def begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where another key begins."""
    first = np.ones(len(sorted_keys[0]), bool)
    first[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in sorted_keys))
    return first


def ends(first: np.ndarray) -> np.ndarray:
    """True at the last of each run, given where runs begin."""
    return np.append(first[1:], True)[: len(first)]
