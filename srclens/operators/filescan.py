"""Whole files as byte arrays: what the line scanners of both languages share.

A task gets its files in the order of their key. Files are cut into lines by
numpy, some megabytes of text at a time, and every running value of a file is
a running value of the array that starts anew where a file does. Files of one
key (a repeated or missing repo and path) are read as one: their lines in the
order of the line numbers, those of one number in the order of the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import patterns as P

#: Text bytes that are scanned at once (a longer run of files of one key is scanned whole).
CHUNK = 1 << 21
#: First bytes of the characters that are white space and neither a space, a tab nor a newline.
_ODD = np.isin(np.arange(256), [0x0B, 0x0C, 0x0D, *{c.encode()[0] for c in P.GO_SPACE_CHARS if ord(c) > 127}])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], more: list[str] = ()) -> Iterator[tuple[list[tuple], list[tuple], list[bytes]]]:
    """(keys, further columns, texts) of about CHUNK bytes of text; the files of one key come together."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for b in batches:
        names = zip(*(b.column(k).to_pylist() for k in keys))
        rest = zip(*(b.column(k).to_pylist() for k in more)) if more else iter(() for _ in range(len(b)))
        for key, other, text in zip(names, rest, b.column("content").cast(pa.large_binary()).to_pylist()):
            if size >= CHUNK and key != held[0][-1]:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (key, other, text)):
                column.append(value)
            size += len(text)
    if held[0]:
        yield held


class Lines:
    """The lines of several texts: ``a`` (all bytes, each text closed by a newline), ``start`` and ``end`` (without
    the newline) of every line in it, ``file`` (number of the text) and ``no`` (line number from 1)."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.a = np.frombuffer(self.raw + b"\n" * 8, np.uint8)
        self.end = np.flatnonzero(self.a[:len(self.raw)] == 10)
        self.start = np.append(0, self.end[:-1] + 1)
        n = np.array([t.count(b"\n") + 1 for t in texts])
        self.file = np.repeat(np.arange(len(texts)), n)
        self.first = np.cumsum(n) - n
        self.no = np.arange(len(self.end)) - self.first[self.file] + 1

    def lead(self) -> np.ndarray:
        """The first place of every line that holds neither a space nor a tab."""
        solid = np.flatnonzero((self.a != 32) & (self.a != 9))
        return solid[np.searchsorted(solid, self.start)]

    def indents(self) -> tuple[np.ndarray, np.ndarray]:
        """(indent, start of the trimmed text) of every line; a tab counts four."""
        at = self.lead()
        indent = at - self.start
        if (self.a == 9).any():
            tabs = np.append(0, np.cumsum(self.a == 9))
            indent = indent + 3 * (tabs[at] - tabs[self.start])
        for i in np.flatnonzero(_ODD[self.a[at]]).tolist():
            text = self.raw[self.start[i]:self.end[i]].decode("utf-8", "surrogateescape").lstrip(P.GO_SPACE_CHARS)
            at[i] = self.end[i] - len(text.encode("utf-8", "surrogateescape"))
        return indent, at

    def starting(self, at: np.ndarray, word: bytes) -> np.ndarray:
        """Whether a line's text starts with the word."""
        found = self.a[at] == word[0]
        some = np.flatnonzero(found)
        for k in range(1, len(word)):
            some = some[self.a[at[some] + k] == word[k]]
        found[:] = False
        found[some] = True
        return found & (at < self.end)


def words(a: np.ndarray, members: np.ndarray, wanted: list[str]) -> np.ndarray:
    """Starts of the wanted words (at most eight bytes each); members: the bytes that words are made of."""
    inside = members[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    codes = [int.from_bytes(w.encode(), "little") for w in wanted]
    likely = np.isin(np.arange(256), [w.encode()[0] for w in wanted])
    some = (size <= max(map(len, wanted))) & (size >= min(map(len, wanted))) & likely[a[start]]
    start, size = start[some], size[some]
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)[np.minimum(start, len(a) - 8)]).view("<u8")[:, 0] if len(start) else np.zeros(0, np.uint64)
    eight = eight & ((np.uint64(1) << (size * 8).astype(np.uint64)) - np.uint64(1))
    return start[np.isin(eight, np.array(codes, np.uint64))]


def in_order(run: np.ndarray, no: np.ndarray) -> np.ndarray | None:
    """The order by run and line number, lines of one number as they are; None where they lie in it."""
    key = run * (int(no.max(initial=0)) + 1) + no
    return None if (key[1:] > key[:-1]).all() else np.argsort(key, kind="stable")


def run_numbers(keys: list[tuple]) -> np.ndarray:
    """The number of each file's key."""
    new = [0] + [int(keys[i] != keys[i - 1]) for i in range(1, len(keys))]
    return np.cumsum(new)


def segments(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment of every row, first row of every segment), given whether a row starts one."""
    return np.cumsum(starts) - 1, np.flatnonzero(starts)
