"""Packing: sum-of-squares online packing of documents into fixed token windows.

Every task packs the documents of its own input split, in order, so nothing is shuffled and a retried task gives the
same rows. A document longer than the window is cut into full windows and a rest. A rest of ``s`` tokens goes to the
fill level ``h`` that minimises the sum of squares of the level array N (N[l]: the open windows filled to l):
opening a window changes the sum by 2 N[s] + 1, moving one from h to h+s by 2 (N[h+s] - N[h]) + 2, and completing
one by 1 - 2 N[h]. At the end of the split the open windows are completed by cutting the emptiest ones into the gaps
of the fullest, and the last one is cut at powers of two, where sequences need no padding.

Defined cases: a null or empty text is one piece of its closing token; repeated rows are packed each for itself;
other columns are passed over; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

#: Byte-level models write each byte as a character: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000
#: Words of plain letters, then marks. Texts with _WHOLE don't fall apart into words at white space as the tokenizer sees it.
_LETTERS_MARKS = re.compile("([a-zà-öø-ÿ]+)([.,;:!?*$%&#|]*)")
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")


class WordIds(dict):
    """Word -> its ids as little-endian bytes. What a full memory held stays behind it as ``older`` until the next time."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            low = word.lower()
            # The tokenizer lowers letters and splits them from marks; of these letters each is one code point in any case.
            m = _LETTERS_MARKS.fullmatch(low)
            if not m:
                got = self.whole(word)
            elif low != word or m[2]:
                got = self[m[1]] + (self._marks(m[2]) if m[2] else b"")
            else:
                got = self._piece(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got

    def _marks(self, run: str) -> bytes:
        if run not in self.runs and len(self.runs) < 10_000:
            self.runs[run] = self._piece(run)
        return self.runs.get(run) or self._piece(run)

    def _piece(self, run: str) -> bytes:
        """Ids of letters alone or marks alone: nothing is left to normalise or split, so the model takes them, byte for byte."""
        found = self.tokenizer.model.tokenize(run.encode().decode("latin-1").translate(_BYTE_CHARS))
        return np.array([t.id for t in found], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The tokenizer's ids of ``text``: it drops white space and never joins what stands on its two sides."""
        return self.whole(text) if _WHOLE.search(text) else b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Levels:
    """The level array: how many open windows are filled to each level, and which."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Places a piece of ``size`` < window tokens; returns a window that it completed."""
        n, w = self.count, self.window
        # Level h for every window that it may go to: 0 opens one, w - size completes one.
        cost = np.full(w - size + 1, np.iinfo(np.int64).max)
        used = np.flatnonzero(n[1 : w - size + 1]) + 1
        cost[0] = 2 * n[size] + 1
        if len(used):
            inner = used[used < w - size]
            cost[inner] = 2 * (n[inner + size] - n[inner]) + 2
            if used[-1] == w - size:
                cost[-1] = 1 - 2 * n[used[-1]]
        # Of equal changes the fullest level.
        h = len(cost) - 1 - int(cost[::-1].argmin())
        held = self._take(h) if h else []
        held.append((piece, size))
        if h + size == w:
            return held
        self.count[h + size] += 1
        self.open.setdefault(h + size, []).append(held)
        return None

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        return self.open[level].pop()

    def close(self) -> Iterator[list]:
        """Completes the open windows: the emptiest are cut into the gaps of the fullest."""
        left = [(level, held) for level in sorted(self.open, reverse=True) for held in self.open[level]]
        self.count[:], self.open = 0, {}
        first, last = 0, len(left) - 1
        while first < last:
            level, held = left[first]
            donor_level, donor = left[last]
            while level < self.window and donor:
                (doc, start), size = donor.pop()
                cut = min(size, self.window - level)
                held.append(((doc, start), cut))
                level, donor_level = level + cut, donor_level - cut
                if cut < size:
                    donor.append(((doc, start + cut), size - cut))
            if donor:
                left[last] = (donor_level, donor)
            else:
                last -= 1
            left[first] = (level, held)
            if level == self.window:
                first += 1
                yield held
        for level, held in left[first : last + 1]:
            # Cut at powers of two, largest first.
            while level:
                room = power = 1 << (level.bit_length() - 1)
                out = []
                while room:
                    (doc, start), size = held.pop()
                    cut = min(size, room)
                    out.append(((doc, start), cut))
                    if cut < size:
                        held.append(((doc, start + cut), size - cut))
                    room -= cut
                level -= power
                yield out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, levels = word_ids(tokenizer_path), Levels(window)
        base, made = TaskContext.get().partitionId() << 40, 0
        #: Ids of what lies in open windows, by the document's number in this split.
        ids: dict[int, tuple] = {}
        rows: list[tuple] = []

        def emit(held: list) -> None:
            nonlocal made
            at = 0
            for (doc, start), size in held:
                doc_id, tokens, text, first, waits = ids[doc]
                body = text[(start - first) * 4 : (start - first + size) * 4]
                rows.append((doc_id, start, size, zlib.crc32(body), tokens, base + made, at))
                at += size
                if waits == size:
                    del ids[doc]
                else:
                    ids[doc] = (doc_id, tokens, text, first, waits - size)
            made += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        number = 0
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body = words.encode(text or "") + end
                tokens = len(body) // 4
                full = tokens - tokens % window
                for start in range(0, full, window):
                    rows.append((doc_id, start, window, zlib.crc32(body[start * 4 : (start + window) * 4]), tokens, base + made, 0))
                    made += 1
                if full < tokens:
                    ids[number] = (doc_id, tokens, body[full * 4 :], full, tokens - full)
                    done = levels.place((number, full), tokens - full)
                    if done:
                        emit(done)
                number += 1
            if rows:
                yield flush()
        for held in levels.close():
            emit(held)
        if rows:
            yield flush()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
