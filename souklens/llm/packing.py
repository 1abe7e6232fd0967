"""Sum-of-squares online packing of token sequences into windows (operator 7).

Each task packs the documents of its input partition as they come.  A level array holds, for each fill level, how many
open windows are filled so far; a document goes to the level (or to a new window) for which the sum of the squared counts
grows least, so no level collects many windows that wait for the same gap.  A document longer than a window first fills
whole windows; its rest is placed.

Open windows are closed at the end of the partition, or when ``OPEN_WINDOWS`` of them are open, which bounds memory: the
fullest are filled up with pieces of the emptiest, and what is left at last is cut into powers of two, which need no
padding.  So nothing is padded, and cuts touch only the documents of windows that were still open.

Defined cases: a null or empty text is the end id alone.  Repeated rows are packed one by one.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.text import chunks
from souklens.llm.tokens import END_ID, encoder

SIZE = 4096
OPEN_WINDOWS = 2_048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple  # (document, start, ids, tokens of the document)


class SumOfSquares:
    def __init__(self, size: int = SIZE, most_open: int = OPEN_WINDOWS):
        self.size, self.most_open, self.open_now = size, most_open, 0
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)

    def level_for(self, n: int) -> int:
        """The level whose window takes ``n`` more tokens; 0 is a new window."""
        c = self.levels
        cost = 2 * (c[n:] - c[:self.size + 1 - n]) + 2
        cost[-1] = 1 - 2 * c[self.size - n]
        cost[c[:self.size + 1 - n] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * c[n] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, document, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Take a document; give the windows that are full."""
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [(document, at, ids[at:at + self.size], total)]
            at += self.size
        n = total - at
        if not n:
            return
        level = self.level_for(n)
        window = []
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.open_now -= 1
        window.append((document, at, ids[at:].copy(), total))
        if level + n == self.size:
            yield window
            return
        self.windows[level + n].append(window)
        self.levels[level + n] += 1
        self.open_now += 1
        if self.open_now >= self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Empty all open windows into full windows and, at last, windows of powers of two."""
        left = [(level, w) for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.windows.clear()
        self.levels[:] = 0
        self.open_now = 0
        i, j = 0, len(left) - 1
        while i < j:
            level, window = left[i]
            while level < self.size and i < j:
                low, donor = left[j]
                document, start, ids, total = donor.pop()
                n = min(self.size - level, len(ids))
                window.append((document, start, ids[:n], total))
                if n < len(ids):
                    donor.append((document, start + n, ids[n:], total))
                level += n
                left[j] = (low - n, donor)
                if not donor:
                    j -= 1
            left[i] = (level, window)
            if level == self.size:
                yield window
                i += 1
        for level, window in left[i:j + 1]:
            if level == self.size:
                yield window
                continue
            for bit in range(self.size.bit_length(), -1, -1):
                want, part = level & (1 << bit), []
                while want:
                    document, start, ids, total = window.pop(0)
                    n = min(want, len(ids))
                    part.append((document, start, ids[:n], total))
                    if n < len(ids):
                        window.insert(0, (document, start + n, ids[n:], total))
                    want -= n
                if part:
                    yield part


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID,
         most_open: int = OPEN_WINDOWS) -> DataFrame:
    """The pieces of all documents: ids (little-endian u4) ``start`` to ``start + length`` of the document stand in
    sequence ``sequence_id`` from ``offset`` on.  Sequence ids are unique; the upper bits are the input partition's."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), SumOfSquares(size, most_open)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def put(window: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for document, start, ids, total in window:
                rows.append((document, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                   ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for part, texts in chunks(batches, "text", 1 << 20):
            ids, sizes = encode(texts)
            at = 0
            for d, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                own = np.empty(n + 1, np.uint32)
                own[:n], own[n] = ids[at:at + n], end_id
                at += n
                for window in packer.place(d, own):
                    put(window)
            yield batch()
        for window in packer.close():
            put(window)
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, PIECES)


def op7_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
