"""Token files of directly addressable codes (operator 4).

An id is cut into chunks of eight bits.  Level 0 holds the lowest chunk of every id; a bitmap says which ids go on, and
their next chunks follow in level 1, and so on.  A rank directory (ones before every 512th bit) turns a place in one level
into the place in the next with one small count, so any token, or any range of tokens, is read without decoding the rest.

``write_tokens`` writes a table of segments in ascending order of doc_id: each row holds the ids of whole documents (about
``SEGMENT`` tokens; a longer document is a segment of its own), the documents' lengths, and the levels.  The rows' order,
and with it every document's first token, is fixed by (part, segment).  ``read_tokens`` reads the documents' ids back from
the files alone.  ``tokens_at`` reads single tokens: the files are not compressed and hold a page for each segment, whose
part and segment are in the page index, so a search for some segments reads their pages and no others, and in an opened
segment a token costs one chunk, one bit and one rank a level.

Defined cases: null and empty texts are the end id alone.  Rows with equal doc_id stand next to each other in no special
order, rows without doc_id come first.  A hot doc_id is spread over parts.  An empty table writes no segment.  Other
columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souklens.llm.storage import new_folder
from souklens.llm.text import chunks
from souklens.llm.tokens import END_ID, encoder

SEGMENT = 1 << 17
_STEP = 512  # bits between two entries of a rank directory


class Codes:
    """Directly addressable codes of a sequence of unsigned 32-bit numbers."""

    def __init__(self, data: bytes):
        levels, at = data[0], 1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<q", data, at)
            at += 8
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", n // _STEP + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    @staticmethod
    def encode(numbers: np.ndarray) -> bytes:
        rest, out = numbers.astype(np.uint32), []
        while True:
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            ones = np.concatenate([[0], np.cumsum(more)])[::_STEP].astype("<u4")
            ranks = ones[:len(rest) // _STEP + 1]
            out.append(struct.pack("<q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
            if not more.any():
                return bytes([len(out)]) + b"".join(out)
            rest = rest[more] >> 8

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, place: int) -> int:
        """The number of ids before ``place`` that go on to the next level."""
        _, bits, ranks = self.levels[level]
        block = place // _STEP
        head = bits[block * _STEP // 8:place // 8]
        ones = int(ranks[block]) + int(np.bitwise_count(head).sum())
        return ones + ((int(bits[place // 8]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else 0)

    def __getitem__(self, place: int) -> int:
        """One number, from one chunk, one bit and one rank in each level."""
        value = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[place]) << 8 * level
            if not bits[place // 8] >> place % 8 & 1:
                break
            place = self.rank(level, place)
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """The numbers from ``start`` to ``end`` (exclusive)."""
        out, where = np.zeros(end - start, np.uint32), None
        for level, (chunk, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            part = chunk[start:end].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            first = start // 8
            more = np.unpackbits(bits[first:-(-end // 8)], bitorder="little")[start - 8 * first:end - 8 * first].astype(bool)
            start, end = self.rank(level, start), self.rank(level, start) + int(more.sum())
            where = np.flatnonzero(more) if where is None else where[more]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 segment: int = SEGMENT) -> None:
    """Write the ids of all documents, each followed by ``end_id``, as a Parquet table of segments."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, sizes, parts, total, number = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal ids, sizes, parts, total, number
            made = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([Codes.encode(np.concatenate(parts))], pa.binary())],
                ["part", "segment", "n_tokens", "doc_ids", "sizes", "codes"])
            ids, sizes, parts, total, number = [], [], [], 0, number + 1
            return made

        for piece, texts in chunks(batches, "text", 1 << 20):
            flat, counts = ids_of(texts)
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            at = 0
            for d, n in zip(piece.column(0).to_pylist(), (counts + 1).tolist()):
                if total and total + n > segment:
                    yield row()
                ids.append(d)
                sizes.append(n)
                parts.append(flat[at:at + n])
                total += n
                at += n
        if ids:
            yield row()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id", F.rand(11)).sortWithinPartitions("doc_id"))
    made = ordered.mapInArrow(encode, "part int, segment int, n_tokens long, doc_ids array<long>, sizes array<long>, codes binary")
    made.write.option("compression", "uncompressed").option("parquet.page.row.count.limit", "1").parquet(path)


def _starts(table: DataFrame) -> DataFrame:
    """(part, segment, n_tokens, first): the ids of all segments before each one."""
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each written partition
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment")
    starts = table.select("part", "segment", "n_tokens").withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return starts.join(offsets, "part").select("part", "segment", "n_tokens", (F.col("before") + F.col("inside")).alias("first"))


def tokens_at(spark: SparkSession, path: str, places: DataFrame, pushed: int = 1_000) -> DataFrame:
    """(place, id) for each of ``places(place)`` among all ids of the files, counted from 0; places beyond them, null ones and
    repeated ones give no row of their own.  Where ``pushed`` segments at most are asked for, their numbers go to the scan,
    which then opens no other page."""
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                codes = Codes(row["codes"])
                yield pa.record_batch([pa.array([row["first"] + p for p in row["places"]], pa.int64()),
                                       pa.array([codes[p] for p in row["places"]], pa.int64())], ["place", "id"])

    table = spark.read.parquet(path)
    span = F.lit(SEGMENT)
    starts = _starts(table).withColumn("range", F.explode(F.sequence(
        F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("n_tokens") - 1) / span))))
    asked = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("range", F.floor(F.col("place") / span))
    found = (asked.join(starts, "range").filter("place >= first and place < first + n_tokens")
             .groupBy("part", "segment", "first").agg(F.sort_array(F.collect_list(F.col("place") - F.col("first"))).alias("places")))
    some = found.select("part", "segment").limit(pushed + 1).collect()
    wanted = table.select("part", "segment", "codes")
    if len(some) <= pushed:
        by_part: dict[int, list[int]] = {}
        for r in some:
            by_part.setdefault(r["part"], []).append(r["segment"])
        keep = F.lit(False)
        for part, segments in by_part.items():
            keep |= (F.col("part") == part) & F.col("segment").isin(*segments)
        wanted = wanted.filter(keep)
    return wanted.join(found, ["part", "segment"]).select("first", "codes", "places").mapInArrow(look_up, "place long, id long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ids as little-endian unsigned 32-bit numbers, ``start`` the ids
    of all documents before it."""
    table = spark.read.parquet(path)
    starts = _starts(table).drop("n_tokens")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                codes, sizes = Codes(row["codes"]), np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                every = codes.read(0, len(codes)).astype("<u4").tobytes()
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - sizes), pa.array(sizes),
                     pa.array([every[4 * (b - n):4 * b] for n, b in zip(sizes.tolist(), ends.tolist())],
                              pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return (table.select("part", "segment", "doc_ids", "sizes", "codes").join(starts, ["part", "segment"])
            .select("first", "doc_ids", "sizes", "codes")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary"))


def op4_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-codes")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
