"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 3).

1. Each input partition is put in random order by a local sort, without an exchange, and written once with its rows'
   partition and rank, so that every later step sees the same draw.  The key of this order and that of step 3 are hashes of
   the row's number under different names: independent of each other, and from partition to partition.
2. From the partitions' row counts alone the driver draws how many rows of each partition go to each shard: the
   multivariate hypergeometric law, which is what a uniform permutation of all rows induces.  Ranks are cut at the running
   totals of that row of the matrix, so every shard gets exactly its size.
3. Within a shard the rows are permuted again: a second random key orders them.  The key's upper part is a cell of
   bounded size, so no task orders a whole shard; a row's slot is its cell's first slot plus its rank in the cell.

All row work is DataFrame functions.  The matrix has one row for each input partition and one number for each shard.

Defined cases: null texts have size 1 and checksum 0.  Shards differ by one row at most, the first ones being larger.
Repeated rows are dealt one by one.  An empty table gives no rows.  All columns pass through; names used on the way avoid
those of the input.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souklens.llm.storage import cut, free_name, new_folder

SHARDS = 8
CELL_ROWS = 10_000
SEED = 7_919
MATRIX_LINES = 4_096            # of the matrix in one plan
BROADCAST_NUMBERS = 20_000_000  # of the matrix in a broadcast: 160 MB
_NEGLIGIBLE = 1e-18  # of the most likely value's weight; a double cannot hold the sum of what is below


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good: the weights around the most likely value by their ratios, then
    one uniform number among them."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up, w, k = [1.0], 1.0, mode
    while k < high and w > _NEGLIGIBLE:
        w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        up.append(w)
    down, w, k = [], 1.0, mode
    while k > low and w > _NEGLIGIBLE:
        w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        down.append(w)
    u = rng.random() * (sum(up) + sum(down))
    for value, weight in [*((mode + i, x) for i, x in enumerate(up)), *((mode - 1 - i, x) for i, x in enumerate(down))]:
        u -= weight
        if u < 0:
            return value
    return mode


def communication_matrix(rows: list[int], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """How many rows each partition sends to each shard; line sums are ``rows``, column sums are ``sizes``."""
    room, out = list(sizes), []
    for n in rows:
        rest, line = sum(room), []
        for k, size in enumerate(room):
            rest -= size
            x = hypergeometric(rng, size, rest, n)
            room[k] -= x
            n -= x
            line.append(x)
        out.append(line)
    return out


def draws(docs: DataFrame, seed: int, row: str, deal: str, slot: str) -> DataFrame:
    """``docs`` with a number for each row and two random keys: hashes of the row's number under two different names, so
    that neither a row's keys nor those of different partitions have anything to do with each other."""
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.withColumns({deal: F.xxhash64(row, F.lit(seed), F.lit("deal")), slot: F.xxhash64(row, F.lit(seed), F.lit("slot"))})


def _matrix_table(spark: SparkSession, lines: list[dict], part: str, cuts: str) -> DataFrame:
    """The matrix as a small table in the shared folder, written some thousand lines at a time, so that no plan holds it."""
    path = new_folder(spark, "shard-matrix")
    for at in range(0, max(1, len(lines)), MATRIX_LINES):
        text = F.lit(json.dumps(lines[at:at + MATRIX_LINES]))
        some = spark.range(1).select(F.explode(F.from_json(text, "array<struct<p:bigint,c:array<bigint>>>")).alias("x"))
        some.select(F.col("x.p").alias(part), F.col("x.c").alias(cuts)).write.mode("append").parquet(path)
    return spark.read.schema(f"`{part}` bigint, `{cuts}` array<bigint>").parquet(path)


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS,
                        shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` with its shard (0 to ``shards - 1``) and its slot there (gapless from 0)."""
    spark = docs.sparkSession
    row, place, deal, key, part, rank, cuts, cell, size, before = (free_name(docs, f"_llm_{x}") for x in (
        "row", "place", "deal", "key", "part", "rank", "cuts", "cell", "size", "before"))
    local = draws(docs, seed, row, deal, key).sortWithinPartitions(deal, row).withColumn(place, F.monotonically_increasing_id())
    fixed = cut(local.withColumn(part, F.shiftright(place, 33)).withColumn(rank, F.col(place).bitwiseAND((1 << 33) - 1)).drop(row, deal),
                "shard-input")
    counts = sorted((r[0], r[1]) for r in fixed.groupBy(part).count().collect())  # one number for each partition
    total = sum(n for _, n in counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, random.Random(seed))
    lines = [{"p": p, "c": [sum(line[:k + 1]) for k in range(shards)]} for (p, _), line in zip(counts, matrix)]
    table = _matrix_table(spark, lines, part, cuts)
    if len(lines) * shards <= BROADCAST_NUMBERS:  # as many numbers as partitions times shards
        table = F.broadcast(table)
    cells = max(1, -(-sizes[0] // cell_rows))
    dealt = (fixed.join(table, part)
             .withColumn(shard_col, F.size(F.filter(cuts, lambda c: c <= F.col(rank))))
             .withColumn(cell, F.floor(F.shiftrightunsigned(key, 11) / F.lit(2.0 ** 53) * cells).cast("int")))
    sized = dealt.groupBy(shard_col, cell).agg(F.count(F.lit(1)).alias(size))
    offsets = sized.select(shard_col, cell, (F.sum(size).over(Window.partitionBy(shard_col).orderBy(cell)) - F.col(size))
                           .alias(before))
    order = Window.partitionBy(shard_col, cell).orderBy(key, place)
    ranked = dealt.withColumn(rank, F.row_number().over(order)).join(offsets, [shard_col, cell])
    return ranked.select(*docs.columns, F.col(shard_col), (F.col(before) + F.col(rank) - 1).cast("long").alias(slot_col))


def op3_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                            F.lit(None).cast("int").alias("grown_shard"))
