"""Near-duplicate vectors by int8 tile products with error bounds (operator 9).

1. Equal vectors of one label are one class with a multiplicity; only classes are compared, and only within a label.
2. The classes of a label are dealt into tiles of some 2,048 vectors.  A tile is one row: unit vectors in full precision,
   their int8 codes with a scale, and for each vector the exact length of its quantisation error.  Vectors whose components
   are single-precision numbers travel as such.
3. Each pair of tiles of a label is one bounded group, so a label with a third of all vectors is many groups.  The codes'
   product is an exact integer product at any length: at most 1,040 components are summed in single precision (sums below
   2^24), and these sums in double.  With x = s*q + r the cosine differs from the scaled
   product by at most |r_x| + |r_y| + |r_x||r_y|; only pairs that may reach the threshold within that bound are computed
   again in double precision.
4. A tile pair gives, for each class, the number of linked vectors, and a spanning star for each group that it sees, not
   the links one by one: thousands of near copies give a few rows each.  Components by large-star and small-star.

Defined cases: rows without vec_id or label, and vectors that are null, empty, zero or hold null or non-finite components,
link with nothing; the component of such a row is its own vec_id.  Vectors of different length never link.  vec_id is the
identity: rows that share one are one node.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.components import connected_components, stars
from souklens.llm.storage import cut

THRESHOLD = 0.98
TILE = 2_048
_SLACK = 1e-9  # rounding of the double sums, for every 2^16 components
EXACT = 1_040  # products of codes (127 * 127 at most) whose sum stays below 2^24


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the quantisation errors of unit vectors (rows)."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, codes_a, codes_b) -> tuple[np.ndarray, np.ndarray]:
    """All (row of a, row of b) of raw vectors with cosine >= threshold."""
    (qa, sa, ea), (qb, sb, eb) = codes_a, codes_b
    fb = np.ascontiguousarray(qb.T.astype(np.float32))
    slack = _SLACK * (1 + fb.shape[0] / (1 << 16))
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    rows, cols = [], []
    for at in range(0, len(a), 256):
        part = slice(at, at + 256)
        fa, near = qa[part].astype(np.float32), 0
        for c in range(0, fb.shape[0], EXACT):
            near = near + (fa[:, c:c + EXACT] @ fb[c:c + EXACT]).astype(np.float64)
        near = near * sa[part][:, None] * sb[None, :]
        bound = ea[part][:, None] + eb[None, :] + ea[part][:, None] * eb[None, :]
        i, j = np.nonzero(near + bound >= threshold - slack)
        i += at
        for k in range(0, len(i), 1 << 16):
            x, y = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            good = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold
            rows.append(x[good])
            cols.append(y[good])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows) if rows else none), (np.concatenate(cols) if cols else none)


def _usable():
    v = F.col("embedding")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & good
            & F.exists(v, lambda x: x != 0))


def single(values: np.ndarray) -> bool:
    """Whether single precision holds all values as they are."""
    with np.errstate(over="ignore"):
        return bool((values.astype(np.float32).astype(np.float64) == values).all())


def _finite_norm(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two so that squares neither overflow nor vanish; cosines stay as they are."""
    top = np.abs(vectors).max(1, keepdims=True)
    return np.ldexp(vectors, -np.frexp(top)[1])


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``."""
    wide = "array<double>"
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                              F.col("embedding").cast(wide).alias("embedding"))
               .withColumn("k1", F.when(_usable(), F.xxhash64("label", "embedding")))
               .withColumn("k2", F.when(F.col("k1").isNotNull(), F.xxhash64(F.lit(1), "embedding", "label"))), "vectors")
    ids = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = cut(rows.join(ids.withColumnRenamed("id", "vec_id"), ["k1", "k2", "vec_id"])
                  .select("k1", "k2", F.col("vec_id").alias("id"), "copies", "label", "embedding").dropDuplicates(["k1", "k2"])
                  .withColumn("dim", F.size("embedding")), "vector-classes")
    groups = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))

    def to_tile(table: pa.Table) -> pa.Table:
        raw = np.array(table.column("embedding").combine_chunks().flatten().to_numpy()).reshape(table.num_rows, -1)
        scaled = _finite_norm(raw)
        codes, scale, error = quantise(scaled / np.sqrt((scaled * scaled).sum(1))[:, None])
        one = {c: [table.column(c)[0].as_py()] for c in ("label", "dim", "tile", "tiles")}
        arrays = {"ids": table.column("id").to_numpy().astype("<i8"), "copies": table.column("copies").to_numpy().astype("<i8"),
                  "full": raw.astype("<f4" if single(raw) else "<f8"), "codes": codes, "scale": scale, "error": error}
        return pa.table({**one, **{k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in arrays.items()}})

    kind = dict(label="string", dim="long", tile="long", tiles="long")
    packed = dict(ids="binary", copies="binary", full="binary", codes="binary", scale="binary", error="binary")
    tiles = cut(classes.join(groups, ["label", "dim"])
                .withColumn("tile", F.pmod(F.xxhash64("id", F.lit(5)), F.col("tiles")).cast("int"))
                .select("id", "copies", "embedding", *kind).groupBy("label", "dim", "tile")
                .applyInArrow(to_tile, ", ".join(f"{k} {v}" for k, v in (kind | packed).items())), "vector-tiles")
    spread = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", *packed)

    def compare(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        opened = {}
        for r in table.to_pylist():
            opened[r["tile"]] = (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8"),
                                 _finite_norm(np.frombuffer(r["full"], f"<f{len(r['full']) * 8 // (len(r['ids']) * dim)}").astype(np.float64)
                                              .reshape(-1, dim)),
                                 (np.frombuffer(r["codes"], np.int8).reshape(-1, dim), np.frombuffer(r["scale"], "<f8"),
                                  np.frombuffer(r["error"], "<f8")))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i not in opened or j not in opened:  # a tile without vectors
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        (id_a, n_a, a, qa), (id_b, n_b, b, qb) = opened[i], opened[j]
        x, y = tile_links(a, b, threshold, qa, qb)
        x, y = (x[x < y], y[x < y]) if i == j else (x, y)
        u, v, count = np.concatenate([id_a[x], id_b[y]]), np.concatenate([id_b[y], id_a[x]]), np.concatenate([n_b[y], n_a[x]])
        nodes, least = stars(u, v)
        n = np.bincount(np.searchsorted(nodes, u), count, len(nodes))
        return pa.table({"u": nodes, "v": least, "n": n.astype(np.int64)})

    found = cut(spread.groupBy("label", "dim", "i", "j").applyInArrow(compare, "u long, v long, n long"), "vector-links")
    degree = found.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    groups_of = connected_components(found.select("u", "v"), "vector-components")
    by_class = (classes.select("k1", "k2", "id", "copies").join(degree, "id", "left")
                .join(groups_of.withColumnRenamed("node", "id"), "id", "left")
                .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "id").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    # Rows that link with nothing have no class and stay out of the join: they would all have the same key.
    linked = rows.filter("k1 is not null").select("vec_id", "k1", "k2").join(by_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("k1 is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
