"""Near-duplicate groups by MinHash (operator 2).

1. One pass over the texts: the distinct five-word shingles of each document (the whole sequence where it has fewer
   words), 128 minima of universal hashes (32 bits of a*x+b mod 2^64), 32 band keys of four minima, and a 128-bit
   fingerprint of the set.
2. Rows with equal sets form a class, with or without doc_id; classes are numbered and only they go on.  A class is
   represented by its smallest doc_id and, of rows that share it or have none, the smallest hash of the text.
3. Classes that share a band key are candidates.  First the signature of each one is held against those of the smallest
   classes of its keys, and its full set against the smallest of these that agrees.  Components of these links are found.
4. Keys whose classes are still in more than one component are searched in full, in blocks of bounded size: signatures
   first, then the full sets of the classes that agree with one of another component, whose common shingles are counted
   through the postings of the block.  A block gives its links as stars, so a bucket of thousands of near copies gives
   some rows each, and no link is lost to a cap.
5. Components by alternating large-star and small-star over both kinds of links.

A pair of similarity 0.75 shares no key in one of 2*10^5 cases, and passes the signature test (70 of 128 equal minima)
but for one of 10^7; at 0.85 both are below 10^-9.

Defined cases: null and empty texts have n_shingles 0 and are their own component.  Rows that share a doc_id are searched
one by one; their components are then reported as one (``keep_one_each`` keeps them apart).  A component is named by its smallest doc_id, and by null where all its rows have none; ``kept`` marks the rows
with that doc_id, so it is false for rows without one (``keep_one_each`` keeps one of them where no row has one).  Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.components import connected_components, stars
from souklens.llm.storage import cut, free_name, scratch
from souklens.llm.text import WordHashes, chunks, mix, shingle_sets

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
THRESHOLD = 75          # percent
SIGNATURE_LEAST = 70    # equal minima of 128 that a pair needs before its sets are compared
BLOCK = 1_500           # classes in one block of a bucket that is searched in full, and their shingles
BLOCK_SHINGLES = 1_000_000
SHARE = 200             # partners of one class that are confirmed in one group

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_BAND_SEED = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_P, _Q = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature (MINIMA x uint32) of each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate(sets)
    out, tmp = np.empty((MINIMA, len(sets)), np.uint64), np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k in range(MINIMA):
            np.multiply(flat, _A[k], out=tmp)
            np.add(tmp, _B[k], out=tmp)
            np.minimum.reduceat(tmp, starts, out=out[k])
    return np.ascontiguousarray((out >> np.uint64(32)).astype(np.uint32).T)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key (int64) for each band of each signature."""
    parts = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_BAND_SEED, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + parts[:, :, r], _P)
    return key.view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each non-empty set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1].astype(np.int64)
    flat = np.concatenate(sets)
    return tuple(np.add.reduceat(mix(flat, seed), starts).view(np.int64) for seed in (_P, _Q))


def _key() -> list:
    """doc_id and 128 bits of hash of the text: rows that agree in them are the same."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("h1"),
            F.xxhash64(F.lit(2), "text").alias("h2")]


FLAT = ["h1", "h2", "d", "no_id"]


def _flat(df: DataFrame) -> DataFrame:
    """doc_id as two columns without NULL, so that rows meet by plain equality and stay where the join put them."""
    return df.withColumns({"d": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, f1, f2, sig, bands) for each row; the last four are null where there are no words."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in chunks(batches, "text", 400_000):
            sets = shingle_sets(texts, hashes)
            n = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(n)
            f1, f2, sig, bands = ([None] * len(n) for _ in range(4))
            if len(has):
                full = [sets[i] for i in has]
                signatures = minima(full)
                for i, a, b, s, k in zip(has.tolist(), *(x.tolist() for x in fingerprints(full)), signatures,
                                         band_keys(signatures)):
                    f1[i], f2[i], sig[i], bands[i] = a, b, s.tobytes(), k
            yield pa.record_batch([*part.columns[:3], pa.array(n), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                                   pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                  ["doc_id", "h1", "h2", "n_shingles", "f1", "f2", "sig", "bands"])

    return docs.select(*_key(), "text").mapInArrow(
        make, "doc_id long, h1 long, h2 long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")


def _set_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    return shingle_sets([text], hashes)[0]


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def confirm_on_sets(texts: DataFrame) -> DataFrame:
    """(u, v) for each row v of ``texts(id, text, u, share, shares)`` whose full shingle set reaches the threshold with that
    of its partner u.  The rows of one u are dealt into ``shares`` groups (a column of u's own row), each of which gets a
    copy of u's text, so a u with thousands of partners is many groups, and each partner's text is moved once."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, kept = WordHashes(), None, None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a, b = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            good = []
            for x, y, s, t in zip(u, v, a, b):
                if s != last:
                    last, kept = s, _set_of(s or b"", hashes)
                good.append(_alike(kept, _set_of(t or b"", hashes)))
            rows = batch.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch([rows.column(0), rows.column(1)], ["u", "v"])

    partners = texts.filter("u is not null").select("u", "share", F.col("id").alias("v"), F.col("text").alias("tv"))
    centres = texts.filter("shares is not null").select(F.col("id").alias("u"), F.col("text").alias("tu"),
                                                        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return partners.join(centres, ["u", "share"]).select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long")


def _signatures_agree(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs with enough equal minima."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, MINIMA) for k in (2, 3))
            rows = batch.filter(pa.array((a == b).sum(1) >= SIGNATURE_LEAST))
            yield pa.record_batch([rows.column(0), rows.column(1)], ["u", "v"])

    both = (pairs.join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
            .join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u"))
    return both.select("u", "v", "su", "sv").mapInArrow(check, "u long, v long")


def _blocks(members: DataFrame) -> DataFrame:
    """The members of keys with more than one component, once for each pair (i, j) of blocks that their block is in.

    A key's blocks are bounded in members and in shingles, whatever the key's size; members are dealt by a hash."""
    sized = members.groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    dealt = members.join(sized.select("key", "blocks"), "key").withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")


def _with_partners(table: pa.Table) -> pa.Table:
    """The members of a block pair whose signature agrees with one of another component."""
    comp, block = (table.column(c).to_numpy() for c in ("component", "block"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, MINIMA)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = np.zeros(len(block), bool)
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        same = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(MINIMA):
            same += sig[rows, k][:, None] == sig[right, k][None, :]
        hit = (same >= SIGNATURE_LEAST) & (comp[rows][:, None] != comp[right][None, :])
        found[rows] |= hit.any(1)
        found[right] |= hit.any(0)
    return table.select(["key", "i", "j", "id", "component"]).filter(pa.array(found))


def _component_links(table: pa.Table) -> pa.Table:
    """Links between components of a block pair, confirmed on full sets.  The members' postings give the intersections of
    one set with all others at once; the links are reduced to stars."""
    hashes = WordHashes()
    sets = shingle_sets([t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], hashes)
    comp, size = table.column("component").to_numpy(), np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(place, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(place))])
    ends = np.cumsum(size)
    u, v = [], []
    for x in range(len(sets)):
        mine = place[ends[x] - size[x]:ends[x]]
        many = first[mine + 1] - first[mine]
        before = np.cumsum(many) - many
        both = np.bincount(owner[np.repeat(first[mine] - before, many) + np.arange(many.sum())], minlength=len(sets))
        good = np.flatnonzero((100 * both >= THRESHOLD * (size[x] + size - both)) & (comp != comp[x]))
        u.append(np.full(len(good), comp[x]))
        v.append(comp[good])
    nodes, least = stars(np.concatenate(u), np.concatenate(v))
    return pa.table({"u": nodes.astype(np.int64), "v": least.astype(np.int64)})


NAMED = ["n_shingles", "f1", "f2"]


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signature table, the classes (NAMED, id, component) and the components (component, least): ``least`` is the
    doc_id, h1 and h2 of the row that represents the component.  What is written on the way leaves the shared folder."""
    with scratch(docs.sparkSession) as s:
        return tuple(s.keep(df) for df in _search(docs))


def _search(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    table = cut(signature_table(docs), "minhash-signatures")
    narrow = table.select("doc_id", "h1", "h2", "n_shingles", "f1", "f2")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    rep = cut(table.filter("n_shingles > 0").groupBy(*NAMED).agg(
        F.min(least).alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    keys = rep.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(keys.join(shared.select("key", "first"), "key"), "minhash-buckets")
    some = cut(members.select("id").distinct(), "minhash-candidates")
    sigs = cut(rep.select("id", "sig").join(some, "id", "left_semi"), "minhash-candidate-signatures")
    star = members.filter("first < id").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    star = cut(_signatures_agree(star, sigs).groupBy("v").agg(F.min("u").alias("u")), "minhash-star")
    shares = star.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    partner = star.join(shares, "u").select(F.col("v").alias("id"), "u", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("share"))
    # Keys first, then each candidate's text once; rows alike in their key are one row before they are joined.
    want = (rep.select("id", F.col("least.doc_id").alias("doc_id"), F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2"))
            .join(some, "id", "left_semi").join(partner, "id", "left").join(shares.withColumnRenamed("u", "id"), "id", "left"))
    texts = cut(_flat(docs.select(*_key(), "text")).join(_flat(want).drop("doc_id"), FLAT).dropDuplicates(FLAT)
                .select("id", "text", "u", "share", "shares"), "minhash-candidate-texts")
    links = cut(confirm_on_sets(texts), "minhash-links")
    first = cut(connected_components(links), "minhash-components")
    of = some.join(first, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    spread = cut(members.select("key", "id", "n_shingles").join(of, "id"), "minhash-members")
    open_ = cut(_blocks(spread).join(sigs, "id").groupBy("key", "i", "j").applyInArrow(
        _with_partners, "key long, i int, j int, id long, component long"), "minhash-open")
    joined = cut(open_.join(texts.select("id", "text"), "id").groupBy("key", "i", "j").applyInArrow(_component_links, "u long, v long")
                 .filter("u <> v").distinct(), "minhash-more-links")
    second = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = of.join(second, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))
    classes = cut(rep.select(*NAMED, "id", "least").join(final.filter("id <> component"), "id", "left").select(
        *NAMED, "id", F.coalesce("component", "id").alias("component"), "least"), "minhash-merged")
    parts = cut(classes.groupBy("component").agg(F.min("least").alias("least")), "minhash-least")
    return narrow, classes.drop("least"), parts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    with scratch(docs.sparkSession) as s:
        return s.keep(_report(docs))


def _report(docs: DataFrame) -> DataFrame:
    table, classes, parts = _components(docs)
    worded = table.filter("n_shingles > 0").select("doc_id", *NAMED)
    # Components that hold different texts of one doc_id are one in the report.
    mark = F.xxhash64(*NAMED)
    repeated = (worded.filter("doc_id is not null").groupBy("doc_id")
                .agg(F.min(mark).alias("a"), F.max(mark).alias("b")).filter("a <> b").select("doc_id"))
    again = cut(worded.join(repeated, "doc_id", "left_semi").distinct().join(classes, NAMED).select("doc_id", "component"), "minhash-repeated-ids")
    links = again.join(again.groupBy("doc_id").agg(F.min("component").alias("v")), "doc_id").select(
        F.col("component").alias("u"), "v")
    top = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("top"))
    tops = parts.join(top, "component", "left").select("component", F.coalesce("top", "component").alias("top"), "least")
    first = cut(tops.groupBy("top").agg(F.min("least.doc_id").alias("component_id")), "minhash-names")
    names = tops.join(first, "top").select("component", "component_id")
    by_class = cut(classes.join(names, "component").select(*NAMED, "component_id"), "minhash-named")
    # Rows without words have no class and stay out of the join: they would all have the same key.
    out = worded.join(by_class, NAMED).select("doc_id", "n_shingles", "component_id").unionByName(
        table.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, all columns as they are, whether its rows have a doc_id or
    not.  Rows without words stay; of those that share doc_id and text one stays, and all that have no doc_id.  Columns of
    any name pass through.  What goes is decided by keys; the texts move once."""
    with scratch(docs.sparkSession) as s:
        table, _, parts = _components(docs)
        key = ["doc_id", "h1", "h2"]
        stays = _flat(parts.select("least.doc_id", "least.h1", "least.h2")).select(*FLAT)
        goes = s.keep(cut(_flat(table.filter("n_shingles > 0").select(*key).distinct()).select(*FLAT).join(stays, FLAT, "left_anti"),
                          "minhash-dropped"))
    own = {c: free_name(docs, f"_llm_{c}") for c in FLAT}
    _, h1, h2 = _key()
    i = F.col("doc_id").cast("long")
    keyed = docs.withColumns({own["h1"]: h1, own["h2"]: h2, own["d"]: F.coalesce(i, F.lit(0)), own["no_id"]: i.isNull()})
    # Rows with neither id nor words all stay; they would meet in one key.
    bare = F.col(own["no_id"]) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = keyed.filter(~bare).dropDuplicates(list(own.values()))
    kept = once.join(goes.select(*[F.col(c).alias(n) for c, n in own.items()]), list(own.values()), "left_anti")
    return kept.select(*docs.columns).unionByName(keyed.filter(bare).select(*docs.columns))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
