import itertools
import zlib

import numpy as np

from souklens.llm import quality as q


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    chains = [rng.normal(size=n) for n in (1, 4, 6, 2)]
    tie = rng.normal(size=(2, 2))
    good, log_z, pairs = q.forward_backward(chains, tie)
    for k, u in enumerate(chains):
        total, want, want_pairs = 0.0, np.zeros(len(u)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(u[i] for i in range(len(u)) if y[i]) + sum(tie[a, b] for a, b in zip(y, y[1:])))
            total += w
            want += w * np.array(y)
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w
        assert np.allclose(log_z[k], np.log(total))
        assert np.allclose(good[k], want / total)
        assert np.allclose(pairs[k], want_pairs / total)


def test_long_chains_stay_finite():
    good, log_z, _ = q.forward_backward([np.full(5000, 3.0), np.full(5000, -3.0)], np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(log_z).all() and good[0].min() > 0.99 and good[1].max() < 0.01


def test_features_of_odd_texts():
    for text in (b"", b"\n", b"\n\n\n", b"x", "é|!\n".encode(), b"A" * 100_000, b"same\n" * 50):
        x, w = q.line_features(text)
        assert x.shape == (text.count(b"\n") + 1, q.WIDTH) and np.isfinite(x).all() and (w > 0).all()


def test_held_out_accuracy(spark):
    """Fitted on a part of the labels of one table, held against the held-out ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in q.op10_line_field(spark, sf).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) >= 0.95


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    rows = [(k, ("WORDS!! " if k % 2 else "plain words of prose. ") * 10) for k in range(60)]
    labels = [(k, 1 - k % 2) for k in range(60)]
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    schema = "doc_id long, quality int"
    a, b = (q.fit_on_labels(docs(rows), spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.tie, b.tie)
    s = a.scores([t.encode() for _, t in rows])
    assert all((x > 0.5) == bool(y) for x, (_, y) in zip(s, labels))


def test_empty_null_contradicting_and_repeated(spark, docs):
    rows = [(1, None), (1, ""), (2, "a"), (None, "b"), (3, "c\n\nd")]
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, None, 0)], [(2, 0, 0), (2, 1, 0), (None, 1, 1), (77, 0, 0)]):
        field = q.fit_on_labels(docs(rows), spark.createDataFrame(labels, schema))
        got = q.score_quality(docs(rows), field).collect()
        assert len(got) == 5 and {round(r["score"], 9) for r in got} == {0.5}
    assert q.score_quality(docs([]), field).collect() == []
    kept = q.keep_good(docs(rows), field)
    assert kept.columns == docs(rows).columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs(rows).collect()), key=str)
    assert q.keep_good(docs(rows), field, threshold=0.6).collect() == []
