import numpy as np

from spindrift.llm import quality as Q


def brute_pool(network, text):
    """Strongest answer of each filter over all chunks, one by one."""
    data = [*text] + [Q.PAD] * (Q.WIDTH + Q.STRIDE)
    best = np.full(Q.FILTERS, -np.inf)
    kernel = network.filters.reshape(Q.WIDTH * Q.VECTOR, Q.FILTERS)
    for at in range(0, max(1, len(text)), Q.STRIDE):
        best = np.maximum(best, network.vectors[data[at : at + Q.WIDTH]].reshape(-1) @ kernel + network.bias)
    return best


def test_pool_covers_whole_texts(monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    network = Q.Network()
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 16, 17, 100, 333, 0, 2)]
    assert np.allclose(network.pooled(texts), [brute_pool(network, t) for t in texts], atol=1e-4)


def test_gradients():
    network = Q.Network()
    texts, labels, weights = [b"some text that is long enough", b"!!", b""], np.array([1, 0, 1], np.float32), np.array([1.0, 2.0, 1.0])

    def loss():
        z = np.maximum(np.array([brute_pool(network, t) for t in texts]), 0) @ network.weights + network.offset
        return float((weights * (np.log1p(np.exp(z)) - labels * z)).mean())

    for part, grad in zip(network.parts, network.gradients(texts, labels, weights), strict=True):
        for i in np.argsort(-np.abs(grad).reshape(-1))[:3]:
            spot = np.unravel_index(i, part.shape)
            old = part[spot]
            part[spot] = old + 1e-2
            up = loss()
            part[spot] = old - 1e-2
            down = loss()
            part[spot] = old
            assert abs((up - down) / 2e-2 - grad[spot]) < 0.05 * abs(grad[spot]) + 1e-3


def test_edge_rows(spark):
    texts = [None, "", "ok", "é" * 100000, "ok", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, SCORE string")
    for rows in ([], [(2, 1), (2, 1)], [(2, 1), (3, 0), (3, 0), (4, None), (None, 0), (77, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        model = Q.fit_quality(docs, labels, rounds=2)
        got = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
        assert got[0].score == got[1].score == got[5].score and got[2].score == got[4].score
        assert Q.keep_quality(docs, model).columns == docs.columns
        assert Q.score_quality(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op5_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality], [r.predicted for r in rows if not r.quality]
    assert len(rows) > 1000 and np.mean(good) > 0.97 and np.mean(bad) < 0.2
