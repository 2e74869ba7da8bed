import random

import numpy as np

from tonguemap.llm import embeddings


def brute(rows):
    """{row: (n_links, component)} by comparing all rows."""
    valid = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = {i: i for i in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = list(valid)
    for x, i in enumerate(keys):
        a = valid[i] / np.linalg.norm(valid[i])
        for j in keys[:x]:
            if len(valid[j]) == len(a) and float(a @ (valid[j] / np.linalg.norm(valid[j]))) >= 0.9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min(least[find(i)])) for i in range(len(rows))]


def vectors():
    rng = np.random.default_rng(1)
    random.seed(1)
    out = [rng.standard_normal(24) for _ in range(150)]
    for centre in list(out[:4]):  # close groups, one larger than a block
        out += [centre + 0.1 * rng.standard_normal(24) for _ in range(40)]
    out += [out[0] * 3, out[0], out[0], out[5] * 1e-8]
    rows = [[float(x) for x in v] for v in out] + [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.1], [-0.0, 5.0], [0.0, 5.0]]
    ids = random.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_links_and_components(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    want = sorted(brute(rows))
    for block in (16, 512):
        got = sorted(embeddings.near_duplicates(df, block=block, recall=0.9999).collect())
        assert [r.vec_id for r in got] == [w[0] for w in want]
        found, whole = sum(r.n_links for r in got), sum(w[1] for w in want)
        assert all(r.n_links <= w[1] for r, w in zip(got, want)) and found >= 0.999 * whole
        assert [r.component_id for r in got] == [w[2] for w in want]
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    default = embeddings.near_duplicates(df)
    assert sum(r.n_links for r in default.collect()) >= 0.95 * whole
    assert default.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    twice = embeddings.near_duplicates(df.where("vec_id = %d" % rows[0][0]).union(df.where("vec_id = %d" % rows[0][0]))).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(1, rows[0][0])] * 2


def test_tables():
    n = embeddings.tables_for(16, 0.9, 0.95)
    meet = (1 - np.arccos(0.9) / np.pi) ** 16
    assert 1 - (1 - meet) ** n >= 0.95 > 1 - (1 - meet) ** (n - 1)
    assert [embeddings.bits_for(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 10**9)] == [16, 16, 16, 17, 30]
