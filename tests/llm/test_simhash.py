import random

import xxhash

from tonguemap.llm import simhash
from tonguemap.llm.components import components


def brute_fingerprint(text, k=4):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(values):
    """Smallest index reachable, for each value of a list of fingerprints."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_tables_cover_every_difference():
    rng = random.Random(1)
    found = [m % (1 << 64) for m in simhash.masks(4)]
    assert len(found) == 31 and all(30 <= m.bit_count() <= 34 for m in found)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & m == 0 for m in found)


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(f"Wörd{rng.randrange(400)}" for _ in range(n)) for n in (2, 3, 4, 5, 60, 400, 3000)]
    texts = [None, "", " \n", "A b\x1fC\x85 d", *base, *base, base[-1].upper(), base[-1] + " tail", base[-2].replace(" ", "\n\t"), "x" * 200_000]
    texts += [" ".join(base[-2].split()[i:]) for i in range(1, 25)]
    docs = spark.createDataFrame([(i + 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    want = [brute_fingerprint(t) for t in texts]
    ids = brute_groups(want)
    got = {r.doc_id - 5: r for r in simhash.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, fp in enumerate(want):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == ids[i] + 5
    kept = simhash.one_of_each_group(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id - 5 for r in kept.collect()) == sorted(set(ids))
    assert simhash.digests(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, a), (None, None), (7, e), (8, e.upper()), (7, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.one_of_each_group(docs.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, c), (None, d), (None, None), (7, e)], key=str)


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:3]:  # dense clusters, so that buckets overflow, and chains of links
        v = centre
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
            values.add(v)
    values = sorted(values, key=signed)
    want = brute_groups(values)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for small in (2, 16, 1000):
        edges = simhash.links(fps, small=small)
        rows = edges.collect()
        assert all((r.a ^ r.b) % (1 << 64) and ((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in rows)
        got = {r.node: r.component for r in components(edges).collect()}
        assert [got.get(signed(v), signed(v)) for v in values] == [signed(values[i]) for i in want]


def test_no_rows_are_broadcast_for_their_files_size(spark, monkeypatch):
    """Spark takes exploded rows for as many bytes as they come from, and written rows for the bytes of their files."""
    staged = {}
    monkeypatch.setattr(simhash, "stage", lambda df, name: staged.setdefault(name, df))
    monkeypatch.setattr(simhash, "components", lambda edges: edges.selectExpr("a AS node", "b AS component"))
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('some words of text ', id % 9, ' and more') AS text")
    found = simhash.groups(docs)
    for df in (staged["buckets"], found):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert next(line for line in plan.splitlines() if "Join" in line).lstrip(" +-:").startswith("SortMergeJoin")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (500, 501), (501, 500), (502, 501)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500, 502: 500}
    assert components(df.limit(0)).count() == 0
