import random

import numpy as np

from tonguemap.llm import suffixes


def repeats(docs, size):
    """{(doc, start)} of all runs of ``size`` words that another document has, by brute force."""
    seen = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for s in range(len(w) - size + 1):
            seen.setdefault(tuple(w[s : s + size]), set()).add((i, s))
    return {x for g in seen.values() if len({i for i, _ in g}) > 1 for x in g}


def corpus():
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(5000)}é"
    passages = [[word() for _ in range(n)] for n in (45, 49, 50, 51, 57, 80, 300)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(60))]
            if rng.random() < 0.5:
                w += rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    for i in range(200, 240):  # edited copies, so that many share parts of different lengths
        w = list(passages[-1])
        for _ in range(4):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, "same " * 300), (303, "x" * 100_000), (304, " ".join(word() for _ in range(30_000))), (305, docs[-1][1])]
    return docs


def test_passages(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")
    got = suffixes.repeated_passages(df.union(df.where("doc_id % 7 = 0"))).collect()
    covered = {}
    for r in got:
        assert r.n_words == r.end_word - r.start_word >= suffixes.CELL and r.other_doc_id != r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    must = repeats(docs, suffixes.MIN_WORDS)
    assert {i for i, _ in must} <= set(covered)
    for i, s in must:  # all of a passage but for the ends
        assert set(range(s + suffixes.STEP - 1, s + suffixes.MIN_WORDS - suffixes.STEP + 1)) <= covered[i]
    may = repeats(docs, suffixes.CELL)
    for i, words in covered.items():
        assert words <= {s + k for j, s in may if j == i for k in range(suffixes.CELL)}
    assert 302 not in covered  # repeats inside one document only
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def test_ends_are_exact(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    covered = {}
    for r in suffixes.repeated_passages(df).collect():
        assert r.n_words >= suffixes.MIN_WORDS
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = {}
    for i, s in repeats(docs, suffixes.MIN_WORDS):
        want.setdefault(i, set()).update(range(s, s + suffixes.MIN_WORDS))
    assert covered == want


def test_hashes_of_runs():
    rng = random.Random(16)
    w = [rng.choice("abc") for _ in range(400)]
    h = suffixes.Words(" ".join(w).encode()).hashes(np.arange(390), 10)
    runs = ["".join(w[i : i + 10]) for i in range(390)]
    assert len(set(h.tolist())) == len(set(runs)) and len(set(zip(runs, h.tolist()))) == len(set(runs))
