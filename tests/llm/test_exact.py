import hashlib
import random
import re

from tonguemap.llm import exact


def brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of each row."""
    groups = {}
    for n, (i, t) in enumerate(rows):
        text = re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "")
        groups.setdefault(text, []).append((i is None, i or 0, n, i))
    out = []
    for text, members in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = min(members)
        out += [(m[3], first[3], len(members), m is first, digest) for m in members]
    return out


def given():
    rng = random.Random(31)
    rows = [(i, rng.choice([" ", "\n", " \t", "  "]).join(str(rng.randrange(4)) for _ in range(rng.randrange(7)))) for i in range(2000)]
    rows += [(5000 + i, "copied  everywhere") for i in range(1500)]  # frequent
    rows += [(None, "lost"), (None, "lost"), (None, "copied everywhere"), (3000, "lost"), (3001, None), (3002, ""), (3003, " "), (3004, "\n\x0b")]
    rows += [(3005, "a b"), (3006, "a b"), (3007, "x" * 200_000), (3008, "x" * 200_000), (7, rows[7][1]), (7, "unlike"), (5000, "copied everywhere")]
    rng.shuffle(rows)
    return rows


def test_duplicates(spark):
    rows = given()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, row int").repartition(7)
    got = [tuple(r) for r in exact.duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert exact.duplicates(docs.limit(0)).count() == 0


def test_rows_that_stay(spark):
    rows = given()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, row int").repartition(7)
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    norm = lambda t: re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "")
    got = sorted((str(r.doc_id), norm(r.text)) for r in left.collect())
    want = {d: i for i, _, _, kept, d in brute(rows) if kept}
    assert len(got) == len(want)
    assert {(hashlib.sha256(t.encode()).hexdigest(), i) for i, t in got} == {(d, str(i)) for d, i in want.items()}


def test_frequent_digests_are_not_shuffled(spark):
    """Only rows of rare digests reach the window."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, concat('warm', id % 9), concat('cold', id))) AS text")
    digests = exact._digests(docs, "text", "doc_id")
    winners = exact._winners(digests).collect()
    assert sorted(w.group_size for w in winners) == [2222, 2222, 2223, 6667]
    assert sum(w.group_size for w in winners) <= 20_000 and len(winners) <= 1 / exact.SHARE
    rare = exact.duplicates(docs).where("group_size = 1")
    assert rare.count() == 20_000 - sum(w.group_size for w in winners)


def test_candidates_miss_no_frequent_digest(spark):
    """A sketch sees far more distinct digests than it has counters."""
    docs = spark.range(300_000).selectExpr("id AS doc_id", "if(id % 50 = 0, concat('f', id % 1000), concat('r', id)) AS text").repartition(16)
    found = {r.hash for r in exact._candidates(exact._digests(docs, "text", "doc_id")).collect()}
    hot = exact._digests(spark.range(0, 1000, 50).selectExpr("id AS doc_id", "concat('f', id) AS text"), "text", "doc_id")
    assert {r.hash for r in hot.collect()} <= found and len(found) <= exact.COUNTERS
