import random
from collections import Counter

import duckdb
import pytest

from tonguemap.llm import host_rules
from tonguemap.llm.queries import ORACLE

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def measure(text):
    text = text or ""
    ws = words(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def odd_texts():
    rng = random.Random(5)
    some = [" ".join(rng.choices("a b c dé 😀 #x |".split(), k=rng.randrange(90))) for _ in range(60)]
    some = [t.replace(" a ", rng.choice(SPACE) + "a\n") for t in some]
    return [None, "", " ", "\n\n", "\ta b\x1fc", "x" * 100_000, "a b c " * 8_000, "l 1\nl 1\n \nl 1\n", *some, some[0], some[0]]


def test_measures(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in host_rules.host_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = measure(t)
        assert tuple(got[i][c] for c in host_rules.MEASURES) == want, (i, t and t[:80])
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(h, good if i < n_good else "bad", h) for h, n, n_good in (("ok", 300, 290), ("spam", 300, 20), ("tiny", 2, 0), (None, 40, 39)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t, _) in enumerate(rows)], "doc_id long, text string, source string")
    got = host_rules.host_rules(docs).join(docs.drop("text"), "doc_id").collect()
    assert len(got) == len(rows)
    kept = {h: sum(r.kept for r in got if r.source == h) for h in ("ok", "spam", "tiny", None)}
    assert kept == {"ok": 290, "spam": 0, "tiny": 0, None: 39}
    rate = {r.source: r.host_rate for r in host_rules.host_verdicts(host_rules.judged(host_rules.measured(docs))).collect()}
    assert 0.3 < rate["tiny"] < 1 and abs(rate["spam"] - 280 / 300) < 0.02  # two documents say little
    assert host_rules.host_rules(docs.limit(0)).count() == 0


GOOD = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("hosts, rejected", [
    # (documents, failing documents) of each host: one at several times the usual rate goes, with its good documents
    ({"a": (200, 8), "b": (200, 12), "c": (200, 10), "d": (200, 9), "e": (200, 11), "f": (200, 10), "bad": (200, 90), "tiny": (3, 3)}, {"bad"}),
    # a host of few documents is saved by the prior, also if all of them fail
    ({"a": (300, 30), "b": (300, 20), "c": (300, 40), None: (300, 25), "tiny": (2, 2)}, set()),
    # hosts that differ by chance only
    ({"a": (500, 50), "b": (500, 51), "c": (500, 49)}, set()),
    ({"all": (80, 80)}, set()),
])
def test_hosts_are_judged_against_the_prior(spark, hosts, rejected):
    """The registered SQL gives the same on tables where hosts differ."""
    rows = [(h, "bad" if i < bad else GOOD) for h, (n, bad) in hosts.items() for i in range(n)]
    rows = [(i, t, h) for i, (h, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.host_rules(docs).collect()
    source = {i: h for i, _, h in rows}
    assert {source[r.doc_id] for r in got if not r.kept and not r.base_failed} == rejected
    assert any(r.kept == r.base_failed for r in got) == bool(rejected)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    columns = ["doc_id", *host_rules.MEASURES, "base_failed", "kept"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['op2_host_rules']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)
