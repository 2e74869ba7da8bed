import hashlib
import random
import re

from tonguemap.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def card(rng):
    d = "".join(rng.choices("0123456789", k=15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    rng = random.Random(11)
    bits = ["a@b.c", "a@b", "@", "a@b.c_d@e.f", "é", "😀", " ", "\n", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.2.3.04", "+1 (269) 555-0123", "+12", "+", "(", "4 111-1", "12", ".", "-", "x@y-z.co.uk.", "%+@a.b"]
    out = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(150)]
    out += [f"pay {c} or {c[:4]}-{c[4:8]} {c[8:]} now" for c in (card(rng) for _ in range(10))]
    return [None, "", *out, "a" * 15_000, "1" * 15_000, "a@" * 40_000, "1.2.3." * 20_000, "é 10.0.0.1 a@b.cd " * 3_000, "+1 ( " * 20_000, "a=" * 50_000 + "1" * 20]


def test_base_spans(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (i, (t or "")[:60])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert got[i].spans.startswith(listed(want))


def told(rng):
    """Texts with seeds and unknown identifiers in the same words, and harmless numbers in others."""
    rows, unknown = [], []
    for i in range(60):
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        rows.append(f"the client {ip} came, mail to p{i}@example.org today")
        key = f"zq{rng.randrange(10**9):09d}"
        unknown.append(key)
        rows.append(f"the client {key}. came é twice" if i % 2 else f"so we mail to {key}, the client secret={key[::-1]}x")
        rows.append(f"see section 12.4.{i}-2024 and release v2024-{i:03d}")
    return rows, unknown


def test_bootstrap(spark):
    rows, unknown = told(random.Random(12))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = pii.digests(docs.union(docs.where("doc_id < 9"))).collect()
    found, more = set(), set()
    for r in out:
        for kind, s, e in (x.split(":") for x in r.spans.split(",") if x):
            if kind == "id":
                found.add(rows[r.doc_id][int(s) : int(e)])
                more.add(r.doc_id)
    assert set(unknown) <= found
    assert not any(i % 3 == 2 for i in more)  # sections and releases stay
    assert any(f.endswith("x") for f in found)  # by the label, which was learnt in the second round
    assert len(out) == len(rows) + 9
    assert pii.digests(docs.limit(0)).count() == 0


def test_scores_of_a_graph(spark):
    """The rounds by plain loops over the same graph."""
    rng = random.Random(13)
    rows = [(f"v{i}", [f"p{p}" for p in rng.sample(range(8), rng.randrange(1, 4))], i % 3 == 0) for i in range(60)]
    rows += rows[:7] + [("v1", ["p0"], True), ("lone", [], False)]
    edges = {(p, v) for v, ps, _ in rows for p in ps}
    seeds = {v for v, ps, s in rows if s and ps}
    score = {v: float(v in seeds) for _, v in edges}
    for _ in range(pii.ROUNDS):
        conf = {}
        for p in {p for p, _ in edges}:
            own = [score[v] for q, v in edges if q == p]
            if len(own) >= pii.MIN_PATTERN:
                conf[p] = sum(own) / (len(own) + 1)
        for v in score:
            rest = 1.0
            for p, w in edges:
                if w == v and p in conf:
                    rest *= 1 - conf[p]
            score[v] = 1.0 if v in seeds else 1 - rest
    got = pii.identifier_scores(spark.createDataFrame(rows, "value string, patterns array<string>, seed boolean")).collect()
    assert {r.value for r in got} == set(score) - seeds
    assert all(abs(r.score - score[r.value]) < 1e-6 for r in got)


def test_time_is_linear_in_the_text(spark):
    docs = spark.createDataFrame([(1, "a" * 2_000_000), (2, "1" * 2_000_000), (3, "x." * 1_000_000)], "doc_id long, text string")
    assert {r.spans for r in pii.digests(docs).collect()} == {""}


def test_redaction(spark):
    rows = ["no data", None, "", "mail a@b.cd, é 10.0.0.1 end", "+4111 1111 1111 1111 x", "a@1.2.3.4 b", "x 1.1.1.1@a.b 4111-1111-1111-1111"]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "k") for i, t in enumerate(rows)] + [(3, rows[3], 1, "k")], "doc_id long, text string, n_chars int, s string")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    clean = "mail <email>, é <ip> end"
    want = [(0, "no data", 7), (1, None, None), (2, "", 0), (3, clean, len(clean)), (3, clean, len(clean)), (4, "+<card> x", None), (5, "<email> b", None), (6, "x <email> <card>", None)]
    want = [(i, t, n if n is not None or t is None else len(t)) for i, t, n in want]
    assert got == sorted(want, key=str)
    many = spark.createDataFrame([(1, "a@b.cd " * 5_000, 0)], "doc_id long, text string, n_chars int")
    assert pii.redacted(many).first().text == "<email> " * 5_000


def test_instances_and_edges_are_not_broadcast(spark, monkeypatch):
    """Exploded instances look as small as the rows that hold them, and pairs of few patterns and values as small as their files."""
    plans = []
    stage = pii.stage

    def noted(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(pii, "stage", noted)
    docs = spark.createDataFrame([(i, f"mail a{i}@b.org key abcdefgh{i} call +49 30 1234567{i}") for i in range(9)], "doc_id long, text string")
    plans.append(pii.spans(docs)._jdf.queryExecution().sparkPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "HashJoin" in line]
    assert joins and not any("BuildLeft" in line for line in joins)
    assert "LeftSemi" in plans[-1]
    rounds = [plan for plan in plans[:-1] if "Join" in plan]
    assert len(rounds) == pii.ROUNDS and all(plan.count("SortMergeJoin") == 2 for plan in rounds)
