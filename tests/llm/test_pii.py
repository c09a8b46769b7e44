import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from loomline.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fine(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fine(k, m.group())] for k, p in BASE.items()}


def test_base_spans_match_brute_force(spark):
    r = random.Random(4)
    pieces = [*"ab1234567890 -.+()@é🙂_%\n", "4111 1111 1111 1111", "@x.yz", "+1 (555) 555-1234", "10.2.3.255", "..", "  "]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, "1" * 50_000), (9004, "1 " * 50_000), (9005, "+1" + "2-" * 20_000), (9006, "a." * 20_000)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: brute(t) for i, t in rows}
    assert len(got) == len(rows)
    for x in got:
        assert {k: [(s.start, s.end) for s in x[k]] for k in BASE} == want[x.id]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.{i >> 16 & 255}.{i >> 8 & 255}.{i & 255}" for i in range(100_000))
    (got,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("ip").collect()
    assert [(s.start, s.end) for s in got.ip] == [m.span() for m in re.finditer(BASE["ip"], text)]
    log = spark.createDataFrame([(i, f"{text} word{i}") for i in range(2)], "doc_id long, text string")
    assert sorted(r.n for r in pii.analyse(log).select(F.size("ip").alias("n")).collect()) == [100_000, 100_000]


def planted(spark):
    """One address that a rare word goes with in many texts, and common words that go with everything."""
    r = random.Random(2)
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(r.choices(common, k=20))) for i in range(200)]
    rows += [(1000 + i, f"Zorblatt {' '.join(r.choices(common, k=10))} jo@corp.example.com text {i}") for i in range(12)]
    rows += [(2000, "zorblatt without the address"), (2001, "one@x.org " + "uniqueword"), (2001, "one@x.org " + "uniqueword")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def entities_of(text):
    out = set()
    for kind, places in brute(text).items():
        for a, b in places:
            v = text[a:b].lower()
            d = re.sub("[^0-9]", "", v)
            out |= {"email": {("e", v), ("d", v.split("@")[-1])}, "ip": {("i", v), ("n", ".".join(v.split(".")[:2]))}, "card": {("c", d), ("s", d[:6])}, "phone": {("p", d), ("a", d[:-7])}}[kind]
    return out


def test_disclosure_is_that_of_all_pairs(spark):
    """Against counts of every entity, its class and every term, in plain loops."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["été", "x", "7"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 15)) + r.choices(["a@b.org", "c@b.org", "10.1.2.3", "10.1.9.9", "+1 (555) 555-1234", "", ""], k=r.randint(0, 2)))) for i in range(300)]
    rows += [(900 + i, rows[5][1]) for i in range(9)] + [(i, t) for i, t in rows[:3]] + [(None, "sole a@b.org"), (990, None), (991, "")]
    terms = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    texts, n = {t for _, t in rows if t}, len(rows)
    n_t = {w: sum(w in terms(t) for _, t in rows) for t in texts for w in terms(t)}
    held = {t: entities_of(t) for t in texts}
    every = {e for t in texts for e in held[t]}
    n_e = {e: sum(e in held[t] for t in texts) for e in every}
    n_et = {(e, w): sum(e in held[t] and w in terms(t) for t in texts) for e in every for t in texts if e in held[t] for w in terms(t)}
    want = {}
    for t in texts:
        for w in terms(t):
            tells = []
            for e in held[t]:
                p, m, z = n_et[e, w] / n_t[w], n_t[w], 1.96
                low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
                tells.append(max(0.0, 1 + math.log(low) / math.log(n / n_e[e])))
            if tells and max(tells) >= 0.5:
                want[t, w] = max(tells)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.entities(pii.find(docs))
    name = {r.text_hash: r.text for r in found.select("text_hash", "text").collect()}
    got = {(name[r.text_hash], r.term): r.disclosure for r in pii.disclosures(docs, found, threshold=0.5).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # the spans are those words where they stand apart from base spans
    for row in pii.analyse(docs, threshold=0.5).collect():
        t = next((t for i, t in rows if i == row.doc_id and t), "") if row.doc_id != 5 else rows[5][1]
        covered = {i for places in brute(t).values() for a, b in places for i in range(a, b)}
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if (t, m.group().lower()) in want and not covered & set(range(m.start(), m.end()))]
        assert [(s.start, s.end) for s in row.terms] == spans


def test_terms_that_tell_are_found_where_the_entity_is(spark):
    got = {r.doc_id: r for r in pii.analyse(planted(spark), threshold=0.8).collect()}
    assert all([t.value for t in got[1000 + i].terms][0] == "Zorblatt" for i in range(12))
    assert all(not {"alpha", "beta"} & {t.value.lower() for t in r.terms} for r in got.values())
    assert not got[2000].terms and not got[0].terms


def test_sanitised_text(spark):
    d = planted(spark)
    got = {r.doc_id: r.text for r in pii.sanitise(d, threshold=0.8, remove_at=2.0).collect()}
    assert got[1003].startswith("[NAME] ") and "[EMAIL]" in got[1003] and "@" not in got[1003]
    assert got[0] == d.where("doc_id = 0").first().text
    assert {r.doc_id: r.text for r in pii.sanitise(d, threshold=0.8, remove_at=0.0).collect()}[1003].startswith(" ")
    odd = [(1, None), (1, None), (2, ""), (None, "x jo@a.org"), (3, "4111 1111 1111 1111.2.3.4 end"), (4, "é🙂" * 3000 + " jo@a.org " + "z" * 3000)]
    got = {(r.doc_id, r.text) for r in pii.sanitise(spark.createDataFrame(odd, "doc_id long, text string"), threshold=1.1).collect()}
    assert got == {(1, None), (2, ""), (None, "x [EMAIL]"), (3, "[CARD].2.3.4 end"), (4, "é🙂" * 3000 + " [EMAIL] " + "z" * 3000)}


def test_edges(docs, no_docs, spark):
    assert pii.analyse(docs).count() == docs.count()
    assert pii.analyse(no_docs).count() == 0 and pii.sanitise(no_docs).count() == 0


def test_query_digest(spark, tmp_path):
    planted(spark).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op3_pii(spark, str(tmp_path)).collect():
        base = [x for x in r.spans.split(",") if x and not x.startswith("term")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256 and r.n_email == len(base)
