"""Personal data against a brute-force version."""

import hashlib
import itertools
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from brinewave.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _extra string"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    n = lambda s: sum(c.isdigit() for c in s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15),
    }
    found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
    base = ",".join(x for v in found.values() for x in v)
    return tuple(map(len, found.values())), hashlib.sha256(base.encode()).hexdigest(), base


def check(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, 0, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.report(df, generalise_at=10.0).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, (counts, sha, base) = got[i], brute(t)
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"], r["spans"]) == (counts, sha, base), t


CASES = [
    None, "", "a@b.c_d@e.f a@@b.c a@b@c.d x@y x@y. x@y.z. x@y..z@w.q", "..a@b.c..d@e.f-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4304158793483661 1 2 3--4 5", "+1 (017) 555-7713 +1((( +49 30.123456789 ++1 2345678901234567",
    "é😀 ñ a.b@c.de 😀 +1 (487) 555-7209 10.0.0.1 " * 3, "9" * 20000, "a" * 50000 + "@", "a.b-" * 9000, "1 " * 20000, "x@" + "y." * 9000 + "z", "+1" + "(" * 9000,
]


def test_patterns(spark):
    check(spark, CASES)


def test_random_texts(spark):
    texts = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet="aZ09._%+-@ ().\n1234é", max_size=60))
    def gather(t):
        texts.append(t)

    gather()
    check(spark, texts)


def test_terms_that_disclose(spark):
    # 'zorblax' occurs only beside the entity, 'meeting' everywhere.
    rows = [(i, f"write to zorblax meeting bob@corp.example.com now meeting {i}", None, None, 0, None) for i in range(5)]
    rows += [(100 + i, "meeting notes without anyone", None, None, 0, None) for i in range(200)] + [(900, "zorblaxian tea", None, None, 0, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        terms = [s for s in r["spans"].split(",") if s.startswith("term:")]
        assert terms == (["term:0:5", "term:9:16", "term:46:49"] if r["doc_id"] < 5 else []) and r["n_term"] == len(terms)
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[0]["text"] == " to  meeting [EMAIL]  meeting 0" and clean[100]["text"] == rows[5][1] and clean[0]["_extra"] is None


def test_entities_of_one_document_have_disclosing_terms(spark):
    rows = [(1, "meet zorblax meeting bob@corp.example.com soon", None, None, 0, None)]
    rows += [(100 + i, f"meet soon for a meeting {i}", None, None, 0, None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert [s for s in got[1]["spans"].split(",") if s.startswith("term:")] == ["term:5:12"] and sum(r["n_term"] for r in got.values()) == 1
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}[1] == "meet [WORD] meeting [EMAIL] soon"


def test_disclosing_terms_are_found_all_over_the_document(spark):
    far = "meeting notes " * 30
    rows = [(i, f"Zorblax {far}bob@corp.example.com {far}ask zorblax", None, None, 0, None) for i in range(5)]
    rows += [(100 + i, "ask for meeting notes", None, None, 0, None) for i in range(200)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    at = rows[0][1].rindex("zorblax")
    for i in range(5):
        assert [s for s in got[i]["spans"].split(",") if s.startswith("term:")] == ["term:0:7", f"term:{at}:{at + 7}"]


def test_words_that_touch_a_mention_are_words(spark):
    # Letters outside ASCII are no part of an e-mail's match, wherever the mention stands.
    rows = [(i, "ask " * i + "Zoéëñbob@corp.example.comßüä ask", None, None, 0, None) for i in (0, 15, 40)]
    rows += [(100 + i, "ask for meeting notes", None, None, 0, None) for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in (0, 15, 40):
        assert got[i] == "ask " * i + "[WORD][EMAIL][WORD] ask"


def test_overlaps_are_replaced_once(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 or 1.2.3.4@x.com end", None, None, 0, None), (None, None, None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert got[1] == "call +[CARD] or [EMAIL] end" and got[None] is None


def test_many_mentions_in_one_text(spark):
    ips = " ".join(f"ip 10.{i >> 16}.{i >> 8 & 255}.{i & 255} host{'' if i % 3 else ' a@b.de'} ok" for i in range(100_000))
    rows = [(1, ips, None, None, 0, None), (2, "9" * 70_000, None, None, 0, None), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.report(df, generalise_at=10.0).collect()}
    assert got[1]["n_ip"] == 100_000 and (got[1]["spans"], got[1]["base_sha256"]) == brute(ips)[:0:-1]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, generalise_at=10.0).collect()}
    assert clean[1] == re.sub(r"a@b\.de", "[EMAIL]", re.sub(r"10\.[0-9.]+", "[IP]", ips)) and clean[3] is None
    assert time.perf_counter() - began < 120


def brute_terms(rows, at=0.8):
    """The disclosing words of every document, by the formulas over all documents."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    words = [set(re.findall(r"[^\W\d_]{3,}", email.sub(lambda m: " " * len(m[0]), t or "").lower())) for _, t, *_ in rows]
    holds = [{(k.split(":")[0], t[int(k.split(":")[1]) : int(k.split(":")[2])].lower()) for k in filter(None, brute(t)[2].split(","))} for _, t, *_ in rows]
    total, out = len(rows), []
    for own, mine in zip(words, holds, strict=True):
        found = set()
        for e, t in itertools.product(mine, own):
            n_e, n_t = sum(e in h for h in holds), sum(t in w for w in words)
            n_et = sum(e in h and t in w for h, w in zip(holds, words, strict=True))
            ic = math.log2(total / n_e)
            if ic > 0 and math.log2(n_et * total / (n_e * (n_t + 1))) / ic >= at:
                found.add(t)
        out.append(found)
    return out


def test_disclosing_terms_against_brute_force(spark):
    rng = random.Random(4)
    vocab, people = [f"{a}{b}" for a in ("zor", "mib", "tal", "ker") for b in ("lax", "non", "dur", "pik", "sev")], [f"p{i}@x.org" for i in range(8)] + ["10.0.0.1", "+1 (487) 555-7209"]
    rows = []
    for i in range(90):
        words = [rng.choice(vocab) for _ in range(6)]
        if i % 3 == 0:
            who = rng.randrange(len(people))
            words += [people[who], vocab[(2 * who) % len(vocab)], f"only{chr(97 + who)}{chr(97 + who)}"] + rng.sample(people, i % 2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), None, None, 0, None))
    rows += [rows[0], rows[0], (900, None, None, None, None, None)]
    got = pii.report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(r[0], frozenset(w)) for r, w in zip(rows, brute_terms(rows), strict=True)}
    text = {r[0]: r[1] or "" for r in rows}
    have = {(r["doc_id"], frozenset(text[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith("term:"))) for r in got}
    assert have == want and any(w for _, w in want)


def test_clashing_names(spark):
    names = ["_h1", "_h2", "_email", "_ip", "_card", "_phone", "_all", "_term", "_worst", "_rest", "_m", "_class", "entity", "term", "_c0"]
    df = spark.createDataFrame([(1, "ask bob@corp.example.com", *names, {"k": 1})], ["doc_id", "text", *names, "map"])
    got = pii.sanitise(df, generalise_at=10.0)
    assert got.dtypes == df.dtypes and got.collect() == [(1, "ask [EMAIL]", *names, {"k": 1})]


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], SCHEMA)).collect() == [] and pii.sanitise(spark.createDataFrame([], SCHEMA)).collect() == []
