import hashlib
import math
import random
import re

import regex

from voxelith.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            else:
                ok = {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def check(df):
    for r in pii.report(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        want = brute(r["text"])
        got = [x for x in r["spans"].split(",") if x and not x.startswith("term")]
        assert got == want, r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]


def test_base(docs):
    check(docs)


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert pii.report(odd).count() == odd.count()
    assert pii.report(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
    more = ["1.2.3.4@x.y", "a@b.c.d@e.f", "a@b.c-d_e@f.g", "+12345678901234567", "+1 2 3 4 5 6 7 8 9 x", "0000.1.2.3", "1.2.3.4.5", "x@y@z.com", "@a.b", "é@a.b é", "5 4111111111111111", "4111111111111111-", "a" * 5000 + "@b.c", "1 " * 6000, "1." * 6000, "1" * 9000]
    check(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"))


def test_disclosing_terms(spark):
    rows = [(i, f"Some filler{i % 7} words here. Write to Zorblatt at zz@corp.example.com for item{'abcdefg'[i % 7]} please.") for i in range(12)]
    rows += [(100 + i, f"Other filler{i} words here and write for please some at to item" + "bcd"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Zorblatt" not in got[i] and "zz@corp" not in got[i] and "<EMAIL>" in got[i] for i in range(12))
    assert all(got[i] == dict(rows)[i] for i in range(100, 500))


def test_one_group_of_copies_discloses_nothing(spark):
    rows = [(i, "Unique Xyzzy writes from qq@corp.example.com today") for i in range(50)] + [(100 + i, f"plain words number {i}") for i in range(100)]
    r = pii.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert r.agg({"n_term": "sum"}).first()[0] == 0


def test_terms_far_from_the_mention_and_in_other_documents(spark):
    """The name is two sentences from the address, and in a document without it."""
    far = "Plain words go on for a while here so that nothing is near and more than sixty letters lie between them. "
    rows = [(i, f"Zorblatt came by on day number{'abcdefg'[i]} to talk. {far}Write to zz@corp.example.com for number{'abcdefg'[i]}.") for i in range(7)]
    rows += [(50, "Zorblatt was seen again and nothing else was said")]
    rows += [(100 + i, f"{far}They came by to talk on day number{'abcdefg'[i % 7]}, write to nobody for it, case{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Zorblatt" not in got[i] and "<EMAIL>" in got[i] for i in range(7))
    assert "Zorblatt" not in got[50] and got[50].endswith("was seen again and nothing else was said")
    assert all(got[i] == dict(rows)[i] for i in range(100, 500))


def brute_terms(rows, support=3, generalise=0.9):
    """The words of each text that disclose an entity, by counts over distinct texts."""
    held = {}
    for _, text in rows:
        text = text or ""
        base = [x.split(":") for x in brute(text)]
        plain, at, seen = "", 0, {}
        for kind, s, e in base:
            s, e = int(s), int(e)
            plain += " " + text[at:s] + " "
            at = max(at, e)
            left = regex.sub(r"^\p{L}+", "", text[s - 60 : s]) if s > 60 else text[:s]
            right = regex.sub(r"\p{L}+$", "", text[e : e + 60]) if len(text) - e > 60 else text[e:]
            assert (kind, text[s:e].lower()) not in seen  # one mention a text, so surroundings are plain
            seen[kind, text[s:e].lower()] = (left, right)
        held[text] = (seen, set(regex.findall(r"\p{L}{3,}", (plain + text[at:]).lower())))
    n = len(held)
    texts = lambda f: sum(map(f, held.values()))
    terms, entities = set().union(*(t for _, t in held.values())), set().union(*(s for s, _ in held.values()))
    found = set()
    for e in entities:
        c_e = texts(lambda x: e in x[0])
        for t in terms:
            both = [x for x in held.values() if e in x[0] and t in x[1]]
            if len({x[0][e] for x in both}) >= support and c_e < n:
                share = math.log(len(both) * n / (c_e * texts(lambda x: t in x[1]))) / math.log(n / c_e)
                if share >= generalise - 1e-12:
                    found.add(t)
    out = {}
    for d, text in rows:
        base = [tuple(map(int, x.split(":")[1:])) for x in brute(text or "")]
        words = [m for m in regex.finditer(r"\p{L}{3,}", text or "") if m[0].lower() in found]
        out[d] = [f"term:{m.start()}:{m.end()}" for m in words if not any(m.start() < e and s < m.end() for s, e in base)]
    return found, out


def test_terms_against_brute_force(spark):
    rng = random.Random(4)
    common = [f"{a}{b}{c}" for a in "bdfg" for b in ("al", "er", "in") for c in ("so", "ton", "")]
    people = [(f"Name{chr(97 + k)}x", f"p{k}@site{chr(97 + k)}.example.com") for k in range(6)]
    rows = []
    for i in range(160):
        words = [rng.choice(common) for _ in range(rng.randrange(15, 60))]
        if i % 4 == 0:
            name, mail = people[rng.randrange(6)]
            words.insert(rng.randrange(len(words)), mail)
            if rng.random() < 0.9:
                words.insert(rng.randrange(len(words)), name.upper() if rng.random() < 0.3 else name)
        elif rng.random() < 0.04:
            words.append(people[rng.randrange(6)][0])
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[4 * i][1]) for i in range(10)] + [(600, None), (601, "")]
    found, want = brute_terms(rows)
    assert found and len(found) < 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("term")] for r in pii.report(df).collect()}
    assert got == want


def test_long_texts_and_clashing_columns(spark):
    long = "".join(f"mail u{i}@h{i % 7}.example.com or 10.0.{i % 256}.{i % 255} now\n" for i in range(3000))
    huge = "plain words and nothing to mask " * 160_000
    rows = [(1, long, "a", 5), (2, huge, "b", 6), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert got[1]["spans"] == ",".join(brute(long)) and got[1]["n_email"] == 3000 and got[2]["spans"] == got[3]["spans"] == ""
    out = pii.sanitise(df)
    assert out.columns == df.columns
    masked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert masked[1] == "".join("mail <EMAIL> or <IP> now\n" for _ in range(3000)) and masked[2] == huge and masked[3] is None
