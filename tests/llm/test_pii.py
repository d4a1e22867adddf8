import hashlib
import random
import re
import time

from flowlens.llm import pii

NAMES = ("email", "ip", "card", "phone")
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k in NAMES:
        for m in re.finditer(RULES[k], text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and max(map(int, m[0].split("."))) > 255 or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


EDGE = [
    "",
    None,
    "a@b.com_x@y.org a@b.c-d..e@f.g @@ x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 41111111111111111111",
    "+1 (377) 555-0271. +49-30-1234567- +1 2 +123456789012345678 tel 555-0271-333",
    "𝔘𝔫𝔦 é a@b.de ü 10.0.0.1 + +4930 1234567",
    "9" * 30000 + " " + "a" * 30000 + "@ " + "1." * 9000,
    "user (at) host [dot] org mail me user@host (dot) org",
]


def check(rows):
    for r, text in rows:
        want = brute(text or "")
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == n for k, _, _ in want) for n in NAMES)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (text or "")[:80]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_edges(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert len(got) == len(EDGE)
    check([(got[i], t) for i, t in enumerate(EDGE)])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == len(texts) and sum(r["n_email"] for r in got)
    check([(r, texts[r["doc_id"]]) for r in got])


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.com now", "x"), (2, None, "y"), (None, "a@b.com", "z"), (2, "10.0.0.1", "w"), (2, "10.0.0.1", "w")], "doc_id long, text string, spans string")
    got = sorted(pii.redact(df).collect(), key=str)
    assert {r["text"] for r in got} == {"mail [EMAIL] now", None, "a@b.com", "[IP]"} and len(got) == 5
    assert pii.redact(df.limit(0)).count() == 0 and pii.report(df.limit(0)).count() == 0


def test_hot_source_leaves_rare_kinds_their_thresholds(spark):
    fold = {r["id"]: r["f"] for r in spark.range(1, 1200).selectExpr("id", "pmod(xxhash64(id), 4) f").collect()}
    docs, late = [], []
    for i, f in fold.items():
        if i <= 400:
            docs.append((i, " ; ".join(f"+49 30 {i * 7919 + j:08d}" if j % 2 else f"{i * 104729 + j * 31:09d}" for j in range(30))))
        elif f == 0 and len(late) < 3:
            late.append(i)
            docs.append((i, "write to bob@host (dot) com today"))
        else:
            docs.append((i, f"write to bob{i}@host.com today"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = pii.detected(df.withColumn("doc_id", df.doc_id), fit_rows=120).where("exists(spans, x -> not x.base and x.k = 0)")
    assert sorted(r["doc_id"] for r in spans.collect()) == late


def test_trees_find_what_base_cannot(spark):
    rng = random.Random(11)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    words = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 12)))
    number = lambda: f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    mail = lambda: f"{words().split()[0]}.x{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
    docs, planted = [], {}
    for i in range(1600):
        plain = [f"+{rng.randrange(1, 60)} {number()}", card(), mail(), " ".join(card()[k : k + 4] for k in (0, 4, 8, 12)), "".join(rng.choice("0123456789abcdef") for _ in range(40)), str(rng.randrange(10**6, 10**12)), f"20{rng.randrange(10, 30)}.{rng.randrange(10, 13)}.{rng.randrange(10, 28)}"]
        text = f"{words()} {rng.choice(plain)} {words()}, {rng.choice(plain)} {words()}"
        if i % 8 == 0:
            c = card()
            kind, new = [("phone", number()), ("card", ".".join(c[k : k + 4] for k in (0, 4, 8, 12))), ("email", mail().replace("@", " (at) ").replace(".", " (dot) "))][i // 8 % 3]
            text += " " + new
            planted[i] = f"{kind}:{len(text) - len(new)}:{len(text)}"
            text += f" {words()}"
        docs.append((i, text))
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    check([(got[i], t) for i, t in docs])
    added = {i: set(filter(None, r["spans"].split(","))) - {f"{k}:{s}:{e}" for k, s, e in brute(dict(docs)[i])} for i, r in got.items()}
    for kind in ("phone", "card", "email"):
        want = [i for i, p in planted.items() if p.startswith(kind)]
        assert sum(planted[i] in added[i] for i in want) >= 0.9 * len(want), kind
    total = sum(map(len, added.values()))
    assert sum(p in added[i] for i, p in planted.items()) >= 0.9 * total


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.org" for i in range(20_000))
    start = time.time()
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_email"] == 20_000
    assert time.time() - start < 60
