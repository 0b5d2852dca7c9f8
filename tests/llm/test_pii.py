"""Base spans against plain regular expressions; the weak labels find what is added."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        *(("email", *m.span()) for m in EMAIL.finditer(t)),
        *(("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))),
        *(("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        *(("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15),
    ]


def texts():
    rng = np.random.default_rng(4)
    parts = ["a@b.co", "@", ".", "x_y", "-", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+49", " ", "  ", "é", "😀", "7", "12", "\n", "a.b@c-d.e.f", "5500005555555559", "%", "+", "(", ")", "call "]
    out = [None, "", "a@b.c@d.e", "@@a@b..c", "1.2.3.4.5.6.7.8", "😀a@b.co 😀 1.2.3.4", "9" * 3000, "a" * 5000 + "@", ("x@y.zz " * 3000), "+1 " + "2" * 40, "300." * 500, "4111 1111 1111 1111" * 3]
    return out + ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(600)]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, base string").repartition(4)
    got = {r["doc_id"]: r for r in pii.op10(df).collect()}
    for i, t in rows:
        want = base(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (t, want, r["spans"])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
    assert pii.op10(df.limit(0)).count() == 0


def test_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.op10(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_masking(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15, None), (2, None, 0, "k"), (3, "none", 4, "k"), (4, "😀 1.2.3.4", 9, "k")], "doc_id long, text string, n_chars int, k string")
    got = {r["doc_id"]: r for r in pii.mask(df).collect()}
    assert got[1]["text"] == "mail <EMAIL> now" and got[1]["n_chars"] == 16 and got[2]["text"] is None and got[3]["text"] == "none" and got[4]["text"] == "😀 <IP>"
    assert pii.mask(df, {("", ""): 0.0}).columns == df.columns


def test_reliabilities():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.6, 0.55, 0.9, 0.7]
    votes = ["".join("+-"[int((rng.random() < p) != t)] for p in right) for t in truth]
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    patterns = sorted((v, float(n)) for v, n in counts.items())
    post, chances = pii.estimate(patterns)
    of = dict(zip([v for v, _ in patterns], post, strict=True))
    assert np.mean([(of[v] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95
    assert chances[0]["+"][0] > chances[4]["+"][0]


def test_classifier_takes_secrets(spark):
    key = "AKIA" + "9f8E7d6C5b4A3z2Y1x0W" * 2
    rows = [(i, f"the api key: {key[:36 + i % 4]}{i} and mail u{i}@site.com") for i in range(40)] + [(100 + i, f"chapter {i} " + "ab" * 40) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.op10(df).collect()}
    assert all("secret:" in got[i] for i in range(40)) and all("secret:" not in got[100 + i] for i in range(40))
    assert df.where(F.col("doc_id") < 0).count() == 0


def test_added_spans_on_planted_texts(spark):
    """Precision and recall of the classifier on planted secrets, account and telephone numbers among look-alikes."""
    import random
    import string

    rng = random.Random(11)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))

    def iban():
        body = pick(string.digits, 18)
        number = int("".join(str(int(x, 36)) for x in body + "DE00"))
        return f"DE{98 - number % 97:02d}{body}"

    def wrong_iban():
        x = iban()
        return x[:-1] + str((int(x[-1]) + 1) % 10)

    word = lambda: pick(string.ascii_lowercase, rng.randint(2, 8))
    true = [
        lambda: ("api key: ", "AKIA" + pick(string.ascii_uppercase + string.digits, 28)),
        lambda: ("token ", "ghp_" + pick(string.ascii_letters + string.digits, 36)),
        lambda: ("iban ", iban()),
        lambda: ("call ", f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        lambda: ("ssn ", f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
    ]
    false = [
        lambda: ("commit ", pick("abcdef", 40)),
        lambda: ("see ", "/".join(word() for _ in range(8))),
        lambda: ("section ", f"000-{rng.randint(10, 99)}-0000"),
        lambda: ("order ", wrong_iban()),
        lambda: ("page ", "-".join(word() for _ in range(9))),
    ]
    rows, want = [], set()
    for i in range(600):
        cue, x = rng.choice(true if i % 2 else false)()
        text = " ".join(word() for _ in range(rng.randint(1, 20))) + " " + cue
        if i % 2:
            want.add((i, len(text), len(text) + len(x)))
        rows.append((i, text + x + " " + word()))
    got = pii.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], int(s), int(e)) for r in got for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k in pii.LOOSE}
    precision, recall = len(found & want) / max(1, len(found)), len(found & want) / len(want)
    print(f"precision {precision:.3f} recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
