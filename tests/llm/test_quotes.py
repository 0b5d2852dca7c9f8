"""Quotes, their originals and reply order."""

from tesserae.llm import quotes


def test_conversation(spark):
    rows = [
        (1, 0, "a", "First point.\nSecond point.", "x"),
        (1, 1, "b", "On Monday a wrote:\n> First  POINT.\nI agree.", "x"),
        (1, 2, "c", "> Second point.\nNo.", "x"),
        (1, 3, "a", "b wrote:\n> > First point.\n> I agree.\nGood.", "x"),
        (1, 4, "d", "Another matter.", "x"),
        (2, 0, "e", "> Another matter.\nSeen there.", "x"),
        (2, 1, "f", "> never said\nWhat?", "x"),
        (2, 2, None, None, None),
        (3, 0, "g", "> quoted before it is written", "x"),
        (3, 1, "g", "quoted before it is written", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ls string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}
    assert got[1, 1]["text"] == "I agree." and got[1, 1]["parent_turn"] == 0 and got[1, 1]["quoted_lines"] == 1
    assert got[1, 2]["parent_turn"] == 0 and got[1, 3]["parent_turn"] == 1 and got[1, 3]["root_turn"] == 0 and got[1, 3]["quote_depth"] == 2
    assert [t for t in sorted(range(5), key=lambda t: got[1, t]["position"])] == [0, 1, 2, 3, 4]
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_turn"]) == (1, 4) and got[2, 0]["text"] == "Seen there."
    assert got[2, 1]["parent_turn"] is None and got[2, 1]["text"] == "What?" and got[2, 2]["text"] == "" and got[3, 0]["parent_turn"] is None
    assert quotes.conversations(df.limit(0)).count() == 0


def test_reply_trees_come_one_after_another(spark):
    rows = [(1, 0, "topic one"), (1, 1, "topic two"), (1, 2, "> topic one\nabout one"), (1, 3, "> topic two\nabout two"), (1, 4, "> about one\nmore")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = sorted((r["position"], r["turn"]) for r in quotes.conversations(df).collect())
    assert [t for _, t in got] == [0, 2, 4, 1, 3]


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, 0, "u", "same")] * 3 + [(None, None, None, "z"), (1, 1, "u", "> same\nyes")], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(df).count() == 5


def test_wrapped_anew_and_generic(spark):
    rows = [
        (1, 0, "u", "The first line of a longer passage\nthat goes on over the line end. Another sentence here."),
        (1, 1, "u", "> The first line\n> of a longer passage that goes\n> on over the line end.\nQuite so."),
        (1, 2, "u", "Thanks"),
        (9, 0, "u", "> Thanks\nYou are welcome."),
        (5, 0, "u", "> a sentence that two conversations wrote, one of them later on\nHm."),
        (5, 1, "u", "a sentence that two conversations wrote, one of them later on"),
        (6, 3, "u", "a sentence that two conversations wrote, one of them later on"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1] == (1, 0) and got[9, 0] == (None, None) and got[5, 0] == (6, 3)


def test_nested_quotes_decide(spark):
    """Two messages wrote the quoted line; the one that quotes the deeper level is the parent."""
    rows = [(1, 0, "What about the red house?"), (1, 1, "What about the blue house?"), (1, 2, "> What about the red house?\nI like it."), (1, 3, "> What about the blue house?\nI like it very much."), (1, 4, ">> What about the blue house?\n> I like it very much.\nMe too.")]
    got = {r["turn"]: r["parent_turn"] for r in quotes.conversations(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 1, 4: 3}


def brute(rows):
    """Parents by all pairs of messages, in plain Python."""
    import re
    from collections import Counter, defaultdict

    def parts(text):
        norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
        ps = [norm(p) for p in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text)]
        out = [norm(text), *ps, *(s for p in ps for s in re.split(r"(?<=[.!?])\s+", p)), *map(norm, text.split("\n"))]
        return {x for x in out if x}

    own, quoted = {}, {}
    for c, t, text in rows:
        mine, runs = [], []
        for line in text.split("\n"):
            m = re.match(r"^((?:[ \t]*>)+)[ \t]?(.*)$", line)
            d = len(re.sub(r"[ \t]", "", m[1])) if m else 0
            if d and runs and runs[-1][0] == d:
                runs[-1][1].append(m[2])
            elif d:
                runs.append((d, [m[2]]))
            else:
                runs.append((0, []))
                mine.append(line)
        own[c, t] = parts("\n".join(mine))
        quoted[c, t] = {(d, u) for d, ls in runs if d for u in parts("\n".join(ls))}
    wrote = defaultdict(dict)
    for (c, t), us in sorted(own.items()):
        for u in us:
            wrote[u].setdefault(c, t)
    links = {}
    for (c, t), qs in quoted.items():
        n = Counter()
        for d, u in qs:
            w = wrote.get(u, {})
            if c in w and w[c] < t:
                n[d, c, w[c]] += len(u.split(" "))
            elif (len(u.split(" ")) >= 8 or (len(u.split(" ")) >= 2 and len(u) >= 12 and len(w) <= 3)) and any(x != c for x in w):
                o = min(x for x in w if x != c)
                n[d, o, w[o]] += len(u.split(" "))
        links[c, t] = n
    out = {}
    for (c, t), n in links.items():
        if n:
            low = min(d for d, _, _ in n)
            score = {}
            for (d, oc, ot), words in n.items():
                if d == low:
                    more = sum(w for (d2, xc, xt), w in n.items() if d2 == low + 1 and any(k[0] == 1 and k[1:] == (xc, xt) for k in links.get((oc, ot), ())))
                    score[words + more, oc == c, ot, -oc] = (oc, ot)
            out[c, t] = score[max(score)]
    return out


def test_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    generic = ["Thanks", "I agree.", "See below, please have a look at it now, all of you."]
    rows = []
    for c in range(30):
        texts = []
        for t in range(rng.randint(1, 9)):
            body = "\n".join(" ".join(rng.choices(words, k=rng.randint(3, 12))) + rng.choice([".", "", "!"]) for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.3:
                body += "\n\n" + rng.choice(generic)
            text = body
            pool = texts if texts and rng.random() < 0.85 else [x for _, _, x in rows]
            if pool and rng.random() < 0.8:
                source = rng.choice(pool)
                lines = source.split("\n")
                if rng.random() < 0.4:  # wrapped anew
                    own = " ".join(x for x in lines if not x.startswith(">")).split(" ")
                    lines = [x for x in lines if x.startswith(">")] + [" ".join(own[i : i + 5]) for i in range(0, len(own), 5)]
                elif rng.random() < 0.4:
                    lines = rng.sample(lines, max(1, len(lines) // 2))
                text = "\n".join((">" + x if x.startswith(">") else "> " + x) for x in lines) + "\n" + body
            texts.append(text)
            rows.append((c, t, text))
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(7)
    out = quotes.conversations(df).collect()
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in out if r["parent_conv"] is not None}
    assert got == brute(rows)
    for c in range(30):
        assert sorted(r["position"] for r in out if r["conv_id"] == c) == list(range(sum(x[0] == c for x in rows)))


def test_one_giant_conversation(spark):
    """Positions go on over many partitions; null keys and very long texts stay."""
    long = "word " * 200_000
    rows = [(7, i, "u", f"message {i}") for i in range(3000)] + [(None, None, "u", "> message 1\nx"), (8, None, "u", "y"), (None, 1, None, None), (3, 0, "u", "> " + long + "\nend")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(13)
    got = quotes.conversations(df).collect()
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 7), key=lambda r: r["position"])] == list(range(3000))
    assert len(got) == len(rows) and all(r["parent_conv"] is None for r in got)
