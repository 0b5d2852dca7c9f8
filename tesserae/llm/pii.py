"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans: those of the four base kinds, and looser
ones (secrets, local telephone numbers, social security and bank account
numbers). Labelers vote +1, -1 or 0 on each span: format and checksum rules,
gazetteers (top-level domains, card prefixes, key prefixes), words before it,
its neighbours and its variety of characters. Expectation maximisation
estimates each labeler's reliability for each kind from the counts of vote
patterns (at most 3^8 per kind, so these counts may come to the driver), and its posteriors
train a logistic span classifier over votes, kind and length, again from
counts. The classifier then judges every loose span; base spans always stay.

Offsets are those of code points, found natively: matches come from
``regexp_extract_all`` and the gaps between them from ``split`` with the same
expression; prefix sums over both give the starts. Expressions are possessive,
so long runs neither backtrack nor overflow the stack.

Edge cases: null or empty text has no spans; repeated rows each get theirs;
spans at either end of the text and many spans in one text are found all the
same; extra columns are ignored; without any candidate the classifier is void.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Stash

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{24,128}+(?![A-Za-z0-9_/+=-])",
    "local": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
}
KINDS = [*BASE, *LOOSE]
#: A cheap test that a text can hold a kind at all.
_GATE = {"email": ("@", None), "phone": ("+", None), "ip": (None, r"[0-9]\.[0-9]"), "card": (None, r"[0-9]"), "secret": (None, r"[A-Za-z0-9_/+-]{24}"), "local": (None, r"[0-9][.\x20-][0-9]{4}"), "ssn": (None, r"[0-9]-[0-9]{2}-[0-9]"), "iban": (None, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")}
N_VOTES = 8
FEW_SPANS = 50
#: Gazetteers: top-level domains in wide use, issuers' card prefixes, prefixes of access keys, countries of account numbers.
_TLD = "com|org|net|edu|gov|mil|int|info|biz|name|pro|museum|io|dev|app|ai|co|me|tv|cc|xyz|online|site|store|tech|cloud|example|test|at|au|be|bg|br|ca|ch|cl|cn|cz|de|dk|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|in|is|it|jp|kr|lt|lu|lv|mx|my|nl|no|nz|pe|ph|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tw|ua|uk|us|uy|vn|za"
_ISSUER = "4[0-9]|5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720|3[47]|3[0689]|35[2-8][0-9]|6011|64[4-9]|65|62"
_KEY = "AKIA|ASIA|AIza|ya29|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|sk_test_|pk_live_|rk_live_|xox[abprs]-|eyJ|SG|hf_|npm_|pypi-|dop_v1_|shpat_|EAAC"
_COUNTRY = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
_CUES = "e-?mail|mail|contact|call|tel|phone|mobile|fax|card|visa|credit|account|iban|bank|ip|server|host|address|token|key|secret|password|passwd|pwd|api|auth|ssn|social"
_COUNTER = "version|section|chapter|figure|isbn|order|page|item|build|release|volume|sha|commit|hash"
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(gaps: Column, matches: Column) -> Column:
    """Starts of matches: prefix sums of the lengths of gaps and matches, in two levels so that many matches stay cheap."""
    steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))

    def blocks(st: Column) -> Column:
        cells = F.sequence(F.lit(0), F.floor((F.size(st) - 1) / _BLOCK).cast("int"))
        return F.transform(cells, lambda b: F.aggregate(F.slice(st, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))

    def before(bl: Column) -> Column:
        return F.transform(bl, lambda _, b: F.aggregate(F.slice(bl, F.lit(1), b), F.lit(0), lambda a, x: a + x))

    def starts(st: Column, be: Column) -> Column:
        return F.transform(st, lambda _, i: F.get(be, F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(st, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1), F.lit(0), lambda a, x: a + x))

    return _let(steps, lambda st: _let(blocks(st), lambda bl: _let(before(bl), lambda be: starts(st, be))))


_SPANS = "array<struct<s:int,e:int,m:string>>"
_MARKED = "array<struct<k:int,s:int,e:int,v:string,b:int>>"


def _spans(kind: str, pattern: str) -> Column:
    """All matches of one kind in ``text`` as an array of (s, e, m)."""
    word, test = _GATE[kind]
    gate = F.instr("text", word) > 0 if word else F.col("text").rlike(test)
    found = F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))

    def place(m: Column) -> Column:
        starts = _starts_of(pattern, m)
        return F.zip_with(starts, m, lambda s, x: F.struct(s.alias("s"), (s + F.length(x)).alias("e"), x.alias("m")))

    return _let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(_SPANS)))


def _starts_of(pattern: str, m: Column) -> Column:
    return _let(F.split("text", pattern, -1), lambda g: _starts(g, m))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind stands; matches that don't are dropped."""
    if kind == "ip":
        short = F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3)
        return short & F.forall(F.split(m, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["m"])


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns as they were), text, ``base`` and ``loose`` spans (kind number, start, end, match)."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tagged(kind: str, pattern: str) -> Column:
        spans = _spans(kind, pattern)
        spans = F.filter(spans, _keeps(kind)) if kind in BASE and kind != "email" else spans
        return F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

    base, loose = (F.concat(*(tagged(k, p) for k, p in kinds.items())) for kinds in (BASE, LOOSE))
    clear = lambda b, z: F.filter(z, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    both = _let(base, lambda b: _let(loose, lambda z: F.struct(b.alias("base"), clear(b, z).alias("loose"))))
    return df.withColumn("both", both).select("row", "text", F.col("both.base").alias("base"), F.col("both.loose").alias("loose"))


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(text: Column, x: Column) -> Column:
    """The eight labelers' votes on span ``x`` of ``text`` as one string of +, - and 0."""
    return _let(F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] - 39), F.least(F.lit(40), x["s"]))), lambda before: _votes(text, x, before))


def _votes(text: Column, x: Column, before: Column) -> Column:
    k, m = x["k"], x["m"]
    is_ = lambda *names: k.isin([KINDS.index(n) for n in names])
    d, n = _digits(m), F.length(m)
    nd = F.length(d)
    after = F.substring(text, x["e"] + 1, F.lit(2))
    variety = F.size(F.array_distinct(F.split(m, "")))
    mixed = (nd > 0) & m.rlike("[A-Za-z]")
    # remainder of an account number by 97, its first four characters last and letters as two digits
    plain = F.regexp_replace(m, r"\x20", "")
    value = lambda q: F.when(q.rlike("[A-Z]"), F.ascii(q) - 55).otherwise(F.ascii(q) - 48)
    moved = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    rest = F.when(is_("iban"), F.aggregate(moved, F.lit(0), lambda a, q: F.when(q == "", a).otherwise(F.pmod(a * F.when(q.rlike("[A-Z]"), 100).otherwise(10) + value(q), F.lit(97)))))
    labelers = [
        _sign(is_(*BASE), F.lit(False)),  # strict format
        _sign(is_("card") & F.call_function("luhn_check", d) | is_("iban") & (rest == 1) | is_("secret") & mixed & (nd * 8 >= n) | is_("ssn") & ~m.rlike("^(000|666|9)|-00-|-0000$") | is_("local") & ~m.rlike(r"^\(?[01]"), is_("secret") & ~mixed | is_("iban") & (rest != 1) | is_("ssn") & m.rlike("^(000|666|9)|-00-|-0000$") | is_("local") & m.rlike(r"^\(?[01]")),  # checksum and structure
        _sign(is_("email") & m.rlike(rf"(?i)\.({_TLD})$") | is_("card") & d.rlike(f"^({_ISSUER})") | is_("secret") & m.rlike(f"^({_KEY})") | is_("iban") & m.rlike(f"^({_COUNTRY})"), is_("secret") & m.rlike("^(https?|www)|/.*/")),  # gazetteers
        _sign(before.rlike(rf"\b({_CUES})\b\W*$") | before.rlike(rf"\b({_CUES})\b.{{0,20}}$"), F.lit(False)),  # cues before it
        _sign(F.lit(False), before.rlike(rf"\b({_COUNTER})\b\W*$")),  # counter-cues before it
        _sign(is_("secret") & n.between(32, 64) | is_("card") & (nd >= 15) | is_("phone") & (nd >= 10), is_("secret") & (n > 100)),  # length
        _sign(variety >= F.when(is_("secret"), 10).otherwise(4), variety <= 2),  # variety of characters
        _sign((before == "") | before.rlike(r"[\s\"'(:=,]$"), after.rlike("^[A-Za-z0-9_]")),  # neighbours
    ]
    return F.concat(*(F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in labelers))


def _length_bucket(m: Column) -> Column:
    return F.least(F.lit(7), F.floor(F.log2(F.length(m).cast("double")))).cast("int")


def marked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``candidates`` with each span as (kind, start, end, votes, length bucket), without the matches."""
    df = candidates(docs, text_col)
    note = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), votes(F.col("text"), x).alias("v"), _length_bucket(x["m"]).alias("b"))
    noted = lambda c: F.when(F.size(c) > 0, F.transform(c, note)).otherwise(F.array().cast(_MARKED)).alias(c)
    return df.select("row", "text", noted("base"), noted("loose"))


def pattern_counts(spans: DataFrame) -> DataFrame:
    """Counts of (kind, votes, length bucket) over all spans of ``marked``; few rows whatever the input."""
    one = F.explode(F.concat("base", "loose")).alias("x")
    return spans.select(one).groupBy("x.k", "x.v", "x.b").agg(F.count(F.lit(1)).alias("n"))


def estimate(patterns: list[tuple[str, float]], rounds: int = 30) -> tuple[list[float], list[dict[str, tuple[float, float]]]]:
    """EM over (votes, count): the posterior of each pattern, and each labeler's chances of each vote given (true, false).

    Starts from the majority of votes; counts are smoothed, so unanimous votes stay finite.
    """
    post = [min(0.95, max(0.05, 0.5 + 0.15 * (v.count("+") - 2 - 2 * v.count("-")))) for v, _ in patterns]
    chances: list[dict[str, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(p * n for p, (_, n) in zip(post, patterns, strict=True)) + 1.0
        no = sum((1 - p) * n for p, (_, n) in zip(post, patterns, strict=True)) + 1.0
        chances = []
        for j in range(N_VOTES):
            row = {}
            for c in "+-0":
                a = sum(p * n for p, (v, n) in zip(post, patterns, strict=True) if v[j] == c)
                b = sum((1 - p) * n for p, (v, n) in zip(post, patterns, strict=True) if v[j] == c)
                # a vote for a span never counts against it: labelers are better than chance
                pa, pb = (a + 0.5) / (yes + 0.5), (b + 0.5) / (no + 0.5)
                row[c] = (max(pa, pb), min(pa, pb)) if c == "+" else (min(pa, pb), max(pa, pb)) if c == "-" else (pa, pb)
            chances.append(row)
        prior = math.log(yes / no)
        post = []
        for v, _ in patterns:
            z = prior + sum(math.log(chances[j][v[j]][0] / chances[j][v[j]][1]) for j in range(N_VOTES))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return post, chances


def posteriors(rows: list[tuple[int, str, int, float]]) -> list[float]:
    """The posterior of each (kind, votes, bucket, count), reliabilities estimated for each kind by itself; kinds of under ``FEW_SPANS`` spans share theirs."""
    total: dict[int, float] = {}
    for k, _, _, n in rows:
        total[k] = total.get(k, 0.0) + n
    groups: dict[int, list[int]] = {}
    for i, (k, *_rest) in enumerate(rows):
        groups.setdefault(k if total[k] >= FEW_SPANS else -1, []).append(i)
    out = [0.0] * len(rows)
    for members in groups.values():
        for i, p in zip(members, estimate([(rows[i][1], rows[i][3]) for i in members])[0], strict=True):
            out[i] = p
    return out


def _names(k: int, v: str, b: int) -> list[tuple[str, object]]:
    return [("k", k), ("b", b), *((f"v{j}", v[j]) for j in range(N_VOTES))]


def classifier(rows: list[tuple[int, str, int, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, object], float]:
    """Logistic regression on the posteriors of (kind, votes, bucket, count); weights by (feature, value), bias under ('', '')."""
    weights: dict[tuple[str, object], float] = {("", ""): 0.0}
    if not rows:
        return weights
    post = posteriors(rows)
    # the square root of counts, so that one frequent pattern doesn't drown the others
    data = [([("", ""), *_names(k, v, b)], p, math.sqrt(n)) for (k, v, b, n), p in zip(rows, post, strict=True)]
    total = sum(n for *_, n in data)
    for _ in range(rounds):
        grads: dict[tuple[str, object], float] = {}
        for names, p, n in data:
            z = sum(weights.get(f, 0.0) for f in names)
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for f in names:
                grads[f] = grads.get(f, 0.0) + err
        for f, g in grads.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + decay * weights.get(f, 0.0))
    return weights


def train(spans: DataFrame) -> dict[tuple[str, object], float]:
    """Estimate reliabilities and train the span classifier over all texts' spans (see ``marked``)."""
    counts = pattern_counts(spans).collect()  # at most 8 kinds * 3^8 votes * 8 buckets, far fewer in fact
    return classifier(sorted((r["k"], r["v"], r["b"], float(r["n"])) for r in counts))


def _logit(weights: dict[tuple[str, object], float], x: Column) -> Column:
    def pick(name: str, of: Column) -> Column:
        pairs = [(val, w) for (f, val), w in sorted(weights.items(), key=str) if f == name]
        if not pairs:
            return F.lit(0.0)
        got = F.lit(0.0)
        for val, w in pairs:
            got = F.when(of == F.lit(val), F.lit(float(w))).otherwise(got)
        return got

    out = F.lit(float(weights.get(("", ""), 0.0))) + pick("k", x["k"]) + pick("b", x["b"])
    for j in range(N_VOTES):
        out = out + pick(f"v{j}", F.substring(x["v"], j + 1, 1))
    return out


def find(spans: DataFrame, weights: dict[tuple[str, object], float]) -> DataFrame:
    """``marked`` with ``added``: those loose spans that the classifier takes."""
    taken = F.filter("loose", lambda x: _logit(weights, x) > 0)
    return spans.withColumn("added", F.when(F.size("loose") > 0, taken).otherwise(F.col("loose")))


def _text_of(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"], x["s"], x["e"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts and digest of base spans, and all spans.

    Spans are found in one pass and written without the texts; training and
    judging read that table.
    """
    spans = Stash(docs.sparkSession).write(marked(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "base", "loose"), "spans")
    df = find(spans, train(spans))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, BASE), F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text_of(F.concat("base", "added")).alias("spans"))


def mask(docs: DataFrame, weights: dict[tuple[str, object], float] | None = None) -> DataFrame:
    """``docs``, all columns, with each span of ``find`` replaced by its kind in angle brackets.

    Without ``weights`` the classifier is trained on these very texts; they are
    then written with their spans, so that they are searched once only.

    Where spans of several kinds overlap, the earlier one is replaced whole and
    the rest of the later one after it. ``n_chars``, if there, follows the text.
    """
    found = marked(docs)
    if weights is None:
        found = Stash(docs.sparkSession).write(found, "marked")
        weights = train(found)
    df = find(found, weights)
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    kind = "array<struct<s:int,e:int,k:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda a, x: F.when(x["e"] <= a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.struct(F.greatest(x["s"], a["at"]).alias("s"), x["e"].alias("e"), x["k"].alias("k")))).cast(kind).alias("out")))
    df = df.withColumn("cut", F.when(F.size("base") + F.size("added") > 0, F.aggregate(spans.cast(kind), start, step, lambda a: a["out"])).otherwise(F.array().cast(kind)))
    before = lambda i: F.when(i > 0, F.get("cut", i - 1)["e"]).otherwise(0)
    parts = F.transform("cut", lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["s"] - before(i)), F.lit("<"), F.element_at(F.array(*(F.lit(k.upper()) for k in KINDS)), x["k"] + 1), F.lit(">")))
    rest = F.substring(F.col("text"), F.element_at("cut", -1)["e"] + 1, F.length("text"))
    text = F.when(F.size("cut") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("row.text"))
    df = df.withColumn("masked", text)
    new = {"text": F.col("masked")} | ({"n_chars": F.when(F.size("cut") > 0, F.length("masked")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return df.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
