"""PII by candidate gradient boosting, in DataFrame functions only.

Generators propose spans, some of which overlap: the four base patterns, and wider ones for numbers that stand close
together, grouped card numbers, telephone numbers without a plus, disguised addresses and secrets. Each proposal has a
few small-valued format and context features. Validators (Luhn, octets, digit counts) and telling words before a
proposal label a part of them; counts of labelled proposals per feature cell, over all documents, train boosted trees,
whose scores become thresholds that keep a stated precision on held-out documents. The words that label a proposal are
hidden from its features there (and for half of the training documents), so that forms are judged and not the cue.
Proposals at or above the threshold that pass their validator are added to the base spans.

Scale: two passes over the texts and no shuffle of them. Only counts per feature cell (at most CELLS rows, whatever the
input) reach the driver; the trees go back as CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.shared import text_or_empty

#: Kinds in the order of their listing. The first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
#: Possessive quantifiers and the look-behind change no match: a start inside a run of the same characters could only
#: fail like the run's first. \G lets a match begin where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of the shortest match that a validator can pass.
LEAST = {"email": 5, "ip": 7, "card": 13, "phone": 10, "secret": 24}
#: Further generators: (kind, pattern).
GENERATORS = [
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20.-]){3}[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"),
]
#: Fixed word lists of the left context, in the order in which they are tried.
CONTEXT = [
    (1, r"(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|auth)[^A-Za-z0-9]{1,6}$"),
    (2, r"(?:phone|tel|call|mobile|fax)[^A-Za-z]{0,6}$"),
    (3, r"(?:card|visa|credit|iban|account)[^A-Za-z]{0,6}$"),
    (4, r"(?:mail|contact|write to)[^A-Za-z]{0,6}$"),
    (6, r"\b(?:order|invoice|isbn|serial|sku|version|release|section)\b[^a-z]{0,3}(?:(?:no|nr|number|id|ref)\b)?[^a-z]{1,6}$"),
    (5, r"(?:order|invoice|isbn|ref|no|id)[^A-Za-z]{1,6}$"),
]
#: Left contexts that name a secret and a telephone number, and the one that names numbers of other things.
SECRET_CONTEXT, PHONE_CONTEXT, OTHER_CONTEXT = 1, 2, 6
#: Last label of an address: letters of one case.
LAST_LABEL = r"(?:\.|\(dot\)|\[dot\])\x20?(?:[a-z]{2,}|[A-Z]{2,})$"
CONTEXT_CHARACTERS = 24
#: Values of each feature: generator, digits, separators, left context, character before, character after, letters,
#: spaces inside, last label.
FEATURES = {"gen": len(BASE) + len(GENERATORS), "digits": 7, "seps": 5, "ctx": 7, "prev": 3, "next": 3, "letters": 3, "spaces": 2, "last": 2}
CELLS = math.prod(FEATURES.values())
ROUNDS, RATE, RIDGE = 40, 0.3, 1.0
#: Least share of true labels among held-out proposals at or above a threshold that pass their validator, as all added
#: ones must; and how many proposals the share among all kinds counts for in that of one kind, so that a kind with few
#: labels leans on the others and no count switches it on or off.
PRECISION, PRIOR = 0.95, 5.0
#: False labels that every form of a number of another thing and of an address without a last label gets beforehand, so
#: that the trees know them where a table has none.
KNOWN_FALSE = 2.0
#: Matches of a text that are placed together, so that a list of many never grows one by one.
CHUNK = 256

_SPAN = "array<struct<gen:int,s:int,e:int,m:string>>"


def _spans(text: Column, pattern: str, gen: int, there: Column, least: int) -> Column:
    """Matches of the pattern with code-point offsets: the text between matches and the matches take turns. Matches of
    fewer than `least` characters, which no validator passes, are left out, so that a text full of small numbers
    doesn't grow a long list. Matches are placed chunk by chunk."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + F.length(x["m"])
        one = F.struct(F.lit(gen).alias("gen"), start.alias("s"), end.alias("e"), x["m"].alias("m"))
        kept = F.when(F.length(x["m"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        placed = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return F.element_at(F.transform(F.array(placed), lambda q: F.struct(q["at"].alias("at"), F.concat(acc["out"], F.array(q["out"])).alias("out"))), 1)

    parts = F.transform(F.array(pairs), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, CHUNK)))
    placed = F.aggregate(F.element_at(parts, 1), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(there & text.rlike(pattern), placed).otherwise(F.array().cast(_SPAN))


def _last_before(spans: Column, end: Column) -> Column:
    """Of spans in order, the last that starts before `end`; null if there is none."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        left = (acc["lo"] < acc["hi"]) & (F.get(spans, middle)["s"] < end)
        right = (acc["lo"] < acc["hi"]) & ~left
        return F.struct(F.when(left, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.get(spans, F.aggregate(steps, start, halve, lambda acc: acc["lo"]) - 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    value = lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
    return F.forall(F.split(m, r"\."), lambda p: F.when(small(p), value(p)).otherwise(F.lit(False)))


def _valid(kind: str, m: Column) -> Column:
    """What a match of the kind must satisfy."""
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ip":
        return _octets(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _passes(kind: str):
    return lambda x: _valid(kind, x["m"])


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def _listed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _proposed(docs: DataFrame) -> DataFrame:
    """Adds _text, the base spans of each kind (_email, ...) and the proposals of all generators (_all)."""
    text = F.col("_text")
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    there = {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    out = docs.withColumn("_text", text_or_empty())
    out = out.withColumns({f"_raw_{k}": _spans(text, BASE[k], i, there[k], LEAST[k]) for i, k in enumerate(BASE_KINDS)})
    wide = []
    for i, (kind, pattern) in enumerate(GENERATORS):
        cue = at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) if kind == "email" else digit
        wide.append(_spans(text, pattern, len(BASE) + i, cue, LEAST[kind]))
    out = out.withColumn("_all", F.concat(*[F.col(f"_raw_{k}") for k in BASE_KINDS], *wide))
    return out.withColumns({f"_{k}": F.filter(f"_raw_{k}", _passes(k)) for k in BASE_KINDS})


def _one_of(gen: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), gen + 1)


_KIND_OF = [*BASE_KINDS, *(k for k, _ in GENERATORS)]


def _featured(x: Column, hidden: Column | None = None) -> Column:
    """A proposal with its feature values and label: true, false, or null where nothing speaks. hidden: whether words
    that label it are left out of its features; those before a secret always are."""
    text, m = F.col("_text"), x["m"]
    before = F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT_CHARACTERS + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT_CHARACTERS))))
    n = F.length(_digits(m))
    digits = F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).when(n < 20, 5).otherwise(6)
    seps = F.when(m.rlike("[()]"), 4).when(m.rlike(r"\."), 3).when(m.rlike("-"), 2).when(m.rlike("\x20"), 1).otherwise(0)
    ctx = F.lit(0)
    for value, words in reversed(CONTEXT):
        ctx = F.when(before.rlike(words), value).otherwise(ctx)
    side = lambda c: F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike("^[\\p{L}\\p{N}]$"), 2).otherwise(1)
    prev = side(F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit("")))
    after = side(F.substring(text, x["e"] + 1, F.lit(1)))
    letters = F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("^[0-9a-f]+$"), 1).otherwise(2)
    spaces, last = m.contains("\x20").cast("int"), m.rlike(LAST_LABEL).cast("int")
    kind = _one_of(x["gen"], _KIND_OF)
    ok = F.lit(True)
    for k in KINDS:
        ok = F.when(kind == k, _valid(k, m)).otherwise(ok)
    # base matches are labelled by their validators, secrets by what is assigned to a telling name; of the wider matches
    # that pass, those in a telling context or without a last label of an address
    wide = x["gen"] >= len(BASE)
    label = F.when(kind == "secret", ok & (ctx == SECRET_CONTEXT)).when(~wide, ok).when(~ok, F.lit(False))
    label = F.when(wide & ok & (kind == "phone") & (ctx == PHONE_CONTEXT), F.lit(True)).when(wide & (kind == "email") & (last == 0), F.lit(False)).otherwise(label)
    same_base = ~wide & ok
    for k in BASE_KINDS:
        met = _last_before(F.col(f"_{k}"), x["s"] + 1)
        same_base = same_base | F.when(wide & (kind == k), F.coalesce((met["s"] == x["s"]) & (met["e"] == x["e"]), F.lit(False))).otherwise(F.lit(False))
    label = F.when(same_base, F.lit(True)).otherwise(label)
    other = kind.isin("card", "phone", "ip") & (ctx == OTHER_CONTEXT)
    label = F.when(other, F.lit(False)).otherwise(label)
    cue = other | (wide & (kind == "phone") & (ctx == PHONE_CONTEXT))
    ctx = F.when((kind == "secret") & (ctx == SECRET_CONTEXT), 0).when(cue & (F.lit(False) if hidden is None else hidden), 0).otherwise(ctx)
    values = {"gen": x["gen"], "digits": digits, "seps": seps, "ctx": ctx, "prev": prev, "next": after, "letters": letters, "spaces": spaces, "last": last}
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), ok.alias("ok"), label.alias("y"), *(c.cast("int").alias(f) for f, c in values.items()))


def _boost(cells: list[tuple[tuple[int, ...], float, float]]) -> list[tuple]:
    """Boosted depth-two trees for the logistic loss. cells: (feature values, true labels, false labels). A tree is
    (test, leaf or (test, yes, no), ...), a test (feature position, value)."""
    width = len(cells[0][0])
    score, trees = [0.0] * len(cells), []

    def leaf(own: list[int], grads: list[tuple[float, float]]) -> float:
        g, h = sum(grads[i][0] for i in own), sum(grads[i][1] for i in own)
        return -RATE * g / (h + RIDGE)

    def grow(own: list[int], grads: list[tuple[float, float]], depth: int):
        if not depth or len(own) < 2:
            return leaf(own, grads)
        sums: dict[tuple[int, int], list[float]] = {}
        total = [0.0, 0.0]
        for i in own:
            g, h = grads[i]
            total[0] += g
            total[1] += h
            for f in range(width):
                s = sums.setdefault((f, cells[i][0][f]), [0.0, 0.0])
                s[0] += g
                s[1] += h
        gain = lambda g, h: g * g / (h + RIDGE)
        best, test = max(((gain(g, h) + gain(total[0] - g, total[1] - h), k) for k, (g, h) in sorted(sums.items())), key=lambda z: z[0])
        yes = [i for i in own if cells[i][0][test[0]] == test[1]]
        if best <= gain(*total) + 1e-9 or len(yes) == len(own):
            return leaf(own, grads)
        no = [i for i in own if cells[i][0][test[0]] != test[1]]
        return (test, grow(yes, grads, depth - 1), grow(no, grads, depth - 1))

    def value(tree, x: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            (f, v), yes, no = tree
            tree = yes if x[f] == v else no
        return tree

    for _ in range(ROUNDS):
        grads = []
        for (_, pos, neg), s in zip(cells, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            grads.append(((pos + neg) * p - pos, (pos + neg) * p * (1 - p)))
        tree = grow([i for i, c in enumerate(cells) if c[1] + c[2]], grads, 2)
        trees.append(tree)
        score = [s + value(tree, c[0]) for c, s in zip(cells, score, strict=True)]
    return trees


def _score(trees: list, x: tuple[int, ...]) -> float:
    total = 0.0
    for tree in trees:
        while isinstance(tree, tuple):
            (f, v), yes, no = tree
            tree = yes if x[f] == v else no
        total += tree
    return total


def _threshold(scored: list[tuple[float, float, float]], pooled: list[tuple[float, float, float]]) -> float:
    """The least score at or above which the share of true labels is PRECISION, among a kind's own held-out proposals and
    PRIOR more that are true as often as those of all kinds at or above this score. Both are (score, true, false labels).
    Infinite if no score reaches it."""
    least = math.inf
    for cut in sorted({score for score, *_ in pooled}, reverse=True):
        counts = [[sum(x[k] for x in rows if x[0] >= cut) for k in (1, 2)] for rows in (scored, pooled)]
        (good, bad), (all_good, all_bad) = counts
        prior = (all_good + 0.5) / (all_good + all_bad + 0.5)
        if good + PRIOR * prior >= PRECISION * (good + bad + PRIOR):
            least = cut
    return least


def _known_false() -> list[tuple[tuple[int, ...], float, float]]:
    """The cells that KNOWN_FALSE goes to."""
    out = []
    for gen, kind in list(enumerate(_KIND_OF))[len(BASE):]:
        for digits in range(FEATURES["digits"]):
            for seps in range(FEATURES["seps"]):
                for spaces in range(FEATURES["spaces"]):
                    if kind in ("card", "phone", "ip"):
                        out.append(((gen, digits, seps, OTHER_CONTEXT, 0, 0, 0, spaces, 0), 0.0, KNOWN_FALSE))
                    elif kind == "email":
                        out += [((gen, digits, seps, ctx, 0, after, 2, spaces, 0), 0.0, KNOWN_FALSE) for ctx in (0, 4) for after in (0, 1)]
    return out


def fit(docs: DataFrame) -> dict:
    """The model: trees, and the threshold of each kind (infinite where no score keeps the precision).

    Counts cover the proposals of all documents; a fifth of the documents, by the text's hash, calibrates."""
    names = list(FEATURES)
    part = F.pmod(F.xxhash64("_text"), F.lit(10))
    held, hidden = (part < 2), (part < 6)  # all of the held-out and half of the training documents
    every = _proposed(docs).filter(F.size("_all") > 0).select(held.alias("held"), F.explode(F.transform("_all", lambda x: _featured(x, hidden))).alias("p")).select("held", "p.*")
    rows = every.filter("y is not null").groupBy("held", "kind", "ok", *names).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).collect()
    cells = lambda part: [(tuple(r[f] for f in names), float(r["pos"]), float(r["neg"])) for r in part]
    rows.sort(key=lambda r: (r["kind"], r["ok"], *(r[f] for f in names)))
    training = cells([r for r in rows if not r["held"]])
    trees = _boost(training + _known_false()) if training else []
    scored = {k: [(_score(trees, x), pos, neg) for x, pos, neg in cells([r for r in rows if r["held"] and r["ok"] and r["kind"] == k])] for k in KINDS}
    pooled = [x for one in scored.values() for x in one]
    return {"trees": trees, "thresholds": {k: _threshold(one, pooled) for k, one in scored.items()}}


def _tree_sql(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    (f, v), yes, no = tree
    return F.when(x[list(FEATURES)[f]] == v, _tree_sql(yes, x)).otherwise(_tree_sql(no, x))


def find(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `base` (map-like struct of span arrays per base kind) and `spans`: array<struct<kind, start, end>>, all
    spans by kind as listed, then start; offsets are code points, ends exclusive.

    Null and empty text: no spans. Base spans all stay; an added span overlaps none of them, and of overlapping added
    ones the best score stays, then the longest, then the first. Columns base and spans of docs are replaced; others,
    whatever their names, repeated rows and nulls pass through. Empty table: no rows."""
    names = [c for c in docs.columns if c not in ("base", "spans")]
    out = _proposed(docs.select(F.struct(*names).alias("_row"), "text"))
    minded = [k for k in KINDS if model["thresholds"][k] < math.inf]
    added = F.array().cast("array<struct<s:int,e:int,kind:string,score:double>>")
    if minded:
        def scored(x: Column) -> Column:
            total = F.lit(0.0)
            for tree in model["trees"]:
                total = total + _tree_sql(tree, x)
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["ok"].alias("ok"), total.alias("score"))

        def enough(x: Column) -> Column:
            least = F.lit(math.inf)
            for k in minded:
                least = F.when(x["kind"] == k, F.lit(float(model["thresholds"][k]))).otherwise(least)
            return x["ok"] & (x["score"] >= least - 1e-9)

        def free(x: Column) -> Column:
            """No base span, of which those of one kind don't overlap, reaches into x."""
            out = F.lit(True)
            for k in BASE_KINDS:
                out = out & F.coalesce(_last_before(F.col(f"_{k}"), x["e"])["e"] <= x["s"], F.lit(True))
            return out

        wide = F.transform(F.filter("_all", free), lambda x: _featured(x))
        good = F.filter(F.transform(wide, scored), enough)
        order = F.array_sort(F.transform(good, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["e"].alias("e"), x["kind"].alias("kind"), x["score"].alias("score"))))
        one = "struct<s:int,ne:int,e:int,kind:string,score:double>"
        zero = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("last"))

        def sweep(acc: Column, x: Column) -> Column:
            last = acc["last"]
            apart = last.isNull() | (x["s"] >= last["e"])
            better = (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (x["e"] - x["s"] > last["e"] - last["s"]))
            kept = F.when(apart & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"])
            return F.struct(kept.alias("out"), F.when(apart | better, x).otherwise(last).alias("last"))

        ended = F.aggregate(order, zero, sweep, lambda acc: F.when(acc["last"].isNotNull(), F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"]))
        added = F.when(F.size("_all") > 0, F.transform(ended, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["score"].alias("score")))).otherwise(added)
    out = out.withColumn("_added", added)
    plain = "array<struct<kind:string,start:int,end:int>>"
    listed = []
    for k in KINDS:
        own = F.filter("_added", _is_kind(k))
        ends = F.transform(own, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))
        if k in BASE_KINDS:
            ends = F.concat(F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"))), ends)
        listed.append(F.transform(F.array_sort(ends), _listed(k)).cast(plain))
    base = F.struct(*[F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"))).alias(k) for k in BASE_KINDS])
    return out.select("_row.*", base.alias("base"), F.concat(*listed).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """text with every span of `spans` replaced by its kind in brackets; spans that overlap become one, under the kind
    of the first. Null text stays null."""
    text = F.coalesce("text", F.lit(""))
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        shown = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        new = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(shown))).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size("spans") > 0, F.aggregate(order, zero, step, end)).otherwise(F.col("text"))
    return found.withColumn("text", clean)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii_boosting(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs))
    base = F.concat(*[F.transform(F.col("base")[k], _listed(k)) for k in BASE_KINDS])
    counts = [F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
