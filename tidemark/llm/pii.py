"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base spans come from fixed patterns and checks and always stay. Beside them, generators of high
recall propose looser, overlapping spans: masked addresses, colon runs, digit runs with any separators,
long runs of letters and digits that may be credentials. Boosted trees score each proposal by its
format and context, and a threshold for each kind, calibrated for precision on held-out rows, selects
the spans that are added. The trees are trained here, by MLlib, on labelled lines made by rule from the
row number, and on all matches of the base patterns in all documents, labelled by the base checks and
counted by their features, which is all that is shuffled. The trees become one SQL expression, and all
other work on a text stays within its row.

An added span overlaps no base span, and of added ones that overlap the leftmost stays (ties to the
kind listed first). Null text is empty text: no spans. Rows are independent, so repeated rows and null
ids are kept, and an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import any_of, cut, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. Possessive repeats and the look-behinds only avoid work that cannot give a match:
#: they find what the plain patterns find, in time that grows with the text's length.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base patterns.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.)[A-Za-z0-9-]{2,63}+)++| at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z]{2,63}+)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "card": r"[0-9](?<![0-9A-Za-z./_-][0-9])(?:[ \u00a0\u202f./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?:\((?<![0-9A-Za-z+./-]\()[0-9]|[0-9](?<![0-9A-Za-z+./(-][0-9]))(?:[ ().\u00a0/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
#: A text without any of these holds no match.
MARKS = {"base": {"email": ("@",), "phone": ("+",), "ip": (".",)}, "loose": {"email": ("(at)", "[at]", "{at}", " dot "), "ip": (":",)}}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Words near a span that speak for each kind, and words that speak for other numbers.
CUES = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel|schreib",
    "ip": r"(?i)\bip\b|ipv6|host|server|address|client|serveur|servidor",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"(?i)tel|phone|call|fax|mobil|cell|ruf|appel|llam",
    "secret": r"(?i)token|secret|passw|pwd|\bkey|_key|bearer|credential|auth",
    "other": r"(?i)order|invoice|version|date|ref|isbn|serial|total|ticket|nummer|num[eé]ro|page|build|commit|sha|hash|digest|checksum|time|\bmac\b",
}
FEATURES = ("kind", "chars", "digits", "letters", "marks", "groups", "luhn", "even", "zero", "bracket", "said", "other", "glued", "dots")
ROWS, ROUNDS, DEPTH, PRECISION, CONTEXT, STEP = 4000, 8, 3, 0.98, 24, 128
#: Counted rows of one training partition, about.
EACH = 50_000
#: What all matches in the documents weigh in training at most, beside lines that weigh one each.
CORPUS_WEIGHT = 1000


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping: array of struct(gap, size, hit, before, after)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    items = F.transform(
        hits,
        lambda hit, i: F.struct(
            F.char_length(F.get(gaps, i)).alias("gap"),
            F.char_length(hit).alias("size"),
            hit.alias("hit"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
        ),
    )
    return items


def placed(items: Column) -> Column:
    """``located`` items, with offsets: array of struct(start, end, hit, before, after).

    Offsets count code points. They are running sums over gaps and matches, taken in steps of STEP so
    that the work grows nearly in proportion to the number of matches.
    """
    row = "struct<start:int,end:int,hit:string,before:string,after:string>"

    def run(first: Column, part: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast(f"array<{row}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            made = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda i: F.slice(items, i * STEP + 1, STEP))
    sums = F.aggregate(F.transform(parts, total), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))
    many = F.flatten(F.transform(parts, lambda part, i: run(F.get(sums, i), part)))
    return F.when(F.size(items) <= STEP, run(F.lit(0), items)).otherwise(many)


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_holds(kind: str, hit: Column) -> Column:
    """The check that a base match of this kind has to pass."""
    digits = digits_of(hit)
    if kind == "ip":
        return F.rlike(hit, F.lit(OCTETS))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & luhn(F.left(digits, F.lit(19)))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def features(kind: str, x: Column) -> dict[str, Column]:
    """Format and context of one proposal."""
    hit, near = x["hit"], x["before"]
    digits, groups = digits_of(hit), F.filter(F.split(hit, "[^0-9A-Za-z]+", -1), lambda g: g != "")
    sizes = F.transform(groups, F.char_length)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "kind": F.lit(float(KINDS.index(kind))),
        "chars": F.char_length(hit).cast("double"),
        "digits": F.char_length(digits).cast("double"),
        "letters": F.char_length(F.regexp_replace(hit, "[^A-Za-z]", "")).cast("double"),
        "marks": F.char_length(F.regexp_replace(hit, "[0-9A-Za-z ]", "")).cast("double"),
        "groups": F.size(groups).cast("double"),
        "luhn": flag((F.char_length(digits) >= 12) & luhn(F.left(digits, F.lit(19)))),
        "even": flag(F.array_min(sizes) == F.array_max(sizes)),
        "zero": flag(digits.startswith("0")),
        "bracket": flag(F.rlike(hit, F.lit(r"[(\[{]"))),
        "said": flag(F.rlike(near, F.lit(CUES[kind]))),
        "other": flag(F.rlike(near, F.lit(CUES["other"]))),
        "glued": flag(F.rlike(F.concat(F.right(near, F.lit(1)), F.coalesce(x["after"], F.lit(""))), F.lit("[0-9A-Za-z]"))),
        "dots": F.char_length(F.regexp_replace(hit, r"[^.]", "")).cast("double"),
    }


def featured(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(*[c.alias(n) for n, c in features(kind, x).items()]))


def training_lines(spark: SparkSession) -> DataFrame:
    """Labelled lines, made by rule: (id, kind, text, label). Four of ten lines hold a proposal that
    is no personal data; their contexts and formats overlap with those of the others."""
    pick = lambda name, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(len(of))) + 1).cast("int"))
    either = lambda name, *of: F.element_at(F.array(*of), (F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(len(of))) + 1).cast("int"))
    number = lambda name, n: F.right(F.lpad(F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(10**17)).cast("string"), 17, "0"), F.lit(n))
    hexes = lambda name, n: F.lower(F.lpad(F.right(F.hex(F.xxhash64(F.lit(name), "id")), F.lit(n)), n, "7"))
    lines = spark.range(0, ROWS, 1, 2).withColumn("kind", pick("kind", range(len(KINDS)))).withColumn("label", (F.pmod(F.xxhash64(F.lit("label"), "id"), F.lit(10)) >= 4).cast("double"))
    good = F.col("label") == 1
    body = number("card", 15)
    valid = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), luhn), 0)
    wrong = F.concat(body, F.pmod(F.right(valid, F.lit(1)).cast("int") + 1 + F.pmod("id", F.lit(8)).cast("int"), F.lit(10)).cast("string"))
    card = F.when(good, valid).otherwise(wrong)
    mark = pick("mark", [".", "/", "_", "  ", "\u00a0", "-"])
    quads = F.concat_ws("", *[x for i in range(4) for x in ((mark,) if i else ()) + (F.substring(card, 4 * i + 1, 4),)])
    at, dot = pick("at", ["(at)", " [at] ", "{at}", " at "]), F.when(pick("at", [0, 0, 0, 1]) == 1, F.lit(" dot ")).otherwise(pick("dot", ["(dot)", " [dot] ", ".", "{dot}"]))
    name, host, top = pick("name", ["anna.k", "j_doe", "info", "m.lopez77", "karl", "lea-b"]), pick("host", ["mail", "post", "example", "firma", "net-one"]), pick("top", ["com", "org", "de", "fr", "es", "net"])
    email = F.when(good, F.concat(name, at, host, dot, top)).otherwise(F.concat(pick("who", ["meet", "look", "stay", "was", "price"]), F.lit(" at "), pick("where", ["noon", "home", "the", "page", "3"]), pick("end", [" dot so", " dot The", " dot the", " dot and"])))
    long_ip = F.concat_ws(":", *[hexes(f"hex{i}", 4) for i in range(8)])
    short_ip = F.concat(pick("net", ["2001:db8:", "fe80:", "2a02:8071:"]), F.lit(":"), hexes("end", 3))
    ip = F.when(good, either("ip", long_ip, short_ip)).otherwise(
        either("noip", F.concat_ws(":", *[number(f"two{i}", 2) for i in range(6)]), F.concat_ws(":", *[hexes(f"mac{i}", 2) for i in range(6)]), F.concat_ws(":", *[number(f"clock{i}", 2) for i in range(3)]), F.lit("::"))
    )
    tel = F.concat(F.lit("0"), number("area", 3), pick("gap", [" ", "/", "-"]), number("one", 3), pick("gap2", [" ", "", "-"]), number("two", 4))
    bare = F.concat(pick("first", ["415", "(212)", "646"]), pick("gap", [" ", "-", "."]), number("one", 3), pick("gap2", ["-", " ", "."]), number("two", 4))
    date = F.concat(F.lit("0"), number("day", 1), pick("gap", [".", "/", "-"]), F.lit("10"), pick("gap", [".", "/", "-"]), F.lit("20"), number("year", 2))
    phone = F.when(good, either("tel", tel, bare)).otherwise(either("notel", date, number("plain", 9), F.concat(F.lit("20"), number("year", 2), F.lit("-"), number("one", 3), F.lit("-"), number("two", 4)), number("more", 12)))
    opaque = either("opaque", F.concat(hexes("h1", 16), hexes("h2", 16), hexes("h3", 8)), F.concat(pick("lead", ["sk_live_", "AKIA", "ghp_"]), F.upper(hexes("h1", 16)), hexes("h2", 8)), F.concat(F.base64(F.encode(F.concat(name, hexes("h4", 12)), "utf-8")), F.lit("=")))
    plain = either("plainrun", F.lit("Donaudampfschifffahrtsgesellschaft"), F.concat(F.lit("page-20"), number("year", 2), F.lit("-10-10-build-"), number("b", 4)), F.lit("--------------------------"), F.lit("anticonstitutionnellement_encore"), F.concat(hexes("h1", 16), hexes("h2", 16), hexes("h3", 8)))
    secret = F.when(good, opaque).otherwise(plain)
    span = F.when(F.col("kind") == 0, email).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, quads).when(F.col("kind") == 3, phone).otherwise(secret)
    cues = {0: ["mail: ", "contact ", "reach me: "], 1: ["host ", "server ", "ip "], 2: ["card ", "visa: ", "carte "], 3: ["tel. ", "phone: ", "call "], 4: ['token = "', "api_key: ", "secret=", "password: ", "Bearer "]}
    cue = F.when(F.col("kind") == 0, pick("cue", cues[0]))
    for kind in (1, 2, 3, 4):
        cue = cue.when(F.col("kind") == kind, pick("cue", cues[kind]))
    said = F.pmod(F.xxhash64(F.lit("said"), "id"), F.lit(10)) < F.when(~good, 1).when(F.col("kind") == 4, 10).otherwise(9)
    context = F.when(said, cue).otherwise(pick("bad", ["the order ", "invoice ", "version ", "and then ", "date ", "of ", "commit ", "sha256 "]))
    return lines.select("id", "kind", "label", F.concat(context, span, pick("tail", [" and", ".", ", ", "\n", '" '])).alias("text"))


def proposals(text: Column) -> dict[str, Column]:
    return {kind: placed(located(text, pattern)) for kind, pattern in LOOSE.items()}


def matches(pattern: str, marks: tuple[str, ...] = (), make: Callable[[Column], Column] = lambda items: items) -> Column:
    """``make`` of the ``located`` matches in ``text``. Most texts hold none: a look for a mark, or for the first match,
    spares them the rest."""
    may = F.rlike("text", F.lit(pattern))
    if marks:
        may = any_of([F.contains("text", F.lit(m)) for m in marks]) & may
    return F.when(may, make(located(F.col("text"), pattern)))


def corpus_rows(texts: DataFrame) -> DataFrame:
    """(held, label, x, n): how many matches of the base patterns in all ``texts`` have the features x, labelled by their
    checks. Equal texts are on the same side of ``held``."""

    def example(kind: str):
        return lambda x: F.struct(base_holds(kind, x["hit"]).cast("double").alias("label"), F.struct(*[c.alias(n) for n, c in features(kind, x).items()]).alias("x"))

    none = F.array().cast(f"array<struct<label:double,x:struct<{','.join(f'{n}:double' for n in FEATURES)}>>>")
    labelled = [F.coalesce(F.transform(matches(pattern, MARKS["base"].get(kind, ())), example(kind)), none) for kind, pattern in BASE.items()]
    return texts.select(held_out(F.xxhash64("text")).alias("held"), F.inline(F.concat(*labelled))).groupBy("held", "label", "x").agg(F.count("*").alias("n"))


def held_out(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), id_), F.lit(3)) == 0


def model(texts: DataFrame) -> tuple:
    """(trees, weights, thresholds): nested tuples of the boosted trees and each kind's threshold on their sum.

    Rows are counted by side, label and features. Lines weigh one each; matches in the documents weigh one each too, or all
    together CORPUS_WEIGHT if they are more, so that the documents' size does not drown the lines. A threshold is the
    lowest score on held-out rows from which on the precision is PRECISION; a kind that never gets there
    adds nothing. The held-out scores are counted by their values, of which trees have few, so what is
    collected is bounded.
    """
    spark = texts.sparkSession
    found = training_lines(spark).select("id", "label", F.explode(F.concat(*[featured(kind, spans) for kind, spans in proposals(F.col("text")).items()])).alias("x"))
    # a line's other proposals, of other kinds than the one it was made for, are no examples
    lines = found.where(F.col("x.kind") == F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(KINDS)))).select(held_out(F.col("id")).alias("held"), "label", "x")
    both = lines.withColumns({"own": F.lit(1).cast("bigint"), "met": F.lit(0).cast("bigint")}).unionByName(corpus_rows(texts).select("held", "label", "x", F.lit(0).cast("bigint").alias("own"), F.col("n").alias("met")))
    counted = cut(both.groupBy("held", "label", "x").agg(F.sum("own").alias("own"), F.sum("met").alias("met")))
    size, met = counted.agg(F.count("*"), F.sum("met")).first()
    share = min(1.0, CORPUS_WEIGHT / max(met or 0, 1))
    weighed = counted.select("held", "label", "x.*", "own", "met", (F.col("own") + F.col("met") * share).alias("weight"))
    # the partitions' number and order go by the rows alone, so that sums of floats agree between reruns
    rows = cut(weighed.repartition(max(4, size // EACH), "held", "label", *FEATURES).sortWithinPartitions("held", "label", *FEATURES))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, featuresCol="features", labelCol="label", weightCol="weight").fit(rows.where("not held"))

    def nested(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), nested(node.leftChild()), nested(node.rightChild())

    trees, weights = [nested(t._call_java("rootNode")) for t in fitted.trees], [float(w) for w in fitted.treeWeights]
    columns = {n: F.col(n) for n in FEATURES}
    scored = rows.where("held").select("kind", "label", "own", "met", F.round(score(columns, trees, weights), 6).alias("s"))
    sums = [F.sum("own").alias("own"), F.sum("met").alias("met"), F.sum(F.when(F.col("label") == 1, F.col("own")).otherwise(0)).alias("good_own"), F.sum(F.when(F.col("label") == 1, F.col("met")).otherwise(0)).alias("good_met")]
    counts = scored.groupBy("kind", "s").agg(*sums).orderBy("kind", F.desc("s")).collect()
    thresholds = {}
    for k, kind in enumerate(KINDS):
        n, good, best = 0.0, 0.0, None
        for r in (r for r in counts if r["kind"] == k):
            n, good = n + r["own"] + r["met"] * share, good + r["good_own"] + r["good_met"] * share
            if good / n >= PRECISION:
                best = r["s"] - 1e-6
        thresholds[kind] = best
    return trees, weights, thresholds


def score(columns: dict[str, Column], trees: list, weights: list[float]) -> Column:
    """The boosted sum as an expression of the features."""

    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(columns[FEATURES[feature]] <= threshold, walk(left)).otherwise(walk(right))

    return sum((F.lit(w) * walk(t) for t, w in zip(trees[1:], weights[1:])), F.lit(weights[0]) * walk(trees[0]))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def apart(base: Column, more: Column) -> Column:
    """Of the proposals ``more`` those that overlap no base span and no proposal kept before them, in one sweep by start.

    The sweep goes in steps of STEP spans, so that its work grows nearly in proportion to their number."""
    marked = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end")))
    nothing = F.lit(None).cast("struct<start:int,kind:int,end:int>")
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        last, own = acc["last"], x["own"] == 1
        over = F.coalesce(last["end"] > x["start"], F.lit(False))
        takes = own & (x["start"] >= acc["at"]) & ~over
        moved = takes | (~own & ~over)
        out = F.when(moved & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"])
        after = F.when(takes, F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).when(own, last).otherwise(nothing)
        return F.struct(F.when(own, acc["at"]).otherwise(F.greatest(acc["at"], x["end"])).alias("at"), after.alias("last"), out.alias("out"))

    def stride(acc: Column, part: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), acc["last"].alias("last"), none.alias("out"))
        done = lambda inner: F.struct(inner["at"].alias("at"), inner["last"].alias("last"), F.concat(acc["done"], F.array(inner["out"])).alias("done"))
        return F.aggregate(part, first, step, done)

    both = F.array_sort(F.concat(marked(base, 0), marked(more, 1)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / STEP).cast("int")), lambda i: F.slice(both, i * STEP + 1, STEP))
    first = F.struct(F.lit(0).alias("at"), nothing.alias("last"), F.array().cast(f"array<{SPANS}>").alias("done"))
    end = lambda acc: F.concat(F.flatten(acc["done"]), F.when(acc["last"].isNotNull(), F.array(acc["last"])).otherwise(none))
    return F.when(F.size(more) == 0, none).otherwise(F.aggregate(parts, first, stride, end))


def find_spans(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base, spans (and ``carry``): arrays of struct(start, kind, end), kind a place in KINDS."""
    trees, weights, thresholds = model(df.select(F.col(f"`{text}`").alias("text")).where("length(text) > 0"))
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in carry])
    none = F.array().cast(SPANS)

    def chosen(column: str, kind: str, holds) -> Column:
        place = F.lit(KINDS.index(kind))
        return F.transform(F.filter(column, holds), lambda x: F.struct(x["start"].alias("start"), place.alias("kind"), x["end"].alias("end")))

    def holds_base(kind: str):
        return lambda x: base_holds(kind, x["hit"])

    def holds_score(kind: str):
        return lambda x: score(features(kind, x), trees, weights) >= thresholds[kind]

    for kind, pattern in BASE.items():
        slim = slim.withColumn(f"_{kind}", matches(pattern, MARKS["base"].get(kind, ()), placed))
    loose = [kind for kind in KINDS if thresholds[kind] is not None]
    for kind in loose:
        slim = slim.withColumn(f"_more_{kind}", matches(LOOSE[kind], MARKS["loose"].get(kind, ()), placed))
    base = [F.coalesce(chosen(f"_{kind}", kind, holds_base(kind)), none) for kind in BASE]
    wanted = [F.coalesce(chosen(f"_more_{kind}", kind, holds_score(kind)), none) for kind in loose]
    out = slim.select("doc_id", "text", *[F.col(f"`{c}`") for c in carry], F.array_sort(F.concat(*base)).alias("base"), F.concat(*wanted, none).alias("more"))
    return out.withColumn("spans", F.array_sort(F.concat("base", apart(F.col("base"), F.col("more"))))).drop("more")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def digest(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, spans (all of them, base and added) as listed(), and
    n_added, the number of added spans."""
    found = find_spans(df, doc_id=doc_id, text=text)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)


def redacted(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows, with all their columns, with every span of ``text`` replaced by its kind's name in brackets."""
    others = tuple(c for c in df.columns if c not in (doc_id, text))
    found = find_spans(df, doc_id=doc_id, text=text, carry=others)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)), F.lit("]"))
        part = F.array(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), mark)
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))), "")
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", start, step, rest))
    out = found.withColumn("_clean", clean)
    size = F.char_length("_clean").cast("bigint")
    pick = {doc_id: F.col("doc_id"), text: F.col("_clean"), n_chars: size}
    return out.select([(pick[c] if c in pick else F.col(f"`{c}`")).alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: personal data in whole texts of ``documents``."""
    return digest(table(spark, sf_dir, "documents"))
