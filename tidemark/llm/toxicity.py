"""Toxicity by a counterfactual-regularised classifier.

A text's margin is a bias plus what each of its different words adds; a word adds the weights of
itself and of its character n-grams as far as they exceed FLOOR, so that length alone makes no text
toxic. The weights are fitted in numpy to the labels, with a penalty on the squared change of the
margin when terms in a labelled text are swapped for others of the same kind: identity terms of four
languages, and stand-ins for them, words of the learned texts that both labels use about as often.
What a text says about a group, not which group it names, decides.

It learns from a bounded sample: at most SAMPLE labelled rows of any length, drawn by a hash of the id
with both labels alike, of those outside the held-out fold; of an id labelled both ways the greater
label counts. Where not both labels have a text, nothing is learned: all scores are 0.5 and, by the
rule that 0.5 is enough, predicted 1. All texts are scored whole, in their row; nothing is shuffled
but the labels. Null text is empty text and gets the bias's score. Repeated rows score alike, null ids
are kept, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_bucket, narrow, table, texts_mapped

FOLDS, HELD_OUT = 5, 0
SAMPLE = 3000
#: Identity terms by kind; a swap puts another term of the same list in place of one.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "transgender", "heteros"),
    ("türken", "deutsche", "polen", "araber", "syrer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "français"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "españoles"),
)
KIND = {term: kind for kind in IDENTITY for term in kind}
#: Lengths of n-grams; how many labelled texts a part must occur in, about; the evidence below which a word adds nothing.
GRAMS, RARE, FLOOR = (4, 5), 10, 0.5
#: Stand-ins: least letters, least texts of either label, most ratio between the labels' rates, terms of a kind.
LETTERS, COMMON, EVEN, GROUP = 4, 5, 3.0, 4
SWAPS, PENALTY, DECAY, STEPS, RATE = 3, 5.0, 2e-3, 90, 0.15
#: Words each worker remembers before it starts afresh.
REMEMBERED = 300_000
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def parts_of(word: str) -> set[str]:
    """The word itself (between marks) and its n-grams, marks included."""
    marked = f"<{word}>"
    return {marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}


def swapped(words: set[str], turn: int, kinds: dict[str, tuple[str, ...]]) -> set[str]:
    """The words with every term of a kind replaced by the one ``turn`` places on in its kind."""
    return {kinds[w][(kinds[w].index(w) + turn) % len(kinds[w])] if w in kinds else w for w in words}


class Incidence:
    """Rows of places, for sums over rows and back."""

    def __init__(self, rows: Iterator[list[int]], width: int):
        sizes, at = array("i"), array("i")
        for row in rows:
            sizes.append(len(row))
            at.extend(row)
        self.sizes, self.at, self.width = np.array(sizes), np.array(at), width
        self.of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, values[self.at], len(self.sizes))

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.of], self.width)


class Model:
    """Bias and weights of words and n-grams."""

    def __init__(self, bias: float = 0.0, weights: dict[str, float] | None = None):
        self.bias, self.weights, self._known = bias, weights or {}, {}

    def adds(self, word: str) -> float:
        known = self._known.get(word)
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            weight = self.weights.get
            known = self._known[word] = max(0.0, sum(weight(p, 0.0) for p in parts_of(word)) - FLOOR)
        return known

    def score(self, text: str) -> float:
        margin = self.bias + sum(map(self.adds, sorted(words_of(text))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_known": {}}


def stand_ins(bags: list[set[str]], labels: list[int]) -> list[tuple[str, ...]]:
    """Kinds of words of the learned texts that name things without a judgement: words of LETTERS letters or
    more that texts of both labels use about as often, grouped with those of the nearest frequency."""
    sizes = Counter(labels)
    used = {label: Counter(w for bag, mark in zip(bags, labels) if mark == label for w in bag) for label in (0, 1)}
    rates = {w: (used[0][w] / sizes[0], n / sizes[1]) for w, n in used[1].items() if len(w) >= LETTERS and min(n, used[0][w]) >= COMMON}
    even = sorted((w for w, (a, b) in rates.items() if max(a, b) <= EVEN * min(a, b)), key=lambda w: (-sum(rates[w]), w))
    return [tuple(even[k : k + GROUP]) for k in range(0, len(even) - 1, GROUP)]


def counterfactuals(bags: list[set[str]], labels: list[int]) -> list[tuple[int, set[str]]]:
    """(place of a text, its words after a swap): SWAPS swaps of identity terms, one of the learned stand-ins."""
    found = {term: kind for kind in stand_ins(bags, labels) for term in kind if term not in KIND}
    pairs = [(k, swapped(bag, turn, KIND)) for k, bag in enumerate(bags) for turn in range(1, SWAPS + 1) if not bag.isdisjoint(KIND)]
    return pairs + [(k, swapped(bag, 1, found)) for k, bag in enumerate(bags) if not bag.isdisjoint(found)]


def mean_change(model: Model, bags: list[set[str]], pairs: list[tuple[int, set[str]]]) -> float:
    """Root of the mean squared margin change under the swaps."""
    total = lambda words: sum(map(model.adds, words))
    return math.sqrt(sum((total(bags[k]) - total(other)) ** 2 for k, other in pairs) / max(1, len(pairs)))


def fitted(bags: list[set[str]], labels: list[int], *, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Adam on the logistic loss plus ``penalty`` times the squared margin change under swaps."""
    pairs = counterfactuals(bags, labels)
    words = sorted(set().union(*bags, *(bag for _, bag in pairs)))
    place = {w: k for k, w in enumerate(words)}
    held, seen = Counter(w for bag in bags for w in bag), Counter()
    for word, n in held.items():
        for p in parts_of(word):
            seen[p] += n
    names = sorted(p for p, n in seen.items() if n >= RARE)
    index = {p: k for k, p in enumerate(names)}
    seen.clear()
    grams = Incidence((sorted(index[p] for p in parts_of(w) if p in index) for w in words), len(names))
    docs = Incidence(([place[w] for w in sorted(bag)] for bag in bags), len(words))
    turned = Incidence(([place[w] for w in sorted(bag)] for _, bag in pairs), len(words))
    source = np.array([k for k, _ in pairs], dtype=np.int64)
    y = np.array(labels, dtype=float)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta, bias = np.zeros(len(names) + 1), -1.0
    theta[:-1] = 0.01
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        raw = grams.sums(theta[:-1]) - FLOOR
        value = np.maximum(raw, 0)
        margin = theta[-1] + docs.sums(value)
        slope = balance * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)
        change = docs.sums(value)[source] - turned.sums(value) if len(pairs) else np.zeros(0)
        push = 2 * penalty * change / max(1, len(pairs))
        to_words = loss = docs.back(slope)
        if len(pairs):
            to_words = loss + docs.back(np.bincount(source, push, len(bags))) - turned.back(push)
        # at first, a word without evidence yet still learns when the loss asks for more
        to_parts = np.where(raw > 0, to_words, np.where((loss < 0) & (step <= steps // 2), loss, 0))
        grad = np.append(grams.back(to_parts), slope.sum())
        grad[:-1] += DECAY * theta[:-1]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= RATE * min(1.0, 1.6 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(float(theta[-1]), {p: float(w) for p, w in zip(names, theta[:-1]) if abs(w) > 1e-4})


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[set[str]], list[int]]:
    """Word sets and labels of at most SAMPLE rows; both labels alike as far as there are rows."""
    marks = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], []
    size = F.when(F.col("label") == 1, float(counts[1])).otherwise(float(counts[0]))
    order = -F.ln(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 31)) / float(1 << 31) + 1e-12) * size
    # about four times SAMPLE ids come below this bound, however many there are: few enough to broadcast
    few = marks.select("doc_id", "label", order.alias("order")).where((F.col("order") <= 2.0 * SAMPLE) & (fold_bucket("doc_id", FOLDS) != HELD_OUT))
    taught = docs.where("length(text) > 0").join(F.broadcast(few), "doc_id")
    drawn = taught.select("label", "order", "text").orderBy("order", "text", "label").limit(SAMPLE)
    rows = texts_mapped(drawn, "text", "words string", lambda texts: [[" ".join(sorted(words_of(t))) for t in texts]]).collect()
    rows.sort(key=lambda r: (r["order"], r["words"], r["label"]))
    return [set(r["words"].split()) for r in rows], [int(r["label"]) for r in rows]


def classify(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted. ``labels`` has doc_id and ``label``."""
    spark = df.sparkSession
    docs = narrow(df, doc_id=doc_id, text=text)
    bags, marks = sample(docs, narrow(labels, doc_id=doc_id, label=label))
    shared = spark.sparkContext.broadcast(fitted(bags, marks) if len(set(marks)) == 2 else Model())

    def work(values: list[str]) -> list:
        scores = [shared.value.score(t) for t in values]
        return [scores, [int(x >= 0.5) for x in scores]]

    slim = docs.select("doc_id", (fold_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return texts_mapped(slim, "text", "score double, predicted int", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: toxicity of every whole text of ``documents``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
