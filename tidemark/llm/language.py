"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: each direction reads a
segment of bytes with gated recurrent units, every position gets a distribution over languages, and
a document's distribution is the mean over all its positions. Texts are scored whole, in segments;
the work is per row, so nothing is shuffled.

It learns from a bounded sample: at most SAMPLE windows of WINDOW characters, drawn by a hash of id and
text so that languages weigh alike; a language is learned if a window of it is drawn. When it scores,
states start afresh with every READ bytes, so context is never longer. Null or letterless text is
`und` with score 0, and so is everything if no row teaches. Repeated rows score alike, null ids are
kept, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_bucket, narrow, table, texts_mapped

FOLDS, HELD_OUT = 4, 2
SAMPLE, WINDOW = 1600, 1024
HIDDEN, SEGMENT, BATCH, STEPS, RATE = 8, 48, 160, 260, 0.02
#: Segments that are scored at once, and bytes of a segment when scoring.
AT_ONCE, READ = 2048, 64
UND = "und"
#: Most languages whose counts are broadcast; beyond it they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000


def squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One direction's gated units: the update gate z, the reset gate r and the candidate n."""

    def __init__(self, rng: np.random.Generator):
        self.x = {g: rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32) for g in "zrn"}
        self.u = {g: rng.normal(0, 0.3, (HIDDEN, HIDDEN)).astype(np.float32) for g in "zrn"}

    def forward(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """data (time, batch) of bytes -> states (time, batch, HIDDEN)."""
        h = np.zeros((data.shape[1], HIDDEN), dtype=np.float32)
        out = np.empty((*data.shape, HIDDEN), dtype=np.float32)
        with np.errstate(over="ignore"):
            for t, at in enumerate(data):
                z = squash(self.x["z"].take(at, axis=0) + h @ self.u["z"])
                r = squash(self.x["r"].take(at, axis=0) + h @ self.u["r"])
                q = h @ self.u["n"]
                n = squash(2 * (self.x["n"].take(at, axis=0) + r * q))
                n *= 2
                n -= 1
                if keep is not None:
                    keep.append((h, z, r, q, n))
                h = h + z * (n - h)
                out[t] = h
        return out

    def backward(self, data: np.ndarray, kept: list, slopes: np.ndarray) -> tuple[dict, dict]:
        """Gradients of x and u from the slopes of the states, back through time."""
        du = {g: np.zeros_like(m) for g, m in self.u.items()}
        sent = {g: np.empty_like(slopes) for g in "zrn"}
        dh = np.zeros_like(slopes[0])
        for t in range(len(data) - 1, -1, -1):
            h, z, r, q, n = kept[t]
            dh = dh + slopes[t]
            an = dh * z * (1 - n * n)
            az = dh * (n - h) * z * (1 - z)
            ar = an * q * r * (1 - r)
            for g, a in (("z", az), ("r", ar), ("n", an * r)):
                du[g] += h.T @ a
            dh = dh * (1 - z) + az @ self.u["z"].T + ar @ self.u["r"].T + (an * r) @ self.u["n"].T
            sent["z"][t], sent["r"][t], sent["n"][t] = az, ar, an
        at = data.ravel()
        dx = {g: np.stack([np.bincount(at, s[..., k].ravel(), 256) for k in range(HIDDEN)], 1).astype(np.float32) for g, s in sent.items()}
        return dx, du


class Network:
    """Both directions and the layer that labels every position."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.ahead, self.back = labels, Direction(rng), Direction(rng)
        self.w = rng.normal(0, 0.3, (2 * HIDDEN, len(labels))).astype(np.float32)
        self.b = np.zeros(len(labels), dtype=np.float32)

    def states(self, data: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        first, second = keep or (None, None)
        return np.concatenate([self.ahead.forward(data, first), self.back.forward(data[::-1], second)[::-1]], axis=2)

    def positions(self, states: np.ndarray) -> np.ndarray:
        """A distribution over the labels at every position."""
        p = states.reshape(-1, 2 * HIDDEN) @ self.w
        p += self.b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(*states.shape[:2], -1)

    def train(self, texts: list[bytes], targets: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam on the cross-entropy of every position; each label is drawn as often as the others."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(targets == k) for k in range(len(self.labels))]
        some = [k for k, r in enumerate(rows) if len(r)]
        params = [d for side in (self.ahead, self.back) for m in (side.x, side.u) for d in m.values()] + [self.w, self.b]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            goal = rng.choice(some, BATCH)
            data, held = np.zeros((SEGMENT, BATCH), dtype=np.uint8), np.zeros((SEGMENT, BATCH), dtype=np.float32)
            for k, label in enumerate(goal):
                text = texts[rng.choice(rows[label])]
                start = rng.integers(0, max(1, len(text) - SEGMENT // 2))
                part = text[start : start + int(rng.integers(8, SEGMENT + 1))]
                data[: len(part), k], held[: len(part), k] = np.frombuffer(part, dtype=np.uint8), 1
            keep: tuple[list, list] = ([], [])
            states = self.states(data, keep)
            slope = self.positions(states)
            slope[:, np.arange(BATCH), goal] -= 1
            slope *= held[..., None] / held.sum()
            flat = slope.reshape(-1, len(self.labels))
            back = (flat @ self.w.T).reshape(states.shape)
            grads = []
            for side, kept, read, part in ((self.ahead, keep[0], data, back[..., :HIDDEN]), (self.back, keep[1], data[::-1], back[::-1, :, HIDDEN:])):
                dx, du = side.backward(read, kept, np.ascontiguousarray(part))
                grads += [*dx.values(), *du.values()]
            grads += [states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)]
            rate = RATE * min(1.0, 1.5 - step / steps)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For non-empty texts: the mean over all positions, read in segments of READ bytes."""
        sums, owner, parts = np.zeros((len(texts), len(self.labels))), [], []
        sizes = np.array([len(t) for t in texts])

        def flush() -> None:
            rows = np.concatenate(parts)
            of = np.concatenate(owner)
            for at in range(0, len(rows), AT_ONCE):
                some, to = rows[at : at + AT_ONCE], of[at : at + AT_ONCE]
                p = self.positions(self.states(np.ascontiguousarray(some[:, :READ].T)))
                p *= (np.arange(READ)[:, None] < some[:, READ])[..., None]
                np.add.at(sums, to, p.sum(axis=0))
            owner.clear()
            parts.clear()

        held = 0
        for k, text in enumerate(texts):
            n = -(-len(text) // READ)
            block = np.zeros((n, READ + 1), dtype=np.uint8)
            block[:, READ] = READ
            block[-1, READ] = len(text) - (n - 1) * READ
            padded = np.zeros(n * READ, dtype=np.uint8)
            padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
            block[:, :READ] = padded.reshape(n, READ)
            parts.append(block)
            owner.append(np.full(n, k))
            held += n
            if held >= 2 * AT_ONCE:
                flush()
                held = 0
        if held:
            flush()
        return sums / sizes[:, None]


def sample(docs: DataFrame) -> tuple[list[str], list[bytes], list[str]]:
    """(labels, windows of text, label of each window), at most SAMPLE of them."""
    taught = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold_bucket("doc_id", FOLDS) != HELD_OUT))
    counts = taught.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    luck = lambda name: F.pmod(F.xxhash64(F.lit(name), "doc_id", "text"), F.lit(1 << 31)) / float(1 << 31)
    size = F.char_length("text")
    start = (1 + luck("place") * F.greatest(F.lit(1), size - WINDOW)).cast("int")
    parts = taught.select("lang", "doc_id", (-F.ln(luck("draw") + 1e-12)).alias("luck"), F.substring(F.col("text"), start, F.lit(WINDOW)).alias("part"))
    side = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    # about twice SAMPLE rows come below this bound, however many there are, so few are sent to the driver
    drawn = parts.join(side, "lang").withColumn("order", F.col("luck") * F.col("n")).where(F.col("order") <= 2.0 * SAMPLE / max(1, languages))
    rows = [r for r in drawn.select("lang", "doc_id", "part", "order").orderBy("order", "doc_id", "part").limit(SAMPLE).collect() if r["part"]]
    return sorted({r["lang"] for r in rows}), [r["part"].encode() for r in rows], [r["lang"] for r in rows]


def trained(docs: DataFrame) -> Network | None:
    labels, texts, langs = sample(docs)
    if not texts:
        return None
    net = Network(labels)
    place = {label: k for k, label in enumerate(labels)}
    net.train(texts, np.array([place[x] for x in langs]))
    return net


def detect(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", net: Network | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score (the pooled probability of lang_pred)."""
    docs = narrow(df, doc_id=doc_id, text=text, lang=lang)
    net = net or trained(docs)
    shared = df.sparkSession.sparkContext.broadcast(net)

    slim = docs.select("doc_id", (fold_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return texts_mapped(slim, "text", "lang_pred string, score double", lambda texts: labelled(shared.value, texts))


def labelled(net: Network | None, texts: list[str]) -> list[list]:
    """The label of each text and its pooled probability."""
    label, score = [UND] * len(texts), [0.0] * len(texts)
    rows = [k for k, t in enumerate(texts) if net and any(map(str.isalpha, t))]
    if rows:
        pooled = net.pooled([texts[k].encode() for k in rows])
        best = pooled.argmax(axis=1)
        for k, place, p in zip(rows, best.tolist(), pooled[np.arange(len(rows)), best].tolist()):
            label[k], score[k] = net.labels[place], min(1.0, max(0.0, p))
    return [label, score]


def known_languages(df: DataFrame, least: float, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language with a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(trained(narrow(df, doc_id=doc_id, text=text, lang=lang)))

    def work(texts: list[str]) -> list:
        return [[name != UND and p >= least for name, p in zip(*labelled(shared.value, texts))]]

    return texts_mapped(df, text, "_known boolean", work, keep_text=True).where("_known").drop("_known")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the language of every whole text of ``documents``."""
    return detect(table(spark, sf_dir, "documents"))
