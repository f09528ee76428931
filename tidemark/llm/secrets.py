"""Secrets by fixed patterns and by sliding-window Shannon entropy.

Base spans come from fixed patterns and checks and always stay: assignments to names such as ``token``,
access keys and hexadecimal runs. Beside them every maximal run of a character class is a candidate. A
window of WIDTH characters slides over it; the counts of its characters change by one that enters and
one that leaves, so the sum of c * log2(c), and with it the window's Shannon entropy, is kept up in a
constant number of steps, in whole numbers so that no rounding adds up. Windows with at least their
class's entropy and with both letters and digits are joined where they touch or overlap, which gives the
added spans. A candidate that the allow-list knows (identifiers and digests that say what they are,
addresses, sample values, alphabets, or a value named by the caller) adds nothing.

An added span that lies within a base span, or within a longer added one, is left out. Kinds are listed
in the order of KINDS, offsets count code points, ends are exclusive. Null text is empty text: no spans.
Rows are independent: repeated rows and null ids are kept, an empty table gives an empty table, only the
named columns are read. Work grows with a text's length, and whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, table, texts_mapped

KINDS = ("assign", "access", "hex", "hexadecimal", "alphanumeric", "encoded")
#: Base patterns with the least size of the group that is measured.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: A text without any of these, in lower case, holds no match of the kind; "" is in every text.
MARKS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "hex": ("",)}
#: Character classes of candidates and the least bits of a window of each.
CLASSES = {"hexadecimal": ("0-9A-Fa-f", 2.9), "alphanumeric": ("A-Za-z0-9", 3.7), "encoded": ("A-Za-z0-9+/_=-", 3.8)}
WIDTH = 20
#: Any candidate lies in a run of this.
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WIDTH},}}")
PARTS = {kind: re.compile(f"[{letters}]{{{WIDTH},}}") for kind, (letters, _) in CLASSES.items()}
#: Characters before a candidate that the allow-list looks at.
CONTEXT = 64
#: Candidates of these forms are no secrets.
ALLOWED_RUN = re.compile(
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"  # identifiers in their usual form
    r"|(?i:example|sample|dummy|placeholder|changeme|xxxxxx)"
    r"|0123456789|9876543210|(?i:abcdefghijkl|qwertyuiop)"
)
#: Candidates after these are addresses, embedded files or digests that say so.
ALLOWED_BEFORE = re.compile(r"(?:https?|ftp|file)://\S*$|;base64,$|(?i:\b(?:sha-?(?:1|224|256|384|512)|md5|checksum|digest|etag|integrity|commit|revision)\b[\"']?\s?[:=(-]?\s?[\"']?)$")

#: c * log2(c) in whole units.
UNIT = 1 << 24
WEIGHT = [0] + [round(c * log2(c) * UNIT) for c in range(1, WIDTH + 1)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the matches that pass."""
    folded, out = text.lower(), []
    for place, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if any(mark in folded for mark in MARKS[kind]):
            out += [(m.start(), place, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def entropies(run: str) -> Iterator[tuple[int, int]]:
    """(start, WIDTH * entropy in units) of every window of a run of ASCII characters."""
    counts, total = [0] * 128, 0
    codes = run.encode("ascii")
    for end, code in enumerate(codes, 1):
        have = counts[code]
        counts[code] = have + 1
        total += WEIGHT[have + 1] - WEIGHT[have]
        if end >= WIDTH:
            start = end - WIDTH
            yield start, WEIGHT[WIDTH] - total
            have = counts[codes[start]]
            counts[codes[start]] = have - 1
            total -= WEIGHT[have] - WEIGHT[have - 1]


def dense(run: str, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` of at least ``bits`` a character that hold both letters and digits."""
    out: list[tuple[int, int]] = []
    least, digits = round(bits * WIDTH * UNIT), [0]
    for c in run:
        digits.append(digits[-1] + c.isdigit())
    letters = [0]
    for c in run:
        letters.append(letters[-1] + c.isalpha())
    for start, amount in entropies(run):
        end = start + WIDTH
        if amount >= least and digits[end] > digits[start] and letters[end] > letters[start]:
            if out and start <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((start, end))
    return out


def allowed(text: str, start: int, end: int, values: frozenset[str]) -> bool:
    run = text[start:end]
    return run in values or bool(ALLOWED_RUN.search(run) or ALLOWED_BEFORE.search(text[max(0, start - CONTEXT) : start]))


def added_spans(text: str, values: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, int]], int]:
    """Spans of dense windows as (start, place, end), and in how many runs the allow-list kept more out."""
    out, kept_out = [], 0
    for run in RUN.finditer(text):
        at, piece, known = run.start(), run.group(), False
        for kind, pattern in PARTS.items():
            for part in pattern.finditer(piece):
                found = dense(part.group(), CLASSES[kind][1])
                if found and (allowed(text, at, run.end(), values) or allowed(text, at + part.start(), at + part.end(), values)):
                    known = True
                else:
                    begin = at + part.start()
                    out += [(begin + s, KINDS.index(kind), begin + e) for s, e in found]
        kept_out += known
    return out, kept_out


def spans_of(text: str, values: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, int]], int]:
    """All spans by start and kind, and the number of runs in which the allow-list kept some out."""
    base = base_spans(text)
    more, kept_out = added_spans(text, values)
    # base spans first, then longer before shorter: a span within an earlier one ends no later than the furthest that starts before it
    order = sorted([(s, -e, 0, k) for s, k, e in base] + [(s, -e, 1, -k) for s, k, e in more])
    out, furthest = list(base), -1
    for start, end, own, kind in order:
        if own and -end > furthest:
            out.append((start, -kind, -end))
        furthest = max(furthest, -end)
    return sorted(out), kept_out


def find_secrets(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans (array of struct(start, kind, end), kind a place in KINDS) and n_allowed, one row for each row."""
    values = frozenset(allow)

    def work(texts: list[str]) -> list[list]:
        found = [spans_of(t, values) for t in texts]
        return [*[[[s[i] for s in spans] for spans, _ in found] for i in range(3)], [n for _, n in found]]

    rows = texts_mapped(narrow(df, doc_id=doc_id, text=text), "text", "start array<int>, kind array<int>, end array<int>, n_allowed bigint", work)
    return rows.select("doc_id", F.arrays_zip("start", "kind", "end").alias("spans"), "n_allowed")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def masked(df: DataFrame, *, text: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """The rows with every secret in ``text`` replaced by ``[SECRET]``; null stays null."""
    values = frozenset(allow)

    def mask(value: str) -> str:
        out, at = [], 0
        for start, _, end in spans_of(value, values)[0]:
            if start >= at:
                out += [value[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join([*out, value[at:]])

    own = [f"c{k}" for k in range(len(df.columns))]  # names of columns are theirs to choose
    place = own[df.columns.index(text)]
    clean = texts_mapped(df.toDF(*own), place, "clean string", lambda texts: [[mask(t) for t in texts]], keep_text=True)
    return clean.select([F.when(F.col(c).isNotNull(), F.col("clean")).alias(name) if c == place else F.col(c).alias(name) for c, name in zip(own, df.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: secrets in whole texts of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base, kinds = F.filter("spans", lambda x: x["kind"] < len(BASE)), F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    n_added = F.size(F.filter("spans", lambda x: x["kind"] >= len(BASE))).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n_added, "n_allowed")
