"""Secret scans, source divergence and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import divergence, lexical, queries, secrets
from tidemark.llm.common import split_words


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def brute_spans(text):
    """Every window measured from scratch, every span held against every other."""
    kinds = secrets.KINDS
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    added = []
    for kind, (letters, bits) in secrets.CLASSES.items():
        for run in re.finditer(f"[{letters}]+", text):
            if len(run.group()) < secrets.WIDTH:
                continue
            whole = next(m for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if m.start() <= run.start() and run.end() <= m.end())
            if any(secrets.allowed(text, m.start(), m.end(), frozenset()) for m in (whole, run)):
                continue
            marked = [False] * len(text)
            ends = []
            for s in range(run.start(), run.end() - secrets.WIDTH + 1):
                w = text[s : s + secrets.WIDTH]
                if entropy(w) >= bits - 1e-9 and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                    ends.append((s, s + secrets.WIDTH))
            for s, e in ends:
                marked[s:e] = [True] * (e - s)
            joined = []
            for s, e in ends:
                if joined and s <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], e)
                else:
                    joined.append((s, e))
            added += [(s, kinds.index(kind), e) for s, e in joined]
    out = list(base)
    for s, k, e in added:
        within = any(bs <= s and e <= be for bs, _, be in base)
        longer = any(a <= s and e <= b and ((b - a) > (e - s) or ok > k) for a, ok, b in added if (a, ok, b) != (s, k, e))
        if not within and not longer:
            out.append((s, k, e))
    return sorted(out)


def random_text(rng):
    parts = []
    for _ in range(rng.randint(0, 8)):
        kind = rng.randint(0, 9)
        if kind < 3:
            parts.append("".join(rng.choices("ABCDEFabcdef0123456789", k=rng.randint(10, 60))))
        elif kind < 5:
            parts.append("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", k=rng.randint(10, 90))))
        elif kind == 5:
            parts.append(rng.choice(["token", "API_key", "passwd", "Secret", "password"]) + rng.choice([" = ", ":", '": "', "  =  '"]) + "".join(rng.choices("abcXYZ0123.", k=rng.randint(2, 20))))
        elif kind == 6:
            parts.append("AKIA" + "".join(rng.choices("ABCXYZ0123", k=rng.randint(10, 20))))
        elif kind == 7:
            parts.append(rng.choice(["sha256: ", "https://a.b/", "commit ", "é"]) + "".join(rng.choices("abcdef0123456789XYZ", k=rng.randint(20, 50))))
        else:
            parts.append(rng.choice(["plain words here", "ab" * 20, "Donaudampfschifffahrtsgesellschaft", "1234567890" * 3]))
    return rng.choice([" ", "", "\n", "-"]).join(parts)


def test_secret_spans_equal_brute_force():
    rng = random.Random(11)
    some = [random_text(rng) for _ in range(400)]
    assert sum(any(k > 2 for _, k, _ in brute_spans(t)) for t in some) > 50
    for text in some:
        assert secrets.spans_of(text)[0] == brute_spans(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefABCXYZ0129+/_-=", min_size=secrets.WIDTH, max_size=70))
def test_incremental_entropy_equals_entropy_of_each_window(run):
    for start, amount in secrets.entropies(run):
        assert abs(amount / secrets.UNIT / secrets.WIDTH - entropy(run[start : start + secrets.WIDTH])) < 1e-6


def test_added_secrets_and_allow_list():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCY9dQk4Zt"
    (start, kind, end), *more = secrets.spans_of(f"key {key} end")[0]
    assert (start, end) == (4, 4 + len(key)) and secrets.KINDS[kind] in ("alphanumeric", "encoded") and not more
    for clean in (
        "123e4567-e89b-12d3-a456-426614174000",
        "digest: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
        f"https://example.org/a/{key}",
        "EXAMPLE" + key,
        "0123456789abcdefghijklmnopqrstuvwxyz",
        "Rindfleischetikettierungsueberwachungsaufgabenuebertragungsgesetz",
        "4111111111111111111111111",
    ):
        assert all(k < 3 for _, k, _ in secrets.spans_of(clean)[0]), clean
    assert secrets.spans_of(f"key {key}", frozenset([key])) == ([], 1)


def test_secrets_rows(spark):
    long = "words and words " * 200_000 + "token = abcdef1234"
    rows = [(1, "token = abcdef", "x"), (1, "token = abcdef", "x"), (None, None, "y"), (2, "", "z"), (3, long, "z"), (4, "é😀 passwd: geheim99", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = {(r["doc_id"], len(r["spans"])): [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(df).collect()}
    assert found[1, 1] == [(0, 0, 14)] and found[None, 0] == [] and found[2, 0] == []
    assert found[3, 1] == [(len(long) - 18, 0, len(long))] and found[4, 1] == [(3, 0, 19)]
    masked = secrets.masked(df).collect()
    assert [r["text"] for r in masked if r["doc_id"] == 2] == [""] and {r["text"] for r in masked if r["doc_id"] == 1} == {"[SECRET]"}
    assert [r["text"] for r in masked if r["doc_id"] is None] == [None] and masked[0].asDict().keys() == {"doc_id", "text", "spans"}
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_secret_query_counts_and_digests(spark, sf01):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    rows = secrets.query(spark, sf01).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 0
    for r in rows:
        spans = brute_spans(texts[r["doc_id"]])
        text = lambda of: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in of)
        assert r["spans"] == text(spans)
        assert r["base_sha256"] == hashlib.sha256(text([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


def brute_audit(rows):
    """(lang, source, part, item, value, rank) in plain Python."""
    holders, counts, groups = defaultdict(int), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        for t in set(terms):
            holders[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (own, t), n in holders.items() if own == lang and n >= 3)
        sources = sorted(s for own, s in groups if own == lang)
        share = lambda counter: [1 + 10**9 * (counter[t] + 1) // (sum(counter[k] for k in kept) + len(kept)) for t in kept]
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-((a - b) ** 2 // b), t) for a, b, t in zip(p[s], q, kept) if counts[lang, s][t] and a > b)
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(terms[:200])]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(330)] + ["É", "éa", "日本", "ZZ", "😀"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 300))), rng.choice(["a", "b", None]), rng.choice(["s", "s", "s", "t", "u", None])) for _ in range(60)]
    rows += [rows[0], rows[0], (None, "a", "empty"), ("", "c", "x"), ("once only", "c", "y"), (None, None, None), ("1 2 3", "d", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int")
    expected = brute_audit(rows)
    assert audited(df) == expected
    monkeypatch.setattr(divergence, "FEW", 0)  # languages beyond the limit of a broadcast
    assert audited(df) == expected
    assert audited(df.limit(0)) == []


def test_pair_matrix_in_small_tiles():
    rng = np.random.default_rng(0)
    p = rng.integers(1, 10**9, (7, 50))
    whole = divergence.pair_matrix(p)
    for cells in (1, 3, 7, 50, 200):
        assert (divergence.pair_matrix(p, cells) == whole).all()
    assert divergence.shares(np.array([10**12]), np.array([3 * 10**15]))[0] == 1 + 10**9 * (10**12 + 1) // (3 * 10**15)


@given(st.text(max_size=200), st.integers(1, 30))
def test_words_in_pieces(text, piece):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for table, pattern in ((divergence.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (lexical.WORDS, lexical.TERM)):
        found = [w.decode() for words in split_words(text.encode(), table, piece) for w in words]
        assert found == re.findall(pattern, lowered)


def brute_search(docs, items):
    tokens = lambda t: re.findall(lexical.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(tokens(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(tokens(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in terms.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[: lexical.BEST])]
    return sorted(out, key=repr)


def searched(docs, items):
    return sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(80)] + ["Éa", "日本", "a1b2", "common", "common", "common"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(3, "common w1"), (3, "common w1"), (None, "w1 w2 w3"), (None, None), (900, ""), (901, "W1-w1.W1"), (902, "zz " * 400_000 + "w1")]
    items = [(1, "w1 w2 w2 common"), (2, "Éa 日本 nothing"), (3, None), (4, "absent"), (5, "w5"), (5, "w6 w5"), (None, "w7")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    expected = brute_search(docs, items)
    assert searched(d, i) == expected
    for name, value in (("BLOCK", 7), ("POSTINGS", 40), ("ENTRIES", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(d.repartition(3), i) == expected
    assert searched(d.limit(0), i) == searched(d, i.limit(0)) == []


def test_impacts_beyond_64_bits():
    counts, sizes = np.array([2 * 10**10, 3]), np.array([10**9, 5])
    expected = [(10**9 * c) // (1000 * c + 12 * (75 + (25 * s * 10**12) // 10**15)) for c, s in ((2 * 10**10, 10**9), (3, 5))]
    assert lexical.impacts(counts, sizes, 10**12, 10**15).tolist() == expected


@pytest.mark.parametrize("name", ["op12_divergence", "op13_lexical"])
def test_queries_equal_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = connection.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
