"""Operators across documents: near-duplicates, passages, mixing, top-k and the pipeline."""

import random
import re
import sys
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, components, language, mixing, pii, simhash, substring, topk, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, uid int"


def rows_of(texts, sources=None):
    return [(i, t, "en", sources[i] if sources else "s", len(t or ""), "clash", 7) for i, t in enumerate(texts)]


def reachable(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_encoder_remembers_within_bounds():
    """Two Python workers share an executor's memory with its JVM: words that never end may not take over 90 MB of each."""
    encoder = bpe.Encoder({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    encoder._words.make = lambda word: (1000, 2000, 3000)
    for i in range(990_000):
        encoder._words[f"word{i}"]
    held = [encoder._words, encoder._words.old]
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) for k in d) for d in held) + sum(64 * len(d) for d in held)
    assert sum(map(len, held)) > 100_000 and size < 90e6, size


def test_components_match_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(9, 9)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = reachable({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert out == want
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdÉx") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(1, 60))] for _ in range(40)]
    texts = [None, "", " \t\n", "One two", "one TWO", "a" * 5000]
    for words in base:
        for _ in range(4):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(copy))
    out = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert all(out[i].fingerprint == f"{p:016x}" for i, p in enumerate(prints))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert {i: r.component_id for i, r in out.items()} == reachable(range(len(texts)), near)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_links_lose_nothing(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()]
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 2 for a, b in links)
    near = [(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 2]
    assert reachable(signed, links) == reachable(signed, near)


def test_near_links_over_a_large_group(spark):
    """Hundreds of near copies share the keys of few segment values, beside many loose fingerprints."""
    rng = random.Random(16)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(400)}
        prints |= {centre ^ (rng.getrandbits(32) << 32) for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()]
    whole = np.array(sorted(prints), dtype=np.uint64)
    near = [(i, j) for i, p in enumerate(whole) for j in np.flatnonzero(np.bitwise_count(whole[:i] ^ p) <= 2)]
    assert (np.bitwise_count((np.array(links)[:, 0] ^ np.array(links)[:, 1]).view(np.uint64)) <= 2).all()
    place = {int(p) - (1 << 64) if int(p) >> 63 else int(p): k for k, p in enumerate(whole)}
    assert reachable(range(len(whole)), [(place[u], place[v]) for u, v in links]) == reachable(range(len(whole)), near)


def test_one_of_each_keeps_rows_whole(spark):
    texts = ["the quick brown fox jumps over it", "the quick brown fox jumps over it", "something else entirely was written here", None]
    odd = [(None, "no id at all here", "en", "s", 5, "x", 1), (None, texts[0], "en", "s", 5, "x", 1), (1, "an id that was seen before", "en", "s", 5, "y", 1), (2, texts[2], "de", "r", 5, "x", 1)]
    out = simhash.one_of_each(spark.createDataFrame(rows_of(texts) + odd + [rows_of(texts)[2]], DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 0, texts[0]), (False, 1, odd[2][1]), (False, 2, texts[2]), (False, 3, ""), (True, 0, odd[0][1])]
    assert next(r for r in out if r.doc_id == 2).lang == "de"  # of rows alike in id and text the least by the others
    assert simhash.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 2**53 + 1
    rows = [(big, "the word of it was there", "en", "s", 5, "x", 1), (None, "le mot de la fin", "fr", "s", 5, "x", 1), (big + 2, "the word of it was here", "en", "s", 5, "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(big, 1), (big + 2, 0)], "doc_id bigint, toxic int")
    for out in (simhash.near_duplicates(df), bpe.encode_documents(df), language.detect(df), toxicity.classify(df, labels), language.known_languages(df, 0.0), pii.digest(df)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == {big, big + 2, None}


def water(sizes):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_to = [s for s in sizes if s not in full]
        over = {s for s in open_to if left * weights[s] / sum(weights[x] for x in open_to) > 2 * sizes[s]}
        if not over:
            target |= {s: 2.0 * sizes[s] for s in full} | {s: left * weights[s] / sum(weights[x] for x in open_to) for s in open_to}
            return target
        full |= over


def test_mixing_targets_and_limits(spark):
    rng = random.Random(8)
    sources = [rng.choice(["a", "b", "c", "d", "é", "", None]) if i % 3 else "a" for i in range(600)]
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 5, 90, 300]))) or None for _ in sources] + ["x " * 9000]
    df = spark.createDataFrame(rows_of(texts, [*sources, "b"]), DOCS)
    out = mixing.mix(df).collect()
    sizes, taken = Counter(), Counter()
    source = dict(enumerate([*sources, "b"]))
    for r in out:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = water(dict(sizes))
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame(rows_of([None, ""]), DOCS)).collect()] == [0, 0]


def test_permutation(spark):
    for n in (1, 2, 97, 640):
        out = spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n).cast("bigint"), F.lit(3)).alias("x"))
        assert sorted(r.x for r in out.collect()) == list(range(n))


def test_mixed_documents_take_what_the_plan_says(spark):
    texts = [" ".join(f"w{i}_{k}" for k in range(40 + 13 * i % 200)) for i in range(60)]
    df = spark.createDataFrame(rows_of(texts, ["abc"[i % 3] for i in range(60)]), DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got, words = Counter(), defaultdict(set)
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_mixed_documents_count_rows_not_ids(spark):
    texts = [f"w{i} " * (20 + i % 9) for i in range(90)]
    rows = [(None if i % 3 == 0 else i // 4, t, "en", "abc"[i % 3], len(t), "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(df.withColumnRenamed("fp", "_row")).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.mix(df).collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_top_products_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [list(map(float, rng.normal(0, 1 + 3 * (i % 7 == 0), 8))) for i in range(260)] + [[0.5] * 8] * 60 + [[0.0] * 8] * 5
    rows = [(i, v, "clash") for i, v in enumerate(vectors)]
    rows += [(1001, None, "x"), (1050, [None] * 8, "x"), (1100, [float("nan")] * 8, "x"), (1151, [], "x"), (None, [1.0] * 8, "x")]
    out = topk.top_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n2 string")).collect()
    whole = np.floor(256 * np.array(vectors, dtype=np.float32).astype(float)).astype(int)
    want = set()
    for q in range(0, len(vectors), 50):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in range(len(vectors)) if c != q))[:5]
        want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == want
    assert topk.top_products(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    few = topk.top_products(spark.createDataFrame([(0, [1.0], ""), (1, [2.0], ""), (1, [2.0], "")], "vec_id bigint, embedding array<float>, n2 string")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in few) == [(1, 1, 131072), (2, 1, 131072)]


def test_top_products_stay_exact_for_large_components(spark):
    rng = np.random.default_rng(5)
    for size in (4e5, 1e6, 1e9):
        vectors = [list(map(float, rng.normal(0, size, 6))) for _ in range(120)] + [[size * 1.5]] * 2
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
        whole = [[int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v)) for v in vectors]
        clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        want = set()
        for q in range(0, len(vectors), 50):
            best = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in range(len(vectors)) if c != q)[:5]
            want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df).collect()} == want
    same = spark.createDataFrame([(50, [1.0, 2.0])] * 300, "vec_id bigint, embedding array<double>")
    assert topk.top_products(same).count() == 0


def test_bounds_lose_no_vector_that_reaches():
    rng = np.random.default_rng(2)
    for width, power in ((1, 1), (5, 1), (64, 1), (64, 4), (200, 2)):
        rows = np.floor(256 * rng.normal(0, 1, (600, width)) * rng.random((600, width)) ** power * 10.0 ** rng.integers(-1, 4, (600, 1)))
        rows[:20] = 0
        lengths = np.sqrt((rows * rows).sum(axis=1))
        piece, asked = topk.Piece(np.arange(600), rows, lengths), rng.permutation(600)[:80]
        scores = rows[asked] @ piece.rows.T
        for rank in (1, 5, 60, 400):
            floors = np.sort(scores, axis=1)[:, -rank]
            open_to = piece.open_to(slice(0, 600), rows[asked] / np.maximum(lengths[asked], 1e-300)[:, None], lengths[asked], floors)
            assert open_to[scores >= floors[:, None]].all()


def test_most_products_are_skipped():
    """On the test vectors, all of about the same length, coordinates leave out most products, and no result changes."""
    vectors = np.floor(256 * np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"]).column(0).to_pylist(), dtype=float))
    ids, lengths = np.arange(len(vectors)), np.sqrt((vectors * vectors).sum(axis=1))
    piece, asked = topk.Piece(ids, vectors, lengths), slice(0, None, 50)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(scores)), ids[asked]] = -(1 << 40)
    first = np.sort(scores[:, ::2], axis=1)[:, -5]  # as a sample of half of the rows would give
    found = piece.best(ids[asked], vectors[asked], lengths[asked], first, 5)
    want = {(q, c, int(scores[i, c])) for i, q in enumerate(ids[asked]) for c in np.lexsort((ids, -scores[i]))[:5]}
    assert set(found) == want and piece.computed < 0.35 * piece.possible


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    fresh = lambda n: [word() for _ in range(n)]
    passage, paragraph = fresh(52), fresh(120)
    edited = list(paragraph)
    edited[60] = "changed"
    texts = [" ".join(fresh(40) + passage + fresh(33)), " ".join(fresh(7) + passage + fresh(90)), " ".join(paragraph) + "\n" + " ".join(fresh(80)), " ".join(fresh(20)) + "\n" + " ".join(edited).upper(), " ".join(fresh(200)), None, "", " ".join(fresh(8)) * 2]
    rows = rows_of(texts) + [(None, texts[0], "en", "s", 1, "x", 1)]
    out = substring.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    found = defaultdict(set)
    for r in out:
        found[r.doc_id].add((r.kind, r.cluster_id, r.keep))
        assert texts[r.doc_id][r.start : r.end].strip() == texts[r.doc_id][r.start : r.end]
    assert found[0] == {("passage", 0, True)} and found[1] == {("passage", 0, False)}
    assert ("paragraph", 2, True) in found[2] and ("paragraph", 2, False) in found[3] and set(found) == {0, 1, 2, 3}
    assert substring.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_keep_every_word_once_and_reach_their_ends(spark):
    rng = random.Random(33)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    text, planted = fresh(140), [fresh(51) for _ in range(12)]
    bodies = [text[:81], text, text[60:]] + [fresh(30) + p + fresh(30) for p in planted for _ in range(2)]
    texts = [" ".join(fresh(20) + b + fresh(20)) for b in bodies]
    out = [r for r in substring.repeated_passages(spark.createDataFrame(rows_of(texts), DOCS)).collect() if r.kind == "passage"]
    kept = [set(t.split()) for t in texts]
    for r in out:
        assert r.words == len(texts[r.doc_id][r.start : r.end].split())
        if not r.keep:
            kept[r.doc_id] -= set(texts[r.doc_id][r.start : r.end].split())
    times = Counter(w for words in kept for w in words)
    assert all(times[w] == 1 for t in texts for w in t.split())
    spans = {(r.doc_id, r.keep): texts[r.doc_id][r.start : r.end] for r in out}
    for k, p in enumerate(planted):
        assert spans[3 + 2 * k, True] == spans[4 + 2 * k, False] == " ".join(p)


def test_edits_of_one_paragraph_match_brute_force(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for copies in (240, 60):
        base = fresh(110)
        texts.append(base)
        for _ in range(copies):
            edited = list(base)
            for place in rng.sample(range(5, 105), 2):
                edited[place] = fresh(1)[0]
            texts.append(edited)
    texts += [fresh(110) for _ in range(20)]
    shingles = [set(zip(*(t[i:] for i in range(5)))) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    want = reachable(range(len(texts)), linked)
    sizes = Counter(want.values())
    out = substring.repeated_passages(spark.createDataFrame(rows_of([" ".join(t) for t in texts]), DOCS)).where("kind = 'paragraph'").collect()
    assert {r.doc_id: r.cluster_id for r in out} == {i: c for i, c in want.items() if sizes[c] > 1}


def test_band_recall_on_documents(spark, sf):
    """Components of lines at Jaccard 0.8 or more over all documents, against brute force by shared shingles."""
    assert 1 - (1 - substring.SIMILAR**substring.ROWS) ** substring.BANDS > 0.999
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = defaultdict(list)
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            words = line.encode().lower().split()
            if len(words) >= 5:
                lines[frozenset(zip(*(words[i:] for i in range(5))))].append(r.doc_id)
    sets, holders = list(lines), defaultdict(list)
    for k, shingles in enumerate(sets):
        for x in shingles:
            holders[x].append(k)
    pairs = {(i, j) for held in holders.values() for i in held for j in held if i < j}
    linked = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = reachable(range(len(sets)), linked)
    ids = defaultdict(set)
    for k, shingles in enumerate(sets):
        ids[group[k]] |= set(lines[shingles])
    want = {(min(found), doc) for found in ids.values() if len(found) > 1 for doc in found}
    out = {(r.cluster_id, r.doc_id) for r in substring.repeated_passages(docs).where("kind = 'paragraph'").collect()}
    assert out <= want and len(out & want) >= 0.99 * len(want) and len(want) > 10


def test_crowded_keys_bring_an_id_of_their_own(spark):
    rows = spark.range(1, 20000).selectExpr("id", "explode(array(7, 8, 100 + id)) AS key")
    found = {r.key: (r.low, r.high, r.head) for r in substring.crowded(rows, "id").collect()}
    assert set(found) == {7, 8} and all(low <= head <= high for low, high, head in found.values())
    heads = spark.createDataFrame([(k, v[2]) for k, v in found.items()], "key bigint, id bigint")
    assert rows.join(heads, ["key", "id"]).count() == 2


def test_short_paragraphs_and_clashing_hashes(spark, monkeypatch):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    edited = [*base[:-1], "changed"]  # 10 of 12 shingles in common
    texts = [" ".join(base), "x\n" + " ".join(edited), "a b c d e", "y\na b c d e\nz", "a b c d", "a b c d"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    out = {(r.doc_id, r.cluster_id, r.keep) for r in substring.repeated_passages(df).collect()}
    assert out == {(0, 0, True), (1, 0, False), (2, 2, True), (3, 2, False)}
    units = spark.createDataFrame([(1,), (1,), (2,)], "key bigint")
    monkeypatch.setattr(substring, "lines_of", lambda docs, seed: spark.createDataFrame([(1, "a"), (1, "b" if seed == 42 else "a"), (2, "c"), (2, "d")], "uid bigint, line string"))
    assert substring.clash(df, units, 42) and not substring.clash(df, units, 43)


def test_pipeline_stages_against_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").cache()
    kinds = [t for _, t in docs.dtypes]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.language_id(spark, docs, sf).cache()
    labels = {r.doc_id: r for r in language.detect(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in labels.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    one = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, c in groups.items() if i == c}
    clean = corpus_pipeline.personal_data(spark, one, sf).cache()
    spans = {r.doc_id: [(x.start, x.end, pii.KINDS[x.kind]) for x in r.spans] for r in pii.find_spans(one).collect()}
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        out, at = "", 0
        for a, b, kind in sorted(spans[r.doc_id]):
            if a >= at:
                out += before[r.doc_id][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r.text == out + before[r.doc_id][at:] and r.n_chars == len(r.text)
    mixed = corpus_pipeline.mix(spark, clean, sf).cache()
    plan = {r.doc_id: r.taken for r in mixing.mix(clean).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == Counter({k: v for k, v in plan.items() if v})
    for df in (kept, one, clean, mixed):
        assert df.columns == docs.columns and [t for _, t in df.dtypes] == kinds
    tokens = corpus_pipeline.token_ids(spark, mixed, sf).collect()
    assert len(tokens) == mixed.count() and all(r.n_tokens == len(r.ids) for r in tokens)


def test_every_operator_has_a_query():
    from tidemark.llm import queries

    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries())
    assert numbers == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_whole_numbers_of_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, []), (3, [1.0, None]), (4, [float("nan")]), (5, [float("-inf")]), (6, None), (None, [1.0]), (7, [1e300, -0.0]), ((1 << 53) + 1, [3.0, 4.0])]
    made = topk.integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {r["vec_id"]: (list(r["v"]), r["length"]) for r in made.collect()}
    assert set(got) == {1, 2, 7, (1 << 53) + 1}
    assert got[1][0] == [128.0, -1.0] and got[2] == ([], 0.0) and got[7][0] == [256e300, 0.0]
    assert got[(1 << 53) + 1] == ([768.0, 1024.0], 1280.0)


def test_units_of_texts_do_not_depend_on_the_texts_beside_them():
    texts = ["", "a b c d e", "\n\né 日本 x\ty Z w\n", " ".join(f"w{i % 41}" for i in range(300)), "\n".join("same line of some words" for _ in range(40)), "a b c d"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    units = lambda batches: sorted(str(r) for b in substring.unit_rows(42)(iter(batches)) for r in b.to_pylist())
    assert units([batch]) == units([batch.slice(i, 1) for i in range(len(texts))])
    values = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for wide in (1, 5, 16):
        assert substring.first_least(values, wide).tolist() == [i + int(values[i : i + wide].argmin()) for i in range(len(values) - wide + 1)]


def test_passages_do_not_depend_on_how_many_bands_are_dealt_out_at_once(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    out = []
    for n in (substring.BANDS, 5):
        monkeypatch.setattr(substring, "BANDS_AT_ONCE", n)
        out.append(sorted(map(tuple, substring.repeated_passages(docs).collect())))
    assert out[0] and out[0] == out[1]


def test_rounds_over_few_links_run_in_few_tasks(spark, monkeypatch):
    parts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: parts.append(cut(df)) or parts[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint")
        assert {r.component for r in components.components(links).collect()} == {0}
        assert len(parts) > 4 and max(p.rdd.getNumPartitions() for p in parts[1:]) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_values_of_ids_come_in_order_for_none_one_and_many():
    for keys in ([], [3], [2, 3, 2], np.array([1, 3])):
        assert list(bpe.each_of({1: "a", 2: "b", 3: "c"}, keys)) == [{1: "a", 2: "b", 3: "c"}[k] for k in keys]


def test_a_sieve_lets_all_ids_pass_and_few_others(spark, monkeypatch):
    rows, every = spark.range(40_000), lambda step: spark.range(0, 40_000, step)
    passed = lambda ids: {r.id for r in common.sifted(rows, ids, "id").collect()}
    for step in (2, 20):
        got = passed(every(step))
        assert set(range(0, 40_000, step)) <= got and len(got) < 40_000 / step + 4_000
    assert not passed(every(20).limit(0))
    monkeypatch.setattr(common, "SIEVE_ROWS", 1)
    assert set(range(0, 40_000, 2)) <= passed(every(2))


def test_what_all_tasks_get_does_not_grow_with_repeated_lines(spark, monkeypatch):
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    docs = spark.range(300_000).selectExpr("id AS doc_id", "concat('line number ', id % 150000, ' of many words') AS text")
    lines = substring.lines_of(docs, 42)
    assert not substring.clash(docs, lines.select(F.col("uid").alias("key")), 42)
    assert sent and max(sent) <= common.SIEVE_ROWS


def test_the_size_spark_guesses_for_links_does_not_grow_with_rounds(spark, monkeypatch):
    bits, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: bits.append((out := cut(df))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()) or out)
    links = spark.range(60).select(F.xxhash64("id").alias("u"), F.xxhash64(F.col("id") + 1).alias("v"))
    assert components.components(links).select("component").distinct().count() == 1
    assert len(bits) > 10 and max(bits) < 150
