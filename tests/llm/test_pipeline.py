"""The whole pipeline over documents with nulls, empty and repeated rows, null, repeated and large ids."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folder_of(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCS)
    df.repartition(2).write.parquet(f"{tmp_path.as_uri()}/documents.parquet")
    return tmp_path.as_uri()


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_run_over_odd_rows(spark, sf, tmp_path, encoding):
    plain = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 90").collect()]
    own = {i: t for i, t, *_ in plain}
    long = max((t for t in own.values() if t), key=len)
    big = (1 << 53) + 1
    odd = [(901, None, "en", "src1"), (902, "", "en", "src1"), (903, "12 34 !!", "en", "src1"), plain[3], plain[3], (big, plain[4][1] + " anderes Ende hier", plain[4][2], None), (None, plain[5][1] + " nullid rest of it", plain[5][2], "src1")]
    odd += [(904, f"{plain[6][1]} mail to anna.b@example.org or +49 171 555 0199 now", plain[6][2], "src2"), (905, " ".join([long] * 3), plain[0][2], "src2"), (3, plain[7][1] + " other text of a repeated id", plain[7][2], "src2")]
    out = corpus_pipeline.run(spark, folder_of(spark, tmp_path, plain + odd)).collect()
    ids = {r.doc_id for r in out}
    assert {901, 902, 903}.isdisjoint(ids) and ids <= {i for i, *_ in plain + odd}
    assert len(ids) > 40 and set(out[0].asDict()) == {"doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    for r in out:
        body = encoding.decode_bytes(r.ids)
        assert r.n_tokens == len(r.ids) and hashlib.sha256(body).hexdigest() == r.decoded_sha256
        assert hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
        assert encoding.encode_ordinary(body.decode()) == r.ids and b"anna.b@example.org" not in body
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(encoding.decode(r.ids)))
    for i, n in words.items():  # no document is taken more than twice its size; redaction only joins words
        sizes = [len(WORD.findall(t or "")) for k, t, *_ in plain + odd if k == i]
        assert n <= 2 * sum(sizes)


def test_run_over_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [])).count() == 0
