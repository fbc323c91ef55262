import math

import corpus_pipeline
import pytest
from loomgraph.llm import queries

NAMES = sorted(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_bpe_round_trip_on_the_table(spark, place):
    import hashlib

    import public_tokenizers
    import tiktoken
    from loomgraph.llm import bpe

    ranks = bpe.read_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, place, "documents").collect()}
    for r in queries.op2_bpe(spark, place).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_id_is_right_on_held_out_documents(spark, place):
    lang = {r.doc_id: r.lang for r in queries.table(spark, place, "documents").collect()}
    rows = [r for r in queries.op8_language_id(spark, place).collect() if r.held_out and lang[r.doc_id]]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_toxicity_on_labelled_documents(spark):
    place = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in queries.table(spark, place, "labels").collect()}
    rows = [r for r in queries.op7_toxicity(spark, place).collect() if r.doc_id in toxic]
    assert sum(r.toxic for r in rows if toxic[r.doc_id] == 0) <= 0.02 * len(rows)
    hit = [r.toxic for r in rows if toxic[r.doc_id] == 1]
    assert sum(hit) >= 0.85 * len(hit)
    assert all(0 <= r.severity <= 2 and math.isfinite(r.severity) for r in rows)


def test_toxicity_learned_from_two_thirds_finds_the_rest(spark):
    from loomgraph.llm import toxicity
    from pyspark.sql import functions as F

    place = "/root/testdata/sf0.1"
    docs, labels = (queries.table(spark, place, t) for t in ("documents", "labels"))
    unseen = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    model = toxicity.train(docs, labels.where(~unseen))
    toxic = {r.doc_id: r.toxic for r in labels.where(unseen & F.col("toxic").isNotNull()).collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id in toxic]
    hit, clean = [r.toxic for r in rows if toxic[r.doc_id]], [r.toxic for r in rows if not toxic[r.doc_id]]
    assert sum(hit) >= 0.85 * len(hit) and sum(clean) <= 0.01 * len(clean)


def test_pipeline_stages_take_effect(spark, place):
    docs = queries.table(spark, place, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, place)
        assert docs.count() <= before
        if name != "bpe":
            assert docs.columns == columns
    assert set(docs.columns) >= {"doc_id", "ids"}
