"""Language ID and quality by held-out accuracy; search and the pipeline against brute-force versions."""

import math
import random

import numpy as np
import pytest

from lexiloom.llm import language_id, quality, queries, topk_search

SMALL = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    found = language_id.language_id(spark.read.parquet(f"{SMALL}/documents.parquet"), passed=["doc_id", "lang"])
    held = found.filter("held_out").toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert held.score.between(0, 1).all()


def test_language_id_edges(docs):
    texts = ["the cat and the dog " * 5, "le chat et le chien de la rue " * 5] * 20 + [None, "", "123 !!", "7", "a"]
    langs = ["en", "fr"] * 20 + ["en", None, "fr", None, None]
    frame = docs(texts, langs=langs)
    model = language_id.train(frame)
    got = {r.doc_id: r for r in language_id.language_id(frame, model).collect()}
    assert [got[i].lang_pred for i in range(40)] == ["en", "fr"] * 20
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (40, 41, 42, 43)) and got[44].lang_pred in ("en", "fr")
    assert language_id.language_id(docs(["abc"], langs=[None])).first().lang_pred == "und"  # nothing to learn from
    assert language_id.language_id(docs([]), model).count() == 0


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.quality(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(found) > 50 and (found.quality == found.predicted).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    texts = ["good words in a row, as it is.", "BAD!! BAD!! $$$ BAD!!"][::-1] * 30 + [None, "", "x" * 100_000]
    got = {r.doc_id: r for r in quality.quality(docs(texts), labels).collect()}
    assert len(got) == 63 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1].score > got[0].score
    none = quality.quality(docs(texts), labels.limit(0)).collect()
    assert len(none) == 63 and quality.quality(docs([]), labels).count() == 0


def brute_search(vectors, every, k):
    end = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = [(i, [end(math.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, own) in enumerate(good):
        if q % every == 0:
            scored = sorted((-end(sum(x * y for x, y in zip(own, v, strict=True))), i) for b, (i, v) in enumerate(good) if b != a and len(v) == len(own))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 3, 700])
def test_topk_search(spark, n):
    rnd = random.Random(n)
    vectors = [(i, [float(f"{rnd.gauss(0, 1):.2f}") for _ in range(8)]) for i in range(n)]
    vectors += [(n, vectors[0][1]), (n + 1, vectors[0][1]), (0, [5.0] + [0.0] * 7), (0, vectors[0][1])] if n else []  # ties, and ids that repeat
    odd = [(10_000, None), (10_050, [float("nan")] * 8), (10_100, [1.0] * 7 + [None]), (10_150, [float("inf")] * 8), (None, [1.0] * 8), (10_200, [2.0**100] * 8), (10_201, [-(2.0**90)] * 8), (10_210, [1.0] * 5)]
    frame = spark.createDataFrame([(*v, 1, 2) for v in vectors + odd], "vec_id long, embedding array<float>, score int, block int")
    for block in (4096, 100):  # one block; several, with bars
        got = sorted(tuple(r) for r in topk_search.topk_search(frame, every=10, k=5, candidate_block=block).collect())
        assert got == brute_search(vectors + odd, 10, 5)
    assert topk_search.topk_search(frame.limit(0)).count() == 0


def test_topk_search_stops_early():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(x))
    scores = x[:20] @ x.T
    scores[np.arange(20), np.arange(20)] = -(1 << 40)
    reads = []
    for bars in (None, np.sort(scores, axis=1)[:, -5].astype(np.float64)):
        q, c, score, read = topk_search.search_block(x[:20], ids[:20], x, ids, ids, 5, bars)
        assert [sorted(score[q == i].tolist()) for i in range(20)] == [np.sort(scores[i])[-5:].tolist() for i in range(20)]
        assert (scores[q, c] == score).all()
        reads.append(read)
    # the bounds decide: part of the lists is enough, and less of them with another block's bar
    assert reads[0] < 0.8 * 20 * x.size and reads[1] < 0.65 * 20 * x.size and reads[1] < reads[0]


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from tests.llm.test_text_operators import brute_items, brute_similar

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    odd = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, "123", "en", "s", 3)], docs.schema)
    a = stages["language_id"](spark, docs.unionByName(odd), sf)
    assert a.columns == columns and a.filter("doc_id > 90000").count() == 0 and a.count() == docs.count()
    b = stages["line_dedup"](spark, a, sf)
    assert b.columns == columns and b.count() == docs.count()
    kept = {r.doc_id: r.text for r in b.collect()}
    ids = sorted(kept)
    own = brute_similar([kept[i] for i in ids])
    c = stages["near_dedup"](spark, b, sf)
    assert c.columns == columns and sorted(r.doc_id for r in c.collect()) == sorted({ids[k] for k in own})
    texts = {r.doc_id: r.text for r in c.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [i for i, (_, n, _) in zip(texts, brute_items(texts.values(), items, 10), strict=True) if not n]
    d = stages["decontamination"](spark, c, sf)
    assert d.columns == columns and sorted(r.doc_id for r in d.collect()) == sorted(clean)
    e = stages["byte_bpe"](spark, d, sf)
    assert sorted(r.doc_id for r in e.select("doc_id").collect()) == sorted(clean)
    whole = P.run(spark, sf)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(clean)


def test_registered():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(sql) <= set(names) and None not in sql.values()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
