"""The pipeline's stages against plain Python, and the corpus queries against their SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from sessionloom.llm import queries
from tests.llm.test_operators import BRUTE, brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randrange(30, 80)))) for i in range(60)]
    passage = " ".join(word() for _ in range(14))
    docs = clean + [
        (100, clean[0][1]),  # an exact copy
        (101, clean[1][1] + " " + passage),
        (102, " ".join(word() for _ in range(5))),  # too short
        (103, clean[2][1][:50] + " password = hunter2hunter2 " + clean[2][1][50:] + " " + " ".join(word() for _ in range(40))),
        (104, None),
        (None, clean[3][1] + " " + " ".join(word() for _ in range(50))),
    ] + [(200 + i, " ".join(word() + "$$$" for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(200 + i, 0, 0) for i in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, [(1, passage)]


def test_stages(spark, corpus):
    folder, docs, items = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    found = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, folder).write.parquet(f"{folder}/out{k}")
        df = spark.read.parquet(f"{folder}/out{k}")
        if name != "tokens":
            assert df.columns == columns
            found.append({r["doc_id"]: r for r in df.collect()})
    quality, near, clean, secret = found
    # junk, short and empty documents go; all others stay
    assert set(quality) == {i for i in rows if i is None or (i < 200 and i not in (102, 104))}
    # one document of each group stays
    parts = {}
    for i, _, c in brute_components([(i, r["text"]) for i, r in quality.items()]):
        parts.setdefault(c, []).append(i)
    assert set(near) == {None if c is None else c for c in parts}
    assert 100 not in near and 0 in near
    dirty = {i for i, *_, bad in brute_hits([(i, r["text"]) for i, r in near.items()], items) if bad}
    assert dirty == {101} and set(clean) == set(near) - dirty
    assert set(secret) == set(clean)
    for i, r in secret.items():
        if i == 103:
            assert "[SECRET]" in r["text"] and "hunter2" not in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == rows[i] and not any(m for _, p, g, least in BRUTE for m in p.finditer(r["text"]) if len(m[g]) >= least)
    assert {r["doc_id"] for r in df.collect()} == set(secret)
    assert corpus_pipeline.run(spark, folder).count() == len(secret)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, corpus, name):
    """Empty tables, repeated and null ids, null texts, and columns named as the stages name theirs."""
    folder, _, _ = corpus
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS shard", "'x' AS fp", "'b' AS blob", "true AS stays", "2 AS spans", "3 AS n_words", "'y' AS component_id")
    assert stage(spark, df.limit(0), folder).count() == 0
    odd = df.unionByName(df.where("doc_id IN (3, 104)")).unionByName(df.where("doc_id = 5").selectExpr("cast(null AS long) AS doc_id", *df.columns[1:]))
    got = stage(spark, odd, folder)
    if name == "tokens":
        assert got.count() == odd.count()
        return
    assert got.columns == odd.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts[3] == 2  # rows of one id share a decision
    assert {r["shard"] for r in got.select("shard").distinct().collect()} == {1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    pick = lambda row, names: repr(tuple(row[names.index(c)] for c in sorted(names)))
    assert sorted(pick(tuple(r), df.columns) for r in df.collect()) == sorted(pick(r, columns) for r in cursor.fetchall())


#: Queries whose contract asks for other rows than one for each input row.
OTHER_ROWS = {"secret_history", "secret_path_findings", "op11_embedding_whitening", "op12_phrase_collocations", "op13_best_fit_packing"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER_ROWS))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith(("op1_", "op3_")) else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_rows_of_new_queries(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert got.count() == 8 * vectors and {t for _, t in got.dtypes} == {"bigint", "int", "double"} and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES["op13_best_fit_packing"](spark, SF)
    tokens = queries.QUERIES["op9_byte_bpe"](spark, SF).selectExpr("sum(n_tokens + 1)", "sum(ceil((n_tokens + 1) / 1024))").first()
    found = got.selectExpr("sum(length)", "count(*)", "count(distinct doc_id)", "max(length)").first()
    assert tuple(found)[:2] == (tokens[0], tokens[1]) and found[2] == docs and found[3] <= 1024
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
