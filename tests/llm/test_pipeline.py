"""The pipeline's stages against brute force, and the queries against their SQL."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    cols = sorted(names)
    assert cols == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())


def shingled(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def one_of_each(rows, percent=80):
    """The rows that stay: the first of each component of all pairs, by id."""
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets, parent = [shingled(r.text) for r in rows], list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if root(k) == k]


def test_stages(spark, db):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 1").first()
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", None, None, 5), (10**6 + 2, "This is a short clean text of ten words or more, password=abcdef123", None, None, 5)]
    odd += [(None, first.text, None, None, 5), (1, "Another clean text under an id that is already in use by one of the documents", None, None, 5), (None, "A clean text without any id that no other document of this table resembles at all", None, None, 5)]
    now = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"score": F.lit(1.5), "lang_pred": F.lit("clash"), "text_hash": F.lit(1)})
    columns, stages = now.columns, dict(corpus_pipeline.STAGES)
    now2 = stages["language"](spark, now, SF)
    gone = {r.doc_id for r in now.join(now2, "doc_id", "left_anti").where("doc_id is not null").collect()}
    assert gone == {10**6, 10**6 + 1} and now2.columns == columns and now2.where("doc_id is null").count() == 2

    now3 = stages["near_duplicates"](spark, now2, SF)
    assert sorted(map(str, now3.collect())) == sorted(map(str, one_of_each(now2.collect()))) and now3.columns == columns
    assert now3.where("doc_id = 1").count() == 2 and now3.where("doc_id is null").count() == 1

    hit = now3.limit(1).first()
    held = db.execute("SELECT text FROM benchmark ORDER BY item_id LIMIT 1").fetchall()[0][0]
    now3 = now3.unionByName(spark.createDataFrame([(None, held, *hit[2:])], now3.schema))
    db.register("documents_d", now3.select(F.monotonically_increasing_id().alias("doc_id"), "text").toPandas())
    hits = queries.HITS_CTE.replace("FROM documents)", "FROM documents_d)")
    bad = {r[0] for r in db.execute(f"WITH {hits} SELECT DISTINCT text FROM hits JOIN documents_d USING (doc_id)").fetchall()}
    now4 = stages["decontamination"](spark, now3, SF)
    assert held in bad and sorted(map(str, now4.collect())) == sorted(str(r) for r in now3.collect() if r.text not in bad) and now4.columns == columns

    now5 = stages["secrets"](spark, now4, SF)
    assert now5.columns == columns and now5.dtypes == now.dtypes
    short = now5.where(F.col("doc_id") == 10**6 + 2).first()
    assert short.text.endswith("more, [REDACTED]") and short.n_chars == len(short.text)
    same = now4.select("doc_id", F.col("text").alias("was")).join(now5, "doc_id").where("was <> text and doc_id <> 1")
    assert same.where("not contains(text, '[REDACTED]')").count() == 0

    out = stages["mixture"](spark, now5, SF)
    assert out.count() == now5.count() and out.where("taken > 3 * size").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
