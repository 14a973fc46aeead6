"""Skewed inputs, clashing columns, ties, repeated rows and empty tables of the operators, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common, domain_mixing, embedding_join, html_text, secret_scan, token_counts, toxicity, warc
from tests.llm.test_llm import BASE, brute_components, by_id, mixing_tables, prose, toxic_tables


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    return df.withColumns({"node": F.lit("x"), "n_links": F.lit(7.5), "component_id": F.lit("y"), "_k1": F.lit(0)}) if extra else df


@pytest.mark.parametrize("block", [embedding_join.BLOCK, 60])
def test_links_and_components_of_thousands(spark, monkeypatch, block):
    """Planted partners and a large group of mutual neighbours; small blocks cut every cell into parts."""
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    r = np.random.default_rng(9)
    x = r.standard_normal((2200, 24))
    partners = [x[i] / np.linalg.norm(x[i]) + r.standard_normal(24) * r.choice([0.03, 0.08, 0.095]) for i in range(700)]
    group = [x[2000] + r.standard_normal(24) * 0.1 for _ in range(260)]
    v = np.float32([*x, *partners, *group])
    got = {q["vec_id"]: q for q in embedding_join.near_duplicates(spark, vectors(spark, enumerate(v.tolist()), extra=True)).collect()}
    assert set(next(iter(got.values())).asDict()) == {"vec_id", "n_links", "component_id", "kept"}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    n = links.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum() and n.sum() > 50_000
    if (found == n).all():
        comp = brute_components(range(len(v)), np.argwhere(np.triu(links)).tolist())
        assert all(got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i) for i in range(len(v)))


def test_ties_and_null_ids_of_vectors(spark):
    rows = [(1, [1, 0, 0, 0]), (2, [9, 3, 3, 1]), (3, [8.99, 3, 3, 1]), (None, [1, 0, 0, 0]), (5, None), (1, [1, 0, 0, 0])]
    got = embedding_join.near_duplicates(spark, vectors(spark, rows)).collect()
    by = {}
    for q in got:
        by.setdefault(q["vec_id"], []).append((q["n_links"], q["component_id"]))
    assert by[2] == [(4, 1)] and by[1] == [(3, 1)] * 2  # a cosine of exactly 0.9 links, one below doesn't; equal rows link too
    assert by[None] == [(3, None)] and by[5] == [(0, 5)] and by[3] == [(1, 1)]


def test_split_join_deals_a_frequent_key(spark):
    left = spark.range(3000).selectExpr("id as v", "if(id % 3 > 0, 7L, id) as u")
    right = spark.range(3000).selectExpr("id as u", "id * 2 as m")
    sizes = left.groupBy("u").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_semi"):
        got = common.split_join(spark, left, right, "u", sizes, 3000, "v", how)
        assert got.count() == 3000 and got.columns == (["u", "v"] if how == "left_semi" else ["u", "v", "m"])
        if how != "left_semi":
            assert got.where("m <> u * 2").count() == 0


def test_secrets_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh12", "s", 3, 4), (1, "token = abcdefgh12", "s", 3, 4), (None, None, None, None, None)], "doc_id long, text string, spans string, n_assign int, _k1 int")
    got = secret_scan.scan(spark, df).collect()
    assert [r["n_assign"] for r in sorted(got, key=lambda r: r["doc_id"] is None)] == [1, 1, 0] and all(r.asDict().keys() >= {"doc_id", "spans"} for r in got)


def test_html_of_deep_nesting_and_clashing_columns(spark):
    deep = "<div>" * 20000 + "<article><p>One two three.</p></article>" + "</div>" * 20000
    assert len(html_text.blocks(deep)) == 1 and len(html_text.blocks("<div>x" * 20000)) == 20000
    assert len(html_text.blocks("<b>" * 20000 + "</i>x<p>y" * 3000)) == 3001
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 4, "t"), (1, "u", "<article><p>a b</p></article>", 4, "t")], "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(spark, df).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("a b", 3)] * 2


def test_warc_of_repeated_rows_and_null_ids(spark):
    long = "<p>" + "x" * 400_000
    rows = [(1, "a", "same", 0), (1, "a", "same", 0), (2, "b", "same", 0), (None, "c", "other", 0), (3, "d", long, 0), (4, "e", long, 0)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["payload_bytes"], r["record_type"], r["refers_to"]))
    assert by[2] == [(4, "revisit", 1)] and by[4] == [(400_003, "revisit", 3)] and by[3][0][1] == "response"
    assert len(got) == len(rows) and len(by[None]) == 1


def test_toxicity_of_repeated_rows_and_odd_tokens(spark):
    docs, labels = toxic_tables(spark)
    odd = spark.createDataFrame([(2000, "z" * 60_000), (2001, "zorgax " * 4), (2001, "zorgax " * 4), (2002, "4" * 300 + " $" * 300), (2003, " ")], docs.schema)
    both = docs.union(odd).withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "_text": F.lit(1)})
    got = by_id(toxicity.score(spark, both, labels.where("doc_id % 3 <> 1")))
    assert len(got[2001]) == 2 and got[2001][0]["score"] == got[2001][1]["score"] > 0.5 > got[2003][0]["score"] and len(got[2000]) == len(got[2002]) == 1


def test_mixing_reaches_what_can_be_reached(spark):
    """Rates against a projected gradient in numpy over the same posteriors; repeated rows, long texts and clashing columns."""
    docs, labels = mixing_tables(spark)
    docs = docs.union(docs.where("doc_id < 20")).union(spark.createDataFrame([(950, prose(4000, 1))], docs.schema)).withColumns({"rate": F.lit("r"), "P_CLEAN": F.lit(1), "copies": F.lit(2)})
    out = domain_mixing.mixed(spark, docs, labels, weights={"clean": 0.5, "toxic": 0.3, "low": 0.2})
    got = out.toPandas()
    assert len(got) == docs.count() and (got.groupby("doc_id")["copies"].nunique() == 1).all()
    p, n = got[[f"p_{d}" for d in domain_mixing.DOMAINS]].to_numpy(), got.n_tokens.to_numpy(float)
    want = np.array([0.5, 0.3, 0.2]) * n.sum()
    reached = (p * (n * got.rate.to_numpy())[:, None]).sum(0)
    assert np.abs(reached - want).max() < 1e-3 * n.sum()
    assert [out.totals[d][0] * n.sum() for d in domain_mixing.DOMAINS] == pytest.approx(reached.tolist(), rel=1e-4)
    kept = domain_mixing.drawn(spark, docs, labels, {"clean": 1.0, "toxic": 0.3, "low": 0.5})
    for d, (a, b) in kept.totals.items():
        assert abs(a - b) < 0.03, d
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i in ids for i in range(400) if i % 4 in (0, 2)) >= 195 and sum(i in ids for i in range(1, 400, 4)) < 60


def test_mixing_of_a_target_out_of_reach(spark, caplog):
    docs, labels = mixing_tables(spark)
    out = domain_mixing.mixed(spark, docs, labels, factors={"clean": 3.0, "toxic": 1.0, "low": 1.0}, most=1.0)
    assert out.agg(F.max("rate")).first()[0] == 1.0 and out.totals["clean"][0] < out.totals["clean"][1]
    assert "wanted" in caplog.text


def test_second_run_of_token_counts_hits(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "one two", 5.0, "k"), (2, "one two", 5.0, "k"), (3, None, 5.0, "k"), (4, BASE, 5.0, "k")], "doc_id long, text string, n_bytes double, _key string")
    first = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(spark, df, cache).collect()}
    files = spark.read.parquet(cache).count()
    spark.createDataFrame([(bytes(32), "another tokenizer", 9), (bytes(31), "another tokenizer", 9)], token_counts.CACHE).write.mode("append").parquet(cache)
    again = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(spark, df, cache).collect()}
    assert again == first and spark.read.parquet(cache).count() == files + 2 and first[1] == (7, first[2][1]) and first[3] == (0, 0)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(120, 50 + i) + ".", "en", "s", 1) for i in range(30)]
    secret = (31, prose(90, 7) + " token = abcdefgh1234", "en", "s", 1)
    bad = [(i, prose(80, 900 + i) + " zorgax blimfut krandol" * 2 + ".", "en", "s", 1) for i in range(50, 62)]
    rows = [*good, *bad, (40, good[3][1], "en", "s", 1), (3, good[3][1], "en", "s", 1), (41, None, None, None, None), (42, "", "en", "s", 0), (None, good[4][1], "en", "s", 1), secret]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit("k"), "rate": F.lit("r"), "n_words": F.lit(1.5)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 50)) for i in [*range(20), *range(50, 62)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in out if r["doc_id"] is not None))
    assert 40 not in ids and 41 not in ids and 42 not in ids and 31 in ids and sum(i < 30 for i in ids) >= 30 and sum(i >= 50 for i in ids) < 9
    assert all(r["kept"] == "k" and r["n_tokens"] == len(r["token_ids"]) > 0 for r in out)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
