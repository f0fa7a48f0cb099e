from pyspark.sql import functions as F


def test_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    now, sizes = docs, []
    for _, stage in p.STAGES[:-1]:
        now = p.materialize(stage(spark, now, d), "t")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert now.where(F.col("n_chars") != F.length("text")).count() == 0
        sizes.append(now.count())
    assert docs.count() > sizes[0] == sizes[1] > sizes[2] == sizes[3] > 0
    out = p.run(spark, d)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in now.select("doc_id").collect()}


def test_empty(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0


CLASHES = ["_row", "_text", "_words", "n_words", "_rule", "_n", "host", "lines", "n_lines", "n_dropped", "_kept", "key", "group", "node", "_k", "_id", "_key", "_stays", "n", "spans", "_hash", "_hash2", "_base", "terms", "gone"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{d}/documents.parquet")
    docs = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    now, bare = docs, plain
    for name, stage in p.STAGES[:-1]:
        now, bare = (p.materialize(stage(spark, x, d), "t") for x in (now, bare))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        rows = now.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES), name
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in bare.collect()), name
    assert p.packing_stage(spark, now, d).count() == p.packing_stage(spark, bare, d).count()


def test_stages_stand_nulls_and_long_texts(spark):
    import corpus_pipeline as p

    long = " ".join(f"word{i * 7919 % 300_007}" for i in range(300_000))
    rows = [(1, None, "s", None), (2, "", "s", 0), (None, "no id " + " ".join(f"w{i}" for i in range(80)), None, 5), (3, long, "s", len(long)), (3, long, "s", len(long)), (4, long + " x", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    now = docs
    for _, stage in p.STAGES[:-1]:
        now = p.materialize(stage(spark, now, ""), "t")
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in now.collect()) == [(0, len(rows[2][1])), (3, len(long))]
    assert p.packing_stage(spark, now, "").agg({"length": "sum"}).first()[0] > 600_000
    for name, stage in p.STAGES[1:]:  # those that keep short documents
        assert stage(spark, docs.limit(3), "").count() >= 2, name
