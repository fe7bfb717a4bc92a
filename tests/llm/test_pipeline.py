import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_clean_documents_and_drop_copies(spark, odd_docs, tmp_path):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choices("aeioutnshr", k=rng.randint(2, 8))) for _ in range(200)]
    clean = [(i, "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(6)), "en", f"s{i % 9}", 0) for i in range(60)]
    copies = [(100 + i, clean[0][1], "en", f"s{i % 9}", 0) for i in range(4)] + [(200, clean[1][1] + " tail", "en", "s1", 0)]
    docs = spark.createDataFrame(clean + copies, odd_docs.drop("n_tokens").schema).unionByName(odd_docs.drop("n_tokens").where("doc_id is null or doc_id < 3").withColumn("doc_id", F.col("doc_id") + 900))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        path = f"{sf}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
    ids = {r["doc_id"] for r in now.select("doc_id").collect()}
    assert set(range(60)) <= ids and not ids & set(range(100, 104)) and 200 not in ids
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_stages_on_no_documents(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "unused").count() == 0, name


def test_near_dedup_keeps_every_text_once(spark):
    """Rows that repeat an id with another text are documents of their own."""
    a, x = "a b c d e f g h", "s t u v w x y z"
    rows = [(1, a, "en", "s", 0), (1, x, "en", "s", 0), (2, x, "en", "s", 0), (3, a, "en", "s", 0), (4, None, "en", "s", 0), (4, None, "en", "s", 0), (5, "", None, None, None), (None, a, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.near_dedup(spark, docs, "unused").collect())
    assert got == [(0, a), (1, a), (1, x), (4, ""), (5, "")]


def test_stages_send_small_batches_to_python(spark, no_docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, no_docs, "unused")
        assert int(spark.conf.get(key)) <= 2 << 20, name
    if before is not None:
        spark.conf.set(key, before)
