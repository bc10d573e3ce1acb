import corpus_pipeline
from test_models import plain_leaks
from test_secrets_urls import plain
from test_simhash_packing import check_packing, plain_components, plain_fingerprint

from orderloom.llm import queries, secrets, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark):
    read = lambda name: queries.read(spark, FOLDER, name)
    docs = {r["doc_id"]: r for r in read("documents").collect()}
    model = toxicity.train(read("documents"), read("labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(read("documents"), model).select("row.doc_id", "score").collect()}
    kept = {i for i, r in docs.items() if scores[i] < model.thresholds.get(r["lang"], model.thresholds[""])}
    roots = plain_components([(i, plain_fingerprint(docs[i]["text"])) for i in sorted(kept)])
    kept = {i for i in kept if roots[i] == i}
    kept -= {i for i, _ in plain_leaks([(i, docs[i]["text"]) for i in kept], [tuple(r) for r in read("benchmark").collect()])}
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_report(read("documents")).select("doc_id", "spans").collect()}
    kept = {i for i in kept if not plain(docs[i]["text"]) and not found[i]}
    assert 300 < len(kept) < len(docs)

    stage = read("documents")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        before = stage
        stage = fn(spark, stage, FOLDER)
        assert stage.columns == before.columns
    rows = {r["doc_id"]: r for r in stage.collect()}
    assert set(rows) == kept and all(r == docs[i] for i, r in rows.items())
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    check_packing(packed, [(i, docs[i]["text"]) for i in kept])


def test_stages_take_empty_tables_nulls_and_more_columns(spark):
    more = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, spans string, fp bigint, component_id bigint"
    rows = [(1, None, "en", "s", 0, 1.0, "r", "x", 1, 1), (2, "", None, None, None, None, None, None, None, None), (3, "plain words of a clean text", "en", "s", 27, 1.0, "r", "x", 1, 1)]
    for docs in (spark.createDataFrame(rows, more), spark.createDataFrame(rows, more).limit(0)):
        for name, fn in corpus_pipeline.STAGES:
            out = fn(spark, docs, FOLDER)
            ids = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert ids == ({1, 3} if "simhash" in name else {1, 2, 3} if docs.count() else set()) if docs.count() else not ids, name


def test_driver_lets_go_after_every_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    spark.range(3).selectExpr("id AS doc_id", "'a' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    freed = []
    monkeypatch.setattr(pipeline, "release_driver", lambda s: freed.append(s))
    monkeypatch.setattr(pipeline, "STAGES", [("one", lambda s, d, f: d), ("two", lambda s, d, f: d.where("doc_id > 0"))])
    assert pipeline.run(spark, str(tmp_path)).count() == 2 and len(freed) == 2


def test_driver_lets_go_within_a_stage(spark, monkeypatch):
    from orderloom.llm import common, simhash

    freed = []
    monkeypatch.setattr(common, "release_driver", lambda s: freed.append(s))
    for n in range(2 * common.LET_GO):
        assert simhash.cut_lineage(spark.range(3), "let-go").count() == 3
    assert len(freed) == 2
