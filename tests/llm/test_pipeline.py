import corpus_pipeline
from spanveil.llm import language, pii, simhash

from .helpers import corpus, documents, empty, widened


def test_stages_one_by_one(spark, tmp_path):
    rows = corpus(80) + [(500, "The thing. Mail a.b@mail.example.com", "en", "s1", 36)]
    docs = widened(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    before, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == names
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r["doc_id"] or -1 for r in after.select("doc_id").collect())
        old = before.collect()
        if name == "language":
            model = language.learn(before)
            want = [r["doc_id"] for r, bad in zip(old, language.judged([r["text"] for r in old], model)[2], strict=True) if not bad]
            assert ids == sorted(i or -1 for i in want)
        if name == "near_duplicates":
            prints = {}
            for r in sorted(old, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
                prints.setdefault(simhash.fingerprint(r["text"].encode(), corpus_pipeline.NEAR.shingle, corpus_pipeline.NEAR.seeds), r["doc_id"])
            assert set(ids) <= {i or -1 for i in prints.values()} and len(ids) == len(set(ids))
        if name == "personal_data":
            want = {r["doc_id"]: pii.masked(r["text"], pii.detect(r["text"])) for r in old}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want and "<EMAIL>" in want[500]
        if name == "mixing":
            assert set(ids) <= {r["doc_id"] or -1 for r in old}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    copies = sum(r["start"] == 0 for r in pieces)
    assert copies == before.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()), key=repr) == sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces), key=repr)


def test_empty_documents(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go_and_clean_documents_stay(spark):
    import random

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(300)), "en", "s", 1) for i in range(100)]
    copies = [(1000 + i, rows[i][1].replace(" ", "  ") + (" " + word()) * (i % 2), "en", "s", 1) for i in range(50)]
    ids = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows + copies), "").collect()}
    assert set(range(100)) <= ids and len(ids) <= 105
