import zlib

import numpy as np

from spanveil.llm import language

from .helpers import corpus, documents, empty, widened


def test_identification(spark):
    rows = corpus(120)
    docs = widened(spark, rows)
    model = language.learn(docs, language.Identification(sample=40))
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        text, lang = truth[r["doc_id"]][1:3]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] < 120:
            assert r["lang_pred"] == lang and not r["rejected"]
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert set(range(120)) <= ids and not ids & {120, 121, 122, 126}


def test_predictions_equal_plain_vectors(spark):
    docs = documents(spark)
    model = language.learn(docs)
    for r in language.identify(docs, model).where("doc_id < 20").collect():
        text = next(t for i, t, *_ in corpus() if i == r["doc_id"])
        data = " " + " ".join("".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower()).split()) + " "
        raw, vector = data.encode(), np.zeros(len(model.idf))
        for n, salt in ((2, 0), (3, 1 << 25)):
            for i in range(len(raw) - n + 1):
                code = salt
                value = 0
                for b in raw[i : i + n]:
                    value = value * 257 + b
                vector[((value + code) * 2654435761 % (1 << 32)) >> 20] += 1
        vector = np.log1p(vector) * model.idf
        near = model.centroids @ (vector / np.linalg.norm(vector))
        assert r["lang_pred"] == model.languages[int(near.argmax())] and abs(r["score"] - near.max()) < 1e-4


def test_labels_and_ids_do_not_matter_for_prediction(spark):
    docs = documents(spark)
    model = language.learn(docs)
    other = docs.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'zz' as source", "n_chars").where("doc_id is not null")
    mine = sorted((r["doc_id"] + 1000, r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect() if r["doc_id"] is not None)
    assert mine == sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(other, model).collect())


def test_nothing_to_learn_from(spark):
    rows = [(i, "some text", None, "s", 1) for i in range(5)]
    docs = documents(spark, rows)
    model = language.learn(docs)
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    none = empty(spark)
    assert language.identify(none, language.learn(none)).count() == 0


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ünd the thing " * 100_000
    whole = language.counts(text, 4096)
    assert whole.sum() == sum(len(b" " + b" ".join(text.lower().encode().translate(language.LETTERS).split()) + b" ") - n + 1 for n in (2, 3))


def test_short_texts_stay_and_foreign_ones_go(spark):
    rows = corpus(120)
    model = language.learn(documents(spark, rows), language.Identification(sample=40))
    short = ["The", "der", "Nation.", "House of", "einfach", "und", "Of."]
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "東京都は日本の首都であり世界最大級の都市である" * 4, "ααα βββ γγγ δδδ εεε ζζζ ηηη θθθ " * 4]
    assert not language.judged(short, model)[2].any()
    assert language.judged(foreign, model)[2].all()


def test_many_labels_are_bounded(spark):
    rows = [(i, f"wort nummer {i} in {'der' if i % 2 else 'the'} schule", f"l{i % 40}" if i % 3 == 0 else "en", "s", 1) for i in range(200)]
    options = language.Identification(languages=5, total=50)
    model = language.learn(documents(spark, rows), options)
    assert len(set(model.languages)) <= 5 and "en" in model.languages
