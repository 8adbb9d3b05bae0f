"""Held-out accuracy on the small tables, and odd rows."""

from pyspark.sql import functions as F

from txlens.llm import language, op4_query, op7_query, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (None, "12 345", "x"), (3, "abc " * 30000, "x"), (3, "abc " * 30000, "x")]


def test_toxicity_of_unseen_documents(spark):
    scored = op4_query.op4_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_grammar_composes_what_stands_around_an_insult():
    g = toxicity.Grammar({"fool": 4.0, "blith*": 2.0})
    weight = lambda text: sum(w for _, w in g.clauses(text))
    assert weight("a fool") == 4.0 and weight("blithering") == 2.0
    assert weight("you fool") == weight("fool, you") == 6.0
    assert weight("not a fool") == 2.0 and weight("he said fool") == 2.8 or weight("he said fool") == 4.0 * toxicity.REPORTED
    assert weight("not. a fool") == 4.0
    assert weight("kill it") == 0 and weight("i will kill you") == toxicity.THREAT_WEIGHT
    assert g.clauses("") == [] and g.inputs(None) == [0.0] * 4


def test_reported_speech_in_four_languages():
    g = toxicity.Grammar({"fool": 4.0, "idiot": 4.0, "narr": 4.0, "tonto": 4.0})
    weight = lambda text: sum(w for _, w in g.clauses(text))
    for report, insult in (("he said", "you fool"), ("il a dit", "tu idiot"), ("er sagte", "du narr"), ("ella dijo", "tú tonto")):
        assert weight(f"{report}: {insult}") == weight(f'{report}: "{insult}"') == weight(insult) * toxicity.REPORTED
        assert weight(f"{report}. {insult}") == weight(f"so: {insult}") == weight(insult)
        assert weight(f"{report}: first: {insult}") == weight(insult) * toxicity.REPORTED


def test_bounds_hold_for_repeated_ids(spark, monkeypatch):
    rows = [(1, f"wort {i} eins", "de", 1) for i in range(300)] + [(i, f"word {i % 9} one", "en", 0) for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    monkeypatch.setattr(language, "fit", lambda packed, labels, *a: seen.append(sorted(labels)) or language.Model([], None, None))
    language.learn(df, F.lit(True), per_language=20)
    assert seen == [["de"] * 20 + ["en"] * 20]
    counted = []
    monkeypatch.setattr(toxicity, "learn_arcs", lambda texts: counted.append(texts.count()) or {})
    toxicity.learn(df, df.select("doc_id", "toxic"), F.lit(True))
    assert counted[0] <= 199


def test_toxicity_of_odd_rows(spark):
    model = toxicity.learn(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    df = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 5 and all(r.score < 0.5 for r in rows)
    assert toxicity.without_toxic(df, model).count() == 5 and toxicity.without_toxic(df, model).columns == df.columns
    assert toxicity.score(df.limit(0), model).collect() == []


def test_language_of_unseen_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op7_query.op7_language(spark, SF).where("held_out").join(documents, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    model = language.learn(df, F.lit(True))
    got = [(r.doc_id, r.lang_pred) for r in language.predict(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "und"), (2, "und"), (None, "und"), (3, "x"), (3, "x")], key=repr)
    empty = language.learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}
    assert language.predict(df.limit(0), model).collect() == []
