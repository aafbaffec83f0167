import random

import corpus_pipeline
from specmill.session import settled


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    tongue = {"en": ["the", "and", "with", "this", "from", "other", "water", "house"], "de": ["der", "und", "nicht", "über", "schön", "Wasser", "Häuser", "weiß"]}

    def text(lang, count):
        return " ".join(rng.choice(tongue[lang]) + str(rng.choice(["", "", "s", "en"])) for _ in range(count))

    rows = [(i, text(lang := rng.choice(["en", "de"]), 80), lang, f"s{i % 3}", 0) for i in range(80)]
    passage = text("en", 30)
    rows[10] = (10, f"{passage} {text('en', 60)}", "en", "s0", 0)
    rows[11] = (11, f"{text('en', 60)} write to jane.doe@example.com now", "en", "s1", 0)
    rows += [(100, rows[0][1], "en", "s2", 0), (101, "1234 5678", "en", "s0", 0), (102, None, None, None, 0), (None, text("de", 50), "de", "s1", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        left[name] = sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x))
    everyone = sorted([*range(80), None], key=lambda x: (x is None, x))
    assert left["language_id"] == sorted([*range(80), 5, 100, None], key=lambda x: (x is None, x))
    assert left["near_duplicates"] == everyone
    assert left["decontaminate"] == [i for i in everyone if i != 10] == left["pseudonyms"]
    hidden = docs.where("doc_id = 11").first()
    assert "jane.doe@" not in hidden.text and "@example.com" in hidden.text and hidden.n_chars == len(hidden.text)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mix.count() == 80
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, mix.collect()))


def test_stages_take_columns_of_any_name_and_empty_tables(spark, tmp_path):
    names = ["score", "lang_pred", "n_mail", "_new", "_words", "_spans", "_packed", "_text", "component_id", "kept"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in names)
    spark.createDataFrame([(1, "nothing of this here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"the water and the house of number {'abcdefghij'[i]} mail me@x.org", "en", "s", 0, *range(len(names))) for i in range(10)]
    for number, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = settled(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == columns
            assert {tuple(r)[5:] for r in docs.collect()} == ({tuple(range(len(names)))} if given else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_an_empty_benchmark(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b", 0), (2, None, 0)], "doc_id bigint, text string, _items int")
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 2
