"""Upper and lower case of each character by itself, as the queries' SQL has them."""

import duckdb
from pyspark.sql import functions as F

from sextant.functions import predicates, scalars
from sextant.operators import aggregates, textindex

TEXTS = ["Fuß the ﬁne ß and with Straße end", "ΑΣ ΣΑΣ İ the ᾀ ŉ ǰ and", "a the ßßß with b", None, "", "ﬃ", "xﬃ the ᾈᾀ and ﬀ"]


def test_case_keeps_places(spark):
    texts = TEXTS + [f"a{c}b{c}" for c in sorted(scalars.WIDE)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = rows.select("id", "text", scalars.upper(F.col("text")).alias("u"), scalars.lower(F.col("text")).alias("l")).collect()
    con = duckdb.connect()
    for r in got:
        assert (r.u, r.l) == con.execute("SELECT upper(?::VARCHAR), lower(?::VARCHAR)", [r.text, r.text]).fetchone()
        assert r.text is None or len(r.u) == len(r.l) == len(r.text) and r.u == scalars.upper_text(r.text)


def test_distances_and_words_with_sharp_s(spark):
    rows = spark.createDataFrame([(1, "x the Fußßß with y"), (2, "x the Fußßß and y")], "id long, text string")
    assert [r.d for r in rows.select(scalars.proximity(F.col("text"), "the", "with").alias("d")).collect()] == [7, None]
    assert {(r.id, r.word2 if r.word1 == "THE" else r.word1, r.distance) for r in textindex.alarms(rows, "id", ["text"], ["the", "and", "with"]).collect()} == {(1, "WITH", 7), (2, "AND", 7)}
    assert {r.word: r.n_rows for r in aggregates.word_counts(rows, "id", "text").collect()}["FUẞẞẞ"] == 2
    assert rows.where(predicates.contains_word("text", "fußßß")).count() == 2


def test_near_texts_with_repeated_and_null_ids(spark, tmp_path):
    """f_prox has a row for each text, as its SQL does, whatever the ids."""
    from harness import difference

    from sextant.plans import analysis

    rows = spark.createDataFrame([(1, "x the Fußßß with y"), (1, "x the a with y"), (1, "x the a with y"), (None, "a the b with c"), (2, "no")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert analysis.f_prox(spark, str(tmp_path)).count() == 4
    assert not difference(spark, "f_prox", analysis.f_prox, analysis.SQL["f_prox"], str(tmp_path))
