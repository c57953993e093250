import corpus_pipeline as cp
from sigmill.llm.shared import materialize

from . import helpers as H


def test_stages_keep_columns_and_cut_repeats(spark, tmp_path):
    import numpy as np

    rng = np.random.RandomState(12)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.randint(2, 8))) for _ in range(800)]
    passage = " ".join(rng.choice(words, 60))
    rows, labels = [], []
    for i in range(150):
        t = " ".join(rng.choice(words, 120)) + ".\n" + " ".join(rng.choice(words, 40)) + "."
        bad = i % 5 == 1
        if bad:
            t = " | ".join(t.upper().split(" "))
        if i % 10 == 0:
            t += "\n" + passage
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), 0))
    rows += [(500, rows[0][1], "en", "s", 1), (501, rows[2][1] + " more", "en", "s", 1), (None, rows[4][1], None, None, None), (502, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    bad = {i for i in range(150) if i % 5 == 1}
    clean = set(range(150)) - bad
    assert not bad & set(seen["quality_classifier"])
    assert len(clean - set(seen["quality_classifier"])) <= 2
    assert not {500, 501, 502} & set(seen["near_dedup"])
    want = H.removed({i: r.text for i, r in seen["near_dedup"].items() if i is not None})
    for i, r in seen["suffix_dedup"].items():
        if i is not None:
            assert r.text == want[i][0].decode(errors="ignore") and r.n_chars == len(r.text)
    pieces = cp.STAGES[-1][1](spark, now, str(tmp_path)).toPandas()
    assert set(pieces.doc_id.dropna()) == set(seen["suffix_dedup"]) - {None}
    total = cp.run(spark, str(tmp_path)).toPandas()
    assert len(total) == len(pieces) and total.length.sum() == pieces.length.sum()


def test_columns_of_any_name_and_tables_without_n_chars(spark, tmp_path):
    names = "score, n_bytes, n_removed, n_spans, kept_sha256, _chunk, kept, gone, group_id, rank, d2, id"
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"{text} {i} {i + 1} x{i}.", "en", *([i] * 12)) for i in range(12)] + [(None, None, None, *([None] * 12)), (20, "", "en", *([0] * 12)), (3, "a repeated id", "en", *([1] * 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in names.split(", ")))
    docs = docs.withColumn("source", cp.F.lit("s"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.filter("doc_id < 12 and score > 1").collect():
            assert r["n_bytes"] == r["_chunk"] == r["score"] == r["id"]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 13
