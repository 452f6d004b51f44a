"""All stages over nulls, empty and very long texts, repeated rows and columns that clash with those of the stages."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
CLASHING = ("_found", "_gone", "_text", "_lines", "_line_doc", "_lines_removed", "_q_kept", "_q_w", "x_q_kept", "item_id", "n_words")


def test_all_stages_with_clashing_columns(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    names = schema.names
    text = names.index("text")

    def like(doc_id, value):
        row = list(given[0])
        row[names.index("doc_id")], row[text], row[names.index("n_chars")] = doc_id, value, len(value or "")
        return tuple(row)

    own = " ".join(f"word{i}" for i in range(40))
    long = "\n".join(" ".join(f"l{i}x{j}" for j in range(12)) for i in range(20_000))
    added = [like(900_001, None), like(900_002, ""), like(None, own), like(900_003, long), like(None, None),
             like(900_004, own.replace("word", "term")), like(900_004, own.replace("word", "term"))]
    plain = spark.createDataFrame(given + added, schema)
    from pyspark.sql import functions as F

    tag = F.concat_ws("-", F.lit("mine"), "doc_id")
    wide = plain.withColumns({c: F.concat(F.lit(c), tag) for c in CLASHING})

    def through(docs):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, DATA)
            assert docs.columns == [*before.columns, *(["rate", "copies"] if docs.columns != before.columns else [])], name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        return docs.collect()

    narrow, broad = through(plain), through(wide)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text, r.rate, r.copies)
    assert sorted(map(key, narrow)) == sorted(map(key, broad))
    assert all(r[c] == f"{c}mine" + ("" if r.doc_id is None else f"-{r.doc_id}") for r in broad for c in CLASHING)
    ids = [r.doc_id for r in broad]
    assert ids.count(None) == 1 and ids.count(900_004) == 2 and 900_003 in ids
    assert not {900_001, 900_002} & set(ids)
    assert next(r.text for r in broad if r.doc_id == 900_003) == long
    assert len(ids) > 0.5 * len(given)
