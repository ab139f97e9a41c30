"""The pipeline on a small folder of tables: what each stage decides is what its own brute force says."""

import corpus_pipeline
from tallyspark.llm.common import materialize

from .test_operators import brute_components, brute_hits, corpus, frame, toxic_corpus, words_of


def test_stages(spark, tmp_path):
    toxic, labels = toxic_corpus(spark, 600)
    texts = corpus(4, 80) + [r.text for r in toxic.where("doc_id < 600").orderBy("doc_id").collect()]
    first = len(texts) - 600
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("doc_id", labels.doc_id + first).write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, texts[10]), (2, texts[3])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontaminate", "mix_sources", "shard"]
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, str(tmp_path)), name)
        kept.append(at.collect())
        if name != "shard":
            assert at.columns == docs.columns
    ids = [[r.doc_id for r in rows] for rows in kept]
    # 1: most toxic documents go, hardly any other.
    assert len([i for i in ids[0] if i >= first and (i - first) % 9 == 0]) <= 4 and len([i for i in ids[0] if i >= first and (i - first) % 9]) >= 530
    assert set(range(first)) - set(ids[0]) <= set(range(first)) and len(set(range(first)) & set(ids[0])) >= first - 2
    # 2: one of each class of near copies.
    order = sorted(ids[0])
    classes = brute_components([texts[i] for i in order], 5, 80, 100)
    assert sorted(ids[1]) == [order[k] for k, (_, c) in enumerate(classes) if c == k]
    # 3: none with a benchmark passage, and all others.
    hits = brute_hits([texts[i] for i in sorted(ids[1])], items)
    assert sorted(ids[2]) == [i for i, h in zip(sorted(ids[1]), hits, strict=True) if not h[1]]
    # 4: copies of kept documents only, at most three, near the targets.
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3])) <= 3
    size = lambda rows: sum(len(words_of(r.text)) for r in rows)
    assert abs(size(kept[3]) - size(kept[2])) <= 3
    # 5: every row has one shard.
    assert sorted(ids[4]) == sorted(ids[3]) and all(r.shard_bytes <= 1 << 20 for r in kept[4])
    assert sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.shard) for r in kept[4])


def test_nulls_and_empty_tables(spark, tmp_path):
    """Rows with nulls in any column pass or go like others; without documents, labels and items there is nothing, and no failure."""
    rows = [(1, "a b c d e f", "en", "s", 11), (None, "g h i j k l m", None, None, None), (3, None, "en", "s", None), (None, None, None, None, None), (5, "", None, "s", 0), (None, "g h i j k l m", "de", None, 13), (1, "n o p q r s", None, "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(None, None, None), (None, 1, 1), (1, None, None), (3, None, 0)], "doc_id long, quality int, toxic int").limit(4 if name == "some" else 0).write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(None, None), (None, "n o p q r s"), (3, None)], "item_id long, text string").limit(3 if name == "some" else 0).write.parquet(str(tmp_path / name / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    # The texts of one source are mixed up to its target; the copy and the benchmark's text are gone.
    assert {r.text for r in found} <= {"a b c d e f", "g h i j k l m"} | {" ".join("a b c d e f".split()[:k]) for k in range(1, 6)} | {" ".join("g h i j k l m".split()[:k]) for k in range(1, 7)}
    assert any(r.doc_id is None for r in found) and any(r.doc_id == 1 for r in found) and all(r.shard is not None for r in found)
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)
