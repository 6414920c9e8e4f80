from pyspark.sql import functions as F

from tickloom.llm import toxicity as t


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = t.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75 and n.get((0, 1), 0) / n[0, 0] < 0.03


def test_masked_near_and_left_out():
    lexicon = t.Lexicon({"scum": (9, 0), "vil*": (4, 0)}, 20, 100)
    f = dict(zip(t.FEATURES, t.measure("YOU are $cum! VILE", lexicon), strict=True))
    assert f["masked"] > 0 and f["near"] == 0.5 and f["shouted"] > 0 and f["marks"] > 0 and f["most"] > 0
    assert lexicon.weight("vile", None) > 0 and lexicon.weight("vile", 1) > 0
    assert t.Lexicon({"vil*": (3, 0)}, 20, 100).weight("vile", 1) == 0


def test_edges(spark, edge, none, labels):
    some = spark.createDataFrame([(1, 0), (2, 0), (2, None), (None, 1), (7, 0), (5, 0)], "doc_id long, toxic int")
    got = t.toxicity(edge, some).collect()
    assert len(got) == edge.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert t.toxicity(none, labels).count() == 0 and t.toxicity(edge, labels.where("false")).count() == edge.count()
    assert t.drop_toxic(edge, some).columns == edge.columns


def test_labels_of_held_out_rows_change_nothing(documents, labels):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, t.toxicity(documents, x).collect())) for x in (labels, turned))
    assert a == b
