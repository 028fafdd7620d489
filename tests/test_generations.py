from pyspark.sql import functions as F
from rankforge.operators import generations


def test_phrases_are_whole_and_rows_have_their_own(spark):
    rows = [("an Alpha-cell here", ["alpha cell"], True), ("alphas cell", ["alpha cell"], False), (None, ["x"], False), ("x", [], False), ("a ?!", ["?!", ""], False), ("b", ["a"], False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v array<string>, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", generations.says_any(F.col("t"), F.col("v"))).collect())
    rows = [("see hla-dra.", ["HLA-DRA"], True), ("HLA DRA", ["HLA-DRA"], False), ("xCD4", ["CD4"], False), ("CD4_5 (cd8)", ["CD4"], True), ("cd45", ["CD4"], False), (None, ["CD4"], False), ("x", [""], False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v array<string>, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", generations.names_any(F.col("t"), F.col("v"))).collect())


def test_label_variants_and_empty_generations(spark):
    df = spark.createDataFrame([("gut epithelial cell", ["Gut", " Gut ", ""]), ("cell", None)], "x string, o array<string>")
    ends = ((" epithelial cell", (" epithelial", " epithelium")),)
    got = [r[0] for r in df.select(generations.label_variants(F.col("x"), F.col("o"), ends)).collect()]
    assert got == [["gut epithelial cell", "Gut", "gut epithelial", "gut epithelium"], ["cell"]]
    none = F.lit(None).cast("string")
    lists = {k: F.lit(None).cast("array<string>") for k in ("evidence", "negative")}
    issues = generations.generation_issues(none, none, none, F.array(F.lit("cell")), lists, lists, none, F.lit(True))
    assert spark.range(1).select(issues).first()[0] == ["missing_question", "missing_answer", "answer_lacks_label", "no_markers"]
