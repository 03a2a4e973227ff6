from pyspark.sql import functions as F

from loomline.functions.references import definitions
from loomline.plans import liveness, trees


def test_trees_of_small_tables_are_dealt_out(spark):
    rows = spark.range(1000, numPartitions=1).select(F.concat(F.lit("a"), "id", F.lit(".js")).alias("path"), F.lit("x").alias("content"))
    files = trees.tree(rows)
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and sum(sizes) == 1000 and max(sizes) < 200


def test_edges_plan_only_the_links_that_a_tree_has(spark):
    files = spark.createDataFrame([("src/a.rs", 1, "mod b;"), ("src/a/b.rs", 1, "")], "path string, size long, content string")
    edges = liveness.edges(files)
    assert [tuple(r) for r in edges.collect()] == [("src/a.rs", "src/a/b.rs")]
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") < 30


def test_definitions_of_several_languages(spark):
    texts = {"a.py": "class A:\n  def f(self): pass\n", "b.ts": "x\nexport function g() {}\n", "c.go": "func H() {}\n", "D.java": "public class D {}\n", "e.txt": "def no(): pass\n"}
    df = definitions(spark.createDataFrame(list(texts.items()), "path string, content string"))
    got = {(r.path, d.line_no, d.name) for r in df.collect() for d in r.definitions}
    assert got == {("a.py", 1, "A"), ("a.py", 2, "f"), ("b.ts", 2, "g"), ("c.go", 1, "H"), ("D.java", 1, "D")}
