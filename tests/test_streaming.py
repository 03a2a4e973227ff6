import json

from loomline.operators.rules import Rule
from loomline.streaming.feed import finding_counts, stream_findings


def test_findings_and_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", "bad\nok"), ("2024-01-01 00:01:00", "a", "bad\nok"), ("2024-01-01 00:02:00", "a", "ok"), ("2024-01-01 00:20:00", "b", "x\nworse bad"), ("2024-01-01 05:00:00", "c", "ok")]
    (tmp_path / "in").mkdir()
    for i, (ts, key, text) in enumerate(rows):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"ts": ts, "key": key, "text": text}))
    stream = spark.readStream.schema("ts timestamp, key string, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = stream_findings(stream, [Rule("worse", "worse", "HIGH"), Rule("bad", "bad", "LOW")], "key", "text", "ts")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.key, r.line_no, r.rule) for r in run(found, "found")} == {("a", 1, "bad"), ("b", 2, "worse")} and spark.table("found").count() == 2
    counts = run(finding_counts(found, "ts", "10 minutes"), "counted")
    assert {(r.start.hour, r.start.minute, r.rule, r.n_findings) for r in counts} == {(0, 0, "bad", 1), (0, 20, "worse", 1)}
