import corpus_pipeline
from test_packing import check
from test_simhash import brute as groups_of
from test_simhash import slow as fingerprint_of
from test_substring import brute as passages_of

from loomline.llm.quality import quality
from loomline.llm.toxicity import fit, tag

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(corpus_pipeline.COLUMNS).collect()))


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "substring dedup", "packing"]

    def stage(name, docs):
        steps[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    bad = {r.doc_id for r in tag(docs, fit(docs, labels)).collect() if r.score >= 0.7}
    first = stage("toxicity", docs)
    assert rows(first) == [r for r in rows(docs) if r[0] not in bad] and first.columns == docs.columns

    good = {r.doc_id for r in quality(first).collect() if r.kept}
    second = stage("quality rules", first)
    assert rows(second) == [r for r in rows(first) if r[0] in good] and len(good) > 100

    prints = {r[0]: fingerprint_of(r[1]) for r in rows(second)}
    group = {v: g for g in groups_of(sorted(set(prints.values()))) for v in g}
    least = {}
    for d, v in sorted(prints.items()):
        least.setdefault(group.get(v, frozenset([v])), d)
    third = stage("SimHash near-dedup", second)
    assert rows(third) == [r for r in rows(second) if r[0] in set(least.values())] and third.count() < second.count()

    fourth = stage("substring dedup", third)
    want = {d: n for d, _, n, _ in passages_of([(r[0], r[1]) for r in rows(third)], 20)}
    assert len(rows(fourth)) == len(want) and sum(want.values()) > 0
    for old, new in zip(rows(third), rows(fourth)):
        assert old[0] == new[0] and old[2:4] == new[2:4] and new[4] == len(new[1])
        assert len(old[1].encode().split()) - len(new[1].encode().split()) == want[old[0]]
        assert want[old[0]] or old[1] == new[1]

    assert check(stage("packing", fourth).collect(), {r[0]: r[1] for r in rows(fourth)}, 4096) < 0.02
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "packing")).collect()))


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 4999} of the" for i in range(60_000))
    plain = [" ".join(f"{'abcdefgh'[(k * i) % 8]}{i % 13}the" for i in range(60)) for k in (1, 3, 5)]
    rows = [(i, plain[i % 3] + f" tail{i}", "en", "s", 5) for i in range(12)]
    rows += [(100, None, "en", "s", None), (101, "", None, None, 0), (None, plain[0], "en", "s", 1), (None, None, None, None, None), (102, long, "en", "s", 9), (103, "x" * 100_000, "de", None, 9), (3, plain[1], "en", "s", 5), (3, plain[1], "en", "s", 5)]
    return spark.createDataFrame([(*r, 1, "w", 0.5, "k", True, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, word string, kept double, phrase string, held boolean, start int")


def test_each_stage_on_odd_rows_and_on_none(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    steps = dict(corpus_pipeline.STAGES)

    def ids(df):
        return sorted((r.doc_id is not None, r.doc_id or 0, len(r.text or "")) for r in df.collect())

    all_rows = ids(docs)
    assert ids(steps["toxicity"](spark, docs, SF)) == all_rows
    kept = ids(steps["quality rules"](spark, docs, SF))
    assert set(kept) <= set(all_rows) and all(n for _, _, n in kept) and sum(k == 3 for _, k, _ in kept) in (0, 1, 3)
    one = steps["SimHash near-dedup"](spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS
    assert sum(not n for _, _, n in ids(one)) == 1 and sum(k == 3 for _, k, _ in ids(one)) <= 2
    cut = steps["substring dedup"](spark, docs, SF)
    assert cut.columns == corpus_pipeline.COLUMNS and cut.count() == docs.count()
    assert [r.text for r in cut.where("doc_id in (100, 101)").collect()] == ["", ""]
    pieces = steps["packing"](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in pieces) == docs.count()
