"""The pipeline's stages, each against what it should keep."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_components, brute_fingerprint, brute_overlap, brute_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def made(r):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(800)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(60, 160))) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(40, texts[0], "en", "s0", 1), (41, texts[1], "en", "s1", 1), (42, "too short", "en", "s1", 1), (43, None, "en", "s2", 0), (44, "same words here " * 50, "en", "s2", 1)]
    rows += [rows[5]]  # a repeated row
    rows += [(None, texts[7] + " no id", "en", None, 1), (None, None, None, None, None)]
    # a host that is refused, with a document that its own rules would keep
    rows += [(100 + i, f"short {i}", "en", "bad", 1) for i in range(60)] + [(200, texts[9] + " of a bad host " + texts[8], "en", "bad", 1)]
    items = [(7, " ".join(texts[3].split()[20:50])), (8, " ".join(words[:40]))]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = made(random.Random(4))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]

    def run(name, before):
        after = stages[name](spark, spark.createDataFrame(before, docs.schema), str(tmp_path))
        if name != "sharding":
            assert after.columns == COLUMNS
        return [tuple(x) for x in after.collect()]

    kept = run("quality", rows)
    ok = lambda t: (m := brute_quality(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]
    assert Counter(kept) == Counter(x for x in rows if ok(x[1]) and x[3] != "bad")
    assert any(ok(x[1]) and x[3] == "bad" for x in rows)

    single = run("near_dedup", kept)
    classes = brute_components([x[0] for x in kept], [brute_fingerprint(x[1]) for x in kept])
    assert Counter(x[0] for x in single) == Counter(set(classes))
    assert set(single) <= set(kept)

    clean = run("decontamination", single)
    assert Counter(clean) == Counter(x for x in single if not brute_overlap(x[1], items)[4])
    assert 3 not in {x[0] for x in clean}

    mix = run("mixing", clean)
    assert set(mix) <= set(clean) and max(Counter(mix).values()) <= 3

    placed = run("sharding", mix)
    assert Counter(x[:5] for x in placed) == Counter(mix)
    assert len({x[5:] for x in placed}) == len(placed) and {x[5] for x in placed} <= set(range(40))

    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(x) for x in end) == Counter(placed)


def test_stages_on_edge_tables(spark, tmp_path):
    """No rows; rows of nulls alone; extra columns under names the operators use."""
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, n_words long, fp long, kept boolean, h long, bucket int, tags map<string,int>"
    long_text = " ".join(f"w{i * i % 997}" for i in range(90))
    own = ("own", 7, 8, 9, True, 10, 11, {"a": 1})
    full = [(None, None, None, None, None, *own), (1, long_text, "en", "s", 5, *own), (1, long_text, "en", "s", 5, *own), (None, long_text[::-1], None, None, None, *own)]
    for name, stage in corpus_pipeline.STAGES:
        for rows, least in (([], 0), (full, 1)):
            docs = spark.createDataFrame(rows, kind)
            found = stage(spark, docs, str(tmp_path))
            got = found.collect()
            assert found.columns[: len(docs.columns)] == docs.columns and (len(got) > 0) == bool(least), name
            assert all(x["row"] == "own" and x["tags"] == {"a": 1} for x in got)


def test_near_dedup_sends_no_table_through_the_driver(spark):
    """Tables that grow with the documents are joined by merges, however small they are."""
    from graphloom.llm import simhash as S

    docs = spark.createDataFrame([(k, f"a b c d e {k // 2}") for k in range(20)], "doc_id long, text string")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    for frame in (S.links(edges.select(F.col("a").alias("fp"))), S.components(edges), S.classes(docs, ["doc_id"]), S.near_dedup_stage(spark, docs, "")):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
