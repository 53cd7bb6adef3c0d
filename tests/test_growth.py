"""Work that must not be done twice, and joins that must not gather rows."""

from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators import curation as C
from tessera.operators import extraction as X
from tessera.operators import prompts as P
from tessera.sources import readers as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _review(spark):
    return spark.createDataFrame([("t", "u", '{"a": ["x, y"], "a": ["z"]}', '{"a": ["z"]}', "{}", '"a": ["q"],', False),
                                  ("t", "v", '{"a": ["x"]', "{}", "{}", None, False)], S.REVIEW_SCHEMA)


def test_review_cells_are_parsed_once(spark):
    items = C.explode_sides(C.reviewed(C.parse_review(_review(spark))))
    assert _plan(items).count("from_json(") == 3
    assert sorted(map(tuple, items.collect())) == [("u", "gold", "a", 0, 0, "z"), ("u", "pred", "a", 0, 0, "z"), ("u", "wrong", "a", 0, 0, "q")]


def test_curated_pairs_scan_their_items_twice(spark, tmp_dir):
    rows = [("u", "gold", "a", 0, 0, "Z", False), ("u", "gold", "a", 0, 1, "z", False), ("u", "pred", "a", 0, 0, "z", False), ("u", "pred", "a", 0, 1, "w", False),
            (None, "gold", "a", 0, 0, "n", None), (None, "pred", "a", 0, 0, "n", None), ("r", "pred", "a", 0, 0, "n", True)]
    spark.createDataFrame(rows, "uid string, side string, label string, vpos int, npos int, entity string, rejected boolean").write.parquet(f"{tmp_dir}/i")
    pairs = C.curated_pairs(spark.read.parquet(f"{tmp_dir}/i"), None)
    assert _plan(pairs).count("FileScan") == 2
    found = {(r.uid, r.side, r.entity, r.true) for r in pairs.collect()}
    assert found == {("u", "gold", "Z", "a"), ("u", "gold", "z", "none"), ("u", "pred", "w", "a"), (None, "pred", "n", "a"), ("r", "pred", "n", "none")}


def test_few_terms_are_found_by_a_join(spark):
    gold = spark.createDataFrame([("u", "a", e) for e in ("x", "y", "x")] + [(None, "a", "x")], "uid string, label string, entity string")
    parsed = spark.createDataFrame([("u", "a", "xy"), ("u", "a", "q"), ("u", "b", "x"), (None, "a", "x")], "uid string, label string, value string")
    found = X.match_contained(gold, parsed)
    assert "MapInArrow" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("u", "a", "x", "xy"), ("u", "a", "y", "xy")]
    many = gold.union(spark.createDataFrame([("m", "a", c) for c in "abcdefg"], gold.schema))
    texts = parsed.union(spark.createDataFrame([("m", "a", "gab")], parsed.schema))
    assert sorted(map(tuple, X.match_contained(many, texts).collect())) == [("m", "a", c, "gab") for c in "abg"] + [("u", "a", "x", "xy"), ("u", "a", "y", "xy")]


def test_report_lines_are_not_gathered_by_report(spark, tmp_dir):
    spark.createDataFrame([("*" * 68,), ("1, a, b",)], "value string").coalesce(1).write.text(f"{tmp_dir}/r")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = S.read_report(spark, f"{tmp_dir}/r")
        assert "SortMergeJoin" not in _plan(rows)
        assert [tuple(r)[1:] for r in rows.collect()] == [(1, "a", "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_strip_without_a_pattern(spark):
    texts = ["\x1c a　b  \x85", "​ x", "\n", "", "\xa0é "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip("t").alias("s"))
    assert "regexp" not in _plan(got)
    assert [r.s for r in got.collect()] == [t.strip() for t in texts]


def test_lines_bind_their_labels_once(spark):
    gens = spark.createDataFrame([("u", '1. Smalls: Ab\n- big: I cannot\nsmall kinds: x')], "uid string, pred string")
    found = X.classify_lines(gens, ["small", "big"], {"small kind": "small", "large": "big"}, ["i cannot"])
    assert _plan(found).count("btrim(") + _plan(found).count("trim(") <= 8
    assert [(r.label, r.value, r.status) for r in found.orderBy("pos").collect()] == [("small", "Ab", "ok"), ("big", "I cannot", "refusal"), ("small", "x", "ok")]


def test_templates_are_cut_before_they_meet_rows(spark):
    cut = spark.createDataFrame([("{a}-{b}-{c}",)], "t string").select(*[c.alias(n) for c, n in zip(P.cut_template(F.col("t")), ("p", "n"))])
    assert cut.select(P.fill_cut(F.col("p"), F.col("n"), {"a": F.lit("1"), "b": F.lit(None)})).first()[0] == "1--{c}"
