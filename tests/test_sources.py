"""Readers S1, S2, S8 on small files in the formats the reference reads."""

import csv
import json
import os

from pyspark.sql import functions as F

from tessera.operators import curation as C
from tessera.sources import readers as S


def test_read_mentions_array_and_lines(spark, tmp_dir):
    recs = [{"id": 1, "text": "t1", "entity": "pA", "label": "plasmid"},
            {"id": 2, "text": "t2", "entity": "x", "label": "not relevant"},
            {"id": 3, "text": "t3", "entity": "GFP", "label": "reporter"}]
    arr = os.path.join(tmp_dir, "records.json")
    with open(arr, "w") as f:
        json.dump(recs, f, indent=2)
    got = sorted(r.id for r in S.read_mentions(spark, arr).collect())
    assert got == [1, 3]
    lines = os.path.join(tmp_dir, "records.jsonl")
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    assert sorted(r.id for r in S.read_mentions(spark, lines, multiline=False).collect()) == [1, 3]


def test_read_corpus_nested(spark, tmp_dir):
    rows = [("Title A\n", "u1", "body", [(1, "plasmid", 0, 2, "pA", "abstract", "body")]),
            ("", "u2", "other", [])]
    df = spark.createDataFrame(rows, S.PAPER_SCHEMA)
    path = os.path.join(tmp_dir, "corpus")
    df.write.parquet(path)
    back = {r.uid: r for r in S.read_corpus(spark, path).collect()}
    assert back["u1"].doi == "u1" and back["u1"].annotations[0].entity == "pA"
    assert back["u2"].annotations == []


def test_read_review_csv_with_multiline_cells(spark, tmp_dir):
    path = os.path.join(tmp_dir, "review.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["title", "uid", "annotation", "prediction", "true", "wrong", "rejected"])
        w.writerow(["T, one", "u1", json.dumps({"plasmid": ["pA, pB"]}, indent=4),
                    json.dumps({"plasmid": ["pa"], "reporter": ["GFP"]}, indent=4), "{}", '"reporter": ["gfp"],', "false"])
        w.writerow(["T2", "u2", json.dumps({"promoter": ["pLac"]}, indent=4), "{}", "{}", "", "true"])
    review = C.parse_review(S.read_review(spark, path))
    rows = {r.uid: r for r in review.collect()}
    assert rows["u1"].title == "T, one" and rows["u1"].anno_map == {"plasmid": ["pA, pB"]}
    assert rows["u1"].wrong_map == {"reporter": ["gfp"]} and rows["u2"].rejected is True
    items = C.curated_items(review, C.synonym_table(spark))
    pairs = {(r.side, r.entity, r.true) for r in C.curated_pairs(items, C.review_flags(review)).collect()}
    assert ("gold", "pA", "plasmid") in pairs and ("gold", "pB", "none") in pairs
    assert ("pred", "GFP", "none") in pairs  # listed wrong (case-insensitive)
    assert ("gold", "pLac", "none") in pairs  # not predicted


def test_null_labels_stay_and_first_labels_go_by_rank(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.jsonl")
    with open(p, "w") as f:
        f.write('{"id": 1, "label": null}\n{"id": 2, "label": "not relevant"}\n{"id": 3}\n')
    assert sorted(r.id for r in S.read_mentions(spark, p, multiline=False).collect()) == [1, 3]
    v = os.path.join(tmp_dir, "v.json")
    with open(v, "w") as f:
        json.dump({"b": {"id": 20}, "a": {"id": 10}, "c": {"id": 30}}, f)
    assert [r.label for r in S.read_label_vocab(spark, v, 2).orderBy("id").collect()] == ["a", "b"]
    assert S.read_label_vocab(spark, v).count() == 3


def test_broken_review_cells_go_to_quarantine(spark):
    rows = [("t", "u1", '{"a": ["x"]}', "{}", "{}", '"a": ["x"], "a": ["y"],', False), ("t", "u2", '{"a": [', "{}", "{}", None, False),
            ("t", "u3", "{}", None, "{}", None, False), ("t", "u4", "{}", "{}", "{}", '"a": [', None), ("t", "u5", "{}", "{}", "{}", '"a": [', True)]
    parsed = C.parse_review(spark.createDataFrame(rows, S.REVIEW_SCHEMA))
    assert {r.uid: r.status for r in C.review_quarantine(parsed).collect()} == {"u2": "annotation", "u3": "prediction", "u4": "wrong"}
    kept = {r.uid: r for r in C.reviewed(parsed).collect()}
    assert set(kept) == {"u1", "u5"} and kept["u1"].wrong_map == {"a": ["y"]}  # the last of equal keys


def test_strip_removes_separators(spark):
    from tessera.functions.text import strip
    df = spark.createDataFrame([("\x1c a\x1fb \x1d\x1e\x1f",)], "s string")
    assert df.select(strip("s")).first()[0] == "a\x1fb"
