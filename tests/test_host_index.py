"""The host index file: one JSON array whatever the splits, and its rows read back."""

import glob
import json
import random

import pytest

from tessera.sources import readers as S
from tessera.sources import sinks as K

SCHEMA = "species string, type string, name string, title string, uid string"


@pytest.mark.parametrize("parts", ["1", "7"])
def test_parts_in_order_are_the_nested_array(spark, tmp_dir, parts):
    rng = random.Random(int(parts))
    odd = lambda: rng.choice(["a", 'q"', "\\", "é", "{x", "],", "line\nbreak", "", ","])
    rows = [(rng.choice(["hot"] * 5 + ['s"1', "s2", "ö"]), odd(), odd(), rng.choice([odd(), None]), odd()) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        K.write_host_index(spark.createDataFrame(rows + rows[:20] + [(None, "a", "b", "c", "d")], SCHEMA).repartition(4), f"{tmp_dir}/h")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    files = sorted(glob.glob(f"{tmp_dir}/h/part-*"))
    assert len(files) >= min(int(parts), 3)
    nested = json.loads("".join(open(f).read() for f in files))
    assert [x["species"] for x in nested] == sorted({r[0] for r in rows}, key=str.encode)
    flat = [(x["species"], t["type"], t["name"], *t["references"]) for x in nested for t in x["tools"]]
    key = lambda r: tuple((v is not None, (v or "").encode()) for v in r)
    assert flat == sorted(rows + rows[:20], key=key)
    small = {"spark.sql.files.maxPartitionBytes": "501", "spark.sql.files.openCostInBytes": "1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        back = S.read_host_index(spark, f"{tmp_dir}/h").collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert sorted(map(tuple, back), key=key) == flat


def test_no_rows(spark, tmp_dir):
    K.write_host_index(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/h")
    assert json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{tmp_dir}/h/part-*")))) == []
    assert S.read_host_index(spark, f"{tmp_dir}/h").collect() == []
