"""Every stage of the pipeline against brute force on the smallest tables."""

import os
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import packing, toxicity
from tessera.llm.common import crc_mod, table, written
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, table(spark, SF, "labels").where(crc_mod("doc_id", 3) != 1))
    score = toxicity.scorer(model)
    out = written(stages["toxicity"](spark, docs, SF), "t")
    assert out.schema == docs.schema
    ids = sorted(r.doc_id for r in out.collect())
    assert ids == sorted(i for i, r in rows.items() if score(r.text) < 0.7)

    out = written(stages["simhash_near_dedup"](spark, out, SF), "t")
    assert out.schema == docs.schema
    points = {}
    for i in ids:
        points.setdefault(slow_fingerprint(rows[i].text or ""), i)
    want = slow_components(sorted(((i, f) for f, i in points.items())), 4)
    ids = sorted(r.doc_id for r in out.collect())
    assert ids == sorted(set(want.values()))

    out = written(stages["decontamination"](spark, out, SF), "t")
    assert out.schema == docs.schema
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {d for d, *_ in brute([(i, rows[i].text) for i in ids], items)}
    ids = [i for i in ids if i not in dirty]
    assert sorted(r.doc_id for r in out.collect()) == ids

    out = written(stages["source_mixing"](spark, out, SF), "t")
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == ids

    packed = stages["packing"](spark, out, SF).collect()
    encoder = packing.Encoder(packing.ranks_of(packing.VOCABULARY))
    parts = defaultdict(dict)
    for r in packed:
        x = np.frombuffer(r.ids, dtype="<u2")
        for d, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d][o] = x[a:b]
    assert sorted(parts) == ids
    for i in ids:
        assert b"".join(parts[i][o].tobytes() for o in sorted(parts[i])) == encoder(rows[i].text)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
