"""Python-compatible text semantics: strip, line splitting, G2/G5/G7 rules,
single-pass template filling."""

from pyspark.sql import functions as F

from tessera.functions.fixed import REFUSAL_PREFIXES
from tessera.functions.text import normalise, split_lines, strip
from tessera.operators import extraction as X
from tessera.operators.prompts import fill

SAMPLES = ["  plain  ", " nbsp ", "　wide　", "\ttab\n", "inner  space", "", " sep "]


def _one(spark, rows, *cols):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [tuple(r) for r in df.select(*cols).collect()]


def test_strip_matches_python(spark):
    got = _one(spark, SAMPLES, strip(F.col("s")), normalise(F.col("s")))
    assert got == [(s.strip(), s.strip().lower()) for s in SAMPLES]


def test_split_lines_matches_splitlines(spark):
    text = ["a\nb\r\nc\rd\x0be\x0cf\x1cg h i\x85j", "one", "x\n\ny"]
    got = _one(spark, text, split_lines(F.col("s")))
    for (arr,), t in zip(got, text):
        assert [p for p in arr if p] == [p for p in t.splitlines() if p]


def test_clean_line_cases(spark):
    cases = {
        "1. Plasmid: pX": "Plasmid: pX",
        "** RBS: B0034": "RBS: B0034",
        '* "plasmid": pTps, ': "plasmid: pTps, ",
        "- Promoters: pLac": "Promoters: pLac",
        "12.  - . Terminator: T1": "Terminator: T1",
        "1. **Reporter**: GFP": "**Reporter**: GFP",
    }
    got = _one(spark, list(cases), X.clean_line(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


def test_canonical_label(spark):
    cases = {"Plasmids": "plasmid", "RBS": "rbs", "RBS (ribosome binding site)": "rbs",
             "Counter selection markers": "counter selection", "Counter selection marker": "counter selection",
             "organism hosts": "organism host", "operator": "operator"}
    got = _one(spark, list(cases), X.canonical_label(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


def test_parse_all_refusal_forms_and_shapes(spark):
    vocab = ["plasmid", "organism host", "rbs", "counter selection", "promoter"]
    resp = "\n".join([
        "1. Plasmid: pA",
        "2. Plasmids: pA",             # duplicate value after plural rule
        "* \"promoter\": pLac, pTet",   # quoted label, value with comma
        "Organism host: E. coli: K12",  # second colon stays in the value
        "plasmid (used for cloning)",   # label without colon
        "The paper mentions plasmids.",  # prose
        "RBS (ribosome binding site): B0034",
        "Counter selection markers: sacB",
        "Unknown thing: x",
    ] + [f"Promoter: {r} anywhere" for r in REFUSAL_PREFIXES] + [f"Promoter: {r.upper()}" for r in REFUSAL_PREFIXES])
    gens = spark.createDataFrame([("p1", resp), ("p2", ""), ("p3", "just prose")], "uid string, pred string")
    cl = X.classify_lines(gens, vocab)
    parsed = {(r.label, r.value) for r in X.parse_extractions(gens, vocab).collect()}
    assert parsed == {("plasmid", "pA"), ("promoter", "pLac, pTet"), ("organism host", "E. coli: K12"),
                      ("rbs", "B0034"), ("counter selection", "sacB")}
    statuses = [r.status for r in cl.orderBy("pos").collect() if r.uid == "p1"]
    assert statuses.count("refusal") == 2 * len(REFUSAL_PREFIXES)
    assert "no_separator" in statuses and "no_label" in statuses and "unknown_label" not in statuses[:4]
    empty = {r.uid for r in X.empty_papers(gens.select("uid"), X.parse_extractions(gens, vocab)).collect()}
    assert empty == {"p2", "p3"}


def test_fill_is_single_pass(spark):
    df = spark.createDataFrame([("a {text} b", "E{text}", "T")], "tmpl string, e string, t string")
    got = df.select(fill(F.col("tmpl"), {"text": F.col("e")})).first()[0]
    assert got == "a E{text} b"
    got2 = df.select(fill(F.lit("{entity} in {text}: {unknown}"), {"entity": F.col("e"), "text": F.col("t")})).first()[0]
    assert got2 == "E{text} in T: {unknown}"
