"""Each stage of the pipeline against SQL or plain Python over its own input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm.jaccard_join import OP8_SQL
from quern.llm.line_dedup import OP4_SQL
from quern.llm.mixing import OP6_SQL
from quern.llm.shared import cut
from quern.llm.tokens import public
from quern.llm.toxicity import THRESHOLD, op10_toxicity


def sql(frame, text):
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    return con.execute(text).fetchall()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages, inputs = docs.columns, dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        inputs[name] = docs
        docs = cut(stage(spark, docs, sf_dir))
        assert name == "packing" or docs.columns == columns
    ids = lambda x: [r.doc_id for r in x.select("doc_id").collect()]
    clean = {r.doc_id for r in op10_toxicity(spark, sf_dir).where(F.col("score") < THRESHOLD).collect()}
    assert sorted(ids(inputs["line_dedup"])) == sorted(clean) and 0 < len(clean) < 1000
    expected = {r[0]: r[3] for r in sql(inputs["line_dedup"], OP4_SQL)}
    assert {r.doc_id: r.h for r in inputs["jaccard_join"].select("doc_id", F.sha2("text", 256).alias("h")).collect()} == expected
    assert sorted(ids(inputs["mixing"])) == sorted(r[0] for r in sql(inputs["jaccard_join"], OP8_SQL) if r[0] == r[2])
    copies = {r[0]: r[4] // r[1] for r in sql(inputs["mixing"], OP6_SQL) if r[1]}
    got = Counter(ids(inputs["packing"]))
    assert all(got[k] == n for k, n in copies.items()) and max(copies.values()) == 2 and min(copies.values()) == 0
    encode, lengths = Tokenizer.from_file(public("byte_bpe_50k.json")).encode, Counter()
    for r in inputs["packing"].select("doc_id", "text").collect():
        lengths[r.doc_id] += len(encode(r.text, add_special_tokens=False)) + 1
    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.length
    assert packed == lengths


def test_run_reads_its_own_parquet(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:2] == ["doc_id", "piece"]


ODD = [
    (1, None, "en", "web", 0, "a"), (2, "", None, None, None, "b"), (3, "a b c d e f", "en", "web", 11, "c"), (3, "a b c d e f", "en", "web", 11, "c"), (None, "of nobody", "en", "web", 9, "d"),
    (4, "long " * 60_000, "en", "books", 300_000, "e"), (5, " \n\t\n", "de", "web", 4, "f"), (6, "a b c d e f", "de", "books", 11, None), (7, "unique words of this one text", "en", None, 29, "g"),
    (8, "x\na line that many documents share\ny", "en", "web", 36, "h"), (9, "a line that many documents share\nz", "en", "web", 34, "i"), (10, "a line that many documents share", "en", "web", 32, "j"),
]


@pytest.mark.parametrize("name", [x for x, _ in corpus_pipeline.STAGES])
def test_stages_at_the_edges(spark, sf_dir, name):
    """Nulls, empty and very long texts, repeated rows, an empty table and a column whose name operators use themselves."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    key = lambda r: (r.doc_id is not None, r.doc_id)
    ids = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    if name == "packing":
        assert {key(r) for r in ids} == {(x[0] is not None, x[0]) for x in ODD}
        assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1] and len([r for r in rows if r.doc_id == 3]) == 2
    else:
        assert out.columns == docs.columns
    if name in ("toxicity", "line_dedup"):
        assert len(rows) == len(ODD)
    if name == "line_dedup":
        text = {r.doc_id: r.text for r in rows}
        assert text[1] == "" and text[8] == "x\ny" and text[9] == "z" and text[10] == ODD[-1][1]
    if name == "jaccard_join":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "None", "4", "5", "7", "8", "9", "10"])
    if name == "mixing":
        assert {r.doc_id for r in rows} <= {x[0] for x in ODD} and all(r.copies in [x[5] for x in ODD] for r in rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
