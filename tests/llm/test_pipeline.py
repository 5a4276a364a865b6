import corpus_pipeline

from gaugeline.llm import bpe, decontaminate, lines, quality, simhash
from gaugeline.llm.common import table
from gaugeline.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept, before = {r["doc_id"] for r in out.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= before and len(kept) > 0.5 * len(before)
        docs = out.cache()
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == kept
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codec = bpe.Codec(open(tokenizer("byte_bpe_50k.json"), "rb").read())
    for r in got.collect():
        assert codec.decode(r["ids"]) == texts[r["doc_id"]]


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert {s[1].__name__ for s in corpus_pipeline.STAGES} == {"quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"}
    assert all((quality, lines, simhash, decontaminate))
