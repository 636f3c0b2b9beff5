import zlib

import duckdb
import numpy as np

import corpus_pipeline
from marketloom.llm import mixing, packing, quality, simhash, templates
from tests.llm.cases import documents
from tests.llm.test_operators import brute_fingerprint, components


def test_stages_hand_on_documents(spark, tmp_path):
    rows, docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    # each stage by its operator's own result on its own input
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    kept = [r["doc_id"] for r in quality.quality_verdicts(docs).where("kept").collect()]
    assert sorted(r["doc_id"] for r in read("quality_rules").collect()) == sorted(kept)
    same = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert same(read("line_dedup")) == same(templates.drop_template_lines(read("quality_rules")))
    heads = {r["component_id"] for r in simhash.near_duplicates(read("line_dedup")).collect()}
    assert sorted(r["doc_id"] for r in read("near_dedup").collect()) == sorted(heads)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(read("near_dedup")).collect()}
    assert sorted(r["doc_id"] for r in read("mix_sources").collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(last) == key(whole) == key(packing.cut_pieces(now))


def test_each_stage_against_sql_or_brute_force(spark, tmp_path):
    rows, docs = documents(spark)
    docs.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/0")
    stages = dict(corpus_pipeline.STAGES)

    def step(k, name):
        out = stages[name](spark, spark.read.parquet(f"{tmp_path}/{k}"), str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k + 1}")
        return [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{k + 1}").collect()]

    def sql(k, text, columns):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
        return con.sql(f"SELECT {columns} FROM ({text})").fetchall()

    got = step(0, "quality_rules")
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, kept in sql(0, quality.SQL["op6_line_frequency_rules"], "doc_id, kept") if kept)
    got = step(1, "line_dedup")
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(sql(1, templates.SQL["op4_line_templates"], "doc_id, text"))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in got}
    heads = set(components(sorted(prints), prints, 4).values())
    got = step(2, "near_dedup")
    assert sorted(r["doc_id"] for r in got) == sorted(heads)
    got = step(3, "mix_sources")
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, n in sql(3, mixing.SQL["op1_mix_sources"], "doc_id, copies") for _ in range(n))
    tok = packing.WordTokens(packing.default_tokenizer()).tok
    expected = []
    for r in got:
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(r["doc_id"], at // 4096, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    got = step(4, "pack_sequences")
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1
