"""The pipeline's stages against brute-force versions, each on what the stage before kept."""
import duckdb
import sentencepiece as spm

import __spark_entry__ as entry
import corpus_pipeline
from commitlens.llm import langid, mixing
from commitlens.llm import sentencepiece as sp
from commitlens.llm.common import materialize

from .test_dedup import brute_components, brute_exact, norm, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = spm.SentencePieceProcessor(model_file=sp.MODEL)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
        out = materialize(stage(spark, docs, SF), f"test_{name}")
        rows = out.collect()
        if name != "sentencepiece":
            assert out.schema.simpleString() == docs.schema.simpleString()
            got = sorted(r["doc_id"] for r in rows)
        if name == "language_id":
            accepted = {r["doc_id"] for r in langid.identify(docs).collect() if r["accepted"]}
            assert got == sorted(accepted) and len(got) >= 0.97 * len(before)
        elif name == "exact_dedup":
            assert got == sorted(keep for keep, _ in brute_exact(before).values())
        elif name == "simhash_near_dedup":
            root = brute_components([slow_fingerprint(t) for _, t, *_ in before])
            least = {}
            for d, t, *_ in before:
                r = root[slow_fingerprint(t)]
                least[r] = min(d, least.get(r, d))
            assert got == sorted(least.values())
        elif name == "mix_sources":
            con = duckdb.connect()
            docs.write.parquet(f"file://{tmp_path}/documents")
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
            mixed = con.execute(mixing._SQL).fetchall()
            want = [d for d, size, _, _, taken in mixed if size for _ in range((2 * taken + size) // (2 * size))]
            assert got == sorted(want)
        else:
            assert sorted((r["doc_id"], r["token_ids"], r["n_tokens"]) for r in rows) == sorted((d, own.encode(t), len(own.encode(t))) for d, t, *_ in before)
        docs = out


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {"op1_warc_derivatives", "op3_lm_score", "op5_token_rollups", "op9_mix_sources", "op10_exact_dedup",
                                                                           "op11_lexical_search", "op13_ngram_join"}
    assert norm(" a\tb ") == "ab"
