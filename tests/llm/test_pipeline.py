import corpus_pipeline
from test_lines import brute as brute_lines
from test_neardup import brute as brute_groups

from tallycard.llm import bpe, lines
from tallycard.session import settled


def test_stages_pass_on_what_they_keep(spark, small, odd):
    docs = odd.unionByName(spark.read.parquet(f"{small}/documents.parquet").limit(60).selectExpr("doc_id + 30 as doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    docs = settled(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = settled(stage(spark, docs, small))
        kept[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = kept["line dedup"]
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], lines.LEAST_SITES, 1)
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=repr) == sorted(((w[0], w[4]) for w in want), key=repr)
    before, after = kept["minhash near-dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = [r[0] for r in brute_groups(rows, 5, 80) if r[3]]
    assert sorted((r["doc_id"] for r in after.collect()), key=repr) == sorted(want, key=repr)
    before, after = kept["bpe encoding and decoding"]
    codec = bpe.Codec(open(bpe.vocabulary(), encoding="utf-8").read())
    want = [(r["doc_id"], len(codec.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before.collect()]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in after.collect()), key=repr) == sorted(want, key=repr)


def test_whole_run_on_the_small_table(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 50 < out.count() < 200
