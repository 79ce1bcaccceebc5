import numpy as np

import __spark_entry__
import corpus_pipeline as cp
from crossmer.llm import decontamination as dc, toxicity as tx
from crossmer.llm.tokens import TokenEncoder, default_tokenizer
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_packing
from tests.llm.texts import DOCUMENTS, odd, prose, write

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert [n for n, _ in cp.STAGES] == ["language", "toxicity", "near_dedup", "decontamination", "packing"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES:
        kept.append(cp.materialize(stage(spark, kept[-1], SMALL)))
        assert name == "packing" or kept[-1].columns == columns
    rows = [{r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]

    assert rows[1].keys() == {i for i, t in rows[0].items() if any(c.isalpha() for c in t or "")}

    grammar = tx.learn(kept[1], spark.read.parquet(f"{SMALL}/labels.parquet"), ~tx.held_out("doc_id"))
    own = tx.Grammar(grammar.words, grammar.beginnings, grammar.coefficients.tolist())
    scores = {i: float(own.scores(np.array([own.features(t)]))[0]) for i, t in rows[1].items()}
    assert rows[2].keys() == {i for i, s in scores.items() if s < tx.THRESHOLD}

    assert rows[3].keys() == {i for i, _, c in brute(list(rows[2].items())) if i == c}

    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    matcher = dc.Matcher([(r["item_id"], dc.normal(r["text"])) for r in items])
    assert rows[4].keys() == {i for i, t in rows[3].items() if not matcher.find(dc.normal(t))}
    assert not any(r["text"] in t for r in items for t in rows[4].values())

    encode = TokenEncoder(default_tokenizer()).encode
    total = {i: len(encode([t])[0]) // 4 + 1 for i, t in rows[4].items()}
    packed = kept[5].collect()
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == total
    assert check_packing(packed, 4096) <= -(-sum(total.values()) // 4096) + 1


def test_odd_documents_pass_all_stages(spark, tmp_path):
    write(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    write(spark, tmp_path, "benchmark", spark.createDataFrame([(1, prose(9, 300)[:200])], "item_id long, text string"))
    more = [(100 + n, prose(2000 + n, 50), "en", "s", 0, "", "", "", "") for n in range(10)]
    write(spark, tmp_path, "documents", odd(spark).unionByName(spark.createDataFrame(more, DOCUMENTS)))
    ids = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert {100 + n for n in range(10)} <= ids and not ids & {1, 2, 3, 9, 10}
    write(spark, tmp_path, "documents", spark.createDataFrame([], DOCUMENTS))
    assert cp.run(spark, str(tmp_path)).count() == 0
