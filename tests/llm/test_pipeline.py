"""Every stage of the pipeline against brute force over what the stage before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from parcelweave.llm import quality, toxicity
from tests.llm.conftest import SF, texts_of
from tests.llm.test_quality_secrets import plain_base, plain_measures
from tests.llm.test_search import plain_classes, plain_set
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def masked(text):
    spans, out, reached = plain_base(text), "", 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= reached:
            out += text[reached:start] + "[SECRET]"
        reached = max(reached, end)
    return out + text[reached:]


def test_stages(spark, documents, tokenizer, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scans", "packing"]
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(at)
        kept[name] = spark.read.parquet(at)
        if name != "packing":
            assert kept[name].schema == documents.schema
            docs = kept[name]

    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.is_held_out(F.col("doc_id")))
    scores = toxicity.score(documents, toxicity.train(documents, labels))
    civil = {r["doc_id"] for r in scores.filter("score < 0.5").collect()}
    one = texts_of(kept["toxicity"])
    assert Counter(one) == Counter((i, t) for i, t in texts_of(documents) if i in civil)
    two = texts_of(kept["quality_rules"])
    assert Counter(two) == Counter((i, t) for i, t in one if plain_measures(t, quality.Rules())[-1])
    three = texts_of(kept["jaccard_join"])
    stay = {c for _, c, _ in plain_classes(two)}
    assert Counter(three) == Counter((i, t) for i, t in two if i in stay or not plain_set(t))
    four = texts_of(kept["secret_scans"])
    assert Counter(four) == Counter((i, masked(t)) for i, t in three)
    check_packing(kept["packing"].collect(), four, tokenizer)


def test_run_equals_its_stages(spark, tokenizer):
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_odd_and_empty_documents(request, spark, which, tmp_path):
    docs = request.getfixturevalue(which).drop("ids")
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(at)
        after = spark.read.parquet(at)
        if name != "packing":
            assert after.schema == docs.schema
            docs = after
    assert (after.count() > 0) == (which == "odd_docs")
