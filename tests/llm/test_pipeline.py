"""Every stage of the pipeline on what its predecessor kept, against brute force or the operator's own verdict of every row."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskgrid.llm import decontamination, near_copies, quality_rules, toxicity
from riskgrid.llm.common import read, tokenizer_file


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """Rows before the first stage and after each."""
    docs = read(spark, sf_dir, "documents")
    # near copies at ids of their own
    more = docs.where("length(text) > 800").orderBy("doc_id").limit(6).select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat("text", F.lit(" one more line")).alias("text"), "lang", "source", "n_chars")
    out = [docs.unionByName(more.select(*docs.columns))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], sf_dir).collect() or [], stage(spark, out[-1], sf_dir).schema))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_filters_do_what_their_operators_say(spark, sf_dir, kept):
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    assert ids(kept[1]) == ids(quality_rules.quality_rules(kept[0], trusted).where("kept"))
    assert ids(kept[2]) == ids(toxicity.classify(kept[1], read(spark, sf_dir, "labels")).where(F.col("score") < toxicity.THRESHOLD))
    assert 0 < len(ids(kept[2])) < len(ids(kept[1])) < len(ids(kept[0]))
    assert all(k.columns == kept[0].columns for k in kept[:5])


def test_one_of_each_group_of_near_copies_stays(kept):
    rows = [(r.doc_id, frozenset(near_copies.shingles(r.text).tolist())) for r in kept[2].collect()]
    root = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or len(a & b) >= 0.8 * len(a | b):
            x, y = root[i], root[j]
            root = {k: min(x, y) if v == max(x, y) else v for k, v in root.items()}
    assert ids(kept[3]) == sorted(set(root.values())) and len(ids(kept[3])) < len(rows)


def test_what_overlaps_a_benchmark_item_goes(spark, sf_dir, kept):
    items = [(r.text or "").lower() for r in read(spark, sf_dir, "benchmark").collect()]
    words = [[w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).split()] for t in items]
    gone = set(ids(kept[3])) - set(ids(kept[4]))
    item = max(read(spark, sf_dir, "benchmark").collect(), key=lambda r: len(r.text or "")).text.split()
    broken = " ".join("other" if k % 9 == 4 else w for k, w in enumerate(item))
    planted = spark.createDataFrame([(1, f"some words before {broken} and some after", "en", "x", 1), (2, "nothing of the kind " * 20, "en", "x", 1)], kept[3].schema)
    assert ids(corpus_pipeline.decontaminate(spark, planted, sf_dir)) == [2]
    for r in kept[3].collect():
        own = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (r.text or "").lower()).split()]
        runs = {tuple(own[i : i + 13]) for i in range(len(own) - 12)}
        if any(tuple(w[i : i + 13]) in runs for w in words for i in range(len(w) - 12)):
            assert r.doc_id in gone
    found = {r.doc_id for r in decontamination.contaminated(kept[3], read(spark, sf_dir, "benchmark")).collect()}
    assert gone == found


def test_the_rest_is_encoded_as_the_library_does(kept):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    rows = kept[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = [*sp.encode(texts[r.doc_id] or ""), sp.eos_id()]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(sp.decode(own).encode()).hexdigest())


def test_an_empty_corpus_goes_through(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, sf_dir).schema)
    assert docs.count() == 0
