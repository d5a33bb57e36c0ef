"""The operators against brute force and the public libraries, on small tables with odd rows."""

import hashlib
import itertools
import zlib
from collections import Counter

import pytest
import xxhash

from riskgrid.llm import decontamination, licenses, quality_classifier, quality_rules, queries, sentence_pieces, sharding, simhash, token_store, toxicity
from riskgrid.llm.common import read, tokenizer_file

WORDS = [f"word{i}" for i in range(4000)]
LONG = " ".join(WORDS[i * 7 % 4000] for i in range(3000))
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, LONG), (5, LONG), (6, LONG + " tail"), (7, "a b c " * 40), (8, "Ünïcode ▁ 日本語 \x00 x"), (8, "Ünïcode ▁ 日本語 \x00 x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in ODD], "doc_id bigint, text string, lang string, source string, fp string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def brute_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fps))


def test_simhash_is_brute_force(spark, docs, sf_dir):
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute_components(ODD)
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir).collect()]
    assert sorted(map(tuple, queries.op2_simhash(spark, sf_dir).collect())) == brute_components(rows)


def test_keep_one_of_each_component(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(ODD)})
    assert simhash.keep_one(none).count() == 0


def test_pipeline_leaves_no_near_copies(spark):
    """Texts with a few replaced words are far apart in SimHash bits, but similar in five-word shingles."""
    import corpus_pipeline

    base = [[WORDS[(i * 331 + k * (7 + 2 * i)) % 3989] for k in range(200)] for i in range(20)]
    near = [[f"new{i}" if k in (40, 90, 150) else w for k, w in enumerate(b)] for i, b in enumerate(base)]
    far = [[f"far{i}" if k % 10 == 0 else w for k, w in enumerate(b)] for i, b in enumerate(base)]
    rows = [(i + 100 * n, " ".join(w)) for n, part in enumerate((base, near, far)) for i, w in enumerate(part)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), *range(200, 220)]
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, "").collect()) == [0, 3, 4, 7, 8]


def test_quality_base_figures(spark, docs, none):
    trusted = spark.createDataFrame([(4,), (5,), (6,)], "doc_id bigint")
    for r in quality_rules.quality_rules(docs, trusted).collect():
        text = dict(ODD)[r.doc_id] or ""
        words = [w.decode() for w in text.encode().split()]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    kept = quality_rules.keep_good(docs, trusted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}
    assert quality_rules.quality_rules(none, trusted).count() == 0


@pytest.mark.parametrize("labelled", [0, 300])
def test_copies_do_not_move_the_quality_ratio(labelled, spark):
    """A third of all rows are copies of one clean text, none or all of them trusted."""
    texts = [" ".join(WORDS[(i * 37 + k * (i % 11 + 3)) % 1499] for k in range(200)) for i in range(300)]
    hot = " ".join(WORDS[1500 + k * 7 % 300] for k in range(200)) + " " + " ".join(texts[0].split()[:150])
    rows = [*enumerate(texts), *((1000 + i, hot) for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = [*range(0, 300, 2), *range(1000, 1000 + labelled)]
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    single = spark.createDataFrame(rows[:301], docs.schema)
    assert quality_rules.fit(docs, trusted) == quality_rules.fit(single, trusted)
    kept, alone = ({min(r.doc_id, 1000) for r in quality_rules.keep_good(d, trusted).collect()} for d in (docs, single))
    assert len(kept) > 75 and kept == alone and (not labelled or 1000 in kept)


def test_sentence_pieces_are_the_library(spark, docs, none, sf_dir):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = ODD + [(r.doc_id + 1000, r.text) for r in table(spark, sf_dir).collect()]
    got = sentence_pieces.encoded(docs.select("doc_id", "text").unionByName(table(spark, sf_dir).selectExpr("doc_id + 1000 as doc_id", "text")), model, with_ids=False)
    want = []
    for d, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
    assert sentence_pieces.encoded(none, model, with_ids=False).count() == 0


def test_token_store_round_trip(spark, docs, none, sf_dir):
    import numpy as np
    import tokenizers

    tk = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = sorted(queries.op3_token_store(spark, sf_dir).collect())
    at = 0
    for r, d in zip(got, sorted(table(spark, sf_dir).collect(), key=lambda r: r.doc_id), strict=True):
        ids = [*tk.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.stored(docs, tokenizer_file("word_bpe_49k.json"), end_id=2).count() == len(ODD)
    assert token_store.stored(none, tokenizer_file("word_bpe_49k.json"), end_id=2).count() == 0


def test_shards_are_near_equal_and_whole(spark, docs, none, sf_dir):
    got = queries.op9_sharding(spark, sf_dir).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir).collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert all(s == len(texts[d]) + 1 and c == zlib.crc32(texts[d]) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    size = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert size.max() - size.min() <= 2 * got["size"].max()
    assert sharding.sharded(docs.select("doc_id", "text"), n_shards=8).count() == len(ODD)
    assert sharding.sharded(none.select("doc_id", "text"), n_shards=8).count() == 0


def test_planted_passage_is_found(spark, docs, none):
    passage = " ".join(f"bench{i}" for i in range(40))
    items = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id bigint, text string")
    broken = passage.replace("bench9 ", "other ").replace("bench20 ", "more ")
    more = spark.createDataFrame([(100, f"{LONG} {broken} end", "x", "y", None)], docs.schema)
    all_docs = docs.unionByName(more)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(all_docs, items).collect()} == {(100, 1)}
    kept = decontamination.drop_contaminated(all_docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == len(ODD)
    assert decontamination.contaminated(none, items).count() == 0


@pytest.mark.parametrize("n", range(13, 21))
def test_short_items_with_replaced_words_are_found(n):
    """Every way to replace one to three words that leaves four fifths of the item."""
    item = [f"item{i}" for i in range(n)]
    seeds = decontamination.Seeds([(1, " ".join(item))])
    for k in (1, 2, 3):
        if n - k >= 0.8 * n:
            texts = [" ".join(["before", *("new" if i in gone else w for i, w in enumerate(item)), "after"]) for gone in itertools.combinations(range(n), k)]
            assert {o[0] for o in decontamination.overlaps(seeds, texts)} == set(range(len(texts)))
    assert not list(decontamination.overlaps(seeds, [" ".join(item[:9]), " ".join(item[:5] + ["x"] * 4 + item[9:]) if n < 20 else "x"]))


def test_items_without_an_id_are_matched(spark):
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(2)]
    items = spark.createDataFrame([(None, passages[0]), (2**60 + 1, passages[1])], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a " + passages[0]), (2, passages[1] + " b"), (3, LONG)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(1, None), (2, 2**60 + 1)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == [3]


def test_license_phrases(spark, docs, none):
    rows = [(1, "Under CC BY or the GNU General Public License. All rights reserved."), (2, None), (3, "general public")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels) == (12, 3, 1, "cc-by,gpl,reserved")
    assert got[2].n_words == 0 and got[3].base_labels == ""
    assert licenses.scan(docs).count() == len(ODD) and licenses.scan(none).count() == 0


@pytest.mark.parametrize("operator, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_on_rows_they_did_not_see(operator, label, spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels")
    got = operator.classify(table(spark, sf), labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got.score[got[label] == 1], got.score[got[label] == 0]
    auc = sum((g > bad).mean() + (g == bad).mean() / 2 for g in good) / len(good)
    assert auc > 0.8
    assert operator.classify(docs, labels.limit(0)).count() == len(ODD) and operator.classify(none, labels).count() == 0
