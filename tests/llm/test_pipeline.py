import random
import re
import sys
from collections import Counter

import pytest
import sentencepiece
from test_operators import MODEL, WORD, closure, shingle_sets

import corpus_pipeline
from kinmatch.llm.common import is_held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    texts, quality = [], []
    for i in range(300):
        good = i % 4 > 0
        words = [word() for _ in range(rng.randint(60, 150))]
        texts.append(" ".join(words) if good else " ".join(w + "###" for w in words))
        quality.append(int(good))
    passage = " ".join(word() for _ in range(60))
    for i in (9, 10, 33):
        texts[i] += "\n" + passage
    texts[13] = texts[5]
    texts[17] = texts[5].replace(" ", "  ", 1) + " end"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(300, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), texts, quality


def test_stages_against_brute_force(spark, folder):
    at, texts, quality = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "source_mix", "tokens"]

    good = stages["quality"](spark, docs, at)
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    held = [i for i in range(300) if is_held_out(i)]
    assert sum((i in kept) == quality[i] for i in held) >= 0.95 * len(held) and good.columns == columns

    unique = stages["near_duplicates"](spark, docs, at)
    sets = shingle_sets([*texts, None], 5)
    links = [(i, j) for i in range(301) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closure(301, links)
    assert {r.doc_id for r in unique.collect()} == {i for i in range(301) if want[i] == i} and unique.columns == columns and len(links) == 3

    cleaned = {r.doc_id: r for r in stages["repeated_passages"](spark, docs, at).collect()}
    words = [WORD.findall(t) for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = [m.group() + s for k, (m, s) in enumerate(zip(WORD.finditer(texts[i]), [*re.split(WORD, texts[i])[1:]])) if k not in gone]
        assert cleaned[i].text == re.split(WORD, texts[i])[0] + "".join(kept)
        assert cleaned[i].n_chars == len(cleaned[i].text)
    assert cleaned[300].text is None and len(cleaned) == 301

    mixed = stages["source_mix"](spark, docs, at)
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and 300 not in taken and max(taken.values()) <= 3
    assert 0 <= sum(map(len, words)) - sum(n * len(words[i]) for i, n in taken.items()) <= 160

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in stages["tokens"](spark, docs, at).collect():
        assert r.ids == sp.encode(texts[r.doc_id] if r.doc_id < 300 else "")


def test_run_is_its_stages(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, at)) == key(docs)


def test_entry_lists_everything():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {f"op{n}_" for n in range(1, 11)} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names and "corpus_pipeline" in sys.modules


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(12)
    text = lambda k: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(k))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    copy, other = text(80), text(80)
    data = [(7, copy), (7, copy), (None, copy), (None, copy), (9, copy), (None, other), (None, other), (3, text(80)), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, copy), (None, other), data[7], data[8]])

    data = [(None if i % 3 == 0 else i // 10, text(20 + i % 3)) for i in range(60)] + [(4, copy)] * 5
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 0) for k, (i, t) in enumerate(data)], schema)
    taken = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.source_mix(spark, docs, "").collect())
    rows = Counter((i, t, f"s{k % 2}") for k, (i, t) in enumerate(data))
    total = sum(len(t.split()) for _, t in data)
    assert all(n <= 3 * rows[r] for r, n in taken.items())
    assert total - 160 <= sum(n * len(r[1].split()) for r, n in taken.items()) <= total


def test_stages_on_edge_cases(spark, folder):
    at, texts, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, N_Words int, predicted int, size long, bucket string, _done int, component_id long, taken long"
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(1, texts[1]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, None), (4, None), (5, ""), (6, " \n\t"), (7, long), (8, f"a\n\n  b {passage}\n\n\tc  d"), (9, f"{passage}\n{texts[6]}"), (10, f"x {passage} y")]
    rows = [(i, t, None, None if i == 7 else "s", None, 1.5, 2, 3, 4, "b", 5, 6, 7) for i, t in data]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns and stage(spark, none, at).count() == 0, name
        assert all(r.score == 1.5 and r.N_Words == 2 and r.predicted == 3 and r._done == 5 for r in got.collect()), name
    quality = Counter(r.doc_id for r in corpus_pipeline.good_quality(spark, docs, at).collect())
    assert quality[1] in (0, 3), "equal texts are judged alike"
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, at).collect())
    assert kept == Counter(set(data) - {data[11]}), "the last is a near copy of the one with id 8"
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, at).collect() if r.doc_id and r.doc_id > 4}
    assert cut == {5: "", 6: " \n\t", 7: long, 8: data[9][1], 9: texts[6], 10: "x y"}
    assert corpus_pipeline.repeated_passages(spark, docs, at).where("doc_id = 10").first().n_chars == 3
    assert {r.doc_id for r in corpus_pipeline.source_mix(spark, docs, at).collect()}.isdisjoint({4, 5, 6})
    ids = {(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.tokens(spark, docs, at).collect()}
    assert {(4, False), (5, False), (6, True), (7, True), (None, False), (None, True)} <= ids and corpus_pipeline.tokens(spark, none, at).count() == 0
