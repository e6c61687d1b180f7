import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kinmatch.llm import ann_forest, embed_dedup, licenses, minhash_dedup, mixing, piece_codec, quality_cnn, sharding, substring_dedup, toxicity, wordhash
from kinmatch.llm.common import Scratch, is_held_out
from kinmatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Clashing extra columns that every operator must leave alone.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, hash long, band int, sum long"


def docs(spark, texts, sources=None):
    rows = [(None if t == "NULL-ID" else i, t, "en", (sources or {}).get(i, f"s{i % 4}"), None, 1, 2.0, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    """Nulls, empty and long texts, exact and near copies, repeats inside and across texts, multi-byte characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß한") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(40)
    out = [None, "", " \t\n", "one", "Two words", text(5000)]
    base = text(120)
    for _ in range(6):
        words = base.split()
        words[rng.randrange(120)] = "changed"
        out.append(" ".join(words))
    out += [base, base, base.upper() if base.isascii() else base.title()]
    for _ in range(8):
        out.append(text(rng.randint(3, 60)) + "\n" + passage + "\t" + text(rng.randint(0, 30)))
    out.append(passage + " " + passage)
    out += [text(rng.randint(1, 150)) for _ in range(n - len(out))]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# 1 Toxicity


def test_toxicity_grammar():
    grammar = toxicity.fit([])
    score = lambda t: toxicity.Scorer(grammar).score(t)[0]
    assert score("you are an idiot") > score("what an idiot") > score("he is not an idiot") > score("a fine day")
    assert score("I will kill you") > score("I will kill the lights")
    assert score("they said you are an idiot") < score("you are an idiot")
    assert score("not now. you idiot") == score("you idiot"), "a negation ends with its clause"
    assert score("") == score("a fine day") < 0.5 < score("you are a stupid moron")
    assert score("I will kill you, you idiot") > max(score("I will kill you"), score("you idiot")), "both kinds of attack count"
    assert score("no idiot you") < score("idiot you")
    assert score("the idiot called you names") > score("he called the idiot names"), "reported speech governs what follows"
    assert score("kill them") > score("kill time while the train that carries them is late"), "a target must be near"


def test_composed_transducer_equals_the_cascade():
    rng = random.Random(4)
    for _ in range(3000):
        clause = [rng.choice([0, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 14))]
        flow = list(clause)  # each transducer runs over the whole output of the one before
        for machine in toxicity.CASCADE:
            state, out = machine.start, []
            for symbol in flow:
                state, some = machine.step(state, symbol)
                out += some
            flow = out + machine.end(state)
        want = sum(1 << p for p in {x for x in flow})
        got = list(toxicity.clauses([*clause, -1]))
        assert got == ([want] if {1, 2} & set(clause) else [])
        attacks = sum(s in (1, 2) for s in clause)
        assert len(flow) == attacks, "each attack comes out once"
        kinds = {toxicity.PATTERNS[p][0] for p in flow}
        assert kinds == {s for s in clause if s in (1, 2)}


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(3)
    made = []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice("lorem ipsum dolor sit amet consetetur sadipscing".split()) + str(rng.randint(0, 60)) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = "zork" + rng.choice(["ab", "ib", "ob", "ub"])
        made.append((i, " ".join(words), int(toxic)))
    grammar = toxicity.fit(made)
    assert grammar.stems == {"zork"} and not {w for w, k in grammar.words.items() if k == toxicity.INSULT} - set(toxicity.INSULTS.split())
    got = toxicity.score_documents(docs(spark, [t for _, t, _ in made] + [None, "", "x" * 200_000]), grammar)
    found = {r.doc_id: r.predicted for r in got.collect()}
    held = [i for i, _, _ in made if is_held_out(i)]
    assert all(found[i] == made[i][2] for i in held) and len(found) == 603 and found[600] == found[601] == 0
    assert toxicity.score_documents(docs(spark, []), grammar).count() == 0


# 2 Approximate nearest neighbours


def vectors(spark, x, labels=None):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], (labels or {}).get(i, 0), "t", 1) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, block string, one long")


def test_nearest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[5] = x[100]
    x[7:60] = x[200]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    got = ann_forest.nearest(vectors(spark, [*x, *bad])).collect()
    hits = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in own)
        hits += len(set(order) & {i for _, i, _ in own})
    assert hits >= 0.95 * 120
    assert [(r.vec_id, r.score) for r in got if r.query_id == 200 and r.rank <= 3] == [(7, 0.0), (8, 0.0), (9, 0.0)]
    few = ann_forest.nearest(vectors(spark, x[:4])).collect()
    assert len(few) == 3 and ann_forest.nearest(vectors(spark, [])).count() == 0


# 3 Mixing


def test_mix(spark):
    texts = corpus()
    sources = {i: None if i % 7 == 0 else f"s{i % 3}" for i in range(len(texts))}
    got = mixing.mix(docs(spark, texts, sources)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    total = sum(size.values())
    per = Counter()
    for i, s in sources.items():
        per[s] += size[i]
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # resharing, literally
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * per[s]}
        if not above:
            break
        target |= {s: 3.0 * per[s] for s in above}
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per[s]) and r.target == pytest.approx(target[s])
        assert r.taken in {k * r.size for k in range(4)}
        taken[s] += r.taken
    longest = max(size.values())
    assert len(got) == len(texts) and sum(taken.values()) <= total
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    assert rows(mixing.mix(docs(spark, texts, sources))) == sorted(map(tuple, got))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    kept = mixing.kept_documents(docs(spark, texts, sources))
    assert kept.columns == docs(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == {r.doc_id: r.taken // r.size for r in got if r.taken}


# 4 Substring dedup


def brute_substring(texts, window=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert rows(substring_dedup.digests(docs(spark, texts))) == brute_substring(texts)
    texts = corpus(3)
    assert rows(substring_dedup.digests(docs(spark, texts), window=50)) == brute_substring(texts, 50)
    twice = docs(spark, texts[:20]).unionByName(docs(spark, texts[:20]))
    assert rows(substring_dedup.digests(twice)) == sorted(brute_substring(texts[:20]) * 2)
    assert substring_dedup.digests(docs(spark, [])).count() == 0
    same = " ".join(map(str, range(30)))
    assert [r[2] for r in substring_dedup.digests(docs(spark, ["NULL-ID"]).withColumn("text", F.lit(same)).unionByName(docs(spark, [same]))).collect()] == [0, 0]
    clash = docs(spark, texts).withColumn("N_Words", F.lit(-1)).withColumn("_doc", F.lit(-1)).withColumn("_done", F.lit(-1))
    got = substring_dedup.dedup(clash, window=50)
    assert got.columns == [*docs(spark, []).columns, "_doc", "_done", "n_words", "n_removed", "kept_text"]
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()) == brute_substring(texts, 50)


def test_substring_dedup_can_keep_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    texts = [shared, f"  first\n\tline\n\n{shared}\n\nthe  end\n", f"{shared} tail ", f"head\n{shared}", shared]
    got = {r.doc_id: r.kept_text for r in substring_dedup.dedup(docs(spark, texts), form="spans").collect()}
    assert got == {0: shared, 1: "  first\n\tline\n\nthe  end\n", 2: "tail ", 3: "head\n", 4: ""}


def test_long_texts_are_hashed_by_segments(monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join("x" * rng.integers(1, 200) + str(rng.integers(0, 9)) for _ in range(800))
    whole, starts, ends = wordhash.words(text)
    at = np.arange(len(whole) - 12)
    windows = wordhash.runs(whole, at, at + 13)
    one = wordhash.runs(whole, np.array([3]), np.array([700]), 1)
    monkeypatch.setattr(wordhash, "SEGMENT", 31)
    monkeypatch.setattr(wordhash, "_powers", {})
    assert (wordhash.words(text)[0] == whole).all() and (wordhash.runs(whole, at, at + 13) == windows).all()
    assert (wordhash.runs(whole, np.array([3]), np.array([700]), 1) == one).all()


def test_portions_are_bounded_by_bytes():
    import pyarrow as pa

    from kinmatch.llm.common import portions

    sizes = [3, 0, 9, 100, 1, 4, 4, 4, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([None if n == 0 else "y" * n for n in sizes])], names=["a", "b"])
    got = [b.column(0).to_pylist() for b in portions(iter([batch]), 1, 10)]
    assert sum(got, []) == list(range(9)) and [3] in got and all(sum(sizes[i] for i in g) <= 10 for g in got if g != [3])


def test_word_hashes_do_not_depend_on_place():
    a, starts, ends = wordhash.words("x aa  bb\taa\ncc é aa bb")
    assert a[1] == a[3] == a[6] and a[2] == a[7] and len(set(a.tolist())) == 5
    assert [b"x aa  bb\taa\ncc \xc3\xa9 aa bb"[i:j] for i, j in zip(starts, ends)] == [b"x", b"aa", b"bb", b"aa", b"cc", b"\xc3\xa9", b"aa", b"bb"]


# 5 Quality classifier


def test_quality_network(spark):
    rng = random.Random(5)
    made = []
    for i in range(500):
        good = i % 3 > 0
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        made.append((i, " ".join(words) if good else " ".join(w + rng.choice(["###", "|", "%%%"]) for w in words), int(good)))
    net = quality_cnn.fit(made, epochs=4)
    texts = [t for _, t, _ in made]
    got = {r.doc_id: r for r in quality_cnn.score_documents(docs(spark, [*texts, None, "", "a" * 300_000]), net).collect()}
    held = [i for i, _, _ in made if is_held_out(i)]
    assert sum(got[i].predicted == made[i][2] for i in held) >= 0.95 * len(held)
    assert got[500].score == got[501].score and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 503
    scorer = quality_cnn.Scorer(net)
    long = " ".join(texts[1::3])  # the sliced pass equals one over the whole text
    data, tables = quality_cnn.padded(long.encode()), net.tables()
    whole = sum(tables[w][data[w : w + len(data) - quality_cnn.WIDTH + 1 : quality_cnn.STRIDE]] for w in range(quality_cnn.WIDTH))
    assert np.allclose(quality_cnn.block_max(data, tables), [whole[i : i + quality_cnn.BLOCK].max(0) for i in range(0, len(whole), quality_cnn.BLOCK)])
    assert scorer.score(long) == scorer.score(long)
    kept = quality_cnn.score_documents(docs(spark, texts[:3]), net, keep=True)
    assert kept.columns[: len(docs(spark, []).columns)] == docs(spark, []).columns
    clash = docs(spark, texts[:3]).withColumn("Score", F.lit(7))
    assert {r.score for r in quality_cnn.score_documents(clash, net, keep=True).collect()} == {got[i].score for i in range(3)}
    assert {r.Score for r in quality_cnn.score_documents(clash, net, keep=True, prefix="new_").collect()} == {7}
    assert quality_cnn.score_documents(docs(spark, []), net).count() == 0
    assert quality_cnn.Scorer(quality_cnn.fit([])).score("x") > 0.5


# 6 SentencePiece


def test_codec_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = piece_codec.PieceCodec(MODEL)
    rng = random.Random(6)
    signs = "abcdefgh theing 　é😀\n\t▁.,'\"()0123456789ABCß한語<s>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "   ", "▁", "a" * 5000, " " * 3000, "\x00\x7f￿", "x\n" * 2000]
    for t in texts:
        want = sp.encode(t)
        assert own.encode(t) == want, repr(t)
        assert own.decode(want) == sp.decode(want), repr(t)
        n, ids, decoded = own.described(t)
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), sp.decode(want)), repr(t)
    got = rows(piece_codec.encode_documents(docs(spark, [None, *texts[:50]]), MODEL))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(i, len(sp.encode(t)), digest(",".join(map(str, sp.encode(t)))), digest(sp.decode(sp.encode(t)))) for i, t in enumerate(["", *texts[:50]])]
    kept = piece_codec.encode_documents(docs(spark, texts[:5]), MODEL, keep=True)
    assert [r.ids for r in kept.orderBy("doc_id").collect()] == [sp.encode(t) for t in texts[:5]]
    assert piece_codec.encode_documents(docs(spark, []), MODEL).count() == 0


def test_codec_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_PARTS", 50)
    own, sp = piece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(20):
        text = " ".join(f"w{k * 30 + i} again" for i in range(40))
        assert own.described(text)[1] == ",".join(map(str, sp.encode(text)))
    assert max(len(own.cache), len(own.recent), len(own.known)) <= 51


# 7 Sharding


def test_shards(spark):
    rng = random.Random(7)
    texts = [None, "", *("t%d " % rng.randrange(400) * rng.randint(1, 30) for _ in range(2000)), *["hot text " * 12] * 900]
    got = sharding.shard(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes, slots, where = Counter(), {}, {}
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.text_crc32, set()).add(r.shard)
    fair = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and all(abs(s - fair) < 0.15 * fair for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(where[zlib.crc32(("hot text " * 12).encode())]) > 3, "a hot group is subdivided"
    assert sum(len(s) > 1 for s in where.values()) < 30
    assert sorted(map(tuple, sharding.shard(docs(spark, texts)).collect())) == sorted(map(tuple, got))
    assert sharding.shard(docs(spark, [])).count() == 0 and sharding.shard(docs(spark, [None])).count() == 1


# 8 Licences


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [None, "", "The MIT-License and the mit  license; Apache License", "GENERAL public license general PUBLIC license", "mitlicense", "xMIT license", "mit licenſe", "a " * 3000 + "MIT License", mit, mit.replace("hereby", "not"), "Licensed under the Apache License, Version 2.0", "é mit license ß"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(lower))
        at = {}
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    at.setdefault(k, label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(set(at.values())))), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[8].labels == "mit" and got[8].score == 1.0 and got[9].labels == "" and got[10].labels == "apache"
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licence_places_against_brute_force(spark):
    rng = random.Random(15)
    vocab = [*licenses.vocabulary(licenses.TEMPLATES), *sorted(licenses.STOP), "lorem", "ipsum"]
    texts = [None, "", "mit mit license license", "NULL-ID"]
    for _ in range(250):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            some = rng.choice(licenses.TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):  # some with changed words
                some[rng.randrange(len(some))] = rng.choice(vocab)
            at = rng.randint(0, len(words))
            words[at:at] = some
        texts.append(rng.choice([" ", ", "]).join(words).replace("license", "License"))
    data = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id IN (5, 6)"))  # repeated rows
    lists = {i: re.findall("[0-9a-z]+", (t or "").lower()) for i, t in enumerate(texts)}
    every = [*lists.values(), lists[5], lists[6]]
    known = licenses.vocabulary(licenses.TEMPLATES)
    idf = {w: round(math.log((len(every) + 1) / (sum(w in x for x in every) + 0.5)), 6) for w in known}
    got = licenses.scan(data).collect()
    assert len(got) == len(every)
    for r in got:
        words = lists[3 if r.doc_id is None else r.doc_id]
        found = []
        for x in licenses.TEMPLATES:
            (first, phrase), total = x.phrase, sum(idf[w] for w in x.words if w in idf)
            for at in range(-len(x.words), len(words)):
                here = lambda i: words[at + i] if 0 <= at + i < len(words) else None  # noqa: B023, E731
                share = sum(idf[w] for i, w in enumerate(x.words) if w in idf and here(i) == w) / total
                if [here(first + i) for i in range(len(phrase))] == phrase and round(share, 6) >= licenses.THRESHOLD:
                    found.append((x, at, min(1.0, share)))
        base = [at for x, at, _ in found if x.base]
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(base, default=None), max(base, default=None))
        assert r.labels == ",".join(sorted({x.label for x, _, _ in found})) and r.base_labels == ",".join(sorted({x.label for x, _, _ in found if x.base}))
        assert r.score == pytest.approx(max((s for _, _, s in found), default=0.0), abs=1e-6) and r.n_words == len(words)
    assert len({r.labels for r in got}) > 10


def test_quality_score_against_brute_force():
    rng = np.random.default_rng(2)
    w, e, f = quality_cnn.WIDTH, quality_cnn.EMBED, quality_cnn.FILTERS
    net = quality_cnn.Network(rng.normal(size=(256, e)), rng.normal(size=(w, e, f)), rng.normal(size=f), rng.normal(size=2 * f), 0.3)
    for n in (0, 1, 5, 6, 7, 64, 65, 600, 5000):
        text = "".join(map(chr, rng.integers(32, 126, n)))
        data = np.frombuffer(text.encode().ljust(w, b"\0"), np.uint8)
        if (len(data) - w) % quality_cnn.STRIDE:
            data = np.r_[data, np.uint8(0)]
        signal = np.array([sum(net.embed[data[at + k]] @ net.filters[k] for k in range(w)) for at in range(0, len(data) - w + 1, quality_cnn.STRIDE)])
        span, hop = quality_cnn.BLOCK * quality_cnn.CHUNK, quality_cnn.BLOCK * quality_cnn.HOP
        n_blocks = -(-len(signal) // quality_cnn.BLOCK)
        chunks = [np.maximum(signal[a : a + span].max(0) + net.bias, 0) for a in range(0, max(1, n_blocks - quality_cnn.CHUNK + quality_cnn.HOP) * quality_cnn.BLOCK, hop)]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.dense + net.offset
        assert quality_cnn.Scorer(net).score(text) == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-4)


# 9 MinHash near-dedup


def shingle_sets(texts, n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def closure(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(9)
    texts = corpus(9, 40)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for _ in range(60):  # a group of near copies around the threshold
        words = list(base)
        for _ in range(rng.randint(1, 14)):
            words[rng.randrange(150)] = f"v{rng.randrange(3000)}"
        texts.append(" ".join(words))
    sets = shingle_sets(texts, n)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closure(len(texts), links)
    got = rows(minhash_dedup.near_duplicates(docs(spark, texts), n))
    assert got == [(i, len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]


def test_near_duplicates_edge_cases(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d e f g h", "x"]).unionByName(docs(spark, ["a b c d e f g h", "x"]))
    assert rows(minhash_dedup.near_duplicates(twice)) == [(0, 4, 0, True), (0, 4, 0, True), (1, 1, 1, True), (1, 1, 1, True)]
    none = docs(spark, ["NULL-ID", None, "a b", "A B"]).collect()
    assert rows(minhash_dedup.near_duplicates(spark.createDataFrame(none, SCHEMA))) == [(None, 1, None, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (3000, minhash_dedup.SIZE), dtype=np.uint8)
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 256, x.shape, dtype=np.uint8))
    assert len(minhash_dedup.plausible(x, y, 0.8)[0]) >= 2990
    far = np.where(rng.random(x.shape) < 0.5, x, rng.integers(0, 256, x.shape, dtype=np.uint8))
    assert len(minhash_dedup.plausible(x, far, 0.8)[0]) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (7, 7), (1, 0)] + [(200, 200 + i) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)} | {i: 200 for i in range(200, 250)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# 10 Embedding near-dedup


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 24))
    x[50:130] = x[50] + 0.12 * rng.normal(size=(80, 24))
    x[200], x[300] = x[201], x[301] * 3
    x[310] = x[311] + 0.05 * rng.normal(size=24)
    labels = {i: i // 250 for i in range(400)} | {311: None}
    bad = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24]
    data = vectors(spark, [*x, *bad], labels)
    stored = np.array([v for v in np.asarray(x, np.float32)], float)
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    sim = unit @ unit.T
    links = [(i, j) for i in range(400) for j in range(i) if labels[i] == labels[j] and labels[i] is not None and sim[i, j] >= 0.93]
    want, degree = closure(405, links), Counter(k for pair in links for k in pair)
    assert len(links) > 1000
    assert rows(embed_dedup.near_duplicates(data)) == [(i, degree[i], want[i], want[i] == i) for i in range(405)]
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_embeddings_with_repeated_ids_and_rows(spark):
    # Vector 3 is linked with the second vector of id 1 alone; id 5 comes twice as one row; lengths and labels differ.
    data = [(1, [1.0, 0, 0, 0], 0), (1, [0, 1.0, 0, 0], 0), (3, [0.01, 1.0, 0, 0], 0), (5, [0, 0, 1.0, 0], 0), (5, [0, 0, 1.0, 0], 0), (6, [0, 0, 1.0, 0.01], 0)]
    data += [(7, [0, 0, 1.0], 0), (8, [0, 0, 2.0], 0), (9, [0, 0, 1.0], 1), (4, [0, 0, 1.0, 0], 0), (None, [0, 0, 1.0, 0], 0), (10, [1.0, 0, 0, 0], None)]
    got = rows(embed_dedup.near_duplicates(spark.createDataFrame([(i, [float(c) for c in v], k) for i, v, k in data], "vec_id long, embedding array<float>, label int")))
    assert got == sorted([(None, 0, None, True), (1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (6, 2, 4, False), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (10, 0, 10, True)], key=lambda r: tuple((x is not None, x) for x in r))


def test_links_are_counted_across_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 8, "WIDE": 16, "FEWER": 3}.items():
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(6)
    x = np.concatenate([c + s * rng.normal(size=(n, 16)) for c, s, n in zip(rng.normal(size=(3, 16)), (0.2, 0.28, 0.3), (70, 20, 5))])
    x[11] = x[12] = x[13]
    want = by_brute_force(x)
    assert max(r[1] for r in want) > 20
    assert rows(embed_dedup.near_duplicates(vectors(spark, x))) == want


def test_scores_are_finite():
    net = quality_cnn.fit([])
    assert all(math.isfinite(quality_cnn.Scorer(net).score(t)) for t in ("", "a", "é" * 1000))


def by_brute_force(x, threshold=0.93):
    """id, n_links, component_id, kept of vectors of one label."""
    unit = np.asarray(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = [(int(i), int(j)) for i, j in np.argwhere(np.tril(unit @ unit.T >= threshold, -1))]
    want, degree = closure(len(x), links), Counter(k for pair in links for k in pair)
    return [(i, degree[i], want[i], want[i] == i) for i in range(len(x))]


def test_embedding_groups_joined_by_far_links(spark):
    # Inside of a group the cosine is about 0.99, across about 0.945: each list fills up with its own group.
    rng = np.random.default_rng(3)
    a, d = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    far = 0.955 * a + np.sqrt(1 - 0.955**2) * d
    x = np.concatenate([c + 0.0125 * rng.normal(size=(150, 64)) for c in (a, far)])
    want = by_brute_force(x)
    assert {r[2] for r in want} == {0} and min(r[1] for r in want) > 149
    assert rows(embed_dedup.near_duplicates(vectors(spark, x))) == want


def test_embedding_components_are_completed_where_the_search_misses(spark, monkeypatch):
    # Isolated pairs, and a search too sparse for them: one hash string, one round.
    for name, value in {"TABLES": 1, "ROUNDS": 1, "AUDITS": 1}.items():
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[1::2] = x[::2] + 0.3 * rng.normal(size=(750, 32))
    want = by_brute_force(x)
    assert sum(r[1] for r in want) > 1000
    assert rows(embed_dedup.near_duplicates(vectors(spark, x))) == want
