import itertools
import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import features as feat
from kinmatch.functions import sequence
from kinmatch.functions import text as tx
from kinmatch.sources.records import normalized


def column(spark, values, build):
    return [r[0] for r in spark.createDataFrame([(v, n) for n, v in enumerate(values)], "x string, n int").orderBy("n").select(build(F.col("x"))).collect()]


def test_normalization(spark):
    texts = ["  CAFÉ\t12 CT FL 3  ", "Café", "STRASSE ß", None]
    exact = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(tx.normalize_exact("x")).collect()]
    assert exact == ["café 12 ct fl 3", "café", "strasse ss", None]
    assert column(spark, texts, tx.normalize)[0] == "café 12 ct fl 3"
    assert column(spark, ["12 Main", "21 Main"], tx.normalize) == ["12 main", "21 main"]
    with pytest.raises(TypeError):
        tx.normalize_text(None)


def test_tokens(spark):
    got = column(spark, ["Café Alpha, 12! CAFE café", "   ,,,   ", None, "ग्रेट एग्रो"], tx.tokens)
    assert [set(g) for g in got] == [{"café", "alpha", "12", "cafe"}, set(), set(), {"ग", "र", "ट", "एग"}]


def test_score_on_all_subsets(spark):
    sets = [set(c) for n in range(4) for c in itertools.combinations("abc", n)]
    rows = [(len(t & p), len(p), len(t)) for t in sets for p in sets]
    df = spark.createDataFrame(rows, "tp int, p int, t int").select("tp", "p", "t", tx.score(F.col("tp"), F.col("p"), F.col("t")).alias("s"), tx.score_from_counts(F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")).alias("c"))
    for r in df.collect():
        want = 1.0 if r.p == r.t == 0 else 1.25 * r.tp / (1.25 * r.tp + (r.p - r.tp) + 0.25 * (r.t - r.tp))
        assert r.s == pytest.approx(want) and r.c == pytest.approx(want)
    named = {(2, 2, 2): 1, (1, 1, 2): 5 / 6, (2, 3, 2): 5 / 7, (0, 0, 2): 0, (0, 0, 0): 1, (0, 1, 0): 0}
    got = {tuple(r)[:3]: r.s for r in spark.createDataFrame(list(named), "tp int, p int, t int").select("tp", "p", "t", tx.score(F.col("tp"), F.col("p"), F.col("t")).alias("s")).collect()}
    assert got == pytest.approx(named)


def test_id_lists(spark):
    assert column(spark, ["S2-1, S3-2", "", "  "], tx.parse_ids) == [["S2-1", "S3-2"], [], []]
    for bad in ("S2-123,S2-123", "S1-123", "S2-123,", "S2-123, bad", "S2-12 3", "S2-1\t2", None):
        with pytest.raises(Exception):
            column(spark, [bad], tx.parse_ids)


def test_match_buckets(spark):
    got = [r[0] for r in spark.range(10).orderBy("id").select(tx.match_bucket(F.col("id"))).collect()]
    assert got == ["0", "1", "2", "3-4", "3-4", "5-7", "5-7", "5-7", "8+", "8+"]


SAMPLES = [
    ("Café Alpha", "193 133, Arthur IL"), ("CAFE ALPHA LLC", "198 133 Arthur Illinois"), ("", ""), ("ग्रेट एग्रो", "15/49 New Delhi"), ("名" * 220, "1" * 210), (" \t ", "!!!"), ("abc abc", "1/2"),
]


def literal(r, t):
    """The features by their definitions."""
    side = lambda s: (tx.normalize_text(s[0]), tx.normalize_text(s[1]), set(re.findall(r"[^\W_]+", s[0].lower())), set(re.findall(r"[^\W_]+", s[1].lower())), set(re.findall(r"\d+", s[0] + " " + s[1])), set(re.findall(r"\d+", s[1])), not s[0].strip(), not s[1].strip())
    a, b = side(r), side(t)
    f = {}
    for n, i in (("name", 0), ("address", 1)):
        miss = a[6 + i] or b[6 + i]
        x, y = a[2 + i], b[2 + i]
        f[f"{n}_missing"] = float(miss)
        f[f"{n}_jaccard"] = 0.0 if miss or not x | y else len(x & y) / len(x | y)
        f[f"{n}_exact"] = float(not miss and a[i] == b[i] != "")
        f[f"{n}_char"] = 0.0 if miss else 1.0 if a[i] == b[i] else SequenceMatcher(None, a[i], b[i]).ratio()
        f[f"{n}_containment"] = float(bool(not miss and x and y and (x <= y or y <= x)))
    d, e, g, h = a[4], b[4], a[5], b[5]
    f |= {"number_overlap": float(bool(d & e)), "number_disjoint": float(bool(d and e and not d & e)), "address_numbers_both": float(bool(g and h)), "address_numbers_one": float(bool(g) != bool(h)), "address_numbers_none": float(not g and not h)}
    both = bool(g and h)
    f |= {"address_numbers_equal": float(both and g == h), "address_numbers_partial": float(both and bool(g & h) and g != h), "address_numbers_unshared_ref": float(both and bool(g - h)), "address_numbers_unshared_target": float(both and bool(h - g))}
    for n in ("name_jaccard", "name_char", "name_containment"):
        f[f"{n}_x_address_missing"] = f[n] * f["address_missing"]
    return f


def test_features_match_their_definitions(spark):
    sources = spark.createDataFrame([(f"S{k}-{i}", n, a, "US") for k in (1, 2) for i, (n, a) in enumerate(SAMPLES)], "entity_id string, business_name string, business_address string, country string")
    records = normalized(sources, exact=True)
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(7) for j in range(7)], "reference_id string, target_id string")
    got = feat.features(pairs, records).collect()
    assert len(got) == 49
    for row in got:
        want = literal(SAMPLES[int(row.reference_id[3:])], SAMPLES[int(row.target_id[3:])])
        for name in feat.FEATURES:
            assert math.isclose(row[name], want[name], abs_tol=1e-12), (row.reference_id, row.target_id, name)
    with pytest.raises(Exception):
        feat.features(spark.createDataFrame([("S1-0", "S2-none")], "reference_id string, target_id string"), records, 6).collect()


def test_sequence_ratio_is_difflibs(spark):
    dice = random.Random(7)
    some = lambda n, of: "".join(dice.choice(of) for _ in range(n))
    made = [("", ""), ("", "a"), ("abcd", "bcde"), ("a" * 300, "a" * 200), (" abcd", "abcd abcd")]
    for _ in range(600):
        of = dice.choice(["ab", "abcdefghijklmnopqrst    ", "äßñ名字𝒜😀ab", "".join(map(chr, range(0x1F300, 0x1F400)))])
        a = some(dice.choice([0, 1, 40, 199, 200, 201, 450]), of)
        cut = dice.randrange(len(a) + 1)
        made.append((a, dice.choice([a[cut:] + some(9, of) + a[:cut], some(dice.choice([1, 40, 199, 200, 450]), of)])))
    rows = spark.createDataFrame([*made, (None, "a"), ("a", None)], "a string, b string").select("a", "b", sequence.ratio(spark, F.col("a"), F.col("b")).alias("x")).collect()
    assert len(rows) == len(made) + 2
    for r in rows:
        assert r.x == (None if r.a is None or r.b is None else SequenceMatcher(None, r.a, r.b).ratio()), (r.a, r.b)
