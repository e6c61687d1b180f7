import difflib
import gzip
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import features
from kinmatch.functions.features import FEATURES
from kinmatch.operators import audit, evaluation, exact, model, pairs, policy, retrieval, validation
from kinmatch.operators.retrieval import CONFIGS
from kinmatch.plans import registry
from kinmatch.sources import archives, files, sinks
from kinmatch.sources import records as rec
from kinmatch.streaming import matcher

ROWS = [
    ("S1-A", "Alpha", "12 Main", "US"), ("S1-B", "Singleton", "3 CT", "US"), ("S1-C", "Blank", "", "US"), ("S2-X", "Alpha", "12 Main", "US"),
    ("S3-Y", " ALPHA ", "12  Main", "US"), ("S2-fp", "Singleton", "3 CT", "US"), ("S3-wrong-country", "Alpha", "12 Main", "India"), ("S2-blank", "Blank", "", "US"),
]
SOURCE = "entity_id string, business_name string, business_address string, country string"
PAIR = "reference_id string, target_id string"


@pytest.fixture(scope="module")
def records(spark):
    return rec.normalized(spark.createDataFrame(ROWS, SOURCE), exact=True)


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("S1-A", "S2-X"), ("S1-A", "S3-Y"), ("S1-C", "S2-blank")], PAIR)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_exact_rules_and_summary(spark, records, truth):
    made = exact.exact_matches(records, "normalized_exact").drop("rule")
    assert rows(made) == [("S1-A", "S2-X"), ("S1-A", "S3-Y"), ("S1-B", "S2-fp")]
    assert rows(exact.exact_matches(records, "raw_exact").drop("rule")) == [("S1-A", "S2-X"), ("S1-B", "S2-fp")]
    got = evaluation.summary(evaluation.by_reference(records, truth, made)).first()
    assert got.macro_f05 == pytest.approx(1 / 3) and (got.tp, got.fp, got.fn) == (2, 1, 1)
    assert rows(evaluation.false_positives(truth, made)) == [("S1-B", "S2-fp")]
    assert rows(evaluation.false_negatives(truth, made)) == [("S1-C", "S2-blank")]
    with pytest.raises(Exception):
        evaluation.summary(evaluation.by_reference(records.where("false"), truth, made)).collect()


def test_retrieval_fixture(spark):
    data = [("S2-A", "Café Alpha", "12 Main", "US"), ("S3-B", "CAFÉ Alpha", "12 Main", "US"), ("S2-empty", "", "", "US"), ("S2-C", "Café Alpha", "12 Main", "India"), ("S1-q", "café alpha", "12 main", "US"), ("S1-blank", "", "", "US")]
    data += [(f"S2-d{i:03}", f"Unique{i}", f"{i} Road{i}", "US") for i in range(100)]
    records = rec.normalized(spark.createDataFrame(data, SOURCE), exact=True)
    assert rows(retrieval.candidates(records, CONFIGS["legacy"])) == [("S1-q", t) for t in ("S2-A", "S2-d012", "S3-B")]
    for config in CONFIGS.values():
        got = {t for _, t in rows(retrieval.candidates(records, config))}
        assert {"S2-A", "S3-B"} <= got and "S2-C" not in got
    tied = spark.createDataFrame([("r", "105", 12.5), ("r", "099", 12.5), ("r", "200", 8.0)], PAIR + ", score double")
    assert [r.target_id for r in retrieval.top_candidates(tied, 3).orderBy("rank").collect()] == ["099", "105", "200"]


def test_pairs_are_scored_where_they_are_formed(spark, noisy):
    """No exchange between a posting list's expansion and the ranks: scored pairs are never shuffled."""
    records = registry._records(spark, noisy)
    for name in ("legacy", "k100", "exact_buckets"):
        plan = retrieval.routes(records, CONFIGS[name])._jdf.queryExecution().executedPlan().toString()
        upper = plan[plan.index("Window ") : plan.index("Generate explode(split(")].splitlines()
        # Lines left of the expansion's own branch; builds of hash tables hang beside it.
        depth = len(plan[: plan.index("Generate explode(split(")].splitlines()[-1])
        assert upper and not any("Exchange" in line and len(line[: line.index("Exchange")]) <= depth and ":" not in line[: line.index("Exchange")] for line in upper)


def test_capped_bucket_takes_scored_targets_first(spark):
    """A bucket of more targets than the cap: those that share the address come first, then the smallest ids."""
    data = [("S1-q", "Same", "rare road", "US")] + [(f"S2-{i:03}", "Same", "rare road" if i in (77, 119) else f"other{i}", "US") for i in range(120)]
    data += [(f"S3-{i:03}", f"Name{i}", f"Place{i}", "US") for i in range(60)]
    records = rec.normalized(spark.createDataFrame(data, SOURCE), exact=True)
    got = [t for _, t in rows(retrieval.exact_capped(records, CONFIGS["legacy"], "name", 10))]
    assert got == [f"S2-{i:03}" for i in range(8)] + ["S2-077", "S2-119"]
    assert {("S1-q", t) for t in got} <= set(rows(retrieval.candidates(records, CONFIGS["exact_buckets"])))


def lists(spark, data):
    return spark.createDataFrame([(r, list(t)) for r, t in data], "reference_id string, ids array<string>")


def ids(spark, names):
    return spark.createDataFrame([(n, int(n[1])) for n in names], "entity_id string, source int")


def test_relationship_audit(spark):
    store = ids(spark, ["S1-A", "S1-B", "S1-C", "S1-D", "S2-X", "S2-Y", "S2-distractor", "S3-Z", "S3-W"])
    data = lists(spark, [("S1-A", ["S2-X", "S2-Y"]), ("S1-B", ["S3-Z"]), ("S1-C", []), ("S1-D", ["S2-Y", "S3-W"])])
    found = audit.relationship_audit(store, data)
    assert {r.check: r.n for r in found.collect()} == {k: int(k == "multi_owner_targets") for k in ("duplicate_truth_references", "duplicate_source_ids", "multi_owner_targets", "truth_references_missing", "references_without_truth", "truth_targets_missing", "lists_with_duplicates")}
    assert audit.passed(found)
    totals = audit.audit_totals(store, data.select("reference_id", F.explode("ids").alias("target_id"))).first()
    assert (totals.matched_targets, totals.distractors, totals.multi_owner_targets) == (4, 1, 1)
    assert tuple(audit.truth_audit(data).first())[:3] == (4, 5, 1)


def test_integrity_faults(spark):
    store = ids(spark, ["S1-A", "S1-unlabeled", "S2-X", "S2-X"])
    data = lists(spark, [("S1-A", ["S2-X", "S2-X"]), ("S1-A", []), ("S1-missing", ["S3-missing"])])
    found = audit.relationship_audit(store, data)
    assert {r.check: r.n for r in found.collect()} == {k: int(k != "multi_owner_targets") for k in ("duplicate_truth_references", "duplicate_source_ids", "multi_owner_targets", "truth_references_missing", "references_without_truth", "truth_targets_missing", "lists_with_duplicates")}
    assert not audit.passed(found)


def test_split(spark):
    data = [(f"S1-{i:03}", f"n{i}", "a", "US" if i % 3 else "FR") for i in range(90)] + [(f"S2-{i:03}", f"n{i}", "a", "US") for i in range(60)]
    records = rec.normalized(spark.createDataFrame(data, SOURCE))
    truth = spark.createDataFrame([(f"S1-{i:03}", f"S2-{i:03}") for i in range(40)], PAIR)
    split = audit.reference_split(records, truth)
    for r in split.groupBy("country", "bucket").pivot("split", ["train", "dev", "holdout"]).count().na.fill(0).collect():
        n = r.train + r.dev + r.holdout
        assert (r.train, r.dev) == (int(n * 0.7 + 1e-9), int(n * 0.15 + 1e-9))
    assert rows(split) == rows(audit.reference_split(records, truth)) != rows(audit.reference_split(records, truth, seed=1))
    assigned = audit.target_split(records, truth, split)
    assert rows(audit.verify_split(records, truth, split, assigned).where("n > 0")) == []
    flipped = assigned.withColumn("split", F.when(F.col("target_id") == "S2-003", F.when(F.col("split") == "train", "dev").otherwise("train")).otherwise(F.col("split")))
    assert [r.check for r in audit.verify_split(records, truth, split, flipped).where("n > 0").collect()] == ["target_ownership"]
    with pytest.raises(ValueError):
        audit.reference_split(records, truth, proportions={"train": 1.0, "dev": 0.5, "holdout": -0.5})


def test_tsv_round_trip(spark, tmp_path):
    good = tmp_path / "s.tsv"
    good.write_text('﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""q"" b"\t\tUS\nS1-2\t"two\nlines"\tx\tUS\n', encoding="utf-8")
    want = [("S1-1", 'a "q" b', "", "US"), ("S1-2", "two\nlines", "x", "US")]
    assert rows(files.read_tsv(spark, str(good))) == want
    assert rows(files.preview(spark, str(good), 1)) == want[:1]
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write(good.read_text(encoding="utf-8-sig"))
    assert rows(files.read_tsv(spark, str(tmp_path / "s.tsv.gz"))) == want
    for bad in ("entity_id\tname\nS1-1\tx\n", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tx\n", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tx\ty\tUS\tmore\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(Exception):
            files.read_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    with pytest.raises(ValueError):
        files.preview(spark, str(good), -1)


def test_truth_and_json_sources(spark, tmp_path):
    t = tmp_path / "t.tsv"
    t.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    assert rows(files.read_truth(spark, str(t))) == rows(files.read_raw_truth(spark, str(t))) == [("S1-1", ["S2-1", "S3-2"]), ("S1-2", [])]
    wanted = spark.createDataFrame([("S1-2",), ("S1-9",)], "reference_id string")
    assert rows(files.read_raw_truth(spark, str(t), wanted)) == [("S1-2", [])]
    with pytest.raises(Exception):
        files.read_raw_truth(spark, str(t), wanted, strict=True).collect()
    assert rows(files.read_ids(spark, str(t))) == [("S1-1",), ("S1-2",)] and files.count_rows(spark, str(t)) == 2
    j = tmp_path / "x.jsonl"
    j.write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(files.read_jsonl(spark, str(j), "a int")) == [(1,), (2,)]
    for bad in ('{"a": 1}\n\n{"a": 2}\n', '{"a": 1}\n{"a": \n'):
        j.write_text(bad)
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(j), "a int").collect()
    (tmp_path / "x.json").write_text(json.dumps(["p", "q"]))
    assert rows(files.read_json_array(spark, str(tmp_path / "x.json"))) == [("p",), ("q",)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.tsv", "1\n2\n")
        z.writestr("b.txt", "no")
    assert rows(files.read_zip_lines(spark, str(tmp_path / "z.zip"), ".tsv")) == [("in/a.tsv", 1, "1"), ("in/a.tsv", 2, "2")]


def test_sinks(spark, records, truth, tmp_path):
    out = str(tmp_path / "store")
    sinks.ingest(records, out)
    assert spark.read.parquet(out).count() == len(ROWS)
    with pytest.raises(FileExistsError):
        sinks.ingest(records, out)
    sinks.write_lists(records, truth, str(tmp_path / "m"), files=1)
    (part,) = (tmp_path / "m").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-A\tS2-X,S3-Y\nS1-B\t\nS1-C\tS2-blank\n"
    identity = {"run": "x", "ids": ["S1-A", "S1-B", "S1-C"]}
    batch = str(tmp_path / "batch")
    assert not sinks.batch_valid(spark, batch, identity)
    sinks.write_batch(truth.withColumn("p", F.lit(0.1)), truth.limit(0), records, batch, identity)
    assert sinks.batch_valid(spark, batch, identity)
    with pytest.raises(ValueError):
        sinks.batch_valid(spark, batch, identity | {"ids": ["S1-B", "S1-A", "S1-C"]})
    assert sinks.assemble(spark, [batch], "matches", 3).count() == 3
    with pytest.raises(ValueError):
        sinks.assemble(spark, [batch], "matches", 4)
    manifest = tmp_path / "batch" / "batch.json"
    (tmp_path / "batch" / ".batch.json.crc").unlink(missing_ok=True)
    manifest.write_text(manifest.read_text().replace('"x"', '"y"'))
    with pytest.raises(ValueError):
        sinks.batch_valid(spark, batch, identity)
    ranked = spark.createDataFrame([("S1-A", "S2-X", 1), ("S1-A", "S3-Y", 20)], PAIR + ", rank int")
    sinks.write_routes(ranked, str(tmp_path / "routes"))
    assert {r.k: r["count"] for r in spark.read.json(str(tmp_path / "routes")).groupBy("k").count().collect()} == {10: 1, 50: 2, 100: 2}
    sinks.write_report(spark, str(tmp_path / "r.json"), {"n": 1}, "Audit")
    assert files.read_manifest(spark, str(tmp_path / "r.json")) == {"n": 1} and "| n | 1 |" in (tmp_path / "r.md").read_text()


def test_validator_rules(spark):
    refs = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "reference_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "target_id string")
    check = lambda lines, **k: {r.check.removeprefix("matching_"): r.n for r in validation.submission(spark.createDataFrame([(x,) for x in lines], "value string"), refs, **k).where("n > 0").collect()}
    good = ["S1-1\tS2-1,S3-1", "S1-2\t", "S1-3\tS2-1"]
    assert check(good, targets=known) == {"candidate_file_absent": 1}
    cases = {
        "row_without_tab": ["S1-1\t", "S1-2\t", "S1-3\t", "oops"], "duplicate_rows": [*good, "S1-1\t"], "duplicate_ids": ["S1-1\tS2-1,S2-1", *good[1:]], "self_match": ["S1-1\tS1-2", *good[1:]],
        "wrong_prefix": ["S1-1\tX-2", *good[1:]], "unknown_ids": ["S1-1\tS2-9", *good[1:]], "missing_references": good[1:], "extra_references": [*good, "S1-9\t"],
    }
    for rule, lines in cases.items():
        got = check(lines, targets=known)
        assert got.pop(rule) == 1 and set(got) == {"candidate_file_absent"}, rule
    cands = spark.createDataFrame([("S1-1\tS2-1",), ("S1-2\t",), ("S1-3\tS2-1",)], "value string")
    assert check(good, targets=known, candidate_lines=cands) == {"match_not_in_candidates": 1}
    assert validation.header_problem("a,b", ["a", "b"]) == "comma_separated_header" and validation.header_problem(None, ["a"]) == "empty_file"
    assert validation.header_problem("A\tb\n", ["a", "b"]) is None and validation.header_problem("x\tb", ["a", "b"]) == "wrong_header"


def test_packet_rules(spark, truth):
    base = truth.withColumn("y", F.lit(1)).withColumns({n: F.lit(0.0) for n in FEATURES}).withColumn("p", F.lit(0.5))
    found = lambda df, **k: {r.check for r in validation.packet(df, truth, **k).where("n > 0").collect()}
    assert found(base) == set()
    assert found(base.withColumn("y", F.lit(2))) == {"label_not_binary", "label_is_not_membership"}
    assert found(base.withColumn("name_char", F.lit(float("nan")))) == {"feature_not_finite"}
    assert found(base.withColumn("p", F.lit(1.5))) == {"probability_out_of_range"}
    assert found(base.union(base)) == {"repeated_pairs"}
    parts = spark.createDataFrame([("S1-A", "train"), ("S1-A", "tune")], "reference_id string, partition string")
    assert found(base, partitions=parts) == {"partitions_overlap"}


def test_policies_and_tuning(spark, records, truth):
    scored = spark.createDataFrame([("S1-A", "S2-X", 0.9, 0.7, "US"), ("S1-A", "S3-Y", 0.5, 0.7, "US"), ("S1-B", "S2-fp", 0.4, 0.1, "US"), ("S1-C", "S2-blank", 0.3, 0.9, "France")], PAIR + ", pa double, pb double, country string")
    assert rows(policy.final_policy(scored)) == [("S1-A", "S2-X"), ("S1-A", "S3-Y"), ("S1-C", "S2-blank")]
    assert rows(policy.hybrid_policy(scored, "US")) == [("S1-A", "S2-X"), ("S1-A", "S3-Y"), ("S1-B", "S2-fp"), ("S1-C", "S2-blank")]
    grid = [0.0, 0.35, 0.45, 0.6, 1.0]
    got = {r.threshold: r.macro_f05 for r in policy.sweep(records, truth, scored, grid, "pa").collect()}
    for t in grid:
        want = evaluation.summary(evaluation.by_reference(records, truth, policy.thresholded(scored, t, "pa"))).first().macro_f05
        assert got[t] == pytest.approx(want)
    # thresholds up to 0.5 that separate the false pair tie
    assert policy.tune(records, truth, scored, "b", "pb")[0] == pytest.approx(0.15)
    assert policy.tune(records, truth, scored, "d", "pb") == (pytest.approx(0.7), 1.0)
    assert policy.larger_set_wins(0.5, 0.503) and not policy.larger_set_wins(0.5, 0.501)
    best = policy.pick_blend(policy.blend_grid(records, truth, scored, [0.0, 0.5], [0.3, 0.6])).first()
    assert (best.weight, best.threshold) == (0.5, 0.6)


def test_models(spark, tmp_path):
    data = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", float(i % 2) * 0.8 + 0.1, float(i % 3) / 3, i % 2) for i in range(40)], PAIR + ", u double, v double, y int")
    fitted = model.logistic(data, ["u", "v"])
    got = model.probabilities(fitted, data, ["u", "v"])
    assert got.where("(p >= 0.5) <> (y = 1)").isEmpty()
    model.save(fitted, str(tmp_path / "m"))
    assert rows(model.probabilities(model.load(str(tmp_path / "m")), data, ["u", "v"])) == rows(got)
    with pytest.raises(ValueError):
        model.probabilities(fitted, data.drop("v"), ["u", "v"])
    assert model.probabilities(model.boosted(data, ["u", "v"], depth=2, rounds=3), data, ["u", "v"]).where("(p >= 0.5) <> (y = 1)").isEmpty()


def test_pairs_and_comparisons(spark, records, truth):
    made = exact.exact_matches(records, "normalized_exact").drop("rule")
    assert {(r.target_id, r.y) for r in pairs.labelled(made, truth).collect()} == {("S2-X", 1), ("S3-Y", 1), ("S2-fp", 0)}
    assert rows(pairs.offsets(records, made)) == [("S1-A", 2, 0, 2), ("S1-B", 1, 2, 3), ("S1-C", 0, 3, 3)]
    a, b = (evaluation.by_reference(records, truth, x) for x in (made, truth))
    got = evaluation.paired_comparison(a, b).first()
    assert (got.wins, got.losses, got.ties) == (0, 2, 1)
    ci = evaluation.bootstrap_interval(a, b).first()
    assert ci.low <= ci.mean_delta <= ci.high and ci.mean_delta == pytest.approx(-2 / 3)
    lists_a = evaluation.lists_of(records, made)
    assert evaluation.fingerprint(lists_a).first() == evaluation.fingerprint(lists_a.repartition(3)).first() != evaluation.fingerprint(evaluation.lists_of(records, truth)).first()
    quality = evaluation.retrieval_quality(records, truth, made).first()
    assert (quality.candidates_median, quality.candidates_p95, quality.candidates_max) == (1, 2, 2) and quality.link_recall == pytest.approx(2 / 3, abs=1e-9)


def test_stream_resumes(spark, records, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    refs = rec.references(records)
    refs.where("entity_id = 'S1-A'").write.parquet(incoming)
    config = CONFIGS["exact_buckets"]
    identity = matcher.run_identity(config, data="fixture")
    matcher.match_stream(spark, incoming, records, out, config, identity).awaitTermination()
    refs.where("entity_id <> 'S1-A'").write.mode("append").parquet(incoming)
    for _ in range(2):  # the second start finds nothing new
        matcher.match_stream(spark, incoming, records, out, config, identity).awaitTermination()
    assert rows(matcher.matched(spark, out)) == rows(retrieval.candidates(records, config))


def test_batches_of_a_stream_are_signed(spark, records, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    rec.references(records).repartition(3, "entity_id").write.parquet(incoming)
    config = CONFIGS["legacy"]
    identity = matcher.run_identity(config, records)
    assert identity == matcher.run_identity(config, records.repartition(5)) != matcher.run_identity(config, records.where("entity_id <> 'S2-X'"))
    matcher.match_stream(spark, incoming, records, out, config, identity, files_per_batch=1).awaitTermination()
    folders = matcher.published(spark, out)
    assert len(folders) > 1 and rows(matcher.matched(spark, out)) == rows(retrieval.candidates(records, config))
    done = tmp_path / "out" / "batches" / "0"
    (done / "batch.json").rename(done / "gone.json")
    assert matcher.published(spark, out) == folders[1:], "without its manifest a batch is not complete"
    (done / "gone.json").rename(done / "batch.json")
    spark.createDataFrame([("S1-A", "S9-forged")], PAIR).write.mode("append").parquet(f"{done}/pairs")
    with pytest.raises(ValueError):
        matcher.matched(spark, out)


def test_split_import(spark):
    store = rec.normalized(spark.createDataFrame([(f"S{s}-{n}", n, "a", "US") for s, names in ((1, "ABCD"), (2, "XE"), (3, "Y")) for n in names], SOURCE))
    truth = spark.createDataFrame([("S1-A", "S2-X"), ("S1-B", "S3-Y")], PAIR)
    refs = spark.createDataFrame([("S1-A", "train"), ("S1-B", "dev"), ("S1-C", "holdout"), ("S1-D", "dev")], "reference_id string, split string")
    drawn = spark.createDataFrame([("S2-E", "train")], "target_id string, split string")
    split, assigned = audit.import_split(store, truth, refs, drawn)
    assert rows(split.select("reference_id", "split")) == rows(refs)
    assert rows(assigned.select("target_id", "split")) == [("S2-E", "train"), ("S2-X", "train"), ("S3-Y", "dev")]
    for bad in ((refs.where("reference_id <> 'S1-C'"), drawn), (refs.union(refs.limit(1)), drawn), (refs.replace("dev", "other", "split"), drawn), (refs, drawn.limit(0))):
        with pytest.raises(ValueError):
            audit.import_split(store, truth, *bad)


def test_lists_must_cover_the_references(spark, records):
    good = lists(spark, [("S1-A", ["S2-X", "S3-Y"]), ("S1-B", []), ("S1-C", ["S2-blank"])])
    assert evaluation.macro_of_lists(records, good, good).first().macro_f05 == 1.0
    for bad in (good.where("reference_id <> 'S1-B'"), good.union(good.limit(1)), good.union(lists(spark, [("S1-Z", ["S2-X"])]))):
        with pytest.raises(ValueError):
            evaluation.macro_of_lists(records, good, bad)
        with pytest.raises(ValueError):
            evaluation.macro_of_lists(records, bad, good)


def test_errors_are_mined_by_category(spark, records, truth):
    data = [("S1-A", "S2-X", 0.9, 0.0, 1.0, 1.0), ("S1-A", "S3-Y", 0.1, 0.0, 1.0, 0.0), ("S1-B", "S2-fp", 0.8, 0.0, 1.0, 0.0), ("S1-C", "S2-blank", 0.2, 1.0, 0.0, 0.0)]
    scored = spark.createDataFrame(data, PAIR + ", p double, address_missing double, address_numbers_both double, address_numbers_equal double")
    got = rows(evaluation.mined_errors(records, truth, scored, 0.5).select("category", "kind", "target_id", "p", "target_name"))
    assert got == [("missing_address", "FN", "S2-blank", 0.2, "Blank"), ("numeric_disagreement", "FN", "S3-Y", 0.1, " ALPHA "), ("numeric_disagreement", "FP", "S2-fp", 0.8, "Singleton")]
    assert [tuple(r)[1:4] for r in evaluation.pooled_at(truth, scored, [0.85, 0.15]).orderBy("threshold").collect()] == [(2, 1, 1), (1, 0, 2)]


def test_locked_threshold(spark, records, truth):
    tuning = spark.createDataFrame([("S1-A", "S2-X", 0.6, 0.9), ("S1-A", "S3-Y", 0.6, 0.9), ("S1-C", "S2-blank", 0.6, 0.9), ("S1-B", "S2-fp", 0.5, 0.1)], PAIR + ", pa double, pb double")
    later = tuning.withColumn("pa", F.when(F.col("target_id") == "S2-fp", 0.58).otherwise(F.col("pa")))
    got = {r.model: r for r in policy.confirmed((records, truth, tuning), (records, truth, later), ["pa", "pb"], [0.3, 0.55, 0.95]).collect()}
    assert (got["pa"].threshold, got["pa"].fp, got["pb"].threshold, got["pb"].fp) == (0.55, 1, 0.3, 0) and got["pa"].oracle_macro_f05 == got["pb"].macro_f05 == 1.0


def test_output_audits(spark, records, truth):
    good = lists(spark, [("S1-A", ["S2-X", "S3-Y"]), ("S1-B", []), ("S1-C", ["S2-blank"])])
    other = lists(spark, [("S1-A", ["S2-X"]), ("S1-B", ["S2-none"]), ("S1-C", ["S2-blank"])])
    found = lambda df: {r.check: r.n for r in df.where("n > 0").collect()}
    assert found(validation.hybrid_audit(records, {"India": "b"}, "a", good, good, a=good, b=other)) == {}
    assert found(validation.hybrid_audit(records, {"US": "b"}, "a", good, good, a=good, b=other)) == {"policy_mapping": 2}
    assert found(validation.hybrid_audit(records, {"US": "b"}, "a", other, good, a=good, b=other)) == {"match_not_in_candidates": 1, "unknown_targets": 1}
    assert found(validation.rescored((good, good), (good, good))) == {}
    assert found(validation.rescored((good, good), (other.where("reference_id <> 'S1-C'"), other))) == {"coverage_lost": 1, "candidates_changed": 2}
    fresh = truth.withColumns({n: F.lit(0.5) for n in FEATURES})
    assert found(validation.cache_parity(fresh, fresh.withColumn("name_char", F.lit(0.500001)))) == {}
    assert found(validation.cache_parity(fresh, fresh.withColumn("name_char", F.lit(0.501)).where("target_id <> 'S3-Y'"))) == {"not_cached": 1, "not_close": 2}


def test_archives(tmp_path):
    (tmp_path / "p" / "in").mkdir(parents=True)
    (tmp_path / "p" / "in" / "a.txt").write_text("a")
    (tmp_path / "p" / "m.json").write_text("{}")
    z = str(tmp_path / "p.zip")
    assert archives.pack(str(tmp_path / "p"), z) == archives.pack(str(tmp_path / "p"), z), "equal folders give equal archives"
    want = {"in/a.txt": archives.checksum(tmp_path / "p" / "in" / "a.txt"), "m.json": archives.checksum(tmp_path / "p" / "m.json")}
    archives.extract(z, str(tmp_path / "out"), want)
    assert (tmp_path / "out" / "in" / "a.txt").read_text() == "a"
    with pytest.raises(FileExistsError):
        archives.extract(z, str(tmp_path / "out"), want)
    for wrong in (want | {"b": "0"}, {"m.json": want["m.json"]}, want | {"m.json": "0"}):
        assert archives.problems(z, wrong)
    (tmp_path / "p.zip.sha256").write_text("0  p.zip")
    assert archives.problems(z)
    for name in ("../x", "/x", "a\\x", "C:x", "in/../../x"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as f:
            f.writestr(name, "x")
        with pytest.raises(ValueError):
            archives.extract(str(tmp_path / "bad.zip"), str(tmp_path / "never"))
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "twice.zip", "w") as f:
        f.writestr("x", "1")
        f.writestr("x", "2")
    assert archives.problems(str(tmp_path / "twice.zip")) and not (tmp_path / "never").exists()


def test_packets_and_stores_are_checked(spark, records, truth, tmp_path):
    at = str(tmp_path / "packet")
    sinks.write_packet(truth.withColumns({"y": F.lit(1), "partition": F.lit("train")}), at, {"features": []})
    held, metadata = sinks.read_packet(spark, at)
    assert held.count() == 3 and metadata["pairs"] == {"train": 3} and metadata["files"]
    truth.limit(1).withColumn("y", F.lit(0)).write.mode("append").parquet(f"{at}/pairs/partition=train")
    with pytest.raises(ValueError):
        sinks.read_packet(spark, at)
    store = str(tmp_path / "store")
    assert sinks.ingest(records, store, identity={"x": 1}) and not sinks.ingest(records, store, identity={"x": 1})
    with pytest.raises(ValueError):
        sinks.ingest(records, store, identity={"x": 2})
    j = tmp_path / "x.jsonl"
    j.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    assert [(r.line_number, r.value) for r in files.invalid_json_lines(spark, str(j), "a int").collect()] == [(2, ""), (4, '{"a": ')]
    assert files.dataset_paths("/d/")[0] == "/d/train/source_1.tsv"


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """Documents with names and addresses of shared words: each reference has many legacy candidates."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(7)) for _ in range(100)]
    line = lambda: " ".join(rng.choice(words) for _ in range(4))
    texts = [f"{line()}\n{line()}" for _ in range(300)]
    texts[30:60] = texts[31:61]
    at = str(tmp_path_factory.mktemp("noisy"))
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def test_no_exchange_has_sides(spark, records):
    """Sides meet pairs in their place: what is above the hash table of targets is not shuffled."""
    pairs = spark.createDataFrame([("S1-A", "S2-X"), ("S1-A", "S2-fp")], PAIR)
    for made in (features.with_sides(pairs, records), features.features(pairs, records)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange" not in plan[: plan.index("ShuffledHashJoin")]
        assert made.count() == 2
    with pytest.raises(Exception, match="no record for pair"):
        features.with_sides(spark.createDataFrame([("S1-A", "S2-none")], PAIR), records).collect()


def test_sequence_features_of_noisy_candidates(spark, noisy):
    pairs = {tuple(r) for r in registry._legacy(spark, noisy).select("reference_id", "target_id").collect()}
    records = {r.entity_id: r for r in registry._records(spark, noisy).collect()}
    got = registry.features_sequence(spark, noisy).collect()
    assert {(r.reference_id, r.target_id) for r in got} == pairs and len(got) == len(pairs) > 1000
    for r in got[:200]:
        a, b = records[r.reference_id], records[r.target_id]
        assert r.name_char == pytest.approx(difflib.SequenceMatcher(None, a.name_norm, b.name_norm, False).ratio())
    assert sum(0 < r.name_char < 1 for r in got) > 1000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_stay_in_the_jvm(spark, noisy):
    """Texts of pairs don't go to Python, and a pair's sets are met once each."""
    for made in (registry.features_sequence(spark, noisy), registry.features_all22(spark, noisy)):
        plan = plan_of(made)
        assert "Python" not in plan and "array_except" not in plan and "array_union" not in plan


def test_candidates_are_found_once(spark, noisy):
    """Features read candidates twice, so they are written."""
    for made in (registry.features_sequence(spark, noisy), registry.features_all22(spark, noisy)):
        assert "posexplode" not in plan_of(made) and "Window" not in plan_of(made)


def test_models_read_what_is_written(spark, noisy):
    """The fit's sample is written, so no round sorts all pairs again; its rows and the features are those of all pairs."""
    rows, train = registry._model_pairs(spark, noisy)
    assert "Sort" not in plan_of(train) and "TakeOrdered" not in plan_of(train)
    want = rows.where("split = 'train'").orderBy(F.xxhash64(*registry.PAIR), *registry.PAIR).limit(registry.FITTED)
    assert sorted(train.collect()) == sorted(want.collect())
    first = [*registry.PAIR, *FEATURES]
    assert sorted(rows.select(*first).collect()) == sorted(registry.features_all22(spark, noisy).select(*first).collect())
    truth = {tuple(r) for r in registry._truth(spark, noisy).collect()}
    assert all(r.y == ((r.reference_id, r.target_id) in truth) for r in rows.collect())


def test_what_is_written_leaves_no_shuffle(spark):
    """The setting under which shuffle files go with their job holds while rows are written, and only then."""
    seen, was = [], spark.conf.get(registry.CLEANUP)

    class Rows:
        @property
        def write(self):
            seen.append(spark.conf.get(registry.CLEANUP))
            return spark.range(3).repartition(2, "id").write

    assert registry._kept(spark, Rows(), "rows").count() == 3
    assert seen == ["true"] and spark.conf.get(registry.CLEANUP) == was
