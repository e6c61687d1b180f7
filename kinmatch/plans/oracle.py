"""DuckDB SQL of the oracles: common table expressions by name, put together with what they depend on."""

from __future__ import annotations

from collections.abc import Sequence

#: name: (names it depends on, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _norm(column: str) -> str:
    return f"trim(regexp_replace(replace(lower(nfc_normalize({column})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
_DIGITS = "list_distinct(regexp_extract_all({0}, '\\p{{Nd}}+'))"


def _cte(name: str, body: str, *depends: str) -> None:
    _CTES[name] = (depends, body)


_cte(
    "raw_records",
    "SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, (doc_id % 3 + 1)::INT AS source, lang AS country, split_part(text, chr(10), 1) AS name_raw, "
    f"split_part(text, chr(10), 2) AS address_raw, {_norm('text')} AS text_norm FROM documents",
)
_cte(
    "records",
    f"SELECT *, (country_norm <> '' AND name_norm <> '' AND address_norm <> '')::INT AS eligible FROM (SELECT *, {_norm('country')} AS country_norm, {_norm('name_raw')} AS name_norm, {_norm('address_raw')} AS address_norm FROM raw_records)",
    "raw_records",
)
_cte("truth", "SELECT r.entity_id AS reference_id, t.entity_id AS target_id FROM records r JOIN records t ON r.country = t.country AND r.text_norm = t.text_norm WHERE r.source = 1 AND t.source IN (2, 3)", "records")
for _rule, _keys in (("raw_exact", ("country", "name_raw", "address_raw")), ("normalized_exact", ("country_norm", "name_norm", "address_norm"))):
    _on = " AND ".join(f"r.{k} = t.{k}" for k in _keys)
    _cte(_rule, f"SELECT '{_rule}' AS rule, r.entity_id AS reference_id, t.entity_id AS target_id FROM records r JOIN records t ON {_on} WHERE r.source = 1 AND t.source IN (2, 3) AND r.eligible = 1 AND t.eligible = 1", "records")
for _name, _rule in (("evaluation", "normalized_exact"), ("raw_evaluation", "raw_exact")):
    _cte(
        _name,
        "SELECT *, CASE WHEN true_count = 0 AND predicted_count = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * tp / (predicted_count + 0.25::DOUBLE * true_count) END AS score FROM "
        "(SELECT entity_id AS reference_id, country, coalesce(g, 0) AS true_count, coalesce(m, 0) AS predicted_count, coalesce(h, 0) AS tp, coalesce(m, 0) - coalesce(h, 0) AS fp, coalesce(g, 0) - coalesce(h, 0) AS fn FROM records "
        "LEFT JOIN (SELECT reference_id, count(*) AS g FROM truth GROUP BY 1) a ON a.reference_id = entity_id "
        f"LEFT JOIN (SELECT p.reference_id, count(*) AS m, count(t.target_id) AS h FROM {_rule} p LEFT JOIN truth t ON t.reference_id = p.reference_id AND t.target_id = p.target_id GROUP BY 1) b ON b.reference_id = entity_id WHERE source = 1)",
        "records",
        "truth",
        _rule,
    )

SUMMARY = (
    'count(*) AS "references", round(avg(score), 9) AS macro_f05, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS micro_precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 9) AS micro_recall, '
    "count_if(true_count = 0) AS singletons, count_if(true_count = 0 AND predicted_count > 0) AS singleton_false_matches, round(count_if(true_count = 0 AND predicted_count > 0) / nullif(count_if(true_count = 0), 0), 9) AS singleton_false_positive_rate, "
    "count_if(predicted_count > 0) AS references_with_predictions, round(count_if(fp = 0 AND fn = 0) / count(*), 9) AS exact_set_accuracy, round(count_if(true_count = 0) / count(*), 9) AS empty_baseline, "
    "round(avg(CASE WHEN true_count = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * tp / (tp + 0.25::DOUBLE * true_count) END), 9) AS candidate_oracle_macro_f05"
)

_cte("tok", f"SELECT entity_id, source, country, field, unnest(t) AS token FROM (SELECT entity_id, source, country, 'name' AS field, {_TOKENS.format('name_raw')} AS t FROM records UNION ALL SELECT entity_id, source, country, 'address', {_TOKENS.format('address_raw')} FROM records)", "records")
_cte("frequency", "SELECT k.country, field, token, count(*) AS df, any_value(n) AS n FROM tok k JOIN (SELECT country, count(*) AS n FROM records WHERE source IN (2, 3) GROUP BY 1) c ON c.country = k.country WHERE source IN (2, 3) GROUP BY 1, 2, 3", "tok", "records")
for _cap in (5, 5000, 20000):
    _cte(f"idf{_cap}", f"SELECT country, field, token, df, ln(n / df::DOUBLE) AS idf FROM frequency WHERE df <= least({_cap}, n * 0.05::DOUBLE)", "frequency")
    _cte(
        f"asked{_cap}",
        f"SELECT * FROM (SELECT k.entity_id AS reference_id, k.country, k.field, k.token, i.idf, row_number() OVER (PARTITION BY k.entity_id, k.field ORDER BY i.df, k.token) AS rank FROM tok k JOIN idf{_cap} i ON i.country = k.country AND i.field = k.field AND i.token = k.token WHERE k.source = 1) WHERE rank <= 5",
        "tok",
        f"idf{_cap}",
    )
    _cte(f"scores{_cap}", f"SELECT a.reference_id, a.field, k.entity_id AS target_id, round(sum(a.idf), 9) AS score FROM asked{_cap} a JOIN tok k ON k.country = a.country AND k.field = a.field AND k.token = a.token WHERE k.source IN (2, 3) GROUP BY 1, 2, 3", f"asked{_cap}", "tok")
    _cte(f"ranked{_cap}", f"SELECT *, row_number() OVER (PARTITION BY reference_id, field ORDER BY score DESC, target_id) AS rank FROM scores{_cap}", f"scores{_cap}")
    _cte(f"joint{_cap}", f"SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY score DESC, target_id) AS rank FROM (SELECT reference_id, target_id, round(sum(score), 9) AS score FROM scores{_cap} GROUP BY 1, 2)", f"scores{_cap}")
_cte("exact_both", "SELECT r.entity_id AS reference_id, t.entity_id AS target_id FROM records r JOIN records t ON r.country = t.country AND r.name_norm = t.name_norm AND r.address_norm = t.address_norm WHERE r.source = 1 AND t.source IN (2, 3) AND r.name_norm <> '' AND r.address_norm <> ''", "records")
_cte("candidates_legacy", "SELECT reference_id, target_id FROM ranked5000 WHERE rank <= 50 UNION SELECT reference_id, target_id FROM exact_both", "ranked5000", "exact_both")
for _field, _other in (("name", "address"), ("address", "name")):
    for _df, _cap in ((5000, 10), (5000, 50), (20000, 50)):
        _cte(
            f"capped_{_field}_{_df}_{_cap}",
            f"SELECT reference_id, target_id FROM (SELECT b.*, row_number() OVER (PARTITION BY b.reference_id ORDER BY coalesce(s.score, 0) DESC, b.target_id) AS rank FROM (SELECT r.entity_id AS reference_id, t.entity_id AS target_id FROM records r JOIN records t "
            f"ON r.country = t.country AND r.{_field}_norm = t.{_field}_norm WHERE r.source = 1 AND t.source IN (2, 3) AND r.{_field}_norm <> '') b LEFT JOIN scores{_df} s ON s.reference_id = b.reference_id AND s.target_id = b.target_id AND s.field = '{_other}') WHERE rank <= {_cap}",
            "records",
            f"scores{_df}",
        )
_cte("matching", "SELECT entity_id AS reference_id, coalesce(string_agg(target_id, ',' ORDER BY target_id), '') AS ids FROM records LEFT JOIN normalized_exact ON reference_id = entity_id WHERE source = 1 GROUP BY 1", "records", "normalized_exact")

_cte(
    "split",
    "SELECT reference_id, country, match_count, bucket, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY country, bucket) AS n, "
    "row_number() OVER (PARTITION BY country, bucket ORDER BY sha256('42:' || reference_id), reference_id) AS k FROM (SELECT *, CASE WHEN match_count <= 2 THEN match_count::VARCHAR WHEN match_count <= 4 THEN '3-4' WHEN match_count <= 7 THEN '5-7' ELSE '8+' END AS bucket FROM "
    "(SELECT entity_id AS reference_id, country, count(target_id) AS match_count FROM records LEFT JOIN truth ON reference_id = entity_id WHERE source = 1 GROUP BY 1, 2)))",
    "records",
    "truth",
)
_cte(
    "target_split",
    "SELECT entity_id AS target_id, coalesce(owned, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'holdout' END) AS split, reference_id, source FROM (SELECT entity_id, source, ('0x' || substr(sha256('42:' || entity_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM records WHERE source IN (2, 3)) "
    "LEFT JOIN (SELECT t.target_id, min(t.reference_id) AS reference_id, arg_min(s.split, t.reference_id) AS owned FROM truth t JOIN split s ON s.reference_id = t.reference_id GROUP BY 1) ON target_id = entity_id",
    "records",
    "truth",
    "split",
)

_SIDE = "entity_id, name_norm, address_norm, {} AS nt, {} AS at, {} AS d, {} AS e, regexp_matches(name_raw, '^\\s*$') AS nm, regexp_matches(address_raw, '^\\s*$') AS am".format(
    _TOKENS.format("name_raw"), _TOKENS.format("address_raw"), _DIGITS.format("name_raw || ' ' || address_raw"), _DIGITS.format("address_raw")
)
_cte("sides", f"SELECT {_SIDE} FROM records", "records")


def _feature_columns() -> str:
    both = "(len(r.e) > 0 AND len(t.e) > 0)"
    only = lambda a, b: f"(len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0)"
    out = {}
    for f, s, m in (("name", "nt", "nm"), ("address", "at", "am")):
        miss = f"(r.{m} OR t.{m})"
        common, union = f"len(list_intersect(r.{s}, t.{s}))", f"len(list_distinct(r.{s} || t.{s}))"
        out[f"{f}_missing"] = f"{miss}::INT::DOUBLE"
        out[f"{f}_jaccard"] = f"CASE WHEN {miss} OR {union} = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / {union} END"
        out[f"{f}_exact"] = f"(NOT {miss} AND r.{f}_norm = t.{f}_norm AND r.{f}_norm <> '')::INT::DOUBLE"
        out[f"{f}_containment"] = f"(NOT {miss} AND len(r.{s}) > 0 AND len(t.{s}) > 0 AND (NOT {only(f'r.{s}', f't.{s}')} OR NOT {only(f't.{s}', f'r.{s}')}))::INT::DOUBLE"
    out["number_overlap"] = "(len(list_intersect(r.d, t.d)) > 0)::INT::DOUBLE"
    out["number_disjoint"] = "(len(r.d) > 0 AND len(t.d) > 0 AND len(list_intersect(r.d, t.d)) = 0)::INT::DOUBLE"
    out["address_numbers_both"] = f"{both}::INT::DOUBLE"
    out["address_numbers_one"] = "((len(r.e) > 0) <> (len(t.e) > 0))::INT::DOUBLE"
    out["address_numbers_none"] = "(len(r.e) = 0 AND len(t.e) = 0)::INT::DOUBLE"
    equal = f"(NOT {only('r.e', 't.e')} AND NOT {only('t.e', 'r.e')})"
    out["address_numbers_equal"] = f"({both} AND {equal})::INT::DOUBLE"
    out["address_numbers_partial"] = f"({both} AND len(list_intersect(r.e, t.e)) > 0 AND NOT {equal})::INT::DOUBLE"
    out["address_numbers_unshared_ref"] = f"({both} AND {only('r.e', 't.e')})::INT::DOUBLE"
    out["address_numbers_unshared_target"] = f"({both} AND {only('t.e', 'r.e')})::INT::DOUBLE"
    return ", ".join(f"{v} AS {k}" for k, v in out.items())


_cte("plain_features", f"SELECT c.reference_id, c.target_id, {_feature_columns()} FROM candidates_legacy c JOIN sides r ON r.entity_id = c.reference_id JOIN sides t ON t.entity_id = c.target_id", "candidates_legacy", "sides")
_cte("features", "SELECT *, name_jaccard * address_missing AS name_jaccard_x_address_missing, name_containment * address_missing AS name_containment_x_address_missing FROM plain_features", "plain_features")
_cte(
    "scored",
    "SELECT f.reference_id, f.target_id, country, round(1 / (1 + exp(-(-2.5::DOUBLE + 3.0::DOUBLE * name_jaccard + 2.0::DOUBLE * address_jaccard + 1.5::DOUBLE * name_exact + 1.0::DOUBLE * address_exact))), 9) AS pa, "
    "round(1 / (1 + exp(-(-2.25::DOUBLE + 2.5::DOUBLE * name_jaccard + 2.5::DOUBLE * address_jaccard + 1.0::DOUBLE * name_containment + 0.5::DOUBLE * number_overlap))), 9) AS pb FROM features f JOIN records ON entity_id = f.reference_id",
    "features",
    "records",
)


#: Truth lists with faults: one reference twice, one list with an id twice, one unknown reference with an unknown target,
#: and no list for the largest reference. A known target has two owners besides.
_cte("ends", "SELECT min(entity_id) FILTER (source = 1) AS low, max(entity_id) FILTER (source = 1) AS high, min(entity_id) FILTER (source = 2) AS target FROM records", "records")
_cte("clean_lists", "SELECT entity_id AS reference_id, coalesce(list_sort(list(target_id) FILTER (target_id IS NOT NULL)), []) AS ids FROM records LEFT JOIN truth ON reference_id = entity_id WHERE source = 1 GROUP BY 1", "records", "truth")
_cte(
    "faulty_lists",
    "SELECT reference_id, ids FROM clean_lists, ends WHERE reference_id <> high UNION ALL SELECT low, [target, target] FROM ends UNION ALL SELECT 'S1-none', ['S3-none', 'X-1', target] FROM ends",
    "clean_lists",
    "ends",
)
_cte("faulty_links", "SELECT DISTINCT reference_id, unnest(ids) AS target_id FROM faulty_lists", "faulty_lists")
_cte("faulty_records", "SELECT entity_id, source FROM records UNION ALL SELECT target, 2 FROM ends", "records", "ends")


def findings(**offenders: str) -> str:
    """check, n and up to five examples (the smallest ids) of each rule; offenders: a query with a column id."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM ({sql})) AS n, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT id FROM ({sql}) ORDER BY id LIMIT 5)), '') AS examples" for name, sql in offenders.items()
    )


RELATIONSHIPS = findings(
    duplicate_truth_references="SELECT reference_id AS id FROM faulty_lists GROUP BY 1 HAVING count(*) > 1",
    duplicate_source_ids="SELECT entity_id AS id FROM faulty_records GROUP BY 1 HAVING count(*) > 1",
    multi_owner_targets="SELECT target_id AS id FROM faulty_links GROUP BY 1 HAVING count(*) > 1",
    truth_references_missing="SELECT DISTINCT reference_id AS id FROM faulty_lists WHERE reference_id NOT IN (SELECT entity_id FROM records WHERE source = 1)",
    references_without_truth="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM faulty_lists)",
    truth_targets_missing="SELECT DISTINCT target_id AS id FROM faulty_links WHERE target_id NOT IN (SELECT entity_id FROM records WHERE source IN (2, 3))",
    lists_with_duplicates="SELECT reference_id AS id FROM faulty_lists WHERE len(ids) <> len(list_distinct(ids))",
)

#: Lines of a matching file with every fault, and of a candidate file: the legacy candidates less those of the smallest
#: reference, whose line has no tab.
_cte(
    "match_lines",
    "SELECT reference_id, ids FROM clean_lists, ends WHERE reference_id <> high UNION ALL SELECT low, ['X-1', 'S1-00000001', 'S2-none', 'S2-none'] FROM ends UNION ALL SELECT 'S1-none', []",
    "clean_lists",
    "ends",
)
_cte("candidate_lists", "SELECT entity_id AS reference_id, coalesce(list_sort(list(c.target_id) FILTER (c.target_id IS NOT NULL)), []) AS ids FROM records LEFT JOIN candidates_legacy c ON c.reference_id = entity_id WHERE source = 1 GROUP BY 1", "records", "candidates_legacy")
_cte("candidate_lines", "SELECT reference_id, ids FROM candidate_lists, ends WHERE reference_id <> low", "candidate_lists", "ends")


def _line_findings(name: str, lines: str, no_tab: str) -> dict[str, str]:
    ids = f"SELECT unnest(ids) AS id FROM {lines}"
    return {
        f"{name}_row_without_tab": no_tab,
        f"{name}_duplicate_rows": f"SELECT reference_id AS id FROM {lines} GROUP BY 1 HAVING count(*) > 1",
        f"{name}_duplicate_ids": f"SELECT reference_id AS id FROM {lines} WHERE len(ids) <> len(list_distinct(ids))",
        f"{name}_self_match": f"SELECT id FROM ({ids}) WHERE id LIKE 'S1-%'",
        f"{name}_wrong_prefix": f"SELECT id FROM ({ids}) WHERE NOT regexp_matches(id, '^S[123]-')",
        f"{name}_missing_references": f"SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM {lines})",
        f"{name}_extra_references": f"SELECT reference_id AS id FROM {lines} WHERE reference_id NOT IN (SELECT entity_id FROM records WHERE source = 1)",
        f"{name}_unknown_ids": f"SELECT id FROM ({ids}) WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records WHERE source IN (2, 3))",
    }


_OUTSIDE = "SELECT m.reference_id AS id FROM {} m LEFT JOIN {} c USING (reference_id) WHERE len(list_filter(m.ids, lambda x: NOT list_contains(coalesce(c.ids, []), x))) > 0"
SUBMISSION = findings(
    **_line_findings("matching", "match_lines", "SELECT 'no tab here' AS id"),
    **_line_findings("candidate", "candidate_lines", "SELECT low AS id FROM ends"),
    match_not_in_candidates=_OUTSIDE.format("match_lines", "candidate_lines"),
    unknown_ids_not_checked="SELECT NULL::VARCHAR AS id WHERE false",
    candidate_file_absent="SELECT NULL::VARCHAR AS id WHERE false",
)
COVERAGE = findings(
    matches_missing="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM faulty_lists) UNION ALL SELECT reference_id FROM candidate_lines WHERE reference_id NOT IN (SELECT reference_id FROM faulty_lists) AND reference_id NOT IN (SELECT entity_id FROM records WHERE source = 1)",
    candidates_missing="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM candidate_lines) UNION ALL SELECT 'S1-none'",
    not_expected="SELECT 'S1-none' AS id",
    duplicate_match_rows="SELECT reference_id AS id FROM faulty_lists GROUP BY 1 HAVING count(*) > 1",
    duplicate_candidate_rows="SELECT reference_id AS id FROM candidate_lines GROUP BY 1 HAVING count(*) > 1",
    match_not_in_candidates=_OUTSIDE.format("faulty_lists", "candidate_lines"),
)

#: Labelled pairs with faults: the first pair's label is 2, the last comes twice, a true pair is labelled 0.
_cte("pair_ends", "SELECT min(reference_id || '|' || target_id) AS low, max(reference_id || '|' || target_id) AS high FROM candidates_legacy", "candidates_legacy")
_cte("true_pairs", "SELECT c.reference_id || '|' || c.target_id AS id FROM candidates_legacy c JOIN truth t USING (reference_id, target_id)", "candidates_legacy", "truth")
PACKET = findings(
    label_not_binary="SELECT low AS id FROM pair_ends",
    feature_not_finite="SELECT high AS id FROM pair_ends UNION ALL SELECT high FROM pair_ends",
    label_is_not_membership="SELECT low AS id FROM pair_ends UNION ALL SELECT min(id) FROM true_pairs, pair_ends WHERE id > low",
    repeated_pairs="SELECT high AS id FROM pair_ends",
)
_cte("faulty_split", "SELECT reference_id, country, match_count + (reference_id = low)::INT AS match_count, bucket, split FROM split, ends WHERE reference_id <> high UNION ALL SELECT 'S1-none', 'es', 0, '0', 'train'", "split", "ends")
_cte("faulty_targets", "SELECT target_id, split, reference_id FROM target_split UNION ALL SELECT target_id, split, reference_id FROM target_split, ends WHERE target_id = target UNION ALL SELECT 'S3-none', 'unknown', 'S1-none'", "target_split", "ends")
SPLIT = findings(
    reference_coverage="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM faulty_split)",
    extra_references="SELECT reference_id AS id FROM faulty_split WHERE reference_id NOT IN (SELECT entity_id FROM records WHERE source = 1)",
    target_coverage="SELECT entity_id AS id FROM records WHERE source IN (2, 3) AND entity_id NOT IN (SELECT target_id FROM faulty_targets)",
    extra_targets="SELECT target_id AS id FROM faulty_targets WHERE target_id NOT IN (SELECT entity_id FROM records WHERE source IN (2, 3))",
    repeated_assignments="SELECT target_id AS id FROM faulty_targets GROUP BY 1 HAVING count(*) > 1",
    repeated_references="SELECT reference_id AS id FROM faulty_split GROUP BY 1 HAVING count(*) > 1",
    target_ownership="SELECT t.target_id AS id FROM faulty_targets t LEFT JOIN faulty_split s ON s.reference_id = t.reference_id WHERE t.reference_id IS NOT NULL AND (s.split IS NULL OR s.split <> t.split)",
    owner_without_truth="SELECT target_id AS id FROM faulty_targets f WHERE reference_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.target_id = f.target_id AND t.reference_id = f.reference_id)",
    truth_owner="SELECT t.target_id AS id FROM truth t JOIN (SELECT target_id, reference_id AS owner FROM faulty_targets) a USING (target_id) WHERE owner IS NULL OR owner <> t.reference_id",
    reference_metadata="SELECT s.reference_id AS id FROM faulty_split s JOIN records r ON r.entity_id = s.reference_id AND r.source = 1 LEFT JOIN (SELECT reference_id, count(*) AS n FROM truth GROUP BY 1) t ON t.reference_id = s.reference_id WHERE match_count <> coalesce(n, 0) OR s.country <> r.country",
    unknown_split="SELECT id FROM (SELECT reference_id AS id, split FROM faulty_split UNION ALL SELECT target_id, split FROM faulty_targets) WHERE split NOT IN ('train', 'dev', 'holdout')",
    stratification="SELECT country || '/' || bucket AS id FROM faulty_split GROUP BY country, bucket HAVING abs(count_if(split = 'train') - count(*) * 0.7::DOUBLE) > greatest(2, 0.02::DOUBLE * count(*)) OR abs(count_if(split = 'dev') - count(*) * 0.15::DOUBLE) > greatest(2, 0.02::DOUBLE * count(*)) OR abs(count_if(split = 'holdout') - count(*) * 0.15::DOUBLE) > greatest(2, 0.02::DOUBLE * count(*))",
)


def quality(k: int) -> str:
    return (
        f"WITH c AS (SELECT reference_id, target_id FROM ranked5000 WHERE rank <= {k} UNION SELECT reference_id, target_id FROM exact_both), "
        "e AS (SELECT entity_id, coalesce(g, 0) AS g, coalesce(m, 0) AS m, coalesce(h, 0) AS h FROM records LEFT JOIN (SELECT reference_id, count(*) AS g FROM truth GROUP BY 1) a ON a.reference_id = entity_id "
        "LEFT JOIN (SELECT c.reference_id, count(*) AS m, count(t.target_id) AS h FROM c LEFT JOIN truth t ON t.reference_id = c.reference_id AND t.target_id = c.target_id GROUP BY 1) b ON b.reference_id = entity_id WHERE source = 1), "
        "s AS (SELECT list(m ORDER BY m) AS l FROM e) "
        'SELECT count(*) AS "references", sum(m)::BIGINT AS candidates_total, round(avg(m), 9) AS candidates_mean, max(m) AS candidates_max, round(sum(h) / nullif(sum(g), 0), 9) AS link_recall, '
        "round(avg(CASE WHEN g = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * h / (h + 0.25::DOUBLE * g) END), 9) AS oracle_macro_f05, round(count_if(g > 0 AND h = 0) / nullif(count_if(g > 0), 0), 9) AS zero_retrieved_rate, "
        "(SELECT l[(len(l) // 2) + 1] FROM s) AS candidates_median, (SELECT l[floor(len(l) * 0.95::DOUBLE)::BIGINT + 1] FROM s) AS candidates_p95 FROM e"
    )


def _swept(column: str, grid: Sequence[float], by: str = "") -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in sorted(set(grid)))
    by_select, by_group = (f"{by}, ", f"{by}, ") if by else ("", "")
    return (
        f"SELECT {by_select}threshold, round(avg(CASE WHEN g = 0 AND m = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * h / (m + 0.25::DOUBLE * g) END), 9) AS macro_f05, sum(h)::BIGINT AS tp, sum(m - h)::BIGINT AS fp, sum(g - h)::BIGINT AS fn FROM "
        "(SELECT r.entity_id, r.country, threshold, coalesce(any_value(a.g), 0) AS g, count(s.target_id) AS m, count(t.target_id) AS h "
        f"FROM records r CROSS JOIN (VALUES {values}) v(threshold) LEFT JOIN (SELECT reference_id, count(*) AS g FROM truth GROUP BY 1) a ON a.reference_id = r.entity_id "
        f"LEFT JOIN scored s ON s.reference_id = r.entity_id AND {column} >= threshold LEFT JOIN truth t ON t.reference_id = s.reference_id AND t.target_id = s.target_id WHERE r.source = 1 GROUP BY 1, 2, 3) GROUP BY {by_group}threshold"
    )


def sweep(column: str, grid: Sequence[float]) -> str:
    return _swept(f"s.{column}", grid)


def blend_grid(weights: Sequence[float], grid: Sequence[float]) -> str:
    base = _swept("s.pb", [0.665], "country")
    parts = []
    for w in weights:
        p = "round((s.pa + s.pb) / 2, 9)" if w == 0.5 else f"round({w}::DOUBLE * s.pa + {1 - w}::DOUBLE * s.pb, 9)"
        parts.append(
            f"SELECT {w}::DOUBLE AS weight, x.threshold, x.macro_f05, y.worst FROM ({_swept(p, grid)}) x JOIN (SELECT threshold, round(min(z.macro_f05 - b.macro_f05), 9) AS worst FROM ({_swept(p, grid, 'country')}) z JOIN ({base}) b USING (country) GROUP BY z.threshold) y ON x.threshold = y.threshold".replace(
                "SELECT threshold, round(min", "SELECT z.threshold, round(min"
            )
        )
    return " UNION ALL ".join(parts)


def country_grid(grid: Sequence[float]) -> str:
    cells = " UNION ALL ".join(f"SELECT country, '{m}' AS model, threshold, macro_f05 FROM ({_swept(f's.p{m}', grid, 'country')})" for m in "ab")
    return f"SELECT country, model, threshold, macro_f05 FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY macro_f05 DESC, model, threshold) AS k FROM ({cells})) WHERE k = 1"


def _long_counts(sql: str) -> str:
    """count_if() is a HUGEINT in DuckDB; Spark's is a long."""
    at = 0
    while (at := sql.find("count_if(", at)) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count_if({sql[at + 9 : end]}::BIGINT{sql[end:]}"
        at = end
    return sql


def statement(body: str, *names: str) -> str:
    """The body over the named expressions and all that they need, each once, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in _CTES[name][0]:
            visit(d)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return _long_counts(body)
    return _long_counts("WITH " + ", ".join(f"{n} AS ({_CTES[n][1]})" for n in order) + (f" SELECT * FROM ({body})" if body.startswith("WITH") else f" {body}"))
