"""DuckDB SQL for the same results: the shared derivation as CTEs, plus small expressions."""

from __future__ import annotations

from fieldeval import schema as S
from fieldeval.plans import derive as D

FIELDS = S.BUSINESS_FIELDS
_TABLES = {n: n for n in ("orders", "customer", "nation", "lineitem", "events", "pages", "part")}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_truth_case = "CASE f " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(FIELDS, 1)) + " END"
_field_case = "CASE f " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FIELDS, 1)) + " END"
_model_case = "CASE seed " + " ".join(f"WHEN {s} THEN '{m}'" for m, s in D.MODELS.items()) + " END"

_LINE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
LINES = f"""SELECT l_orderkey, max(l_suppkey) AS suppkey,
  string_agg(printf('%d', l_quantity::BIGINT), ' | ' {_LINE_ORDER}) AS quantities,
  string_agg('$' || l_extendedprice::DECIMAL(18,2)::VARCHAR, ' | ' {_LINE_ORDER}) AS prices,
  string_agg('part ' || l_partkey::VARCHAR, ' | ' {_LINE_ORDER}) AS descriptions
FROM lineitem GROUP BY l_orderkey"""

BASE = f"""WITH truth_wide AS MATERIALIZED ({D.truth_sql(_TABLES, LINES)}),
numbers AS (SELECT unnest(range(1, {len(FIELDS) + 1})) AS f),
spec AS (SELECT f, {_field_case} AS field FROM numbers),
seeds AS (SELECT unnest({list(D.MODELS.values())})::BIGINT AS seed),
models AS (SELECT seed, {_model_case} AS model FROM seeds),
cells AS (SELECT k, doc_id, f, {_field_case} AS field, {_truth_case} AS cell FROM truth_wide, numbers),
truth AS (SELECT k, doc_id, f, field, cell AS truth FROM cells WHERE k % 29 <> 0),
runs AS (SELECT k, doc_id, {_model_case} AS model, seed, NOT ({D.FAILED_SQL}) AS successful,
  {D.SECONDS_SQL} AS processing_time FROM truth_wide, seeds WHERE k % 31 <> 0),
altered AS (SELECT k, doc_id, {_model_case} AS model, seed, f, field,
  CASE WHEN k % 29 <> 0 THEN coalesce(cell, '') ELSE '' END AS truth, k % 29 <> 0 AS has_truth,
  {D.ALTER_SQL.format(f="f", t="cell")} AS value
  FROM cells, seeds WHERE k % 31 <> 0),
extr AS (SELECT * FROM altered WHERE value IS NOT NULL AND NOT ({D.FAILED_SQL})),
aligned AS (SELECT k, doc_id, model, f, field, truth, has_truth, NOT ({D.FAILED_SQL}) AS successful,
  CASE WHEN {D.FAILED_SQL} THEN NULL ELSE value END AS value FROM altered),
pieces AS (SELECT k, doc_id, model, seed, string_agg(field || ': ' || value, chr(10) ORDER BY field) AS body,
  string_agg('**' || field || ':** ' || value, chr(10) ORDER BY field) AS bold
  FROM altered WHERE value IS NOT NULL GROUP BY ALL)"""

RESPONSES = BASE.replace("ORDER BY field", "ORDER BY f") + f""",
responses AS (SELECT k, doc_id, model, {D.RESPONSE_SQL.format(body="body", bold="bold")} AS raw_text,
  {D.SECONDS_SQL} AS processing_time FROM pieces)"""


def is_in(field: str, values) -> str:
    return f"{field} IN ({quoted(values)})"


def amount(e: str, g: str, drop: str = "[^0-9.]") -> str:
    def num(x: str) -> str:
        return f"TRY_CAST(regexp_replace({x}, '{drop}', '', 'g') AS DOUBLE)"

    return f"CASE WHEN coalesce(abs({num(e)} - {num(g)}) < 0.01, {e} = {g}) THEN 1.0 ELSE 0.0 END"


def list_share(e: str, g: str) -> str:
    es, gs = f"string_split({e}, '|')", f"string_split({g}, '|')"
    return (
        f"CASE WHEN len({es}) <> len({gs}) THEN 0.0 ELSE "
        f"len(list_filter(list_zip({es}, {gs}), lambda p: trim(p[1]) = trim(p[2])))::DOUBLE / len({gs}) END"
    )


def text_score(e: str, g: str) -> str:
    return f"CASE WHEN {e} = {g} THEN 1.0 WHEN contains({g}, {e}) OR contains({e}, {g}) THEN 0.8 ELSE 0.0 END"


def date_score(e: str, g: str) -> str:
    def d(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9/-]', '', 'g')"

    return f"CASE WHEN {d(e)} = {d(g)} THEN 1.0 ELSE 0.0 END"


_E, _G = "lower(trim(coalesce(value, '')))", "lower(trim(truth))"
NO_TRUTH = (
    f"(truth = '' OR ({is_in('field', S.NUMERIC_TRUTH_FIELDS)} AND coalesce(TRY_CAST(truth AS DOUBLE) = 0, false)))"
)
SCORE = f"""(CASE WHEN {NO_TRUTH} THEN CASE WHEN coalesce(value, '') = '' THEN 1.0 ELSE 0.0 END
  WHEN coalesce(value, '') = '' THEN 0.0
  WHEN {is_in("field", S.AMOUNT_FIELDS)} THEN {amount(_E, _G)}
  WHEN {is_in("field", S.LIST_FIELDS)} THEN {list_share(_E, _G)}
  ELSE {text_score(_E, _G)} END)::DOUBLE"""
_ABSENT = "coalesce(upper({0}) IN (" + quoted(S.NA_VARIANTS) + "), true)"
SCORE_DOC = f"""(CASE WHEN {_ABSENT.format("truth")} THEN CASE WHEN {_ABSENT.format("value")} THEN 1.0 ELSE 0.0 END
  WHEN coalesce(value, '') = '' THEN 0.0
  WHEN {is_in("field", S.MATCH_AMOUNT_FIELDS)} THEN {amount(_E, _G, "[^0-9.-]")}
  WHEN {is_in("field", S.DOCUMENTED_LIST_FIELDS)} THEN {list_share(_E, _G)}
  WHEN {is_in("field", S.DOCUMENTED_DATE_FIELDS)} THEN {date_score(_E, _G)}
  ELSE {text_score(_E, _G)} END)::DOUBLE"""
_EM = "lower(trim(coalesce(value, 'N/A')))"


def match_amount(e: str, g: str) -> str:
    def num(x: str) -> str:
        return f"TRY_CAST(regexp_extract({x}, '[0-9.]+') AS DOUBLE)"

    return f"coalesce(abs({num(g)} - {num(e)}) < 0.01, false)"


def match_address(e: str, g: str) -> str:
    def ws(x: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"

    return f"len(list_intersect({ws(g)}, {ws(e)})) >= len({ws(g)}) * 0.7::DOUBLE"


def match_set(e: str, g: str) -> str:
    def items(x: str) -> str:
        return f"list_sort(list_distinct(list_transform(string_split({x}, ','), lambda w: trim(w))))"

    return f"{items(e)} = {items(g)}"


MATCH = f"""CASE WHEN {_EM} = {_G} THEN true WHEN {_EM} = 'n/a' OR {_G} = 'n/a' THEN false
  WHEN {is_in("field", S.MATCH_AMOUNT_FIELDS)} THEN {match_amount(_EM, _G)}
  WHEN {is_in("field", S.MATCH_ADDRESS_FIELDS)} THEN {match_address(_EM, _G)}
  WHEN {is_in("field", S.MATCH_SET_FIELDS)} THEN {match_set(_EM, _G)} ELSE false END"""

SCORED = BASE + f""",
scored AS (SELECT *, {SCORE} AS score FROM aligned),
doc_acc AS (SELECT k, doc_id, model, successful, CASE WHEN successful THEN round(avg(score), 8) END AS accuracy,
  CASE WHEN successful THEN count(*) FILTER (NOT {NO_TRUTH}) END AS truth_fields,
  CASE WHEN successful THEN count(value) END AS extracted_fields FROM scored GROUP BY k, doc_id, model, successful),
doc_time AS (SELECT d.*, CASE WHEN d.successful THEN r.processing_time END AS processing_time
  FROM doc_acc d JOIN runs r USING (k, model)),
field_acc AS (SELECT model, f, field, round(avg(score), 8) AS accuracy, count(*) AS documents
  FROM scored WHERE successful GROUP BY ALL),
asked AS (SELECT count(*) AS n FROM orders),
summary AS (SELECT model, any_value(n) AS total_images, count(*) FILTER (successful) AS successful,
  any_value(n) - count(*) FILTER (successful) AS failed, count(*) FILTER (successful) / any_value(n) AS success_rate,
  avg(accuracy) AS avg_accuracy, sum(processing_time) / count(*) FILTER (successful) AS avg_processing_time,
  avg(extracted_fields) AS avg_fields_extracted, sum(processing_time) AS total_processing_time
  FROM doc_time, asked GROUP BY model)"""

MATCHED = BASE + f""",
matched AS (SELECT *, {MATCH} AS matched FROM aligned WHERE has_truth),
report AS (SELECT doc_id, model, count(*) FILTER (lower(trim(truth)) <> 'n/a' AND matched) AS correct_fields,
  count(*) FILTER (lower(trim(truth)) <> 'n/a') AS total_fields,
  round(coalesce(correct_fields / nullif(total_fields, 0), 0) * 100, 2) AS accuracy_percentage
  FROM matched GROUP BY ALL),
match_fields AS (SELECT model, f, field, round(count(*) FILTER (truth <> 'N/A' AND matched)
  / nullif(count(*) FILTER (truth <> 'N/A'), 0) * 100, 2) AS accuracy FROM matched GROUP BY ALL)"""

VALUED = "coalesce(value NOT IN ('N/A', 'n/a', ''), false)"
RATES = BASE + f""",
sizes AS (SELECT r.k, r.doc_id, r.model, r.successful, r.processing_time, count(e.field) AS n_fields,
  count(e.field) FILTER ({VALUED}) AS n_valued
  FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY ALL),
per_model AS (SELECT model, count(*) AS docs, avg(n_fields) AS avg_fields_extracted,
  avg(processing_time) AS avg_seconds FROM sizes GROUP BY model),
rates AS (SELECT a.model, f, field, p.docs AS total_docs, p.avg_fields_extracted, count(value) AS present_docs,
  count(*) FILTER ({VALUED}) AS value_docs, count(value) / p.docs AS present_rate,
  count(*) FILTER ({VALUED}) / p.docs AS value_rate,
  coalesce(count(*) FILTER ({VALUED}) / nullif(count(value), 0), 0) AS value_completion
  FROM aligned a JOIN per_model p USING (model) GROUP BY a.model, f, field, p.docs, p.avg_fields_extracted)"""


def events_cte(name: str, sql: str, **extra: str) -> str:
    return f"{name} AS ({sql.format(**_TABLES, **extra)})"


SNAPSHOTS = "WITH " + events_cte("snapshots", D.SNAPSHOT_SQL, ts="epoch_us(ts)")
RESOURCES = SNAPSHOTS + """,
res AS (SELECT run_id, max(process_gb) AS peak_process_gb, avg(process_gb) AS avg_process_gb,
  max(system_used_gb) AS peak_system_gb, count(*) AS total_snapshots, max(ts) - min(ts) AS duration_s,
  max(nullif(gpu_used_gb, 0)) AS peak_gpu_gb, avg(nullif(gpu_used_gb, 0)) AS avg_gpu_gb,
  CASE WHEN count(nullif(gpu_used_gb, 0)) > 0 THEN arg_min(gpu_total_gb, ts) END AS gpu_total_gb
  FROM snapshots GROUP BY run_id)"""
BENCH = "WITH " + events_cte("bench", D.BENCH_SQL) + """,
iters AS (SELECT model, iteration, sum(processing_time) AS total_time,
  count(*) FILTER (ok) AS successful_extractions, count(*) FILTER (NOT ok) AS failed_extractions,
  count(*) FILTER (ok) / count(*) AS success_rate,
  coalesce(avg(processing_time) FILTER (ok), 0) AS avg_processing_time,
  coalesce(min(processing_time) FILTER (ok), 0) AS min_processing_time,
  coalesce(max(processing_time) FILTER (ok), 0) AS max_processing_time FROM bench GROUP BY ALL),
bsum AS (SELECT model, count(*) AS iterations, avg(total_time) AS avg_iteration_time,
  min(total_time) AS min_iteration_time, max(total_time) AS max_iteration_time,
  avg(success_rate) AS avg_success_rate, avg(avg_processing_time) AS avg_processing_time_per_image
  FROM iters GROUP BY model)"""
VALIDATION = "WITH " + events_cte("vruns", D.VALIDATION_SQL)
INVENTORY = (
    "WITH " + events_cte("images", D.IMAGES_SQL) + ", " + events_cte("truth_rows", D.TRUTH_ROWS_SQL) + """,
validated AS (SELECT t.*, CASE WHEN trim(image_name) = '' THEN 'invalid' WHEN i.name IS NULL THEN 'missing_image'
  WHEN trim(image_path) <> '' AND regexp_extract(trim(image_path), '[^/]*$') <> trim(image_name) THEN 'path_mismatch'
  ELSE 'valid' END AS status
  FROM truth_rows t LEFT JOIN (SELECT DISTINCT name FROM images) i ON i.name = trim(t.image_name))"""
)
