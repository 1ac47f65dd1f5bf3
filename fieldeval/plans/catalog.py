"""The registered queries: one builder over the derived inputs, and its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions import parse, score, text, values
from fieldeval.functions.base import count_if, strip
from fieldeval.operators import accuracy, align, capability, fields, profile, rates, runs, series
from fieldeval.plans import derive as D
from fieldeval.plans import oracle as O
from fieldeval.plans.derive import Inputs
from fieldeval.schema import DEFAULT_SPEC, FieldSpec
from fieldeval.sources import readers, writers
from fieldeval.sources.batches import read_published


class Query(NamedTuple):
    build: Callable[[Inputs], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}
WEIGHTS = {"DOCUMENT_TYPE": 2.0, "TOTAL": 1.5, "GST": 1.05, "ABN": 0.7, "SUPPLIER_WEBSITE": 0.5}
WEIGHTED = FieldSpec.of(S.BUSINESS_FIELDS, WEIGHTS)
MODELS = tuple(D.MODELS)
_W = "(CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END)::DOUBLE"


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to six places, as the SQL side returns them."""
    cells: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6)
        cells.append(c.alias(name))
    return df.select(*cells)


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Inputs], DataFrame]):
        CATALOG[name] = Query(lambda i: tidy(build(i)), sql)
        return build

    return add


# ------------------------------------------------------------------ fields and shapes

_TEMPLATES = "WITH " + O.events_cte("templates", D.TEMPLATE_SQL) + """,
lines AS (SELECT template_id, unnest(string_split(template, chr(10))) AS line,
  generate_subscripts(string_split(template, chr(10)), 1) AS pos FROM templates),
named AS (SELECT template_id, pos, regexp_extract(trim(line), '^\\s*([A-Z_]+):\\s*\\[.*\\]', 1) AS field FROM lines),
tfields AS (SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY pos) AS ordinal, field
  FROM named WHERE field <> '' AND field NOT IN ('CORRECT', 'WRONG', 'EXAMPLE'))"""


def _template_fields(i: Inputs) -> DataFrame:
    return fields.fields_from_template(i.sql(D.TEMPLATE_SQL), "template_id", "template")


@query("fields_from_template", _TEMPLATES + " SELECT * FROM tfields")
def _(i):
    return _template_fields(i)


@query(
    "with_weights",
    _TEMPLATES + " SELECT *, (CASE field WHEN 'ECONOMY' THEN 2.0 WHEN 'PART_NAME' THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight FROM tfields",
)
def _(i):
    return fields.with_weights(_template_fields(i), {"ECONOMY": 2.0, "PART_NAME": 0.5, "UNKNOWN": 9.0})


SMALL = FieldSpec.of(("TOTAL", "GST", "PAYER_NAME", "QUANTITIES"))


@query(
    "restrict_to_spec",
    O.BASE + f" SELECT doc_id, model, field, value FROM extr WHERE {O.is_in('field', SMALL.names)}",
)
def _(i):
    kept = fields.restrict_to_spec(i.results(), SMALL)
    return fields.to_long(kept, "doc_id", "model")


_WIDE = ", ".join(f"max(value) FILTER (field = '{n}') AS {n}" for n in S.BUSINESS_FIELDS)


@query(
    "to_wide",
    O.BASE + ", wide AS (SELECT r.doc_id, r.model, " + _WIDE + " FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY ALL) SELECT doc_id, model, "
    + ", ".join(f"coalesce({n}, 'N/A') AS {n}" for n in S.BUSINESS_FIELDS) + " FROM wide",
)
def _(i):
    return fields.to_wide(i.results(), DEFAULT_SPEC, "doc_id", "model")


@query(
    "na_to_null",
    O.BASE + ", wide AS (SELECT r.doc_id, r.model, " + _WIDE + " FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY ALL) SELECT doc_id AS image, model, "
    + ", ".join(f"nullif({n}, 'N/A') AS {n}" for n in S.BUSINESS_FIELDS) + " FROM wide",
)
def _(i):
    rows = i.results().withColumn("image", F.col("doc_id"))
    return fields.to_wide(rows, DEFAULT_SPEC, "image", "model", use_na_strings=False)


@query(
    "has_value",
    O.BASE + f""" SELECT model, field, count(*) FILTER ({O.VALUED}) AS by_rates,
  count(*) FILTER (value <> '' AND upper(trim(value)) NOT IN ('N/A', '')) AS by_strict,
  count(*) FILTER (upper(value) NOT IN ({O.quoted(S.NA_VARIANTS)})) AS by_documented FROM extr GROUP BY ALL""",
)
def _(i):
    long = fields.to_long(i.results(), "model")
    return long.groupBy("model", "field").agg(
        *[count_if(values.has_value("value", r)).alias(f"by_{r}") for r in ("rates", "strict", "documented")]
    )


@query(
    "doc_name",
    """SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') ELSE url END AS name,
  CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE CASE WHEN contains(url, '/') THEN regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') ELSE url END END AS other FROM pages""",
)
def _(i):
    rows = i.table("pages").withColumn("path", F.when(F.col("page_id") % 3 != 0, F.col("url")))
    none = F.lit(None).cast("string")
    return rows.select(
        "page_id", values.doc_name("url").alias("name"), values.doc_name(none, "path").alias("other")
    )


def _export_rows(i: Inputs) -> DataFrame:
    return i.results().select(
        "model",
        F.col("doc_id").alias("img_name"),
        "processing_time",
        (F.col("k") % 500).alias("response_length"),
        "successful",
        "extracted_fields",
    )


@query(
    "export_results",
    O.RATES + f""", wide AS (SELECT r.doc_id, r.model, r.k, {_WIDE} FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY ALL)
SELECT s.model AS model_name, s.doc_id AS image_name, processing_time, s.k % 500 AS response_length, successful, n_fields AS field_count,
  {", ".join(f"coalesce(w.{n}, 'N/A') AS field_{n}" for n in S.BUSINESS_FIELDS)}, n_valued AS fields_with_values,
  CASE WHEN n_valued >= 12 THEN 'excellent' WHEN n_valued >= 8 THEN 'good' WHEN n_valued >= 5 THEN 'fair' ELSE 'poor' END AS quality_rating
FROM sizes s JOIN wide w ON w.k = s.k AND w.model = s.model""",
)
def _(i):
    return fields.export_results(_export_rows(i), DEFAULT_SPEC)


@query(
    "export_metrics_rows",
    O.RATES + " SELECT model, doc_id AS image, successful, n_fields AS field_count, k % 7 AS core_fields_found, processing_time AS extraction_time FROM sizes",
)
def _(i):
    rows = i.results().select(
        "model",
        F.col("doc_id").alias("img_name"),
        "successful",
        "extracted_fields",
        (F.col("k") % 7).alias("core_fields_found"),
        F.col("processing_time").alias("extraction_time"),
    )
    return fields.export_metrics_rows(rows)


def _money(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {c} <> 0 THEN printf('$%.2f', {c}) ELSE 'N/A' END"


_MAPPED = {"DOCUMENT_TYPE": "coalesce(document_type, 'INVOICE')"}
_MAPPED |= {n: _money(n.lower()) for n in ("GST", "TOTAL", "SUBTOTAL")}
_MAPPED |= {
    n: f"coalesce({c}, 'N/A')"
    for n, c in {
        "SUPPLIER": "business_name", "ABN": "abn", "PAYER_NAME": "payer_name", "PAYER_ADDRESS": "payer_address",
        "PAYER_PHONE": "payer_phone", "PAYER_EMAIL": "payer_email", "INVOICE_DATE": "date", "DUE_DATE": "due_date",
        "QUANTITIES": "quantities", "PRICES": "prices", "BUSINESS_ADDRESS": "business_address",
        "BUSINESS_PHONE": "business_phone", "BSB_NUMBER": "bsb", "BANK_ACCOUNT_NUMBER": "bank_account",
        "DESCRIPTIONS": "items_list",
    }.items()
}


@query(
    "map_source_to_truth",
    "WITH " + O.events_cte("source", D.SOURCE_SQL) + " SELECT k, "
    + ", ".join(_MAPPED.get(n, "'N/A'") + f" AS {n}" for n in S.BUSINESS_FIELDS) + " FROM source",
)
def _(i):
    return fields.map_source_to_truth(i.sql(D.SOURCE_SQL), "k")


@query(
    "restrict_documents",
    O.BASE + ", " + O.events_cte("images", D.IMAGES_SQL) + " SELECT doc_id, model, processing_time FROM runs WHERE doc_id IN (SELECT name FROM images)",
)
def _(i):
    ids = i.images().select(F.col("name").alias("doc_id"))
    return fields.restrict_documents(i.results(), ids).select("doc_id", "model", "processing_time")


@query(
    "dependent_field_check",
    O.BASE + f""", wide AS (SELECT r.doc_id, r.model, {_WIDE} FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY ALL)
SELECT doc_id, model, CASE WHEN DOCUMENT_TYPE = 'BANK_STATEMENT' AND coalesce(BANK_ACCOUNT_NUMBER, 'N/A') = 'N/A' THEN 'low' END AS BANK_ACCOUNT_NUMBER_CONFIDENCE,
  CASE WHEN DOCUMENT_TYPE = 'BANK_STATEMENT' AND coalesce(STATEMENT_PERIOD, 'N/A') = 'N/A' THEN 'low' END AS STATEMENT_PERIOD_CONFIDENCE FROM wide""",
)
def _(i):
    wide = fields.to_wide(i.results(), DEFAULT_SPEC, "doc_id", "model")
    rules = {"BANK_STATEMENT": ("BANK_ACCOUNT_NUMBER", "STATEMENT_PERIOD")}
    return fields.dependent_field_check(wide, rules).select(
        "doc_id", "model", "BANK_ACCOUNT_NUMBER_CONFIDENCE", "STATEMENT_PERIOD_CONFIDENCE"
    )


# ------------------------------------------------------------------ text

_TOK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_KEY = "trim(lower(w), '.,!?;:')"


def _words_cte(source: str, key: str, col: str) -> str:
    return f""", toks AS (SELECT {key} AS id, {col} AS raw, {_TOK.format(col)} AS ws FROM {source}),
exploded AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM toks)"""


def _capped(source: str, key: str, col: str) -> str:
    free = O.quoted(S.FREE_WORDS)
    return _words_cte(source, key, col) + f""",
ranked AS (SELECT id, w, pos, {_KEY} AS key, row_number() OVER (PARTITION BY id, {_KEY} ORDER BY pos) AS rn FROM exploded),
joined AS (SELECT id, string_agg(w, ' ' ORDER BY pos) AS kept FROM ranked WHERE rn <= 2 OR key IN ({free}) GROUP BY id),
capped AS (SELECT t.id, CASE WHEN len(ws) < 3 THEN raw ELSE coalesce(kept, '') END AS out FROM toks t LEFT JOIN joined j USING (id))"""


def _strip_tokens(col: str) -> str:
    for t in S.SPECIAL_TOKENS:
        col = f"replace({col}, '{t}', '')"
    return col


_SPACEY = "' ' || chr(9) || chr(10) || chr(13)"
_STRIP = "trim({0}, " + _SPACEY + ")"
_NA_RUNS = (
    "regexp_replace(regexp_replace(regexp_replace({0}, '(?:\\s*N/A\\s*){{3,}}', ' N/A', 'gi'), "
    "'\\b(N/A\\s+){{2,}}N/A\\b', 'N/A', 'gi'), '\\s*N/A(\\s+N/A){{2,}}', ' N/A', 'gi')"
)
_MARKED = "'<|eot_id|>' || text || '</s><|reserved_special_token_7|>'"


@query("strip_special_tokens", f"SELECT doc_id, {_strip_tokens(_MARKED)} AS cleaned FROM documents")
def _(i):
    marked = F.concat(F.lit("<|eot_id|>"), F.col("text"), F.lit("</s><|reserved_special_token_7|>"))
    return i.table("documents").select("doc_id", text.strip_special_tokens(marked).alias("cleaned"))


_NA_TEXT = "replace(text, '. ', '. N/A n/a ') || repeat(' N/A', (doc_id % 7)::BIGINT)"


@query("collapse_na_runs", f"SELECT doc_id, {_NA_RUNS.format('(' + _NA_TEXT + ')')} AS cleaned FROM documents")
def _(i):
    noisy = F.concat(
        F.replace("text", F.lit(". "), F.lit(". N/A n/a ")),
        F.expr("repeat(' N/A', cast(doc_id % 7 AS int))"),
    )
    return i.table("documents").select("doc_id", text.collapse_na_runs(noisy).alias("cleaned"))


@query(
    "drop_repeated_lines",
    f""", x AS (SELECT 1) """.replace(", x AS (SELECT 1) ", "") + f"""WITH pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
kept AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM pieces WHERE {_STRIP.format('line')} <> ''),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM kept WHERE prev IS NULL OR {_STRIP.format('prev')} <> {_STRIP.format('line')} GROUP BY doc_id)
SELECT d.doc_id, coalesce(cleaned, '') AS cleaned FROM documents d LEFT JOIN joined USING (doc_id)""",
)
def _(i):
    return i.table("documents").select("doc_id", text.drop_repeated_lines("text").alias("cleaned"))


@query("cap_word_repeats", "WITH src AS (SELECT doc_id, text FROM documents)" + _capped("src", "doc_id", "text") + " SELECT id AS doc_id, out AS cleaned FROM capped")
def _(i):
    return i.table("documents").select("doc_id", text.cap_word_repeats("text").alias("cleaned"))


@query("squeeze_space", f"SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def _(i):
    return i.table("documents").select("doc_id", text.squeeze_space("text").alias("cleaned"))


@query("clip_text", "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS clipped, length(text)::BIGINT AS response_length FROM documents")
def _(i):
    return i.table("documents").select(
        "doc_id", text.clip_text("text", 300).alias("clipped"), text.response_length("text").alias("response_length")
    )


def _cleaned_sql(source: str, key: str, col: str) -> str:
    first = _NA_RUNS.format(_strip_tokens(_STRIP.format(col)))
    return f""", stepped AS (SELECT {key}, CASE WHEN {_STRIP.format(f"({first})")} = '' THEN '' ELSE {first} END AS stepped FROM {source})""" + _capped("stepped", key, "stepped") + """,
squeezed AS (SELECT id, regexp_replace(out, '\\s+', ' ', 'g') AS s FROM capped),
cleaned AS (SELECT id, trim(CASE WHEN length(s) > 2560 THEN left(s, 2560) || '...' ELSE s END) AS cleaned FROM squeezed)"""


@query("clean_response", "WITH src AS (SELECT doc_id, text FROM documents)" + _cleaned_sql("src", "doc_id", "text") + " SELECT id AS doc_id, cleaned FROM cleaned")
def _(i):
    return i.table("documents").select("doc_id", text.clean_response("text").alias("cleaned"))


@query(
    "clean_conversations",
    "WITH src AS (SELECT conv_id * 1000 + turn AS id0, text FROM conversations)" + _cleaned_sql("src", "id0", "text") + " SELECT id AS turn_id, cleaned FROM cleaned",
)
def _(i):
    return i.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), text.clean_response("text").alias("cleaned")
    )


@query(
    "clean_response_basic",
    "SELECT doc_id, trim(CASE WHEN length(s) > 1000 THEN left(s, 1000) || '...' ELSE s END) AS cleaned FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)",
)
def _(i):
    return i.table("documents").select("doc_id", text.clean_response("text", enabled=False).alias("cleaned"))


_REPETITION = "WITH src AS (SELECT doc_id, text FROM documents)" + _words_cte("src", "doc_id", "text") + f""",
wc AS (SELECT id, {_KEY} AS key, count(*) AS n FROM exploded GROUP BY ALL),
wr AS (SELECT id, avg((n >= 3)::INT) AS r FROM wc GROUP BY id),
pairs AS (SELECT id, lower(w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY pos)) AS p FROM exploded),
pc AS (SELECT id, p, count(*) AS n FROM pairs WHERE p IS NOT NULL GROUP BY ALL),
pr AS (SELECT id, avg((n >= 2)::INT) AS r FROM pc GROUP BY id),
rep AS (SELECT t.id AS doc_id, CASE WHEN len(ws) < 3 THEN 0 ELSE coalesce(wr.r, 0) END AS word_repetition,
  CASE WHEN len(ws) < 3 THEN 0 ELSE coalesce(pr.r, 0) END AS phrase_repetition FROM toks t LEFT JOIN wr USING (id) LEFT JOIN pr USING (id))"""


def _repetition(i: Inputs) -> DataFrame:
    return text.repetition_metrics(i.table("documents").select("doc_id", "text"), "text").drop("text")


@query("repetition_metrics", _REPETITION + " SELECT doc_id, round(word_repetition, 6) AS word_repetition, round(phrase_repetition, 6) AS phrase_repetition FROM rep")
def _(i):
    return _repetition(i)


@query("is_repetitive", _REPETITION + " SELECT doc_id, word_repetition > 0.3 OR phrase_repetition > 0.3 AS repetitive FROM rep")
def _(i):
    return _repetition(i).select("doc_id", text.is_repetitive().alias("repetitive"))


@query("limit_tokens", "SELECT doc_id, least(n_chars, 512) AS tokens FROM documents")
def _(i):
    return i.table("documents").select("doc_id", text.limit_tokens("n_chars").alias("tokens"))


_NEEDS = "(contains({0}, '**') OR contains({0}, '```') OR contains({0}, 'Answer:') OR length({0}) > 2000)"


@query("needs_cleaning", O.RESPONSES + f" SELECT doc_id, model, {_NEEDS.format('raw_text')} AS messy FROM responses")
def _(i):
    return i.responses().select("doc_id", "model", text.needs_cleaning("raw_text").alias("messy"))


_PLAIN = f"""regexp_replace(replace(CASE WHEN contains(raw_text, '```') THEN {_STRIP.format("split_part(raw_text, '```', 1)")}
  WHEN contains(raw_text, '**Answer:**') THEN {_STRIP.format("split_part(raw_text, '**Answer:**', 2)")} ELSE raw_text END, '**', ''), '\\*\\s*', '', 'g')"""
_CUT = "CASE " + " ".join(
    f"WHEN contains(plain, '{m}') THEN {_STRIP.format(f'''split_part(plain, '{m}', 1)''')}" for m in S.END_MARKERS
) + " ELSE plain END"
_NA_CUT = f"CASE WHEN regexp_matches(cut, '\\b(N/A\\s*){{10,}}') THEN {_STRIP.format(chr(39).join(('regexp_replace(cut, ', '(?s)\\b(?:N/A\\s*){10,}.*$', ', ', '', ')')))} ELSE cut END"
_PREPARED = O.RESPONSES + f""",
plain AS (SELECT *, {_PLAIN} AS plain FROM responses), cut AS (SELECT *, {_CUT} AS cut FROM plain),
prepared AS (SELECT *, {_NA_CUT} AS prepared FROM cut)"""


@query("strip_markdown", _PREPARED + " SELECT doc_id, model, plain FROM plain")
def _(i):
    return i.responses().select("doc_id", "model", text.strip_markdown("raw_text").alias("plain"))


@query("cut_at_marker", _PREPARED + " SELECT doc_id, model, cut FROM cut")
def _(i):
    return i.responses().select("doc_id", "model", text.cut_at_marker(text.strip_markdown("raw_text")).alias("cut"))


@query("cut_at_na_run", _PREPARED + " SELECT doc_id, model, prepared FROM prepared")
def _(i):
    return i.responses().select("doc_id", "model", text.prepare_for_parsing("raw_text").alias("prepared"))


def _kv_tokens(source: str, col: str) -> str:
    """CTEs ending in ``kv_tokens(k, model, key, value)``."""
    return f""", tk AS (SELECT k, model, {_TOK.format(col)} AS ws FROM {source}),
tw AS (SELECT k, model, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM tk),
seg AS (SELECT *, sum(CASE WHEN right(w, 1) = ':' THEN 1 ELSE 0 END) OVER (PARTITION BY k, model ORDER BY pos) AS s FROM tw),
kvs AS (SELECT k, model, s, min(pos) AS pos, max(n) AS n, arg_min(left(w, length(w) - 1), pos) AS key,
  string_agg(w, ' ' ORDER BY pos) FILTER (right(w, 1) <> ':') AS value FROM seg WHERE s > 0 GROUP BY ALL),
kv_tokens AS (SELECT k, model, key, arg_max(coalesce(value, 'N/A'), pos) AS value FROM kvs WHERE pos < n GROUP BY ALL)"""


_INSTR = " AND ".join(f"NOT contains(lower(line), '{p}')" for p in S.INSTRUCTION_PHRASES)


def _kv_lines(source: str, col: str) -> str:
    """CTEs ending in ``kv_lines(k, model, key, value)``."""
    names = "|".join(S.BUSINESS_FIELDS)
    return f""", ls AS (SELECT k, model, {_STRIP.format(col)} AS t FROM {source}),
ll AS (SELECT k, model, string_split(CASE WHEN NOT contains(t, chr(10)) AND length(t) > 200
  THEN regexp_replace(t, ' ({names}):', chr(10) || '\\1:', 'g') ELSE t END, chr(10)) AS ls FROM ls),
lw AS (SELECT k, model, {_STRIP.format("unnest(ls)")} AS line, generate_subscripts(ls, 1) AS pos FROM ll),
lp AS (SELECT *, regexp_replace(line, '^\\d+\\.\\s*', '') AS body FROM lw WHERE contains(line, ':') AND left(line, 1) <> '#'
  AND left(line, 5) NOT IN ('NOTE:', 'Note:') AND {_INSTR}),
lk AS (SELECT k, model, pos, replace(upper({_STRIP.format("left(body, instr(body, ':') - 1)")}), '*', '') AS key,
  {_STRIP.format("trim(trim(" + _STRIP.format("replace(substr(body, instr(body, ':') + 1), '*', '')") + ", '\"'), '''')")} AS value FROM lp),
kv_lines AS (SELECT k, model, replace(key, ' ', '_') AS key, arg_max(value, pos) AS value FROM lk
  WHERE value <> '' AND regexp_full_match(replace(replace(key, '_', ''), ' ', ''), '\\pL+') AND length(key) > 1
  GROUP BY k, model, replace(key, ' ', '_'))"""


def _exploded(df: DataFrame, fields_col: str = "extracted_fields") -> DataFrame:
    return fields.to_long(df, "k", "model", fields=fields_col).withColumnRenamed("field", "key")


@query("parse_kv_tokens", O.RESPONSES + _kv_tokens("responses", "raw_text") + " SELECT k, model, key, value FROM kv_tokens")
def _(i):
    return _exploded(i.responses().withColumn("extracted_fields", parse.parse_kv_tokens("raw_text")))


@query(
    "parse_kv_tokens_for_spec",
    O.RESPONSES + _kv_tokens("responses", "raw_text") + f" SELECT k, model, key, value FROM kv_tokens WHERE {O.is_in('key', S.BUSINESS_FIELDS)}",
)
def _(i):
    return _exploded(i.responses().withColumn("extracted_fields", parse.parse_kv_tokens("raw_text", DEFAULT_SPEC)))


@query("parse_kv_lines", _PREPARED + _kv_lines("prepared", "prepared") + " SELECT k, model, key, value FROM kv_lines")
def _(i):
    prepared = text.prepare_for_parsing("raw_text")
    return _exploded(i.responses().withColumn("extracted_fields", parse.parse_kv_lines(prepared)))


@query(
    "parse_cleaned_lines",
    O.RESPONSES + ", rid AS (SELECT k * 2 + (model = 'beta')::BIGINT AS id0, raw_text FROM responses)"
    + _cleaned_sql("rid", "id0", "raw_text").replace("SELECT id0, CASE", "SELECT id0, CASE")
    + ", back AS (SELECT id // 2 AS k, CASE WHEN id % 2 = 1 THEN 'beta' ELSE 'alpha' END AS model, cleaned FROM cleaned)"
    + _kv_lines("back", "cleaned") + " SELECT k, model, key, value FROM kv_lines",
)
def _(i):
    rows = i.responses().withColumn("cleaned", text.clean_response("raw_text"))
    return _exploded(rows.withColumn("extracted_fields", parse.parse_kv_lines("cleaned")))


@query(
    "split_single_line",
    O.RESPONSES + f""" SELECT k, model, array_to_string(list_transform(CASE WHEN NOT contains(t, chr(10)) AND length(t) > 200 THEN
  list_filter(string_split(regexp_replace(t, ' ({"|".join(S.BUSINESS_FIELDS)}):', chr(10) || '\\1:', 'g'), chr(10)), lambda x: trim(x) <> '')
  ELSE string_split(t, chr(10)) END, lambda x: trim(x)), chr(10)) AS split FROM (SELECT k, model, {_STRIP.format('raw_text')} AS t FROM responses)""",
)
def _(i):
    found = F.transform(parse.split_single_line("raw_text", DEFAULT_SPEC), lambda x: F.trim(x))
    return i.responses().select("k", "model", F.array_join(found, "\n").alias("split"))


_LINES = f"list_transform(string_split({_STRIP.format('raw_text')}, chr(10)), lambda x: {_STRIP.format('x')})"
_PAIR = "contains(x, ':') AND trim(left(x, instr(x, ':') - 1)) <> '' AND trim(substr(x, instr(x, ':') + 1)) <> ''"


@query("count_kv_lines", O.RESPONSES + f" SELECT k, model, len(list_filter({_LINES}, lambda x: {_PAIR}))::BIGINT AS n FROM responses")
def _(i):
    return i.responses().select("k", "model", parse.count_kv_lines("raw_text").alias("n"))


@query(
    "has_kv",
    O.RESPONSES + f" SELECT k, model, len(list_filter({_LINES}, lambda x: {_PAIR} AND regexp_full_match(replace(trim(left(x, instr(x, ':') - 1)), '_', ''), '\\pL+'))) >= 3 AS ok FROM responses",
)
def _(i):
    return i.responses().select("k", "model", parse.has_kv("raw_text").alias("ok"))


@query(
    "parse_responses",
    _PREPARED + f", messy AS (SELECT * FROM prepared WHERE {_NEEDS.format('raw_text')}), tidy AS (SELECT * FROM prepared WHERE NOT {_NEEDS.format('raw_text')})"
    + _kv_tokens("tidy", "raw_text") + _kv_lines("messy", "prepared")
    + " SELECT k, model, key, value FROM kv_tokens UNION ALL SELECT k, model, key, value FROM kv_lines",
)
def _(i):
    return _exploded(parse.parse_responses(i.responses()))


_METHOD = f""", feat AS (SELECT k, model, {_LINES} AS ls,
  list_sort({_TOK.format("lower(raw_text)")}) AS ws FROM responses),
facts AS (SELECT k, model, len(list_filter(ls, lambda x: x <> '')) AS total,
  len(list_filter(ls, lambda x: contains(x, ':') AND left(x, 1) NOT IN ('#', '*'))) AS pairs,
  len(list_filter(ls, lambda x: left(x, 1) IN ('#', '*', '-', '|') OR contains(x, '**') OR (regexp_matches(x, '_[^_]*_') AND NOT contains(x, ':')))) > 0 AS md FROM feat),
counted AS (SELECT k, model, max(n) AS most FROM (SELECT k, model, w, count(*) AS n FROM (SELECT k, model, unnest(ws) AS w FROM feat)
  WHERE w NOT IN ({O.quoted(S.COMMON_WORDS)}) GROUP BY ALL) GROUP BY ALL),
methods AS (SELECT f.k, f.model, coalesce(most, 0) > 3 AS rep, md, total > 0 AND pairs / greatest(total, 1) > 0.8 AS clean,
  CASE WHEN clean AND md THEN 'clean_with_markdown' WHEN clean AND rep THEN 'clean_with_repetition' WHEN clean THEN 'clean_extraction'
  WHEN md AND NOT rep THEN 'markdown_fallback' WHEN rep THEN 'repetition_control' ELSE 'complex_parsing' END AS extraction_method
  FROM facts f LEFT JOIN counted c USING (k, model))"""


@query("extraction_method", O.RESPONSES + _METHOD + " SELECT k, model, extraction_method FROM methods")
def _(i):
    return i.responses().select("k", "model", text.extraction_method("raw_text").alias("extraction_method"))


@query(
    "method_distribution",
    O.RESPONSES + _METHOD + f""" SELECT extraction_method, count(*) AS documents, round(avg((NOT ((k * m.seed) % 23 = 0))::INT), 6) AS success_rate,
  round(count(*) / (SELECT count(*) FROM methods), 6) AS share FROM methods JOIN models m USING (model) GROUP BY ALL""",
)
def _(i):
    rows = i.responses().select(
        text.extraction_method("raw_text").alias("extraction_method"),
        (F.col("k") * F.element_at(F.create_map(*[F.lit(x) for p in D.MODELS.items() for x in p]), F.col("model")) % 23 != 0).alias("successful"),
    )
    return rates.method_distribution(rows)


def _has(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{n}')" for n in needles) + ")"


_DETAILED = [
    (_has("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
    (_has(*S.FUEL_WORDS) + " OR regexp_matches(t, '\\d+\\.\\d{2,3}\\s*l\\b|\\d+\\s*litre')", "fuel_receipt", 0.95),
    (_has("fuel", "petrol"), "fuel_receipt", 0.85),
    (_has("tax_invoice", "tax invoice"), "tax_invoice", 0.85),
    (_has("tax") + " AND " + _has("invoice"), "tax_invoice", 0.80),
    (_has("bank_statement", "bank statement"), "bank_statement", 0.90),
    (_has(*S.BANK_WORDS) + " OR regexp_matches(t, '(?i)\\d{3}-\\d{3}\\s+\\d{4,10}|\\bBSB\\b|\\baccount\\s+number\\b')", "bank_statement", 0.95),
    (_has("bank"), "bank_statement", 0.75),
    (_has("receipt"), "receipt", 0.75),
    (_has("invoice"), "tax_invoice", 0.70),
]
_SIMPLE = [
    (_has("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
    (_has("tax_invoice", "tax invoice"), "tax_invoice", 0.85),
    (_has("bank_statement", "bank statement"), "bank_statement", 0.85),
    (_has("receipt"), "receipt", 0.75),
    (_has("invoice"), "tax_invoice", 0.70),
]


def _classified(rules, source: str, keys: str) -> str:
    kind = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for t, k, _ in rules) + " ELSE 'unknown' END"
    conf = "(CASE " + " ".join(f"WHEN {t} THEN {c}" for t, _, c in rules) + " ELSE 0.5 END)::DOUBLE"
    return f" SELECT {keys}, {kind} AS document_type, {conf} AS confidence, {kind} <> 'unknown' AND {conf} > 0.7 AS is_business_document FROM {source}"


@query("classify_documents", _classified(_DETAILED, "(SELECT doc_id, lower(text) AS t FROM documents)", "doc_id"))
def _(i):
    return i.table("documents").select("doc_id", text.classify_document("text").alias("c")).select("doc_id", "c.*")


@query("classify_responses", O.RESPONSES + _classified(_DETAILED, "(SELECT k, model, lower(raw_text) AS t FROM responses)", "k, model"))
def _(i):
    return i.responses().select("k", "model", text.classify_document("raw_text").alias("c")).select("k", "model", "c.*")


@query("classify_responses_simple", O.RESPONSES + _classified(_SIMPLE, "(SELECT k, model, lower(raw_text) AS t FROM responses)", "k, model"))
def _(i):
    return i.responses().select("k", "model", text.classify_document("raw_text", "simple").alias("c")).select("k", "model", "c.*")


# ------------------------------------------------------------------ scoring and alignment


def _aligned(i: Inputs) -> DataFrame:
    return align.align_with_truth(i.results(), i.truth(), DEFAULT_SPEC, "successful")


def _scored(i: Inputs) -> DataFrame:
    return align.aligned_scores(*i.shredded(), DEFAULT_SPEC, "successful")


def _field_acc(i: Inputs) -> DataFrame:
    return accuracy.field_accuracy(_scored(i).where("successful"))


def _doc_acc(i: Inputs) -> DataFrame:
    return accuracy.document_accuracy(*i.shredded(), DEFAULT_SPEC)


def _summary(i: Inputs) -> DataFrame:
    return accuracy.model_accuracy(_doc_acc(i), i.requested())


@query("align_with_truth", O.BASE + " SELECT doc_id, model, f AS ordinal, field, truth, coalesce(value, '') AS extracted, successful FROM aligned")
def _(i):
    return _aligned(i)


@query("score_field", O.SCORED + " SELECT doc_id, model, field, round(score, 6) AS score FROM scored")
def _(i):
    return _scored(i).select("doc_id", "model", "field", "score")


def _family(name: str, names: tuple[str, ...]) -> None:
    @query(name, O.SCORED + f" SELECT model, field, truth, value AS extracted, round(score, 6) AS score FROM scored WHERE {O.is_in('field', names)} AND coalesce(value, '') <> '' AND NOT {O.NO_TRUTH}")
    def _(i):
        rows = i.results()
        spec = FieldSpec.of(names)
        aligned = align.align_with_truth(rows, i.truth(), spec)
        held = aligned.where((F.col("extracted") != "") & ~score.truth_missing(F.col("truth"), F.col("field")))
        return align.score_fields(held).drop("doc_id", "ordinal")


_family("score_amount", ("GST", "TOTAL", "SUBTOTAL"))
_family("score_list", ("QUANTITIES", "PRICES"))
_family("score_text", tuple(n for n in S.BUSINESS_FIELDS if n not in S.AMOUNT_FIELDS and n not in S.LIST_FIELDS))


@query(
    "score_date",
    O.BASE + f" SELECT doc_id, model, CASE WHEN truth = '' THEN CASE WHEN coalesce(value, '') = '' THEN 1.0 ELSE 0.0 END WHEN coalesce(value, '') = '' THEN 0.0 ELSE {O.date_score(O._E, O._G)} END::DOUBLE AS score FROM aligned WHERE field = 'INVOICE_DATE'",
)
def _(i):
    spec = FieldSpec.of(("INVOICE_DATE",))
    aligned = align.align_with_truth(i.results(), i.truth(), spec).withColumn("field", F.lit("DATE"))
    return align.score_fields(aligned).select("doc_id", "model", "score")


@query("score_field_documented", O.BASE + f" SELECT doc_id, model, field, round({O.SCORE_DOC}, 6) AS score FROM aligned")
def _(i):
    scored = align.aligned_scores(*i.shredded(), DEFAULT_SPEC, scorer=score.score_field_documented)
    return scored.select("doc_id", "model", "field", "score")


def _matched(i: Inputs) -> DataFrame:
    return accuracy.match_fields(*i.shredded(), DEFAULT_SPEC)


def _match_report(i: Inputs) -> DataFrame:
    return accuracy.truth_match_documents(*i.shredded(), DEFAULT_SPEC)


@query("match_field", O.MATCHED + " SELECT doc_id, model, field, matched FROM matched")
def _(i):
    return _matched(i).select("doc_id", "model", "field", "matched")


@query("match_kinds", O.MATCHED + f""" SELECT model, CASE WHEN {O.is_in('field', S.MATCH_AMOUNT_FIELDS)} THEN 'amount' WHEN {O.is_in('field', S.MATCH_ADDRESS_FIELDS)} THEN 'address'
  WHEN {O.is_in('field', S.MATCH_SET_FIELDS)} THEN 'set' ELSE 'other' END AS kind, count(*) AS n, count(*) FILTER (matched) AS n_matched FROM matched GROUP BY ALL""")
def _(i):
    f = F.col("field")
    kind = (
        F.when(f.isin(*S.MATCH_AMOUNT_FIELDS), "amount")
        .when(f.isin(*S.MATCH_ADDRESS_FIELDS), "address")
        .when(f.isin(*S.MATCH_SET_FIELDS), "set")
        .otherwise("other")
    )
    return _matched(i).groupBy("model", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("matched")).alias("n_matched")
    )


for _kind, _names in (("amount", S.MATCH_AMOUNT_FIELDS), ("address", S.MATCH_ADDRESS_FIELDS), ("set", S.MATCH_SET_FIELDS)):

    @query(f"match_{_kind}", O.MATCHED + f" SELECT doc_id, model, field, truth, nullif(value, 'N/A') AS value, matched FROM matched WHERE {O.is_in('field', _names)} AND has_truth")
    def _(i, names=_names):
        """Row by row: the value (null where there is none), its truth and whether they match."""
        found = accuracy.match_fields(i.results(), i.truth(), FieldSpec.of(names))
        given = F.nullif("extracted", F.lit("N/A"))
        return found.select("doc_id", "model", "field", "truth", given.alias("value"), "matched")


@query(
    "flag_missing_inputs",
    O.BASE + ", " + O.events_cte("images", D.IMAGES_SQL) + " SELECT doc_id, CASE WHEN i.name IS NULL THEN 'Image not found: ' || doc_id END AS error FROM truth_wide LEFT JOIN (SELECT DISTINCT name FROM images) i ON i.name = doc_id WHERE k % 29 <> 0",
)
def _(i):
    return align.flag_missing_inputs(i.truth().select("doc_id"), i.images())


@query("validate_truth", O.INVENTORY + " SELECT image_name, image_path, DOCUMENT_TYPE, SUPPLIER, status FROM validated")
def _(i):
    return align.validate_truth(i.truth_rows(), i.images())


@query("truth_verdict", O.INVENTORY + """ SELECT count(*) AS total_rows, count(*) FILTER (status = 'valid') AS valid_rows, count(*) FILTER (status = 'invalid') AS invalid_rows,
  count(*) FILTER (status = 'missing_image') AS missing_images, count(*) FILTER (status = 'path_mismatch') AS path_mismatches,
  count(*) FILTER (status <> 'valid') = 0 AS passed, count(*) FILTER (status <> 'valid') > count(*) * 0.1 AS severe FROM validated""")
def _(i):
    return rates.truth_verdict(align.validate_truth(i.truth_rows(), i.images()))


@query("extra_images", O.INVENTORY + " SELECT name FROM images WHERE name NOT IN (SELECT trim(image_name) FROM truth_rows)")
def _(i):
    return align.extra_images(i.images(), i.truth_rows()).select("name")


@query(
    "truth_fill_rates",
    O.INVENTORY + """ SELECT 'DOCUMENT_TYPE' AS field, count(*) AS total, count(*) FILTER (trim(DOCUMENT_TYPE) <> '') AS non_empty, round(count(*) FILTER (trim(DOCUMENT_TYPE) <> '') / count(*), 6) AS fill_rate FROM truth_rows
  UNION ALL SELECT 'SUPPLIER', count(*), count(*) FILTER (trim(SUPPLIER) <> ''), round(count(*) FILTER (trim(SUPPLIER) <> '') / count(*), 6) FROM truth_rows""",
)
def _(i):
    return fields.fill_rates(i.truth_rows(), ("DOCUMENT_TYPE", "SUPPLIER"))


@query(
    "models_side_by_side",
    O.SCORED + """, l AS (SELECT * FROM doc_acc WHERE model = 'alpha'), r AS (SELECT * FROM doc_acc WHERE model = 'beta')
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, round(l.accuracy, 6) AS left_accuracy, round(r.accuracy, 6) AS right_accuracy FROM l FULL OUTER JOIN r ON l.doc_id = r.doc_id""",
)
def _(i):
    return align.models_side_by_side(_doc_acc(i), "alpha", "beta")


@query("attach_weights", O.BASE + f" SELECT doc_id, model, field, {_W} AS weight FROM extr")
def _(i):
    return fields.attach_weights(fields.to_long(i.results(), "doc_id", "model"), WEIGHTED).drop("value")


# ------------------------------------------------------------------ accuracy reports

_Q = "SELECT *"


@query("document_accuracy", O.SCORED + " SELECT doc_id, model, successful, round(processing_time, 6) AS processing_time, round(accuracy, 6) AS accuracy, truth_fields, extracted_fields FROM doc_time")
def _(i):
    return _doc_acc(i)


@query("model_accuracy", O.SCORED + """ SELECT model, total_images, successful, failed, round(success_rate, 6) AS success_rate, round(avg_accuracy, 6) AS avg_accuracy,
  round(avg_processing_time, 6) AS avg_processing_time, round(avg_fields_extracted, 6) AS avg_fields_extracted, round(total_processing_time, 6) AS total_processing_time FROM summary""")
def _(i):
    return _summary(i)


@query("field_accuracy", O.SCORED + " SELECT model, f AS ordinal, field, round(accuracy, 6) AS accuracy, documents FROM field_acc")
def _(i):
    return _field_acc(i)


_NON_NA = "SELECT r.model, count(e.field) FILTER (e.value <> '' AND upper(trim(e.value)) NOT IN ('N/A', '')) / count(DISTINCT r.k) AS non_na_fields FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model GROUP BY r.model"


@query("non_na_fields", O.BASE + f" SELECT model, round(non_na_fields, 6) AS non_na_fields FROM ({_NON_NA})")
def _(i):
    return accuracy.non_na_fields(i.results())


@query("non_na_fields_from_accuracy", O.SCORED + " SELECT model, (count(*) FILTER (accuracy > 0))::DOUBLE AS non_na_fields FROM field_acc GROUP BY model")
def _(i):
    return accuracy.non_na_fields_from_accuracy(_field_acc(i))


@query(
    "accuracy_matrix",
    O.SCORED + """ SELECT f AS ordinal, field, round(coalesce(max(accuracy) FILTER (model = 'alpha'), 0) * 100, 6) AS alpha,
  round(coalesce(max(accuracy) FILTER (model = 'beta'), 0) * 100, 6) AS beta FROM field_acc GROUP BY f, field""",
)
def _(i):
    return accuracy.accuracy_matrix(_field_acc(i), MODELS)


def _usage(i: Inputs) -> DataFrame:
    """Largest process memory per model, from events of even and odd users."""
    model = F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta")
    return i.table("events").groupBy(model.alias("model")).agg((F.max("value") / 25).alias("memory_gb"))


_USAGE = "usage AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS model, max(value) / 25 AS memory_gb FROM events GROUP BY ALL)"


@query(
    "overview_table",
    O.SCORED + f", {_USAGE}, nn AS ({_NON_NA}) SELECT model, round(avg_accuracy, 6) AS avg_accuracy, round(avg_processing_time, 6) AS avg_processing_time, round(non_na_fields, 6) AS non_na_fields, round(memory_gb, 6) AS memory_gb FROM summary LEFT JOIN nn USING (model) LEFT JOIN usage USING (model)",
)
def _(i):
    summary = accuracy.overview_summary(*i.shredded(), DEFAULT_SPEC, i.requested())
    return accuracy.overview_table(summary, None, _usage(i))


@query("best_models", O.SCORED + " SELECT arg_max(model, avg_accuracy) AS best_accuracy, arg_min(model, avg_processing_time) AS fastest FROM summary")
def _(i):
    return accuracy.best_models(_summary(i))


_EVAL = """, doc_eval AS (SELECT doc_id, model, avg(score) AS overall_accuracy, count(*) FILTER (score >= 0.99) AS correct_fields,
  count(*) AS total_fields, count(*) FILTER (score >= 0.99) / count(*) * 100 AS field_accuracy_rate FROM scored WHERE successful GROUP BY ALL)"""


def _doc_eval(i: Inputs) -> DataFrame:
    results, truth = i.shredded()
    return accuracy.evaluated_documents(results.where("successful"), truth, DEFAULT_SPEC)


@query("document_evaluation", O.SCORED + _EVAL + " SELECT doc_id, model, round(overall_accuracy, 6) AS overall_accuracy, correct_fields, total_fields, round(field_accuracy_rate, 6) AS field_accuracy_rate FROM doc_eval")
def _(i):
    return _doc_eval(i)


_CELLS = ", ".join(
    f"round(max(score) FILTER (field = '{n}'), 6) AS {n}_accuracy, max(coalesce(value, '')) FILTER (field = '{n}') AS {n}_extracted, max(truth) FILTER (field = '{n}') AS {n}_ground_truth"
    for n in sorted(S.BUSINESS_FIELDS)
)


@query(
    "document_evaluation_wide",
    O.SCORED + f""" SELECT doc_id, model, round(avg(score), 6) AS overall_accuracy, count(*) FILTER (score >= 0.99) AS correct_fields, count(*) AS total_fields,
  round(count(*) FILTER (score >= 0.99) / count(*) * 100, 6) AS field_accuracy_rate, {_CELLS} FROM scored WHERE successful GROUP BY doc_id, model""",
)
def _(i):
    ok = i.results().where("successful")
    return accuracy.document_evaluation_wide(align.score_documents(ok, i.truth(), DEFAULT_SPEC), DEFAULT_SPEC)


@query(
    "quality_distribution",
    O.SCORED + _EVAL + """, e AS (SELECT *, round(overall_accuracy, 8) AS a FROM doc_eval)
SELECT model, count(*) AS total_images, round(avg(a), 6) AS overall_accuracy, count(*) FILTER (a >= 0.99) AS perfect_documents,
  count(*) FILTER (a >= 0.8 AND a < 0.99) AS good_documents, count(*) FILTER (a >= 0.6 AND a < 0.8) AS fair_documents,
  count(*) FILTER (a < 0.6) AS poor_documents, arg_min(doc_id, {'a': -a, 'd': doc_id}) AS best_image, arg_min(doc_id, {'a': a, 'd': doc_id}) AS worst_image FROM e GROUP BY model""",
)
def _(i):
    return accuracy.quality_distribution(_doc_eval(i))


@query(
    "readiness",
    O.SCORED + _EVAL + """, q AS (SELECT model, avg(overall_accuracy) AS a, count(*) FILTER (round(overall_accuracy, 8) >= 0.99) / count(*) AS perfect FROM doc_eval GROUP BY model),
g AS (SELECT model, count(*) FILTER (accuracy >= 0.9) AS strong FROM field_acc GROUP BY model)
SELECT model, round(a, 8) >= 0.6 AS accuracy_ok, perfect >= 0.3 AS perfect_ok, strong >= 15 AS fields_ok, round(a, 8) >= 0.85 AS gate_ok FROM q JOIN g USING (model)""",
)
def _(i):
    scored = align.score_documents(i.results().where("successful"), i.truth(), DEFAULT_SPEC)
    return accuracy.readiness_of(scored, DEFAULT_SPEC, min_accuracy=0.6)


@query(
    "accuracy_by_type",
    O.SCORED + " SELECT model, t.truth AS document_type, count(*) AS documents, round(avg(accuracy), 6) AS accuracy FROM doc_acc d LEFT JOIN truth t ON t.k = d.k AND t.field = 'DOCUMENT_TYPE' WHERE accuracy IS NOT NULL GROUP BY ALL",
)
def _(i):
    results, truth = i.shredded()
    docs = accuracy.document_accuracy(results.where("successful"), truth, DEFAULT_SPEC, type_field="DOCUMENT_TYPE")
    return accuracy.accuracy_by_type(docs)


@query("low_accuracy_documents", O.SCORED + " SELECT doc_id, model, round(accuracy, 6) AS accuracy FROM doc_acc WHERE accuracy < 0.6")
def _(i):
    return accuracy.low_accuracy_documents(_doc_acc(i), 0.6).select("doc_id", "model", "accuracy")


@query("sparse_documents", O.RATES + " SELECT doc_id, model, n_valued AS filled FROM sizes WHERE n_valued < 10")
def _(i):
    return accuracy.sparse_documents(i.results()).select("doc_id", "model", "filled")


@query("weak_fields", O.SCORED + " SELECT model, field, round(accuracy, 6) AS accuracy FROM field_acc WHERE accuracy < 0.6")
def _(i):
    return accuracy.weak_fields(_field_acc(i), 0.6).select("model", "field", "accuracy")


@query(
    "describe_accuracy",
    O.SCORED + """, v AS (SELECT model, accuracy AS v FROM doc_acc WHERE accuracy IS NOT NULL)
SELECT model, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25,
  round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max FROM v GROUP BY model""",
)
def _(i):
    return accuracy.describe_accuracy(_doc_acc(i), store=lambda counts: i.keep(counts, "accuracies"))


@query("missing_truth", O.BASE + " SELECT r.doc_id, r.model, 'No ground truth found for ' || r.doc_id AS error FROM runs r LEFT JOIN (SELECT DISTINCT k FROM truth) t USING (k) WHERE t.k IS NULL")
def _(i):
    return align.missing_truth(i.results(), i.truth()).select("doc_id", "model", "error")


@query("truth_match_report", O.MATCHED + " SELECT doc_id, model, correct_fields, total_fields, accuracy_percentage FROM report")
def _(i):
    return _match_report(i)


@query("truth_match_summary", O.MATCHED + " SELECT model, count(*) AS total_images, round(avg(accuracy_percentage), 6) AS overall_accuracy, round(avg(correct_fields), 6) AS average_correct_fields FROM report GROUP BY model")
def _(i):
    return accuracy.truth_match_summary(_match_report(i))


@query("truth_match_fields", O.MATCHED + " SELECT model, f AS ordinal, field, accuracy FROM match_fields")
def _(i):
    return accuracy.truth_match_fields(_matched(i))


@query(
    "best_and_worst_fields",
    O.MATCHED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, f) AS b, row_number() OVER (PARTITION BY model ORDER BY accuracy, f) AS w FROM match_fields WHERE accuracy IS NOT NULL)
SELECT model, field, accuracy, 'best' AS list, b AS rank FROM ranked WHERE b <= 5 UNION ALL SELECT model, field, accuracy, 'worst', w FROM ranked WHERE w <= 5""",
)
def _(i):
    return accuracy.best_and_worst(accuracy.truth_match_fields(_matched(i)))


# ------------------------------------------------------------------ extraction statistics


_SUCCESS = ", success AS (SELECT model, count(*) AS documents, count(*) FILTER (successful) AS successful, count(*) FILTER (successful) / count(*) AS success_rate, sum(processing_time) AS execution_time FROM runs GROUP BY model)"


def _rates(i: Inputs) -> DataFrame:
    return rates.field_rates(i.results(), DEFAULT_SPEC)


@query("field_rates", O.RATES + """ SELECT model, f AS ordinal, field, total_docs, round(avg_fields_extracted, 6) AS avg_fields_extracted, present_docs, value_docs,
  round(present_rate, 6) AS present_rate, round(value_rate, 6) AS value_rate, round(value_completion, 6) AS value_completion FROM rates""")
def _(i):
    return _rates(i)


@query("model_profile", O.RATES + _SUCCESS + f""", nn AS ({_NON_NA}) SELECT p.model, s.documents, s.successful, round(s.success_rate, 6) AS success_rate, round(s.execution_time, 6) AS execution_time,
  round(avg_seconds, 6) AS avg_seconds, round(avg_fields_extracted, 6) AS avg_fields_extracted, round(non_na_fields, 6) AS non_na_fields,
  CASE WHEN avg_fields_extracted >= 12 THEN 'excellent' WHEN avg_fields_extracted >= 8 THEN 'good' WHEN avg_fields_extracted >= 5 THEN 'fair' ELSE 'poor' END AS quality,
  CASE WHEN avg_seconds < 15 THEN 'Very Fast' WHEN avg_seconds < 25 THEN 'Fast' WHEN avg_seconds < 40 THEN 'Moderate' ELSE 'Slow' END AS speed_rating
  FROM per_model p JOIN success s USING (model) JOIN nn USING (model)""")
def _(i):
    return profile.model_profile(profile.run_models(i.shredded()[0]))


@query("active_fields", O.RATES + " SELECT f AS ordinal, field, round(max(value_rate), 6) AS best_value_rate FROM rates GROUP BY ALL HAVING max(value_rate) > 0")
def _(i):
    return rates.active_fields(_rates(i))


@query("model_quality", O.RATES + """ SELECT model, docs AS total_docs, round(avg_fields_extracted, 6) AS avg_fields_extracted, CASE WHEN avg_fields_extracted >= 12 THEN 'excellent'
  WHEN avg_fields_extracted >= 8 THEN 'good' WHEN avg_fields_extracted >= 5 THEN 'fair' ELSE 'poor' END AS quality FROM per_model""")
def _(i):
    return rates.model_quality(i.results())


@query("top_fields", O.RATES + " SELECT model, field, value_docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value_docs DESC, f) AS rank FROM rates) WHERE rank <= 5")
def _(i):
    return rates.top_fields(_rates(i)).select("model", "field", "value_docs", "rank")


@query("speed_summary", O.RATES + " SELECT model, round(avg_seconds, 6) AS avg_seconds, CASE WHEN avg_seconds < 15 THEN 'Very Fast' WHEN avg_seconds < 25 THEN 'Fast' WHEN avg_seconds < 40 THEN 'Moderate' ELSE 'Slow' END AS speed_rating FROM per_model")
def _(i):
    return rates.speed_summary(i.results())


_SPEED_ORDER = "{'s': round(avg_seconds, 9), 'm': model}"


@query("speed_advantage", O.RATES + f" SELECT arg_min(model, {_SPEED_ORDER}) AS faster, round((max(avg_seconds) - min(avg_seconds)) / max(avg_seconds) * 100, 6) AS percent_faster FROM per_model HAVING count(*) = 2 AND max(avg_seconds) > 0")
def _(i):
    return rates.speed_advantage(rates.speed_summary(i.results()))


@query(
    "winners",
    O.RATES + f""" SELECT max(avg_fields_extracted) - min(avg_fields_extracted) < 0.001 AS tie,
  CASE WHEN max(avg_fields_extracted) - min(avg_fields_extracted) >= 0.001 THEN arg_min(model, {{'s': -round(avg_fields_extracted, 9), 'm': model}}) END AS field_winner,
  CASE WHEN max(avg_fields_extracted) - min(avg_fields_extracted) >= 0.001 THEN round((max(avg_fields_extracted) - min(avg_fields_extracted)) / min(avg_fields_extracted) * 100, 6) END AS field_advantage,
  arg_min(model, {_SPEED_ORDER}) AS speed_winner, round(min(avg_seconds), 6) AS speed_seconds FROM per_model""",
)
def _(i):
    return rates.winners(profile.model_profile(profile.run_models(i.shredded()[0])), tie_below=0.001)


# Runs some of which name no model or don't say whether they succeeded.
_PATCHY = """, patchy AS (SELECT k, doc_id, processing_time, CASE WHEN k % 37 = 0 THEN NULL ELSE model END AS model,
  CASE WHEN k % 41 = 0 THEN NULL ELSE successful END AS successful FROM runs)"""


def _patchy(i: Inputs) -> DataFrame:
    return i.results().withColumns(
        {
            "model": F.when(F.col("k") % 37 != 0, F.col("model")),
            "successful": F.when(F.col("k") % 41 != 0, F.col("successful")),
            "error": F.concat(F.lit("TimeoutError: order "), F.col("k").cast("string")),
        }
    )




@query(
    "success_metrics",
    O.BASE + _PATCHY + """ SELECT CASE WHEN grouping(model) = 1 THEN '(overall)' ELSE model END AS model, count(*) AS documents, count(*) FILTER (successful) AS successful, round(count(*) FILTER (successful) / count(*), 6) AS success_rate,
  round(sum(processing_time), 6) AS execution_time FROM patchy GROUP BY ROLLUP (model)""",
)
def _(i):
    return rates.success_metrics(_patchy(i))


_IMAGES = ", " + O.events_cte("images", D.IMAGES_SQL)


@query(
    "run_overview",
    O.BASE + _PATCHY + _SUCCESS.replace("FROM runs", "FROM patchy") + _IMAGES + """ SELECT model, round(success_rate, 6) AS success_rate, round(execution_time, 6) AS execution_time,
  round(execution_time / (SELECT count(*) FILTER (verified) FROM images), 6) AS time_per_image,
  CASE WHEN success_rate >= 0.9 THEN 'Excellent' WHEN success_rate >= 0.7 THEN 'Good' ELSE 'Needs Work' END AS status,
  round((SELECT avg(success_rate) FROM success), 6) AS overall_success_rate FROM success""",
)
def _(i):
    return rates.run_overview(_patchy(i), i.images().agg(count_if(F.col("verified"))).scalar())


def _band(c: str) -> str:
    return f"CASE WHEN {c} >= 0.9 THEN 'excellent' WHEN {c} >= 0.7 THEN 'good' WHEN {c} >= 0.5 THEN 'fair' WHEN {c} IS NOT NULL THEN 'poor' END"


@query(
    "field_rate_bands",
    O.RATES + f""", p AS (SELECT f, field, max(value_rate) FILTER (model = 'alpha') AS alpha, max(value_rate) FILTER (model = 'beta') AS beta, max(value_rate) FILTER (model = 'gamma') AS gamma FROM rates GROUP BY ALL)
SELECT f AS ordinal, field, {", ".join(f"round({m}, 6) AS {m}_rate, {_band(m)} AS {m}_band" for m in ("alpha", "beta", "gamma"))} FROM p""",
)
def _(i):
    return rates.field_rate_bands(_rates(i), (*MODELS, "gamma"))


@query(
    "completeness_profile",
    O.BASE + """, c AS (SELECT f, field, count(nullif(value, 'N/A')) AS present, count(*) AS total FROM aligned GROUP BY ALL)
SELECT f AS ordinal, field, present, total, round(present / total * 100, 6) AS percent FROM c
UNION ALL SELECT 26, '(overall)', sum(present)::BIGINT, sum(total)::BIGINT, round(sum(present) / sum(total) * 100, 6) FROM c""",
)
def _(i):
    wide = fields.to_wide(i.results(), DEFAULT_SPEC, use_na_strings=False)
    return fields.completeness_profile(wide, DEFAULT_SPEC)


@query("dataset_summary", "WITH " + O.events_cte("images", D.IMAGES_SQL) + " SELECT count(*) AS expected, count(*) FILTER (verified) AS found, count(*) FILTER (NOT verified) AS missing, round(count(*) FILTER (verified) / count(*), 6) AS found_rate FROM images")
def _(i):
    return rates.dataset_summary(i.images())


_NORMAL = _SUCCESS + _IMAGES + """, normal AS (SELECT s.model, s.success_rate, s.execution_time AS total_processing_time,
  s.execution_time / (SELECT count(*) FROM images) AS avg_processing_time, sum(value_rate) / 25 AS avg_accuracy, count(*) FILTER (value_rate > 0) AS fields_with_data,
  max(avg_fields_extracted) AS avg_fields_extracted FROM success s JOIN rates USING (model) GROUP BY s.model, s.success_rate, s.execution_time)"""


def _normal(i: Inputs) -> DataFrame:
    count = i.images().agg(F.count(F.lit(1))).scalar()
    return profile.normalise_profile(profile.run_profile(i.results(), DEFAULT_SPEC), DEFAULT_SPEC, count)


@query("normalise_runs", O.RATES + _NORMAL + """ SELECT model, round(success_rate, 6) AS success_rate, round(total_processing_time, 6) AS total_processing_time, round(avg_processing_time, 6) AS avg_processing_time,
  round(avg_accuracy, 6) AS avg_accuracy, fields_with_data, round(avg_fields_extracted, 6) AS avg_fields_extracted FROM normal""")
def _(i):
    return _normal(i)


# ------------------------------------------------------------------ capability

_CAP = O.RATES + f""", weights AS (SELECT f, field, {_W} AS weight FROM spec),
per_row AS (SELECT s.k, s.model, any_value(s.successful) AS ok, any_value(s.processing_time) AS seconds, any_value(s.n_fields) AS n_fields,
  coalesce(sum(w.weight), 0) / (SELECT sum(weight) FROM weights) AS weighted,
  count(w.field) FILTER (w.weight >= 0.8) / (SELECT count(*) FROM weights WHERE weight >= 0.8) AS critical,
  coalesce(count(w.field) / nullif(any_value(s.n_fields), 0), 0) AS density, count(w.field) / 25 AS complete
  FROM sizes s LEFT JOIN extr e ON e.k = s.k AND e.model = s.model LEFT JOIN weights w ON w.field = e.field GROUP BY s.k, s.model),
cap AS (SELECT model, count(*) AS total_images, count(*) FILTER (ok) AS successful_extractions, sum(n_fields)::BIGINT AS total_fields_extracted, 0::BIGINT AS total_core_fields_found,
  count(*) FILTER (ok) / count(*) AS success_rate, avg(n_fields) AS avg_fields_per_image, 0::DOUBLE AS avg_core_fields_per_image,
  avg(n_fields) * (count(*) FILTER (ok) / count(*)) AS capability, avg(weighted) AS weighted_extraction_score, avg(critical) AS critical_field_coverage,
  avg(density) AS information_density, avg(complete) AS extraction_completeness, avg(seconds) AS average_inference_time FROM per_row GROUP BY model)"""
_CAP_DOUBLES = ("success_rate", "avg_fields_per_image", "avg_core_fields_per_image", "capability", "weighted_extraction_score", "critical_field_coverage", "information_density", "extraction_completeness", "average_inference_time")


def _capability(i: Inputs) -> DataFrame:
    rows = i.results().withColumnRenamed("processing_time", "extraction_time")
    return capability.extraction_capability(rows, WEIGHTED)


@query(
    "extraction_capability",
    _CAP + " SELECT model, total_images, successful_extractions, total_fields_extracted, total_core_fields_found, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CAP_DOUBLES) + " FROM cap",
)
def _(i):
    return _capability(i)


@query("capability_ranking", _CAP + " SELECT model, round(capability, 6) AS capability FROM cap")
def _(i):
    return capability.capability_ranking(_capability(i))


_GAPS = "[" + ", ".join(f"CASE WHEN round(b.{c} - o.{c}, 9) >= 0.1 THEN '{c}' END" for c in capability.COMPONENTS) + "]"


@query(
    "capability_breakdown",
    _CAP + f""", b AS (SELECT * FROM cap ORDER BY round(capability, 9) DESC, model LIMIT 1)
SELECT o.model, o.total_images, round(o.capability, 6) AS capability, {", ".join(f"round(o.{c}, 6) AS {c}" for c in capability.COMPONENTS)}, o.model = b.model AS is_best,
  CASE WHEN o.model = b.model THEN array_to_string(list_filter([CASE WHEN o.critical_field_coverage >= 0.8 THEN 'critical_field_coverage' END, CASE WHEN o.information_density >= 0.7 THEN 'information_density' END,
    CASE WHEN o.weighted_extraction_score >= 0.6 THEN 'weighted_extraction_score' END], lambda x: x IS NOT NULL), ', ') END AS strengths,
  CASE WHEN o.model <> b.model THEN round(b.capability - o.capability, 6) END AS capability_gap,
  CASE WHEN o.model <> b.model THEN round((b.capability - o.capability) / nullif(o.capability, 0) * 100, 6) END AS percent_better,
  CASE WHEN o.model <> b.model THEN array_to_string(list_filter({_GAPS}, lambda x: x IS NOT NULL), ', ') END AS best_model_advantages FROM cap o, b""",
)
def _(i):
    return capability.capability_breakdown(_capability(i))


# ------------------------------------------------------------------ operational tables


@query("batch_summary", O.BASE + _PATCHY + " SELECT model, count(*) AS total_images, count(*) FILTER (successful) AS successful_extractions, count(*) - count(*) FILTER (successful) AS failed_extractions, round(sum(processing_time) FILTER (successful), 6) AS processing_time, round(count(*) FILTER (successful) / count(*), 6) AS success_rate FROM patchy GROUP BY model")
def _(i):
    return runs.batch_summary(_patchy(i))


@query("first_failures", O.BASE + _PATCHY + " SELECT model, doc_id, 'TimeoutError: order ' || k AS error FROM patchy WHERE successful IS NOT TRUE ORDER BY doc_id, model NULLS FIRST LIMIT 5")
def _(i):
    return runs.first_failures(_patchy(i))


def _rounded(cols: str) -> str:
    return ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in cols.split(","))


@query("benchmark_iterations", O.BENCH + " SELECT model, iteration, successful_extractions, failed_extractions, " + _rounded("total_time, success_rate, avg_processing_time, min_processing_time, max_processing_time") + " FROM iters")
def _(i):
    return runs.benchmark_iterations(i.bench_runs())


_BSUM = "avg_iteration_time, min_iteration_time, max_iteration_time, avg_success_rate, avg_processing_time_per_image"


@query("benchmark_summary", O.BENCH + f" SELECT model, iterations, {_rounded(_BSUM)} FROM bsum")
def _(i):
    return runs.benchmark_summary(runs.benchmark_iterations(i.bench_runs()))


@query("benchmark_best", O.BENCH + " SELECT arg_min(model, avg_processing_time_per_image) AS fastest_model, round(min(avg_processing_time_per_image), 6) AS fastest_time, arg_max(model, avg_success_rate) AS most_accurate_model, round(max(avg_success_rate), 6) AS best_success_rate FROM bsum")
def _(i):
    return runs.benchmark_best(runs.benchmark_summary(runs.benchmark_iterations(i.bench_runs())))


_RES = "peak_process_gb, avg_process_gb, peak_system_gb, duration_s, peak_gpu_gb, avg_gpu_gb, gpu_total_gb"


def _res(i: Inputs) -> DataFrame:
    return runs.resource_summary(i.snapshots())


@query("resource_summary", O.RESOURCES + f" SELECT run_id, total_snapshots, {_rounded(_RES)} FROM res")
def _(i):
    return _res(i)


def _peak(resource: str, value: str, percent: str) -> str:
    order = f"{{'v': -{value}, 't': ts}}"
    return (
        f"SELECT run_id, '{resource}' AS resource, round(max({value}), 6) AS peak_gb, "
        f"round(coalesce(arg_min({percent}, {order}) FILTER ({value} IS NOT NULL), 0), 6) AS percent, "
        f"arg_min(label, {order}) FILTER ({value} IS NOT NULL) AS label FROM snapshots GROUP BY run_id"
    )


@query(
    "resource_peaks",
    O.SNAPSHOTS + " " + " UNION ALL ".join((_peak("system", "system_used_gb", "system_percent"), _peak("process", "process_gb", "process_percent"), _peak("gpu", "gpu_used_gb", "gpu_percent"))),
)
def _(i):
    return runs.resource_peaks(i.snapshots())


@query("resource_timeline", O.SNAPSHOTS + " SELECT run_id, round(ts, 6) AS ts, round(ts - min(ts) OVER (PARTITION BY run_id), 6) AS elapsed_s, label, round(process_gb, 6) AS process_gb, round(gpu_used_gb, 6) AS gpu_used_gb FROM snapshots")
def _(i):
    return runs.resource_timeline(i.snapshots())


@query(
    "resource_checks",
    O.SNAPSHOTS + """, c AS (SELECT run_id, count(*) >= 3 AS sufficient_snapshots, max(ts) - min(ts) > 10 AS adequate_duration,
  count(*) >= 2 AND max(process_gb) > arg_min(process_gb, ts) * 1.1 AS has_peak, NOT (count(*) >= 3 AND min(process_gb) < arg_min(process_gb, ts) * 0.8) AS logical_progression FROM snapshots GROUP BY run_id)
SELECT *, array_to_string(list_filter([CASE WHEN NOT sufficient_snapshots THEN 'insufficient snapshots' END, CASE WHEN NOT adequate_duration THEN 'short monitoring duration' END,
  CASE WHEN NOT has_peak THEN 'no peak captured' END, CASE WHEN NOT logical_progression THEN 'illogical progression' END], lambda x: x IS NOT NULL), '; ') AS issues FROM c""",
)
def _(i):
    return runs.resource_checks(i.snapshots())


_PAIRED = "CASE WHEN run_id IN ('run_0', 'run_2') THEN 'large' ELSE 'small' END"


@query(
    "resource_compare",
    O.SNAPSHOTS.replace("'run_' || cast(user_id % 4 AS string)", "CASE WHEN user_id % 2 = 0 THEN 'large' ELSE 'small' END") + """,
s AS (SELECT run_id, max(process_gb) AS peak, count(*) AS n FROM snapshots GROUP BY run_id)
SELECT run_id, round(peak, 6) AS peak_process_gb, n AS total_snapshots, n >= 3 AS adequate, (SELECT max(peak) FILTER (run_id = 'large') > max(peak) FILTER (run_id = 'small') FROM s) AS size_order_ok FROM s""",
)
def _(i):
    rows = i.snapshots().withColumn("run_id", F.when(F.col("run_id").isin("run_0", "run_2"), "large").otherwise("small"))
    return runs.resource_compare(runs.resource_summary(rows), {"large": 11.0, "small": 2.0})


_COMB = "sum(total_snapshots)::BIGINT AS total_snapshots, round(sum(duration_s), 6) AS duration_s, round(max(peak_process_gb), 6) AS peak_process_gb, round(avg(avg_process_gb), 6) AS avg_process_gb, round(max(peak_system_gb), 6) AS peak_system_gb, round(max(peak_gpu_gb), 6) AS peak_gpu_gb, round(avg(avg_gpu_gb), 6) AS avg_gpu_gb, round(max(gpu_total_gb), 6) AS gpu_total_gb"


@query("resource_combine", O.RESOURCES + f" SELECT {_COMB} FROM res")
def _(i):
    return runs.resource_combine(_res(i))


@query("call_profile", "SELECT round(avg(value), 6) AS avg_inference_time, round(avg(value * 3), 6) AS avg_memory_used_mb, round(max(value * 5 + 1), 6) AS max_peak_memory_mb FROM events")
def _(i):
    return runs.call_profile(i.sql(D.CALLS_SQL))


@query(
    "validation_summary",
    O.VALIDATION + """ SELECT count(*) AS total_models_tested, count(*) FILTER (success) AS successful_validations, round(count(*) FILTER (success) / count(*), 6) AS validation_success_rate,
  round(avg(load_time) FILTER (success), 6) AS average_load_time, round(avg(memory_usage) FILTER (success), 6) AS average_memory_usage,
  arg_min(model_name, {'l': load_time, 'm': model_name}) FILTER (success) AS fastest_model, arg_min(model_name, {'l': -load_time, 'm': model_name}) FILTER (success) AS slowest_model FROM vruns""",
)
def _(i):
    return runs.validation_summary(i.validation_runs())


@query("validation_failures", O.VALIDATION + " SELECT model_name, error_message FROM vruns WHERE success IS NOT TRUE")
def _(i):
    return runs.validation_failures(i.validation_runs())


@query(
    "validation_findings",
    O.VALIDATION + """, e AS (SELECT split_part(error_message, ':', 1) AS detail, count(*) AS n FROM vruns WHERE success IS NOT TRUE AND error_message <> '' GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT max(memory_usage) FILTER (success) AS m, max(load_time) FILTER (success) AS l, count(*) FILTER (success) / count(*) AS r FROM vruns)
SELECT 'high_memory' AS finding, '' AS detail, round(m, 6) AS value FROM s WHERE m > 12 UNION ALL SELECT 'slow_loading', '', round(l, 6) FROM s WHERE l > 60
UNION ALL SELECT 'low_success_rate', '', round(r, 6) FROM s WHERE r < 0.5 UNION ALL SELECT 'all_succeeded', '', round(r, 6) FROM s WHERE r = 1
UNION ALL SELECT 'repeated_error', detail, n::DOUBLE FROM e""",
)
def _(i):
    return runs.validation_findings(i.validation_runs())


# ------------------------------------------------------------------ chart tables


@query(
    "dashboard_series",
    O.RATES + _NORMAL + """ SELECT model, round(avg_accuracy * 100, 6) AS accuracy_percent, round(coalesce(60 / nullif(avg_processing_time, 0), 0), 6) AS throughput, round(success_rate * 100, 6) AS success_percent,
  fields_with_data::DOUBLE AS fields, 48::DOUBLE AS excellent_line, 4::DOUBLE AS very_fast_line, 2.4::DOUBLE AS fast_line, 1.5::DOUBLE AS moderate_line FROM normal""",
)
def _(i):
    return series.dashboard_series(_normal(i), DEFAULT_SPEC)


@query("category_accuracy", O.SCORED + f" SELECT CASE WHEN {_W} > 1.1 THEN 'High Priority' WHEN {_W} = 1.0 THEN 'Standard' ELSE 'Lower Priority' END AS category, model, round(avg(round(accuracy, 6)) * 100, 6) AS percent FROM field_acc GROUP BY ALL")
def _(i):
    # Six places: a mean of twenty then never ends in a tie that the order of a sum decides.
    return series.category_accuracy(_field_acc(i).withColumn("accuracy", F.round("accuracy", 6)), WEIGHTED)


@query("top_matrix", O.SCORED + " SELECT model, field, round(accuracy, 6) AS accuracy FROM field_acc WHERE field IN (SELECT field FROM field_acc GROUP BY f, field ORDER BY round(avg(accuracy), 9) DESC, f LIMIT 12)")
def _(i):
    return series.top_matrix(_field_acc(i)).select("model", "field", "accuracy")


@query("capacity_status", "WITH " + _USAGE + " SELECT model, round(memory_gb, 6) AS memory_gb, CASE WHEN memory_gb <= 16 * 0.85 THEN 'SAFE' WHEN memory_gb <= 16 THEN 'MARGIN' ELSE 'OVER' END AS status, round(memory_gb / 16 * 100, 6) AS utilisation FROM usage")
def _(i):
    return series.capacity_report(_usage(i))


@query("capacity_from_peak", O.RESOURCES + " SELECT run_id AS model, round((SELECT max(peak_gpu_gb) FROM res) / (SELECT count(*) FROM res), 6) AS memory_gb FROM res")
def _(i):
    res = _res(i)
    return series.spread_peak(res.select(F.col("run_id").alias("model")), runs.resource_combine(res))


@query(
    "sizing_advice",
    O.RESOURCES + f""", {_USAGE}, c AS (SELECT avg(avg_process_gb) AS a, max(peak_process_gb) AS p FROM res)
SELECT model, greatest(2, trunc(a * 1.2)::BIGINT) AS cpu_request, greatest(4, trunc(p * 1.5)::BIGINT) AS cpu_limit, greatest(4, trunc(p * 1.1)::BIGINT) AS memory_request_gb,
  greatest(greatest(4, trunc(p * 1.1)::BIGINT) + 1, trunc(p * 1.3)::BIGINT) AS memory_limit_gb, CASE WHEN memory_gb <= 16 THEN 'V100' ELSE 'A100' END AS gpu_class,
  (CASE WHEN memory_gb <= 16 THEN 2.5 ELSE 4.0 END)::DOUBLE AS dollars_per_hour, CASE WHEN memory_gb <= 13.6 THEN 'fits' WHEN memory_gb <= 16 THEN 'tight' ELSE 'needs larger GPU' END AS advice FROM usage, c""",
)
def _(i):
    return series.sizing_advice(_usage(i), runs.resource_combine(_res(i)))


@query(
    "memory_estimate",
    """SELECT p_partkey, round(n / (1024 * 1024 * 1024) * factor, 6) AS memory_gb, n / (1024 * 1024 * 1024) * factor <= 16 * 0.85 AS compliant FROM (
  SELECT p_partkey, (CASE p_size % 4 WHEN 0 THEN 2000000000 WHEN 1 THEN 15000000000 WHEN 2 THEN 38000000000 ELSE 8000000000 END)::DOUBLE AS n,
  CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 1 THEN 1.0 * 1.4 ELSE 2.0 * 1.3 END ELSE CASE p_partkey % 3 WHEN 0 THEN 0.5 * 1.5 WHEN 1 THEN 1.0 * 1.3 ELSE 2.0 * 1.2 END END::DOUBLE AS factor FROM part)""",
)
def _(i):
    size = F.col("p_size") % 4
    path = F.when(size == 0, "/models/InternVL3-2B").when(size == 1, "/m/internvl3_14b").when(size == 2, "x/InternVL3-38B-Instruct").otherwise("/models/other")
    bits = F.when(F.col("p_partkey") % 3 == 0, 4).when(F.col("p_partkey") % 3 == 1, 8).otherwise(16)
    family = F.when(F.col("p_partkey") % 2 == 0, "internvl").otherwise("llama")
    gb = values.memory_estimate(values.parameters_from_name(path), bits, family)
    return i.table("part").select("p_partkey", gb.alias("memory_gb"), values.within_limit(gb).alias("compliant"))


# ------------------------------------------------------------------ readers, on texts


_NUMBERS = "CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN '1.0E31' WHEN 2 THEN '1.0E-9' ELSE '$' || o_orderkey END"


@query(
    "truth_map",
    f"""WITH last AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
SELECT 'doc_' || o_custkey AS doc_id, {_NUMBERS} AS total,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END AS supplier FROM last JOIN orders USING (o_custkey, o_orderkey)""",
)
def _(i):
    found = readers.truth_map(i.sql(D.TRUTH_TEXT_SQL), "image_file", "line_no", ("TOTAL",))
    cells = [F.element_at("truth_fields", n).alias(n.lower()) for n in ("TOTAL", "SUPPLIER")]
    return found.select("doc_id", *cells)


@query(
    "first_truth",
    "SELECT 'doc_' || o_custkey AS image_file, min(o_orderkey) AS line_no FROM orders GROUP BY o_custkey",
)
def _(i):
    return readers.first_truth(i.sql(D.TRUTH_TEXT_SQL), "image_file", "line_no").select("image_file", "line_no")


_BATCH_ROWS = """WITH o AS (SELECT 'file_' || o_orderkey AS file, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT file, '/in/llama_' || k || '.png' AS filename, NULL AS model, c::VARCHAR AS total FROM o WHERE k % 6 = 0
UNION ALL SELECT file, 'i' || k, 'inner', NULL FROM o WHERE k % 6 = 1 UNION ALL SELECT file, 'j', NULL, NULL FROM o WHERE k % 6 = 1
UNION ALL SELECT file, 'p' || c, NULL, NULL FROM o WHERE k % 6 = 3 UNION ALL SELECT file, 'k' || c, NULL, NULL FROM o WHERE k % 6 = 5"""


@query("batch_rows", f"SELECT file, filename, model::VARCHAR AS model, total FROM ({_BATCH_ROWS})")
def _(i):
    rows = readers.batch_image(readers.batch_rows(readers.parse_batches(i.sql(D.BATCH_TEXT_SQL))))
    return rows.select("file", "filename", "model", F.try_element_at("extracted_fields", F.lit("TOTAL")).alias("total"))


@query(
    "detect_model",
    "SELECT 'file_' || o_orderkey AS file, CASE o_orderkey % 6 WHEN 0 THEN 'llama' WHEN 1 THEN 'inner' WHEN 2 THEN 'outer' WHEN 3 THEN 'internvl' END AS model FROM orders",
)
def _(i):
    return readers.model_of(readers.parse_batches(i.sql(D.BATCH_TEXT_SQL)))


@query(
    "comparison_map",
    """SELECT 'm' || o_orderkey AS model, o_custkey::VARCHAR AS value FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'n' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(i):
    return readers.comparison_map(i.sql(D.COMPARISON_TEXT_SQL), "usage")


@query("latest_of", "SELECT arg_max('/in/dir_' || event_id % 7 || '/f' || event_id || CASE event_id % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.tiff' WHEN 4 THEN '.txt' WHEN 5 THEN '' ELSE '.bmp' END, ts) AS path FROM events")
def _(i):
    return readers.latest_of(i.sql(D.FILE_SQL, hex=D.FILE_HEX))


@query(
    "verify_images",
    """WITH f AS (SELECT event_id, event_id % 7 AS e, user_id % 6 AS c FROM events WHERE event_id % 7 NOT IN (4, 5))
SELECT 'f' || event_id || CASE e WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.tiff' ELSE '.bmp' END AS name,
  CASE e WHEN 0 THEN c = 0 WHEN 1 THEN c = 1 WHEN 2 THEN c = 2 WHEN 3 THEN c = 4 ELSE c = 5 END AS verified FROM f""",
)
def _(i):
    files = i.sql(D.FILE_SQL, hex=f"unhex({D.FILE_HEX})")
    return readers.verify_images(readers.images_of(files)).select("name", "verified")


# --------------------------------------------------------- files written and read again

# What is written is read back by the readers for files, so these cover both sides. Every append
# is made twice with one batch id.


def _appended(i: Inputs, name: str, write: Callable[[str, str], bool]) -> str:
    path = i.scratch(name)
    for _ in range(2):
        write(path, "first")
    return path


@query("write_wide_csv", CATALOG["to_wide"].sql)
def _(i):
    path = i.scratch("wide")
    writers.write_wide_csv(fields.to_wide(i.results(), DEFAULT_SPEC, "doc_id", "model"), path)
    return readers.lookup_truth(i.spark, path).na.fill("")  # the CSV reader has empty text as null


_FILE_ROWS = "SELECT r.doc_id AS filename, r.model, r.successful AS success, r.processing_time, e.value AS total FROM runs r LEFT JOIN extr e ON e.k = r.k AND e.model = r.model AND e.field = 'TOTAL'"


@query("read_batch_results", O.BASE + " " + _FILE_ROWS)
def _(i):
    path = i.scratch("lists")
    rows = i.results().select(
        F.col("doc_id").alias("filename"), "model", "extracted_fields", "processing_time", F.col("successful").alias("success")
    )
    writers.write_json_lists(rows, path)
    found = readers.read_batch_results(i.spark, path)
    total = F.try_element_at("extracted_fields", F.lit("TOTAL"))
    return found.select("filename", "model", "success", "processing_time", total.alias("total"))


@query(
    "read_truth_csv",
    O.BASE + " SELECT doc_id, chr(34) || PAYER_NAME || chr(10) || ', ' || BANK_NAME AS supplier, replace(DESCRIPTIONS, ' | ', chr(10)) AS descriptions FROM truth_wide",
)
def _(i):
    """Values with quotes, commas and line breaks; every document is listed twice, the last wins."""
    path = i.scratch("truth")
    name = F.concat(F.lit('"'), "PAYER_NAME", F.lit("\n, "), "BANK_NAME")
    items = F.replace("DESCRIPTIONS", F.lit(" | "), F.lit("\n"))
    rows = i.truth_wide().select(F.col("doc_id").alias("image_file"), name.alias("SUPPLIER"), items.alias("DESCRIPTIONS"))
    older = F.struct("image_file", F.lit("before\n").alias("SUPPLIER"), F.lit("").alias("DESCRIPTIONS"))
    twice = rows.select(F.explode(F.array(older, F.struct(*rows.columns))).alias("r"))
    writers.write_wide_csv(twice.select("r.*"), path)
    found = readers.read_truth_csv(i.spark, path)
    cells = [F.element_at("truth_fields", n).alias(n.lower()) for n in ("SUPPLIER", "DESCRIPTIONS")]
    return found.select("doc_id", *cells)


def _batch_results(i: Inputs) -> str:
    rows = i.results().drop("k", "seed")
    return _appended(i, "batch", lambda path, name: writers.write_batch_results(rows, path, name))


@query("write_batch_results", O.BASE + " " + _FILE_ROWS + " WHERE r.successful")
def _(i):
    schema = "doc_id string, model string, successful boolean, processing_time double, extracted_fields map<string,string>"
    found = writers.read_results(i.spark, _batch_results(i), schema)
    total = F.try_element_at("extracted_fields", F.lit("TOTAL"))
    return found.select(F.col("doc_id").alias("filename"), "model", F.col("successful").alias("success"), "processing_time", total.alias("total"))


@query("failed_images", O.BASE + " SELECT model, doc_id AS image, 'TimeoutError: order ' || k AS error, 'first' AS batch FROM runs WHERE NOT successful")
def _(i):
    return writers.read_failures(i.spark, _batch_results(i))


@query(
    "batch_totals",
    O.BASE + """ SELECT model, count(*) AS total_images, count(*) FILTER (successful) AS successful_extractions, count(*) FILTER (NOT successful) AS failed_extractions,
  round(coalesce(sum(processing_time) FILTER (successful), 0), 6) AS processing_time, round(count(*) FILTER (successful) / count(*), 6) AS success_rate, 'first' AS batch FROM runs GROUP BY model""",
)
def _(i):
    return writers.read_totals(i.spark, _batch_results(i))


@query("write_comparison_results", O.BASE + " SELECT doc_id, model, successful, 'first' AS batch FROM runs")
def _(i):
    rows = i.results().select("doc_id", "model", "successful")
    path = _appended(i, "comparison", lambda path, name: writers.write_comparison_results(rows, path, name))
    return read_published(i.spark, path, schema="doc_id string, model string, successful boolean")


@query(
    "append_truth",
    O.BASE + " SELECT doc_id, TOTAL AS total, PAYER_NAME AS payer, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM truth_wide",
)
def _(i):
    """Two batches, each appended twice."""
    path = i.scratch("appended")
    for name, rest in (("even", 0), ("odd", 1), ("even", 0), ("odd", 1)):
        wide = i.truth_wide().where(F.col("k") % 2 == rest)
        writers.append_truth(wide.select("doc_id", "TOTAL", "PAYER_NAME"), wide.select("doc_id", "k"), path, batch_id=name)
    found = writers.read_truth(i.spark, path)
    return found.select("doc_id", F.col("TOTAL").alias("total"), F.col("PAYER_NAME").alias("payer"), "batch")


# ------------------------------------------------- from stored, shredded, bucketed tables

# The same reports over tables stored by document with a column for each field.


@query("document_accuracy_stored", CATALOG["document_accuracy"].sql)
def _(i):
    return accuracy.document_accuracy(*i.stored(), DEFAULT_SPEC)


@query("field_accuracy_stored", CATALOG["field_accuracy"].sql)
def _(i):
    scored = align.aligned_scores(*i.stored(), DEFAULT_SPEC, "successful")
    return accuracy.field_accuracy(scored.where("successful"))


@query("match_report_stored", CATALOG["truth_match_report"].sql)
def _(i):
    return accuracy.truth_match_documents(*i.stored(), DEFAULT_SPEC)


@query("document_evaluation_stored", CATALOG["document_evaluation"].sql)
def _(i):
    results, truth = i.stored()
    return accuracy.evaluated_documents(results.where("successful"), truth, DEFAULT_SPEC)


@query("field_rates_stored", CATALOG["field_rates"].sql)
def _(i):
    return rates.field_rates(i.stored()[0], DEFAULT_SPEC)


@query("to_wide_stored", CATALOG["to_wide"].sql)
def _(i):
    return fields.to_wide(i.stored()[0], DEFAULT_SPEC, "doc_id", "model")


@query("restrict_to_spec_stored", CATALOG["restrict_to_spec"].sql)
def _(i):
    kept = fields.restrict_to_spec(i.stored()[0], SMALL)
    return fields.to_long(kept, "doc_id", "model")
