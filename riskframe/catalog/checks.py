"""Submissions, ownership, dimensions, model output and prompt pieces, over the given tables."""

from pyspark.sql import functions as F

from riskframe.catalog.inputs import WS_SQL, documents, strip_sql, table
from riskframe.catalog.registry import query
from riskframe.functions import modelio, network, text as texts, variants
from riskframe.operators import access, classify, knowledge, rollups, validate
from riskframe.sources import dimensions, readers

_HOSTS = ["hooks.example.org", "Cb.Example.net"]

# --- submissions ----------------------------------------------------------------------------------------------

_SUBMISSIONS = """sub AS (SELECT doc_id AS submission_id, CASE doc_id % 9 WHEN 0 THEN 'FDX' WHEN 1 THEN 'docx' WHEN 2 THEN NULL WHEN 3 THEN 'PDF' ELSE 'fdx' END AS fmt,
  CASE WHEN doc_id % 7 = 0 THEN source || ' ' || doc_id WHEN doc_id % 31 = 0 THEN NULL ELSE source || '_' || doc_id END AS project_id,
  CASE doc_id % 6 WHEN 0 THEN 'https://hooks.example.org/' || doc_id WHEN 1 THEN 'http://hooks.example.org/x' WHEN 2 THEN 'https://CB.example.net./' WHEN 3 THEN 'https://elsewhere.example/' END AS url,
  repeat(lang, 1 + CAST(doc_id % 140 AS INTEGER)) AS k, CAST(doc_id % 14 AS INTEGER) - 1 AS priority,
  CASE doc_id % 5 WHEN 0 THEN chr(10) || ' ' WHEN 1 THEN '*' || base64(encode(text)) WHEN 2 THEN base64(encode('%PDF-1.7 ' || text)) ELSE base64(encode(text || CASE WHEN doc_id % 8 = 3 THEN chr(0) ELSE '' END)) END AS content,
  '{"lang": "' || lang || '", "n": ' || doc_id || ', ' || CASE doc_id % 4 WHEN 0 THEN '"bad key": 1}' WHEN 1 THEN '"list": [1, "x"]}' WHEN 2 THEN '"long": "' || repeat('x', CAST(doc_id % 2000 AS INTEGER)) || '"}' ELSE '"none": null}' END AS meta
  FROM documents)"""


def _submissions(spark, folder):
    at = F.col("doc_id")
    number = at.cast("string")
    body = F.concat("text", F.when(at % 8 == 3, "\0").otherwise("")).cast("binary")
    content = (
        F.when(at % 5 == 0, "\n ").when(at % 5 == 1, F.concat(F.lit("*"), F.base64(F.col("text").cast("binary"))))
        .when(at % 5 == 2, F.base64(F.concat(F.lit("%PDF-1.7 "), "text").cast("binary"))).otherwise(F.base64(body)))
    meta = F.concat(
        F.lit('{"lang": "'), "lang", F.lit('", "n": '), number, F.lit(", "),
        F.when(at % 4 == 0, '"bad key": 1}').when(at % 4 == 1, '"list": [1, "x"]}').when(at % 4 == 2, F.concat(F.lit('"long": "'), F.repeat(F.lit("x"), (at % 2000).cast("int")), F.lit('"}'))).otherwise('"none": null}'))
    return documents(spark, folder).select(
        at.alias("submission_id"), F.when(at % 9 == 0, "FDX").when(at % 9 == 1, "docx").when(at % 9 == 2, None).when(at % 9 == 3, "PDF").otherwise("fdx").alias("script_format"),
        F.when(at % 7 == 0, F.concat("source", F.lit(" "), number)).when(at % 31 == 0, None).otherwise(F.concat("source", F.lit("_"), number)).alias("project_id"),
        F.when(at % 6 == 0, F.concat(F.lit("https://hooks.example.org/"), number)).when(at % 6 == 1, "http://hooks.example.org/x").when(at % 6 == 2, "https://CB.example.net./").when(at % 6 == 3, "https://elsewhere.example/").alias("callback_url"),
        F.repeat("lang", (1 + at % 140).cast("int")).alias("idempotency_key"), ((at % 14).cast("int") - 1).alias("priority"),
        F.replace(F.replace(content, F.lit("\r"), F.lit("")), F.when(at % 5 == 0, F.lit("\0")).otherwise(F.lit("\n")), F.lit("")).alias("script_content"), meta.alias("metadata_json"))


@query(
    "b1_submission_errors",
    rf"""WITH {_SUBMISSIONS}, p AS (SELECT *, lower(fmt) AS f, regexp_full_match(content, '(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') AND {strip_sql('content')} <> '' AS ok,
  rtrim(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), '.') AS host FROM sub),
b AS (SELECT *, CASE WHEN ok THEN from_base64(content) END AS body FROM p)
SELECT submission_id, list_filter([
  CASE WHEN coalesce(f, '') NOT IN ('fdx', 'pdf') THEN 'script_format: unsupported' END,
  CASE WHEN NOT coalesce(regexp_full_match(project_id, '[A-Za-z0-9_-]{{1,100}}'), false) THEN 'project_id: not allowed' END,
  CASE WHEN url NOT LIKE 'https:%' THEN 'callback_url: not_https' WHEN host NOT IN ('hooks.example.org', 'cb.example.net') THEN 'callback_url: host_not_allowed' END,
  CASE WHEN length(k) > 255 THEN 'idempotency_key: too long' END, CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority: out of range' END,
  CASE WHEN {strip_sql('content')} = '' THEN 'content: empty' WHEN NOT ok THEN 'content: not base64' END,
  CASE WHEN length(content) > 10485760 THEN 'content: encoded text too long' END, CASE WHEN octet_length(body) > 10485760 THEN 'content: body too large' END,
  CASE WHEN f = 'fdx' AND contains(decode(body), chr(0)) THEN 'content: null bytes' END, CASE WHEN f = 'pdf' AND NOT starts_with(decode(body), '%PDF') THEN 'content: not a PDF' END], lambda x: x IS NOT NULL) AS errors FROM b""",
)
def submission_errors(spark, folder):
    """Every violation of every submission, from its whole body."""
    return validate.check_submissions(_submissions(spark, folder).drop("metadata_json"), _HOSTS).select("submission_id", "errors")


@query(
    "b4_metadata_errors",
    f"""WITH {_SUBMISSIONS}, e AS (SELECT submission_id, meta, unnest(json_keys(meta)) AS k FROM sub),
v AS (SELECT *, json_extract(meta, '$."' || k || '"') AS x FROM e)
SELECT submission_id, list_filter([
  CASE WHEN bool_or(NOT regexp_full_match(k, '[A-Za-z0-9_-]{{1,50}}')) THEN 'metadata: bad key' END, CASE WHEN bool_or(json_type(x) = 'VARCHAR' AND length(x ->> '$') > 1000) THEN 'metadata: value too long' END,
  CASE WHEN bool_or(json_type(x) IN ('ARRAY', 'OBJECT')) THEN 'metadata: value is not a scalar' END], lambda x: x IS NOT NULL) AS errors FROM v GROUP BY submission_id""",
)
def metadata_errors(spark, folder):
    return _submissions(spark, folder).select("submission_id", variants.metadata_errors(F.col("metadata_json")).alias("errors"))


@query("b4_event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_filter([CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'k: out of range' END, 'note: missing'], lambda x: x IS NOT NULL) AS errors FROM events")
def event_properties(spark, folder):
    """Properties of events as typed fields, with the path of every fault."""
    fields = (variants.Field("k", "bigint", required=True, high=90), variants.Field("note", required=True))
    value = variants.parsed(F.col("props"))
    return table(spark, folder, "events").select("event_id", variants.read(value, fields[0]).alias("k"), variants.object_errors(value, fields).alias("errors"))


@query("k3_formats", f"WITH {_SUBMISSIONS} SELECT submission_id, CASE WHEN lower(fmt) IN ('fdx', 'pdf') THEN lower(fmt) END AS goes_to, CASE WHEN coalesce(lower(fmt), '') NOT IN ('fdx', 'pdf') THEN 'unsupported format: ' || coalesce(fmt, '') || '; supported: fdx, pdf' END AS error FROM sub")
def formats(spark, folder):
    supported, rest = validate.split_by_format(_submissions(spark, folder))
    out = rest.select("submission_id", F.lit(None).cast("string").alias("goes_to"), "error")
    for name, rows in supported.items():
        out = out.unionByName(rows.select("submission_id", F.lit(name).alias("goes_to"), F.lit(None).cast("string").alias("error")))
    return out


# --- ownership and jobs -----------------------------------------------------------------------------------------


@query(
    "b8_ownership",
    """WITH r AS (SELECT event_id AS request_id, event_id % 90 AS job_id, user_id % 6 AS user_id, CASE WHEN event_id % 5 = 0 THEN user_id % 7 WHEN event_id % 5 = 1 THEN user_id % 6 END AS actor_id FROM events),
j AS (SELECT c_custkey AS job_id, c_nationkey % 6 AS user_id FROM customer)
SELECT request_id, CASE WHEN actor_id IS NOT NULL AND actor_id <> r.user_id THEN 'forbidden' WHEN j.job_id IS NULL THEN 'not_found' ELSE 'ok' END AS access FROM r LEFT JOIN j USING (job_id, user_id)""",
)
def ownership(spark, folder):
    who = F.col("user_id") % 6
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") % 90).alias("job_id"), who.cast("string").alias("user_id"),
        F.when(F.col("event_id") % 5 == 0, F.col("user_id") % 7).when(F.col("event_id") % 5 == 1, who).cast("string").alias("actor_id"))
    jobs = table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_nationkey") % 6).cast("string").alias("user_id"))
    return access.authorise(requests, jobs).select("request_id", "access")


@query(
    "d11_completed_jobs",
    """WITH j AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'pending' END AS status, CAST(c_custkey % 80 AS INTEGER) AS p, CASE WHEN c_custkey % 50 = 0 THEN 'old' END AS report_id FROM customer),
r AS (SELECT o_custkey AS job_id, 'report ' || max(o_orderkey) AS report_id FROM orders GROUP BY 1)
SELECT job_id, CASE WHEN r.report_id IS NULL THEN status ELSE 'completed' END AS status, CASE WHEN r.report_id IS NULL THEN p ELSE 100 END AS progress_percentage, coalesce(r.report_id, j.report_id) AS report_id FROM j LEFT JOIN r USING (job_id)""",
)
def completed_jobs(spark, folder):
    key = F.col("c_custkey")
    jobs = table(spark, folder, "customer").select(
        key.alias("job_id"), F.when(key % 3 == 0, "running").otherwise("pending").alias("status"), (key % 80).cast("int").alias("progress_percentage"), F.when(key % 50 == 0, "old").alias("report_id"))
    reports = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.concat(F.lit("report "), F.max("o_orderkey").cast("string")).alias("report_id"))
    return access.complete_jobs(jobs, reports).select("job_id", "status", "progress_percentage", "report_id")


@query(
    "e14_acceptance",
    """WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN true ELSE false END AND CAST(o_totalprice AS INTEGER) % 9000 > 0 AND CAST(o_totalprice AS INTEGER) % 9000 < 7200 AND coalesce(f, 0) > 0 AS passed FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def acceptance(spark, folder):
    found = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("total_findings"))
    runs = table(spark, folder, "orders").join(found, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        (F.round("o_totalprice", 0).cast("int") % 9000).alias("elapsed_s"), F.coalesce("total_findings", F.lit(0)).alias("total_findings"))
    return rollups.acceptance(runs).select("run_id", "passed")


@query(
    "e16_audit_percentiles",
    """SELECT event_type AS endpoint, CAST(event_id % 3 * 100 + 200 AS INTEGER) AS status_code, CAST(ts AS DATE) AS day, count(*) AS requests, count(DISTINCT user_id) AS users, max(value) AS max_ms,
  list_sort(list(value))[CAST(ceil(0.95 * count(value)) AS INTEGER)] AS p95_ms FROM events GROUP BY 1, 2, 3""",
)
def audit_percentiles(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_type").alias("endpoint"), (F.col("event_id") % 3 * 100 + 200).cast("int").alias("status_code"), F.to_date("ts").alias("day"), "user_id", F.col("value").alias("duration_ms"))
    return rollups.audit_summary(log)


# --- the store's fields -----------------------------------------------------------------------------------------


@query(
    "b12_store_fields",
    f"""WITH k AS (SELECT doc_id, chr(160) || string_split(text, chr(10))[1] || ' ' AS title, ' ' || source AS source, [x FOR x IN ['a', lang, '', 'a', source] IF x <> ''] AS tags, CAST(doc_id * 7 % 9000 AS INTEGER) AS ttl FROM documents)
SELECT doc_id, substr({strip_sql('title')}, 1, 40) AS title, length({strip_sql('title')}) > 40 AS title_truncated, upper(trim(source)) AS source, list_distinct(tags) IS NOT NULL AND len(list_distinct(tags)) = 3 AS three_tags,
  ttl BETWEEN 1 AND 8760 AS ttl_fits FROM k""",
)
def store_fields(spark, folder):
    rows = documents(spark, folder).select(
        "doc_id", F.concat(F.lit(chr(160)), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" ")).alias("title"), F.concat(F.lit(" "), "source").alias("source"),
        F.concat(F.lit("a, "), "lang", F.lit(",, a ,"), "source").alias("tags"), (F.col("doc_id") * 7 % 9000).cast("int").alias("ttl_hours"))
    out = validate.normalise_kb(rows, 40, 20)
    return out.select("doc_id", "title", "title_truncated", "source", (F.size("tags") == 3).alias("three_tags"), (F.size("errors") == 0).alias("ttl_fits"))


@query("i15_expiry", "SELECT doc_id, strftime(TIMESTAMP '2024-02-28 22:30:00' + INTERVAL 1 HOUR * CAST(1 + doc_id % 8760 AS INTEGER), '%Y-%m-%d %H:%M') AS expires_at FROM documents")
def expiry(spark, folder):
    rows = documents(spark, folder).select("doc_id", (1 + F.col("doc_id") % 8760).cast("int").alias("ttl_hours"))
    return knowledge.with_expiry(rows, F.lit("2024-02-28 22:30:00").cast("timestamp")).select("doc_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires_at"))


# --- dimensions -------------------------------------------------------------------------------------------------


def _taxonomy(spark, folder):
    """One document, as a file would hold it: regions as categories, nations as their classes."""
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.col("n_name"), F.struct(F.concat(F.lit("R-"), (F.col("n_nationkey") % 10).cast("string")).alias("rule_id"), F.when(F.col("n_nationkey") % 4 > 0, F.lower("n_name")).alias("description")))
    per = rows.groupBy("r_name").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classes"))  # a dimension: few rows
    entries = F.collect_list(F.struct("r_name", F.struct(F.lower("r_name").alias("description"), "classes")))
    by_name = F.array_sort(entries, lambda a, b: F.when(a["r_name"] < b["r_name"], -1).when(a["r_name"] > b["r_name"], 1).otherwise(0))
    return per.agg(F.map_from_entries(by_name).alias("categories"))


_TAXONOMY = """tax AS (SELECT n_name AS risk_class, r_name AS category, 'R-' || n_nationkey % 10 AS rule_id, CASE WHEN n_nationkey % 4 > 0 THEN lower(n_name) ELSE '' END AS description,
  (dense_rank() OVER (ORDER BY r_name) - 1) * 4294967296 + row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS ord FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("a6_taxonomy", f"WITH {_TAXONOMY} SELECT * FROM tax")
def taxonomy(spark, folder):
    return dimensions.flatten_taxonomy(_taxonomy(spark, folder))


@query("a6_rule_index", f"WITH {_TAXONOMY} SELECT rule_id, arg_max(risk_class, ord) AS risk_class FROM tax GROUP BY 1")
def rule_index(spark, folder):
    return dimensions.rule_index(dimensions.flatten_taxonomy(_taxonomy(spark, folder)))


def _measures(spark, folder):
    rows = table(spark, folder, "nation").alias("a").join(table(spark, folder, "nation").alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    per = rows.groupBy("a.n_nationkey", "a.n_name").agg(F.array_sort(F.collect_list(F.lower("b.n_name"))).alias("applies_to"))  # a dimension: few rows
    code = F.concat(F.lit("M-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    entry = F.struct(code, F.struct(F.concat(F.lit("Measure "), "n_name").alias("title"), F.lit("team").alias("responsible"), F.lit("soon").alias("due"), "applies_to"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("measures"))


@query("a7_measures", "SELECT 'M-' || lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') AS code, 'Measure ' || a.n_name AS title, upper(b.n_name) AS risk_class, CAST(a.n_nationkey AS INTEGER) AS ord FROM nation a JOIN nation b USING (n_regionkey)")
def measure_catalogue(spark, folder):
    measure, applies = dimensions.flatten_measures(_measures(spark, folder))
    return measure.select("code", "title").join(applies, "code").select("code", "title", "risk_class", "ord")


@query(
    "i9_taxonomy_text",
    f"""WITH {_TAXONOMY}, lines AS (SELECT 0 AS part, min(ord) AS a, 'category ' || category || chr(10) || string_agg('- ' || risk_class || ' [' || rule_id || '] ' || description, chr(10) ORDER BY ord) AS t FROM tax GROUP BY category
  UNION ALL SELECT 1, a.n_nationkey, '* M-' || lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') || ': Measure ' || a.n_name || ' (' || string_agg(upper(b.n_name), ', ' ORDER BY upper(b.n_name)) || ')' FROM nation a JOIN nation b USING (n_regionkey) GROUP BY a.n_nationkey, a.n_name)
SELECT string_agg(t, chr(10) ORDER BY part, a) AS taxonomy_context FROM lines""",
)
def taxonomy_text(spark, folder):
    return dimensions.taxonomy_text(dimensions.flatten_taxonomy(_taxonomy(spark, folder)), *dimensions.flatten_measures(_measures(spark, folder)))


# --- model output -----------------------------------------------------------------------------------------------

_OUTPUT = """answer AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>a ' || chr(10) || '{</think>' ELSE '' END || CASE WHEN conv_id % 4 < 2 THEN '```json' || chr(10) ELSE '' END ||
  CASE WHEN conv_id % 13 = 12 THEN 'I cannot' ELSE '{"findings": ' || CASE WHEN conv_id % 17 = 3 THEN '"none"' ELSE '[{"risk_class": ' || to_json(upper(role)) || ', "category": ' || CASE WHEN turn % 5 = 4 THEN '"OTHER"' ELSE '"PHYSICAL"' END ||
  ', "likelihood": ' || (conv_id % 7) || ', "impact": ' || CASE WHEN turn % 4 = 3 THEN '"3"' ELSE CAST(1 + turn % 5 AS VARCHAR) END || ', "description": ' || to_json(text) || CASE WHEN conv_id % 6 = 5 THEN '' ELSE ', "recommendation": "r"' END || ', "evidence": "e"}]' END || '}' END ||
  CASE WHEN conv_id % 4 < 2 THEN chr(10) || '```' ELSE '' END AS model_json FROM conversations)"""


def _outputs(spark, folder):
    c, t = F.col("conv_id"), F.col("turn")
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    finding = F.concat(
        F.lit('[{"risk_class": '), quoted(F.upper("role")), F.lit(', "category": '), F.when(t % 5 == 4, '"OTHER"').otherwise('"PHYSICAL"'), F.lit(', "likelihood": '), (c % 7).cast("string"), F.lit(', "impact": '),
        F.when(t % 4 == 3, '"3"').otherwise((1 + t % 5).cast("string")), F.lit(', "description": '), quoted(F.col("text")), F.when(c % 6 == 5, "").otherwise(', "recommendation": "r"'), F.lit(', "evidence": "e"}]'))
    answer = F.concat(
        F.when(t % 3 == 0, "<think>a \n{</think>").otherwise(""), F.when(c % 4 < 2, "```json\n").otherwise(""),
        F.when(c % 13 == 12, "I cannot").otherwise(F.concat(F.lit('{"findings": '), F.when(c % 17 == 3, '"none"').otherwise(finding), F.lit("}"))), F.when(c % 4 < 2, "\n```").otherwise(""))
    return table(spark, folder, "conversations").select("conv_id", "turn", answer.alias("model_json"))


_CLEAN = r"""clean AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(regexp_replace(model_json, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(10)), '^```(json)?', ''), '```$', ''), ' ' || chr(10)) AS j FROM answer)"""


@query("i3_clean_answers", f"WITH {_OUTPUT}, {_CLEAN} SELECT conv_id, turn, json_valid(j) AS is_json, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.findings[0].description') END AS description FROM clean")
def clean_answers(spark, folder):
    """Answers without reasoning and fences: those that are JSON, and the whole text that one field holds."""
    value = variants.parsed(modelio.clean_model_json(F.col("model_json")))
    return _outputs(spark, folder).select("conv_id", "turn", value.isNotNull().alias("is_json"), F.try_variant_get(value, "$.findings[0].description", "string").alias("description"))


@query(
    "i4_finding_errors",
    f"""WITH {_OUTPUT}, {_CLEAN}, f AS (SELECT conv_id, turn, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN json_type(j->'findings') END AS kind, CASE WHEN json_valid(j) THEN j->'findings'->0 END AS x FROM clean)
SELECT conv_id, turn, CASE WHEN NOT ok THEN ['not JSON'] WHEN kind <> 'ARRAY' THEN ['findings: not array'] ELSE list_filter([
  CASE WHEN x->>'category' NOT IN ('PHYSICAL', 'ENVIRONMENTAL', 'PSYCHOLOGICAL') THEN 'findings[0].category: not allowed' END,
  CASE WHEN CAST(x->>'likelihood' AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'findings[0].likelihood: out of range' END,
  CASE WHEN json_type(x->'impact') = 'VARCHAR' THEN 'findings[0].impact: not int' WHEN CAST(x->>'impact' AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'findings[0].impact: out of range' END,
  CASE WHEN (x->'recommendation') IS NULL THEN 'findings[0].recommendation: missing' END], lambda e: e IS NOT NULL) END AS errors FROM f""",
)
def finding_errors(spark, folder):
    """Every fault of every finding with its path."""
    return _outputs(spark, folder).select("conv_id", "turn", variants.model_findings(modelio.clean_model_json(F.col("model_json")))["errors"].alias("errors"))


@query(
    "a8_model_output",
    f"""WITH {_OUTPUT}, {_CLEAN} SELECT conv_id, turn, CASE WHEN NOT json_valid(j) OR json_type(j->'findings') <> 'ARRAY' OR json_type(j->'findings'->0->'impact') = 'VARCHAR' THEN 'not JSON' END AS parse_error,
  CASE WHEN json_valid(j) AND json_type(j->'findings') = 'ARRAY' AND json_type(j->'findings'->0->'impact') <> 'VARCHAR' THEN json_extract_string(j, '$.findings[0].risk_class') END AS risk_class FROM clean""",
)
def model_output(spark, folder):
    """Answers as typed records; a value of another type makes an answer unreadable as a whole."""
    out = readers.read_model_output(_outputs(spark, folder), modelio.FINDINGS_SCHEMA, required=("findings",))
    return out.select("conv_id", "turn", "parse_error", F.get("parsed.findings", F.lit(0))["risk_class"].alias("risk_class"))


# --- texts for prompts --------------------------------------------------------------------------------------------

_RAW = "raw AS (SELECT doc_id, lang, chr(0) || chr(9) || replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN chr(160) || ' ' WHEN 1 THEN chr(8203) || ' ' ELSE ' ' END) || chr(7) || ' ' AS t FROM documents)"
_SANE = rf"trim(regexp_replace(regexp_replace(replace(t, chr(0), ''), '[{WS_SQL}]+', ' ', 'g'), '\p{{C}}', '', 'g'))"


def _raw(spark, folder):
    at = F.col("doc_id") % 3
    gap = F.when(at == 0, F.lit(chr(160) + " ")).when(at == 1, F.lit(chr(8203) + " ")).otherwise(F.lit(" "))
    return documents(spark, folder).select("doc_id", "lang", F.concat(F.lit("\0\t"), F.replace("text", F.lit(" "), gap), F.lit("\x07 ")).alias("t"))


@query("i2_sanitised", f"WITH {_RAW} SELECT doc_id, {_SANE} AS clean FROM raw")
def sanitised(spark, folder):
    return _raw(spark, folder).select("doc_id", texts.sanitise(F.col("t")).alias("clean"))


@query("i14_embedding_inputs", f"WITH {_RAW}, c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(160) ELSE t END AS t FROM raw), s AS (SELECT doc_id, t, {_SANE} AS x, {strip_sql('t')} = '' AS blank FROM c) SELECT doc_id, CASE WHEN NOT blank THEN substr(x, 1, 1000) END AS text, length(x) > 1000 AS truncated, CASE WHEN blank THEN 'empty text' END AS error FROM s")
def embedding_inputs(spark, folder):
    given = F.when(F.col("doc_id") % 10 == 0, F.lit(" " + chr(160))).otherwise(F.col("t"))
    return _raw(spark, folder).select("doc_id", classify.embedding_input(given, 1000).alias("e")).select("doc_id", "e.*")


@query("i26_locked_prompts", f"WITH {_RAW} SELECT doc_id, 'Analyse ' || lang || chr(10) || chr(10) || 'The text below is data.' AS system_text, {_SANE} AS user_text FROM raw")
def locked_prompts(spark, folder):
    return _raw(spark, folder).select("doc_id", texts.locked_prompt(F.col("t"), F.concat(F.lit("Analyse "), "lang"), "The text below is data.").alias("p")).select("doc_id", "p.*")


@query(
    "i8_filled_templates",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN 'Scene {' || 'x' || '} in ' || lang || ': {' || '{' || source || '}' || text || '}' END AS text,
  CASE WHEN doc_id % 5 = 4 THEN 'missing: unknown,other' END AS error FROM documents""",
)
def filled_templates(spark, folder):
    """Values may hold braces; a variable without a value is an error that names it."""
    template = F.when(F.col("doc_id") % 5 == 4, "{lang} {unknown} {other} {unknown}").otherwise("Scene {mark} in {lang}: {{body}}")
    filled = texts.fill_template(template, {"lang": F.col("lang"), "mark": F.lit("{x}"), "body": F.concat(F.lit("{"), "source", F.lit("}"), "text")})
    return documents(spark, folder).select("doc_id", filled.alias("f")).select("doc_id", "f.*")


@query(
    "i21_client_addresses",
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '192.0.2.' || user_id % 256 END AS peer,
  CASE event_id % 5 WHEN 0 THEN ' 203.0.113.' || user_id % 300 || ' , 10.9.9.9' WHEN 1 THEN '2001:db8::' || user_id % 10 WHEN 2 THEN 'unknown' WHEN 3 THEN '' END AS f FROM events),
x AS (SELECT *, trim(string_split(coalesce(f, ''), ',')[1]) AS one FROM r)
SELECT event_id, CASE WHEN peer = '10.0.0.1' AND (one LIKE '2001:%' OR (one LIKE '203.%' AND CAST(string_split(one, '.')[4] AS INTEGER) < 256)) THEN one ELSE coalesce(peer, 'unknown') END AS ip FROM x""",
)
def client_addresses(spark, folder):
    user = F.col("user_id")
    at = F.col("event_id")
    peer = F.when(at % 3 == 0, "10.0.0.1").when(at % 3 == 1, F.concat(F.lit("192.0.2."), (user % 256).cast("string")))
    sent = F.when(at % 5 == 0, F.concat(F.lit(" 203.0.113."), (user % 300).cast("string"), F.lit(" , 10.9.9.9"))).when(at % 5 == 1, F.concat(F.lit("2001:db8::"), (user % 10).cast("string"))).when(at % 5 == 2, "unknown").when(at % 5 == 3, "")
    return table(spark, folder, "events").select("event_id", network.client_ip(peer, sent, ["10.0.0.1"]).alias("ip"))
