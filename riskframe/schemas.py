"""Declared schemas; nothing is inferred. Columns that hold content of scripts or documents say so in their comment."""

import re

SUBMISSION = (
    "submission_id STRING, ts TIMESTAMP, user_id STRING, script_content STRING COMMENT 'content', script_format STRING, "
    "project_id STRING, script_id INT, callback_url STRING, delivery STRING, idempotency_key STRING, "
    "priority INT, metadata MAP<STRING,STRING>"
)
FDX = (
    "TitlePage STRUCT<Content: STRUCT<Paragraph: ARRAY<STRUCT<Text: ARRAY<STRING>>>>, "
    "Paragraph: ARRAY<STRUCT<Text: ARRAY<STRING>>>>, "
    "Content STRUCT<Paragraph: ARRAY<STRUCT<_Type: STRING, _Number: STRING, Text: ARRAY<STRING>>>>"
)
SCRIPT_TEXT = "script_id BIGINT, full_text STRING COMMENT 'content'"
PAGE_TEXT = "script_id BIGINT, page_no INT, text STRING COMMENT 'content'"
SCENE_TEXT = "scene_ix INT, heading STRING, action_text STRING COMMENT 'content', dialogue ARRAY<STRING> COMMENT 'content'"
KB_DOCUMENT = (
    "doc_id STRING, tenant_id STRING, title STRING, source STRING, tags ARRAY<STRING>, content_hash STRING, "
    "original BINARY COMMENT 'content', key_id STRING, uploaded_by STRING, ttl_hours INT, created_at TIMESTAMP, expires_at TIMESTAMP"
)
KB_CHUNK = (
    "doc_id STRING, chunk_id STRING, chunk_text STRING COMMENT 'content', embedding ARRAY<FLOAT>, dim INT, chunk_offset INT, "
    "length INT, hash STRING"
)
MEASURE_STRUCT = "STRUCT<code: STRING, title: STRING, responsible: STRING, due: STRING>"
FINDING = (
    "report_id STRING, scene_ix INT, finding_ix BIGINT, scene_number STRING, risk_level STRING, category STRING, "
    "risk_class STRING, rule_id STRING, likelihood INT, impact INT, description STRING COMMENT 'content', recommendation STRING COMMENT 'content', "
    f"measures ARRAY<{MEASURE_STRUCT}>, confidence DOUBLE, line_reference STRING, evidence STRING COMMENT 'content', "
    "vulnerability STRING, complexity STRING, exposure_duration STRING"
)
JOB = (
    "job_id STRING, project_id STRING, user_id STRING, script_format STRING, status STRING, priority INT, "
    "progress_percentage INT, report_id STRING, error_message STRING, idempotency_key STRING, created_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)
REPORT_META = (
    "report_id STRING, job_id STRING, project_id STRING, user_id STRING, script_format STRING, total_findings BIGINT, "
    "delivery_mode STRING, is_retrieved BOOLEAN, retrieved_at TIMESTAMP, created_at TIMESTAMP, expires_at TIMESTAMP"
)
AUDIT = (
    "ts TIMESTAMP, endpoint STRING, method STRING, user_id STRING, project_id STRING, request_id STRING, "
    "status_code INT, duration_ms DOUBLE, day DATE"
)
API_KEY = "key_hash STRING, user_id STRING, name STRING, is_active BOOLEAN, expires_at TIMESTAMP"
RISK_CLASS = "risk_class STRING, category STRING, rule_id STRING, description STRING, ord BIGINT"
MEASURE = "code STRING, title STRING, responsible STRING, due STRING, ord INT"
MEASURE_APPLIES = "code STRING, risk_class STRING, ord INT"

#: Names of the columns with content: what leaves the tables is redacted there, and metadata never hold them.
CONTENT_COLUMNS = tuple(sorted({
    name for ddl in (SUBMISSION, SCRIPT_TEXT, PAGE_TEXT, SCENE_TEXT, KB_DOCUMENT, KB_CHUNK, FINDING) for name in re.findall(r"(\w+) [A-Z<>]+ COMMENT 'content'", ddl)
}))
