"""The relations of the library, as Spark DDL."""

from __future__ import annotations

OCR_TASKS = "task_id STRING, tenant_id STRING, user_id STRING, file_url STRING, content BINARY, webhook_url STRING, webhook_custom_headers MAP<STRING, STRING>, meta_data STRING, task_status STRING, result STRING, usage_amount DOUBLE, usage_id STRING"
CHUNK = "chunk_id INT, start_ms BIGINT, end_ms BIGINT, file_path STRING, job_id STRING, text STRING"
TRANSCRIBE_TASKS = f"task_id STRING, tenant_id STRING, user_id STRING, file_url STRING, webhook_url STRING, task_status STRING, result STRING, usage_amount DOUBLE, usage_id STRING, transcription_job_id STRING, chunks ARRAY<STRUCT<{CHUNK.replace(' INT', ': INT').replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING')}>>"
TRANSLATE_TASKS = "task_id STRING, tenant_id STRING, user_id STRING, text STRING, task_status STRING, result STRING, usage_amount DOUBLE, usage_id STRING"
CHUNK_RESULTS = "task_id STRING, chunk_id INT, start_ms BIGINT, end_ms BIGINT, job_id STRING, text STRING, audio_duration_ms BIGINT, transcription_cost DOUBLE"
ARCHIVE_MEMBERS = "member_no INT, member_path STRING, content BINARY, error STRING"
TOKENS = "task_id STRING, seq BIGINT, type STRING, start_time DOUBLE, end_time DOUBLE, content STRING, language STRING"
WEBHOOK_EVENTS = "task_id STRING, chunk_id INT, job_id STRING, status STRING, event_ts TIMESTAMP"
USAGE = "usage_id STRING, user_id STRING, enrollment_id STRING, asset STRING, variant STRING, amount DECIMAL(38,18), meta_data STRING"
QUOTA = "user_id STRING, asset STRING, variant STRING, unit STRING, quota DECIMAL(38,18), is_unlimited BOOLEAN"
LANGUAGES = "value STRING, fa STRING, en STRING, abbreviation STRING"
ALTERNATIVE = "STRUCT<confidence: DOUBLE, content: STRING, language: STRING, speaker: STRING>"
TRANSCRIPT = f"STRUCT<format: STRING, job: STRUCT<id: STRING, created_at: STRING, data_name: STRING, duration: INT>, metadata: STRUCT<created_at: STRING, type: STRING, language_identification: STRUCT<predicted_language: STRING>>, results: ARRAY<STRUCT<type: STRING, start_time: DOUBLE, end_time: DOUBLE, alternatives: ARRAY<{ALTERNATIVE}>>>>"
