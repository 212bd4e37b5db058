"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

CATALOG_DDL = (
    "id long, title string, filename string, source string, type string, content string, status string, "
    "storage_path string, file_size long, content_type string, source_type string, source_url string, "
    "category string, crawl_time timestamp_ntz, last_updated timestamp_ntz, content_hash string, "
    "vector_document_id string, created_time timestamp_ntz")
EXCLUSION_DDL = "source_url string, reason string"
CHAT_HISTORY_DDL = (
    "id long, session string, conversation_id long, question string, answer string, sources string, "
    "confidence int, created_time timestamp_ntz")
CONVERSATION_DDL = (
    "conversation_id long, anonymous_session_id string, title string, created_time timestamp_ntz, "
    "updated_time timestamp_ntz, expire_time timestamp_ntz")
MESSAGE_DDL = (
    "id long, conversation_id long, ord long, role string, content string, sources string, chat_history_id long, "
    "created_time timestamp_ntz")
FEEDBACK_DDL = "chat_history_id long, session string, feedback string, reason string, seq long"
EVALUATION_DDL = (
    "id long, run_id string, category string, question string, answer string, expected_source string, "
    "has_source boolean, source_match boolean, keyword_match boolean, non_empty boolean, score int, "
    "human_accurate boolean, review_note string")
USAGE_DDL = (
    "id long, model string, status string, prompt_tokens int, completion_tokens int, total_tokens int, "
    "cache_hit_tokens int, cache_miss_tokens int, latency_ms long, error_type string, created_time timestamp_ntz")
CRAWL_RECORD_DDL = (
    "url string, title string, category string, content_hash string, etag string, last_modified string, "
    "last_status string, crawled_at timestamp_ntz, indexed_at timestamp_ntz")
PAGE_DDL = (
    "url string, http_status int, content_type string, etag string, last_modified string, html string, "
    "fetched_at timestamp_ntz")
OUTCOME_DDL = (
    "url string, source_url string, title string, content string, source string, category string, content_hash string, "
    "published_time timestamp_ntz, crawl_time timestamp_ntz, last_updated timestamp_ntz, etag string, last_modified string, "
    "http_status int, fetched boolean, status string, action string, links array<struct<url:string,anchor:string>>, "
    "content_links array<struct<url:string,anchor:string>>")
ROBOTS_DDL = "origin string, status int, body string"
CHUNK_DDL = (
    "chunk_id string, document_id string, chunk_index int, filename string, source string, source_url string, "
    "source_type string, category string, page int, content string, upload_time string, last_updated string, "
    "crawl_time string, content_hash string, vector array<float>")
QUESTION_DDL = "question string, category string, expected_source string, expected_keywords array<string>"
ALIAS_FILE_DDL = "terms array<struct<canonical:string,aliases:array<string>,category:string>>"
