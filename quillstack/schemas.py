"""Declared schemas of archive tables; readers never infer."""

from __future__ import annotations

RAW_PAGES = "thread_id STRING, page INT, page_url STRING, html STRING"

POST_FIELDS = (
    "post_id STRING, post_number STRING, post_url STRING, page INT, author STRING, timestamp STRING, text STRING, body_text STRING, signature_text STRING, "
    "attachment_labels ARRAY<STRING>, image_urls ARRAY<STRING>, images ARRAY<STRING>, accepted BOOLEAN, validation_reasons ARRAY<STRING>"
)
POSTS = f"thread_id STRING, {POST_FIELDS}"


def as_struct(fields: str) -> str:
    """A field list in the spelling of a struct type."""
    return "STRUCT<" + ",".join(part.replace(" ", ":", 1) for part in fields.split(", ")) + ">"


THREAD_DOCUMENT = f"title STRING, source_url STRING, start_page INT, archived_at STRING, total_posts BIGINT, posts ARRAY<{as_struct(POST_FIELDS)}>, _corrupt_record STRING"

VALIDATION = (
    "STRUCT<page:INT,expected_post_numbers:ARRAY<STRING>,expected_post_count:INT,accepted_post_count:INT,rejected_post_count:INT,accepted_post_numbers:ARRAY<STRING>,"
    "missing_post_numbers:ARRAY<STRING>,extra_unlabelled_posts:INT,unknown_date_posts:INT,passed:BOOLEAN,warnings:ARRAY<STRING>>"
)
PAGE_STATE = (
    "thread_id STRING, page INT, page_url STRING, title STRING, new_posts_count INT, new_images_downloaded INT, new_images_reused INT, used_cached_html BOOLEAN, "
    f"validation {VALIDATION}, attempts INT, completed_at STRING"
)
RESUME_STATE = (
    "thread_id STRING, base_url STRING, title STRING, requested_start_page INT, actual_start_page INT, last_completed_page INT, next_page INT, last_page_seen INT, finished BOOLEAN, "
    "average_seconds_per_page DOUBLE, final_page_verified BOOLEAN, validation_warning_pages ARRAY<INT>, unknown_date_posts_total INT, last_run_summary_path STRING, updated_at STRING"
)
