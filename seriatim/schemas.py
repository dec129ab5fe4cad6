"""Schemas of the engine's tables and files, as Spark DDL."""

from __future__ import annotations

EXTRACTED_POST = "title STRING, url STRING, content_html STRING, slug STRING, published_at STRING, tags ARRAY<STRING>"
POST_FILE = f"{EXTRACTED_POST}, post_index INT"
CLEANED_FILE = f"{POST_FILE}, content_text STRING, excerpt STRING, word_count INT, reading_time_minutes INT"
CLEAN_RESULT = "html STRING, text STRING, excerpt STRING, word_count INT, reading_time_minutes INT, images ARRAY<STRUCT<src: STRING, alt: STRING>>"
CURATED_LINK = "title STRING, url STRING, author STRING"
REST_ITEM = "title STRUCT<rendered: STRING>, content STRUCT<rendered: STRING>, link STRING, slug STRING, date STRING"
WEBHOOK_EVENT = "type STRING, data STRUCT<email_id: STRING>"
BLOGS = "id STRING, slug STRING, name STRING, author STRING, author_email STRING, description STRING, url STRING, post_count INT, is_active BOOLEAN, revenue_share_percent INT, created_at TIMESTAMP, updated_at TIMESTAMP"
POSTS = "id STRING, blog_id STRING, title STRING, slug STRING, content_html STRING, content_text STRING, excerpt STRING, original_url STRING, published_at TIMESTAMP, post_index INT, word_count INT, reading_time_minutes INT, tags ARRAY<STRING>, created_at TIMESTAMP"
FEEDS = "id STRING, blog_id STRING, name STRING, slug STRING, description STRING, tag_filter STRING, source_url STRING, post_count INT, is_active BOOLEAN, created_at TIMESTAMP"
SUBSCRIBERS = "id STRING, email STRING, name STRING, is_confirmed BOOLEAN, confirmation_token STRING, confirmed_at TIMESTAMP, is_pro BOOLEAN, stripe_customer_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
SUBSCRIPTIONS = "id STRING, subscriber_id STRING, blog_id STRING, feed_id STRING, current_post_index INT, frequency_days INT, preferred_day SMALLINT, preferred_hour SMALLINT, timezone STRING, next_send_at TIMESTAMP, last_sent_at TIMESTAMP, is_active BOOLEAN, is_completed BOOLEAN, paused_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
EMAIL_LOG = "id STRING, subscription_id STRING, post_id STRING, sent_at TIMESTAMP, resend_message_id STRING, opened_at TIMESTAMP, clicked_at TIMESTAMP"
BLOG_REQUESTS = "id STRING, url STRING, requester_email STRING, requester_id STRING, note STRING, vote_count INT, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
