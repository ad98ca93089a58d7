"""Explicit schemas of the raw inputs."""

from __future__ import annotations

# Column names of the two headerless logs, in file order.
BEHAVIORS = "impression_id BIGINT, user_id STRING, time STRING, history STRING, impressions STRING"
NEWS = (
    "news_id STRING, category STRING, sub_category STRING, title STRING, abstract STRING, "
    "url STRING, title_entities STRING, abstract_entities STRING"
)
INTERACTIONS = (
    "user_id STRING, time STRING, news_id STRING, category STRING, sub_category STRING, "
    "title STRING, abstract STRING, interaction_type STRING, score INT"
)
