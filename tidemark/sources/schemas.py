"""Explicit schemas of every file the package reads. Nothing is inferred."""

# Column names and types of the input formats.
REVIEW = (
    "rating double, title string, text string, images array<string>, asin string, parent_asin string, "
    "user_id string, timestamp bigint, helpful_vote bigint, verified_purchase boolean"
)
META = "parent_asin string, main_category string, categories array<string>, average_rating double, rating_number bigint"
PREDS = "item_id string, y int, pred int, p_neg double, p_neu double, p_pos double"
RATER_LOG = (
    "item_id bigint, label string, reason string, raw string, error string, backend string, model string, "
    "prompt_sha string, utc string"
)
