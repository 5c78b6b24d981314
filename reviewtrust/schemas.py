"""Schemas of the input tables, for readers that must not infer one."""

REVIEWS = (
    "product_id bigint, review_id bigint, text string, source string, rating double, "
    "review_date date, date_raw string, verified_purchase boolean, author string, title string, "
    "helpful_votes int, url string, extracted_by string"
)
SOURCE_REPORTS = (
    "product_id bigint, kind string, source string, ok boolean, blocked boolean, error string, "
    "count bigint"
)
LISTINGS = "listing_id bigint, title string, brand string, ids map<string,string>"
VIDEOS = (
    "product_id bigint, video_key bigint, video_id string, title string, url string, source string, "
    "channel string, channel_url string, duration_seconds bigint, published string, views bigint, "
    "thumbnail string, description string"
)
EVIDENCE = (
    "product_id bigint, pos bigint, category string, type string, explanation string, "
    "review_mentions int, external_mentions int, claim_text string, observed_reality string, "
    "severity double"
)
PAGES = "page_id bigint, url string, status int, html string"
CRAWL_FILES = "host string, text string"
FX_RATES = "currency string, rate double"
RESULTS = (
    "cache_key string, seq bigint, product_id string, site string, product_name string, "
    "canonical_url string, status string, payload string, review_count bigint, created_at timestamp"
)
EVENT_LOG = (
    "job_id bigint, seq bigint, ts timestamp, event string, stage string, status string, "
    "source string, data string"
)
REQUESTS = "request_id bigint, ts timestamp, client string, cache_key string"
