"""Tables, enumerations and defaults."""

from __future__ import annotations

# The enumerations of the data model.
CATEGORIES = (
    "electronics", "computers", "gaming", "appliances", "home", "kitchen", "clothing", "shoes-accessories", "baby-kids",
    "toys-games", "sports-outdoors", "tools-auto", "beauty-health", "grocery", "travel", "other",
)
DEPARTMENTS = ("baby", "girls", "boys", "women", "men", "unisex", "na")
VERDICTS = ("verified-low", "verified-good", "market-price", "above-market", "inflated-anchor", "unverified")
EVIDENCE = ("strong", "moderate", "none")
STATUSES = ("active", "expired", "dead")
STRENGTHS = ("gtin", "mpn", "asin", "model", "title", "none")
COMPARABLE = ("gtin", "asin", "mpn")
SORTS = ("hottest", "newest", "biggest-drop", "best-verified", "price-asc", "price-desc", "expiring")

RAW = (
    "source string, source_id string, title string, url string, description string, image_url string, price string, "
    "price_was string, currency string, merchant_name string, merchant_domain string, brand string, gtin string, mpn string, "
    "asin string, category_hint string, department_hint string, coupon_code string, shipping_note string, in_stock boolean, "
    "stock_note string, sizes_available array<string>, posted_at string, expires_at string, votes double, store_id string, "
    "source_path string"
)

DEALS = (
    "id string, source string, source_id string, slug string, url string, canonical_url string, title string, description string, "
    "image_url string, merchant_id string, store_id string, product_key string, product_key_strength string, gtin string, mpn string, "
    "asin string, category string, department string, brand string, keywords string, sizes_available array<string>, price_now bigint, "
    "price_was bigint, currency string, discount_pct double, discount_abs bigint, market_price bigint, market_discount_pct double, "
    "observed_low bigint, price_rank_pct double, verdict string, evidence string, claim_suspect boolean, quality_note string, "
    "coupon_code string, coupon_note string, shipping_note string, in_stock boolean, stock_note string, posted_at timestamp_ntz, "
    "expires_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, votes bigint, heat double, status string, "
    "locale string, also_seen_on array<string>, source_path string"
)
PRICE_POINTS = "id string, deal_id string, price bigint, observed_at timestamp_ntz"
SOURCE_RUNS = (
    "id string, source string, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string, items_found bigint, items_new bigint, "
    "items_updated bigint, items_dropped bigint, latency_ms bigint, http_status int, source_path string, error string"
)
USAGE = (
    "id string, conversation_id string, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
    "cache_creation_tokens bigint, tool_calls bigint, latency_ms bigint, created_at timestamp_ntz"
)
MERCHANTS = (
    "id string, slug string, name string, domain string, logo_url string, affiliate_url_template string, family string, vertical string, "
    "engine string, status string, rate_limit_rps double, created_at timestamp_ntz, updated_at timestamp_ntz"
)
STORES = (
    "id string, chain string, source_store_id string, name string, address string, city string, province string, postal_code string, "
    "lat double, lng double, created_at timestamp_ntz, updated_at timestamp_ntz"
)
