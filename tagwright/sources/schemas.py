"""Declared schemas of everything that is read; nothing is inferred."""

OCR_PAGE = "path STRING, width INT, height INT, error STRING, lines ARRAY<STRUCT<t:STRING,c:DOUBLE,h:INT,b:ARRAY<DOUBLE>>>"
JOB = (
    "job_id STRING, photo STRING, photo_abs STRING, photo_sha256 STRING, photo_size ARRAY<INT>, store STRING, store_source STRING, "
    "band_index INT, band_label STRING, crop_path STRING, crop_box ARRAY<DOUBLE>, crop_size ARRAY<INT>, ocr_prices ARRAY<DOUBLE>, "
    "ocr_digest STRING, photo_taken_at STRING, warnings ARRAY<STRING>"
)
CATALOGUE = {"Category": "category", "Group": "group", "Winery": "winery", "Label": "label", "Assortment (product line)": "assortment", "SKU name (unique)": "sku"}
TRUTH = "photo STRING, rail STRING, position STRING, price STRING, currency STRING, volume_ml STRING, name_contains STRING, notes STRING"

# Fields of an answer, in their order, with their kinds. A trailing ? allows null; every key must be there.
BOX_FIELDS = ("x0", "y0", "x1", "y1")
WINE_FIELDS = {
    "wine_name": "string", "producer": "string?", "vintage": "string?", "wine_type": "string", "sweetness": "string", "grape_varieties": "strings",
    "region": "string?", "country": "string?", "volume_ml": "double?", "abv_percent": "double?", "price": "double?", "currency": "string?",
    "price_text": "string?", "price_kind": "string", "original_price": "double?", "unit_price_text": "string?", "promo_text": "string?",
    "raw_tag_text": "string?", "raw_label_text": "string?", "ocr_price_index": "int?", "name_source": "string", "pairing_confidence": "string",
    "pairing_note": "string?", "bottle_bbox": "box?", "tag_bbox": "box?",
}
TAG_FIELDS = {"raw_text": "string", "price": "double?", "currency": "string?", "reason": "string", "tag_bbox": "box?"}
WRAPPERS = ("result", "extraction", "output", "data")
# Columns of the tables that are written, in their order.
ROW_COLUMNS = (
    "row_id", "store", "wine_name", "producer", "vintage", "wine_type", "sweetness", "price", "currency", "volume_ml", "price_per_litre",
    "price_kind", "original_price", "discount_pct", "grape_varieties", "region", "country", "abv_percent", "promo_text", "unit_price_text",
    "needs_review", "review_reasons", "pairing_confidence", "pairing_note", "brand_group", "brand_winery", "brand_label", "brand_match",
    "price_check", "unit_price_check", "ocr_price", "ocr_price_check", "name_source", "photo", "photo_taken_at", "store_source",
    "store_read_from_photo", "shelf", "price_text", "raw_tag_text", "raw_label_text", "gps_lat", "gps_lon", "bottle_bbox", "tag_bbox", "photo_sha256",
    "model", "extracted_at", "duplicate_of",
)
NUMERIC_COLUMNS = (
    "price", "price_per_litre", "original_price", "discount_pct", "volume_ml", "abv_percent", "gps_lat", "gps_lon", "ocr_price",
)
UNMATCHED_COLUMNS = (
    "store", "photo", "shelf", "raw_text", "price", "currency", "reason", "tag_bbox",
)
