"""Schemas of the tables that jobs read and write."""

REGIONS = "image_id bigint, region_idx bigint, text string, raw_text string, confidence double, bounding_box array<struct<x: double, y: double>>, engine string"
RECORDS_RAW = (
    "record_id bigint, run_id bigint, page_number bigint, raw_case_number string, raw_hearing_date string, raw_party_name string, raw_advocate string, "
    "case_number_confidence double, date_confidence double, party_name_confidence double, advocate_confidence double"
)
RECORDS = (
    RECORDS_RAW + ", case_number string, hearing_date string, party_name string, advocate string, overall_confidence double, confidence_level string, "
    "needs_review boolean, is_duplicate boolean, duplicate_of bigint, validation_passed boolean, validation_issues array<string>"
)
DOCUMENTS_META = "doc_id bigint, filename string, file_size bigint, status string"
RUNS = "run_id bigint, document_id bigint, run_date timestamp, extraction_method string, total_records bigint, records_requiring_review bigint, average_confidence double"
PROCESSING_LOG = "log_id bigint, document_id bigint, level string, message string, created_at timestamp"
REVIEW_QUEUE = "record_id bigint, reason string, priority int, status string, assigned_to string, created_at timestamp"
EXPORT_LOG = "export_id bigint, document_id bigint, format string, record_count bigint, file_path string, created_at timestamp"
