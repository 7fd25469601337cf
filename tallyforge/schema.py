"""The model's tables as Spark schemas (DDL)."""

TABLES = {
    "documents": "doc_id string, file_name string, file_path string, file_hash string, file_size int, file_type string, doc_type string, party string, date_created date, date_received date, date_processed timestamp, processed_by string, status string, project_id string, meta_data string",
    "pages": "page_id bigint, doc_id string, page_number int, content string, has_tables boolean, has_handwriting boolean, has_financial_data boolean, embedding array<float>, meta_data string",
    "line_items": "item_id string, doc_id string, page_id bigint, item_number string, description string, amount decimal(15,2), quantity decimal(10,2), unit_price decimal(15,2), total decimal(15,2), cost_code string, category string, status string, location_in_doc string, extraction_confidence decimal(5,2), context string, meta_data string",
    "document_relationships": "relationship_id bigint, source_doc_id string, target_doc_id string, relationship_type string, confidence decimal(5,2), meta_data string",
    "financial_transactions": "transaction_id bigint, item_id string, transaction_type string, amount decimal(15,2), date date, status string, meta_data string",
    "annotations": "annotation_id bigint, doc_id string, page_id bigint, content string, location_x decimal(10,2), location_y decimal(10,2), width decimal(10,2), height decimal(10,2), annotation_type string, is_handwritten boolean, confidence decimal(5,2), meta_data string",
    "analysis_flags": "flag_id bigint, item_id string, flag_type string, confidence decimal(5,2), explanation string, created_at timestamp, created_by string, status string, meta_data string",
    "reports": "report_id bigint, title string, description string, content string, format string, created_at timestamp, created_by string, parameters string",
    "report_evidence": "evidence_id bigint, report_id bigint, doc_id string, item_id string, page_id bigint, annotation_id bigint, citation_text string, relevance_score decimal(5,2), meta_data string",
    "amount_matches": "match_id bigint, source_item_id string, target_item_id string, match_type string, confidence decimal(5,2), difference decimal(15,2), created_at timestamp, meta_data string",
    "change_orders": "change_order_id bigint, doc_id string, change_order_number string, description string, amount decimal(15,2), status string, date_submitted date, date_responded date, reason_code string, meta_data string",
    "payment_applications": "payment_app_id bigint, doc_id string, payment_app_number string, period_start date, period_end date, amount_requested decimal(15,2), amount_approved decimal(15,2), status string, meta_data string",
}

#: What makes a row of a table the same row again, for upserts.
KEYS = {
    "documents": ("file_hash",),
    "pages": ("doc_id", "page_number"),
    "document_relationships": ("source_doc_id", "target_doc_id", "relationship_type"),
    "analysis_flags": ("item_id", "flag_type"),
    "amount_matches": ("source_item_id", "target_item_id"),
    "change_orders": ("doc_id",),
    "payment_applications": ("doc_id",),
}
