"""Table schemas of the domain, as DDL; money is whole cents in a long, rates are cents per day."""

INSTITUTION_MAPPINGS = (
    "id string, entity_id string, institution_name string, source_type string, settlement_window_days int, dedup_window_days int, "
    "amount_tolerance_pct double, mapping_config string, created_at timestamp"
)
ACCOUNTS = (
    "id string, entity_id string, institution_id string, name string, account_type string, status string, interest_rate decimal(8,4), "
    "starting_balance_cents bigint, balance_cents bigint, credit_limit_cents bigint, created_at timestamp"
)
JOBS = "id string, entity_id string, job_type string, triggered_by string, status string, queued_at timestamp, started_at timestamp, completed_at timestamp, error string, metadata string"
IMPORT_BATCHES = (
    "id string, entity_id string, account_id string, processed_at timestamp, date_range_start date, date_range_end date, "
    "transactions_imported int, transactions_skipped_duplicate int, transactions_superseded int"
)
TRANSACTIONS = (
    "id string, entity_id string, account_id string, import_batch_id string, date date, amount_cents bigint, imported_payee string, "
    "merchant_normalized string, imported_id string, settlement_status string, imported_at timestamp"
)
ENTRIES = (
    "id string, entity_id string, label_id string, direction string, entry_type string, period_days int, rate_method string, "
    "projected_rate_per_day decimal(12,4), conditions string, priority int, status string, source string, recurrence_anchor string, "
    "next_due_date date, start_date date, end_date date, alert_type string, fitness decimal(4,3), merchant_fit decimal(4,3), "
    "timing_fit decimal(4,3), amount_fit decimal(4,3), sample_merchants array<string>, matched_transaction_count int"
)
ASSIGNMENTS = "transaction_id string, entry_id string, fit decimal(4,3)"
SNAPSHOTS = (
    "entity_id string, node_id string, node_type string, snapshot_date date, computed_as_of date, actual_rate_per_day decimal(12,4), "
    "projected_rate_per_day decimal(12,4), drift_per_day decimal(12,4), slope_per_day decimal(14,6), r_squared decimal(4,3), "
    "transaction_count int, window_days_used int, rolling_window_total_cents bigint, balance_cents bigint"
)
PROJECTIONS = (
    "entity_id string, projected_date date, income_rate_per_day decimal(12,4), spend_rate_per_day decimal(12,4), "
    "margin_rate_per_day decimal(12,4), projected_balance_cents bigint, is_pinch_point boolean"
)
LABELS = "id string, entity_id string, name string, source string, created_at timestamp"
JOB_MESSAGE = "job_id string, entity_id string, job_type string, metadata string"

#: Closed sets of the status and kind columns.
ENUMS = {
    "account_type": ["checking", "savings", "credit", "loan", "mortgage", "investment"],
    "account_status": ["active", "passive"],
    "job_type": ["import.process", "entries.reprocess", "account.analyze", "balance.project", "export.report"],
    "job_status": ["queued", "processing", "complete", "failed"],
    "settlement_status": ["flux", "settled"],
    "direction": ["income", "spend", "mixed"],
    "entry_type": ["standing", "variable"],
    "rate_method": ["median", "max"],
    "entry_status": ["pending", "live", "ended"],
    "source": ["user", "engine", "system"],
    "alert_type": ["new", "drift", "ended"],
    "node_type": ["entry", "label"],
}
