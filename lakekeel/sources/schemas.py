"""Row types of the domain, as DDL."""

PING = "worker_id STRING, version STRING, stored_bytes LONG, timestamp LONG, current_epoch INT, last_applied_assignment_id STRING"
CATALOGUE = "dataset STRING, id STRING, size LONG, files STRING, last_block_hash STRING, last_block_timestamp LONG, row_counts MAP<STRING, LONG>"
CHUNK = "dataset STRING, id STRING, size LONG, first_block LONG, last_block LONG, files ARRAY<STRING>, summary STRUCT<last_block_hash: STRING, last_block_timestamp: LONG>"
MVCC_CHUNK = "chunk_pk LONG, dataset_id SHORT, chunk_id STRING, size LONG, schema_id INT, tables_present STRING, first_block LONG, last_block LONG, last_block_hash STRING, last_block_timestamp LONG, registered_at TIMESTAMP"
WORKER = "worker_pk LONG, peer_id STRING, version STRING, inactive_since LONG"
HOLDERS = "chunk_pk LONG, worker_pk LONG"
STALE = "chunk_pk LONG, worker_pk LONG, superseded_at INT"
META = "chunk_pk LONG, rejected BOOLEAN, applied_worker INT, applied_portal INT, marked LONG, dropped_portal INT, dropped_worker LONG"
DIFF = "assignment_id INT, chunk_pk LONG, worker_ids ARRAY<LONG>"
PORTAL = "id INT, created_at LONG, confirmed_up_to INT"
CORRECTION = "old_pk LONG, new_pk LONG, applied_portal INT"
SEGMENT = "dataset STRING, seg_from LONG, weight INT, minimum_worker_version STRING"
