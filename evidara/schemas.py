"""Explicit schemas of the evidence tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "blocks": "height long not null, block_hash string, timestamp long, num_txs int",
    "transactions": "tx_hash string not null, block_height long, num_inputs int, num_outputs int",
    "ring_members": "tx_hash string, input_index int, key_image string, amount long, global_output_index long",
    "resolved_spends": "key_image string not null, real_amount long, real_output_index long, resolved_at_pass int, confidence double",
    "prediction_runs": "run_id string not null, created_at string, dataset_id string, scan_height long, metadata_json string",
    "prediction_records": "prediction_id long not null, run_id string, key_image string, predicted_amount long, predicted_output_index long, confidence double, accepted int, original_ring_size int, created_at string",
    "prediction_candidates": "prediction_id long not null, amount long, output_index long, score double, features_json string",
    "prediction_verifications": "verification_id long not null, prediction_id long, correct int, scan_height long, actual_amount long, actual_output_index long, resolution_event_id long, provenance string, observed_at string, recorded_at string",
    "resolution_events": "id long not null, key_image string, real_amount long, real_output_index long, resolved_at_pass int, confidence double, method string, scan_height long, recorded_at string",
    "resolution_dependencies": "event_id long not null, eliminated_amount long, eliminated_output_index long, source_event_id long",
    "observed_blocks": "height long not null, hash string, previous_hash string, chain_timestamp long, observed_at string, source_origin string, transaction_count int, ring_input_count int, ring_member_count int, ring_sizes map<int,int>, detail_status string",
    "observation_gaps": "from_height long, to_height long, reason string, recorded_at string",
    "pool_snapshots": "poll_id long, seen double, monotonic_seen double, session string, tip long, txs array<struct<id_hash: string, fee: decimal(20,0), weight: decimal(20,0), receive_time: long>>",
    "pool_blocks": "height long, hash string, previous_hash string, chain_timestamp long, observed double, tx_hashes array<string>",
    "block_json": "miner_tx_hash string, tx_hashes array<string>",
    "transaction_json": "vin array<struct<key: struct<amount: long, key_offsets: array<long>, k_image: string>>>, vout array<struct<amount: long>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
