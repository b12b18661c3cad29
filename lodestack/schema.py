"""Schemas of the catalog's tables and its enumerations."""

from __future__ import annotations

VERSION = 1

#: fixed values
STATES = ("annotated", "skipped")
SOURCES = ("model", "import", "human")
RANK = {"model": 0, "import": 1, "human": 2}
EVENTS = ("tombstoned", "withdrawn", "described", "arrived")
SIDES = ("train", "val", "holdout")
RUNS = ("ingest", "prepare", "derive", "generate", "import", "judge", "backfill")
LOGS = ("sample", "sample_collection", "annotation", "event", "origin")

TABLES = {
    "catalog_identity": "id string, created_at timestamp_ntz",
    "run": "id string, kind string, producer string, code string, spec string, spec_hash string, chain string, files_digest string, continues string, counts string, started_at timestamp_ntz, finished_at timestamp_ntz",
    "run_input": "run_id string, checksum string",
    "raw": "id bigint, collection string, path string, checksum string, container string, offset bigint, length bigint, run_id string, ingested_at timestamp_ntz",
    "sample": "id bigint, container string, offset bigint, length bigint, checksum string, media string, subtype string, metadata string, ingested_at timestamp_ntz, deleted_at timestamp_ntz",
    "location": "checksum string, container string, offset bigint, length bigint, placed_at timestamp_ntz",
    "sample_collection": "id bigint, sample_id bigint, collection string, added_at timestamp_ntz",
    "origin": "id bigint, sample_id bigint, run_id string, input_kind string, input string, input_type string, role string, position int, metadata string, recorded_at timestamp_ntz",
    "generation": "id bigint, sample_id bigint, run_id string, model_host string, model_run string, checkpoint string, checkpoint_digest string, template_digest string, system_digest string, settings_digest string, values string, copied_from string, seed bigint, recorded_at timestamp_ntz",
    "label_set": "id bigint, name string, schema string, created_at timestamp_ntz",
    "annotation": "id bigint, sample_id bigint, label_set_id bigint, state string, value string, source string, batch string, run_id string, created_at timestamp_ntz, superseded_at timestamp_ntz",
    "annotation_class": "annotation_id bigint, class_name string",
    "event": "id bigint, kind string, sample_id bigint, annotation_id bigint, before string, after string, at timestamp_ntz",
    "list_version": "id bigint, name string, version int, digest string, size bigint, media string, subtype string, created_at timestamp_ntz",
    "list_member": "list_id bigint, checksum string",
    "dataset": "id bigint, name string, version int, label_set_id bigint, spec string, spec_hash string, watermark string, selection string, annotation_digest string, val_ratio double, val_achieved double, holdout_ratio double, holdout_achieved double, group_by string, sides_from_version int, seed bigint, given_split string, disagreeing_inputs string, created_at timestamp_ntz",
    "dataset_member": "dataset_id bigint, sample_id bigint, side string",
    "annotation_conflict": "sample_id bigint, label_set_id bigint, kept_value string, other_value string, other_origin string, noticed_at timestamp_ntz",
}
