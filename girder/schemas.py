"""Explicit schemas of the building-model tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "products": "guid string, name string, object_type string, tag string, entity string, predefined_type string, storey_name string, type_name string",
    "storeys": "guid string, name string, elevation double",
    "spaces": "guid string, name string, long_name string, storey_guid string",
    "type_objects": "guid string, name string, entity string",
    "contained_in": "child_guid string, parent_guid string",
    "aggregates": "child_guid string, parent_guid string",
    "storey_building": "storey_guid string, building_guid string",
    "voids": "opening_guid string, host_guid string",
    "psets": "guid string, pset string, prop string, value string, data_type string",
    "quantities": "guid string, qset string, qty string, value double",
    "materials": "guid string, material string",
    "classifications": "guid string, system string, code string",
    "boxes": "guid string, entity string, discipline string, storey_guid string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double",
    "elements": "global_id string, ifc_class string, name string, storey string, extra map<string,string>",
    "relationships": "subject_global_id string, object_global_id string, relationship_family string, relationship_type string, confidence double, source_kind string, evidence string",
    "object_versions": "id bigint, bucket string, object_key string, sha256 string, size_bytes bigint, content_type string, kind string, operation string, worker string, job_id string, metadata string, created_at timestamp, version_id string",
    "object_lineage": "parent_id bigint, child_id bigint, role string, parent_version_id string",
    "clash_pairs": "object_version_id bigint, guid_a string, guid_b string, distance double, kind string, recorded_at timestamp",
    "tester_rows": "object_version_id bigint, ifc_guid string, ids_rule string, passed boolean, reason string, recorded_at timestamp",
    "tester_runs": "id int, ifc_filename string, ids_filename string, test_results string, pass_count int, fail_count int, created_at timestamp_ntz",
    "job_history": "id int, job_id string, queue string, status string, func_name string, description string, args string, meta string, exc_info string, created_at timestamp_ntz, enqueued_at timestamp_ntz, ended_at timestamp_ntz, synced_at timestamp_ntz",
    "triples": "s string, p string, o string",
}
LAYERS = ("products", "storeys", "spaces", "type_objects", "contained_in", "aggregates", "storey_building", "voids", "psets", "quantities", "materials", "classifications")

#: A clash report in both layouts: a list of sets, or one set; clashes keyed by pair.
CLASH = "struct<a_global_id:string,b_global_id:string,a_ifc_class:string,b_ifc_class:string,a_name:string,b_name:string,type:string,p1:array<double>,p2:array<double>,distance:string>"
CLASH_SET = f"struct<name:string,clashes:map<string,{CLASH}>>"


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])
