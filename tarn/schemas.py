"""The fixed schemas of owned tables. Identifiers are strings; instants are UTC."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "D": T.DateType(), "a": T.ArrayType(T.StringType())}
DIAGNOSTIC = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (("severity", "s"), ("code", "s"), ("path", "s"), ("message", "s"), ("recoverable", "b"))])
_TYPES["g"] = T.ArrayType(DIAGNOSTIC)


def _schema(fields: str) -> T.StructType:
    """From ``name:type`` words; a word without a type is a string."""
    return T.StructType([T.StructField(n, _TYPES[t or "s"]) for n, _, t in (f.partition(":") for f in fields.split())])


SITES = _schema("contract_version site_uri name description site_type provider_id provider_uri provider_name provider_url mainstem_uri landing_url source_url geometry")
DATASETS = _schema(
    "contract_version site_uri dataset_id distribution_id variable_id dataset_uri dataset_name dataset_description temporal_coverage temporal_start:t temporal_end:t variable_uri variable_name "
    "unit_uri unit_label measurement_technique distribution_url media_type conforms_to:a provider_uri provider_name provider_url license access_rights handler_id fetchable:b source_url"
)
PROBLEMS = _schema("stage source_uri path code severity message recoverable:b occurred_at:t")
REQUESTS = _schema(
    "request_id stage method canonical_url_redacted request_hash body_hash final_url response_status:i response_media_type encoded_bytes:d decoded_bytes:d content_hash etag last_modified retrieved_at:t elapsed_ms:d cache_origin error_code"
)
COMPLETENESS = _schema("stage status truncated:b input_count:l attempted_count:l succeeded_count:l failed_count:l skipped_count:l output_count:l reason")
PLAN_DISTRIBUTIONS = _schema(
    "contract_version selection_order:l fetch_order:i site_uri dataset_id distribution_id provider_uri provider_name distribution_url media_type conforms_to:a handler_id fetchable:b temporal_start:t temporal_end:t "
    "time_start:t time_end:t variable_count:l selected:b decision"
)
PLAN_PARAMETERS = _schema("contract_version distribution_id parameter_order:i variable_id variable_uri variable_name unit_uri unit_label measurement_technique parameter_key mapping_status")
OBSERVATIONS = _schema(
    "contract_version observation_index:l result_id native_row:l site_uri dataset_id distribution_id handler_id variable_id variable_uri variable_name datetime:t value:d unit_uri unit_label original_value original_unit_uri "
    "original_unit_label qualifier harmonized:b conversion_rule_id status"
)
RESOURCES = _schema("contract_version result_index:l result_id distribution_id handler_id payload_class native_rows:l native_columns:i timeseries:b observation_count:l status")
NATIVE_EDR = _schema("coverage_id parameter parameter_label unit datetime:t x:d y:d z:d value:d")
NATIVE_DAILY = _schema("daily_id time_series_id monitoring_location_id parameter_code statistic_id time:D value unit_of_measure approval_status qualifier last_modified:t")
NATIVE_CONTINUOUS = _schema("continuous_id time_series_id monitoring_location_id parameter_code statistic_id time:t value unit_of_measure approval_status qualifier last_modified:t")
COMID_CROSSWALK = _schema(
    "contract_version input_index:l requested_comid status match_index:i comid mainstem_uri mapping_release mainstem_status replacement_uris:a mainstem_observed_at:t mainstem_retrieval_mode diagnostics:g"
)
GAGE_CROSSWALK = _schema("contract_version input_index:l requested_provider_id status match_index:i provider_id gage_id gage_uri mainstem_uri comid diagnostics:g")
BINDINGS = _schema("row:l variable_index:i variable term_type value datatype language bnode_scope")
PACKAGE_RESOURCES = _schema("contract_version path role format media_type bytes:d sha256 rows:l columns:i result_id distribution_id handler_id")

ALL = {n: v for n, v in list(globals().items()) if isinstance(v, T.StructType)}
