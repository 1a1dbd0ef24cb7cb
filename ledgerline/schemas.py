"""Fixed schemas of the tables the jobs read and write, as DDL text."""

from __future__ import annotations

SCRIPTS = ("service string, db_type string, version string, filename string, depth int")

SERVICES = (
    "ordinal int, service string, project string, repo string, ref string, path string, check_from string"
)

TASK = (
    "f_id bigint, f_service_name string, f_installed_version string, f_target_version string, "
    "f_script_file_name string, f_create_time timestamp_ntz, f_update_time timestamp_ntz"
)

HISTORY = (
    "f_id bigint, f_service_name string, f_version string, f_script_file_name string, "
    "f_status string, f_message string, f_create_time timestamp_ntz"
)

CHANGE_ITEM = (
    "db_name string, table_name string, object_type string, operation_type string, "
    "object_name string, object_property string, object_comment string, new_name string"
)

STATEMENTS = ("dialect string, file_kind string, file_id string, ord int, sql string")

COLUMN_FACTS = (
    "dialect string, db_name string, table_name string, column_name string, ordinal int, "
    "data_type string, type_length string, is_unsigned boolean, is_nullable boolean, "
    "identity string, charset string, collate string, column_default string, comment string"
)

INDEX_FACTS = (
    "dialect string, db_name string, table_name string, index_name string, kind string, columns array<string>"
)

TABLE_FACTS = (
    "dialect string, db_name string, table_name string, file_id string, options map<string,string>"
)

COMMENT_FACTS = ("dialect string, db_name string, table_name string, column_name string, comment string")

VIOLATIONS = (
    "rule string, severity string, db_name string, table_name string, object_name string, "
    "file_id string, detail string"
)


def names(schema: str) -> list[str]:
    """Column names of a schema above."""
    return [field.split(" ")[0] for field in schema.split(", ")]
