"""SQL for every query, over the same tables. ``ROLES`` are shared common table expressions."""

from __future__ import annotations

import re


def _vk(version: str) -> str:
    """Sort key of a version; NULL for anything else."""
    return (
        f"CASE WHEN regexp_full_match({version}, '[0-9]+(\\.[0-9]+)*') THEN "
        f"string_split(regexp_replace({version}, '(\\.0+)+$', ''), '.')::HUGEINT[] END"
    )


IS_VERSION = "regexp_full_match(version, '[0-9]+(\\.[0-9]+)*')"
IS_SCRIPT = "(regexp_matches(filename, '^[0-9]+-.*\\.(sql|py|json)$') AND filename <> 'init.sql')"
SEQ = "TRY_CAST(regexp_extract(filename, '^([0-9]+)-.*\\.(sql|py|json)$', 1) AS DECIMAL(38,0))"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
VOID = "CAST(NULL AS VARCHAR)"

ROLES: dict[str, str] = {
    "order_versions": """
        SELECT o_orderkey, o_orderstatus, 'svc-' || o_custkey AS service,
            CASE left(o_orderpriority, 1) WHEN '1' THEN 'dm8' WHEN '2' THEN 'kdb9' ELSE 'mariadb' END AS db_type,
            CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN 'v' || ymd
                 WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN ymd || '.0'
                 WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 300000 THEN ymd || '.12345678901234567890'
                 ELSE ymd END AS version
        FROM (SELECT *, year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate) AS ymd FROM orders)""",
    "scripts": """
        SELECT service, db_type, version,
            CASE WHEN l_linenumber = 7 THEN 'init.sql'
                 WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 6 THEN 'notes-p' || l_partkey || '.md'
                 WHEN l_linenumber = 5 AND l_discount >= 0.05 THEN '20240101120000-p' || l_partkey || ext
                 WHEN l_linenumber = 5 THEN '5-p' || l_partkey || ext
                 ELSE lpad(l_linenumber::VARCHAR, 2, '0') || '-p' || l_partkey || ext END AS filename,
            CASE WHEN l_discount >= 0.1 THEN 5 ELSE 4 END AS depth
        FROM order_versions JOIN (
            SELECT *, CASE l_returnflag WHEN 'A' THEN '.sql' WHEN 'R' THEN '.py' ELSE '.json' END AS ext FROM lineitem
        ) ON l_orderkey = o_orderkey""",
    "services": """
        SELECT c_custkey::INTEGER AS ordinal, 'svc-' || c_custkey AS service
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "task": f"""
        SELECT f_service_name, f_installed_version, f_installed_version AS f_target_version,
            coalesce(anchor || '/03-done.sql', '') AS f_script_file_name,
            TIMESTAMP '2024-01-01 00:00:00' AS f_create_time, TIMESTAMP '2024-01-01 00:00:00' AS f_update_time
        FROM (
            SELECT service AS f_service_name,
                CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN NULL WHEN service LIKE '%77' THEN ''
                     WHEN service LIKE '%88' THEN 'latest'
                     ELSE arg_max(version, (vk, version)) FILTER (o_orderstatus = 'F') END AS f_installed_version,
                arg_min(version, (vk, version)) FILTER (o_orderstatus = 'P') AS anchor
            FROM (SELECT *, {_vk('version')} AS vk FROM order_versions WHERE {IS_VERSION}) GROUP BY service)
        WHERE f_installed_version IS NOT NULL""",
    "versions": f"""
        SELECT service, db_type, version, count(*) AS n_files,
            sum(CASE WHEN depth = 4 AND {IS_SCRIPT} THEN 1 ELSE 0 END)::BIGINT AS n_scripts,
            max(CASE WHEN depth = 4 AND filename = 'init.sql' THEN 1 ELSE 0 END)::INTEGER AS has_init,
            {_vk('version')} AS vk
        FROM scripts WHERE {IS_VERSION} GROUP BY service, db_type, version""",
    "distinct_versions": f"""
        SELECT DISTINCT service, version, {_vk('version')} AS vk FROM order_versions WHERE {IS_VERSION}""",
    "state": f"""
        SELECT s.service, s.ordinal, c.db_type, c.n_files, c.n_versions,
            CASE WHEN t.f_service_name IS NULL THEN 'install' ELSE 'upgrade' END AS route,
            t.f_installed_version AS installed_version,
            CASE WHEN t.f_installed_version = '' THEN []::HUGEINT[] ELSE {_vk('t.f_installed_version')} END AS installed_vk,
            CASE WHEN length(t.f_script_file_name) > 0 THEN string_split(t.f_script_file_name, '/')[1] END AS anchor_version,
            CASE WHEN length(t.f_script_file_name) > 0 THEN 3 ELSE -1 END::DECIMAL(38,0) AS anchor_seq,
            c.target_version, c.can_install
        FROM services s
        JOIN (
            SELECT service, db_type, sum(n_files)::BIGINT AS n_files, count(*) AS n_versions,
                arg_max(version, (vk, version)) AS target_version,
                arg_max(has_init, (vk, version)) = 1 AS can_install
            FROM versions v
            WHERE db_type = 'dm8' OR (db_type = 'mariadb' AND NOT EXISTS (
                SELECT 1 FROM versions w WHERE w.service = v.service AND w.db_type = 'dm8'))
            GROUP BY service, db_type
        ) c ON c.service = s.service
        LEFT JOIN task t ON t.f_service_name = s.service""",
    "live": """
        SELECT service, anchor_version AS live_version, anchor_seq AS live_seq
        FROM (
            SELECT st.service, st.anchor_version, st.anchor_seq,
                row_number() OVER (PARTITION BY st.service ORDER BY v.vk, v.version) AS place, v.version
            FROM state st JOIN versions v ON v.service = st.service AND v.db_type = st.db_type
            WHERE st.route = 'upgrade' AND v.n_scripts > 0 AND v.vk > st.installed_vk
        ) WHERE place = 1 AND version = anchor_version""",
    "pending": f"""
        SELECT st.ordinal, st.service, st.db_type, s.version, {SEQ} AS seq, s.filename,
            st.installed_version, st.target_version
        FROM state st JOIN scripts s ON s.service = st.service AND s.db_type = st.db_type
        WHERE st.route = 'upgrade' AND s.depth = 4 AND {IS_SCRIPT} AND {_vk('s.version')} > st.installed_vk""",
    "plan": """
        SELECT ordinal, service, db_type, 'install' AS route, target_version AS version, -1::DECIMAL(38,0) AS seq,
            'init.sql' AS filename, target_version || '/init.sql' AS relative_name, installed_version, target_version
        FROM state WHERE route = 'install' AND can_install
        UNION ALL
        SELECT p.ordinal, p.service, p.db_type, 'upgrade', p.version, p.seq, p.filename, p.version || '/' || p.filename,
            p.installed_version, p.target_version
        FROM pending p LEFT JOIN live l ON l.service = p.service
        WHERE NOT coalesce(p.version = l.live_version AND p.seq <= l.live_seq, false)""",
    "choices": """
        SELECT service, wanted, n_rows,
            CASE WHEN own > 0 THEN wanted WHEN fallback > 0 THEN 'mariadb' END AS db_type
        FROM (
            SELECT s.service, w.wanted,
                count(*) FILTER (s.db_type = w.wanted) AS own,
                count(*) FILTER (s.db_type = 'mariadb') AS fallback,
                CASE WHEN count(*) FILTER (s.db_type = w.wanted) > 0 THEN count(*) FILTER (s.db_type = w.wanted)
                     ELSE count(*) FILTER (s.db_type = 'mariadb') END AS n_rows
            FROM scripts s, (VALUES ('dm8'), ('kdb9')) w(wanted) GROUP BY s.service, w.wanted)""",
    "history": f"""
        SELECT event_id AS f_id, 'svc-' || user_id AS f_service_name,
            '1.' || month(ts) || '.' || day(ts) AS f_version,
            '1.' || month(ts) || '.' || day(ts) || '/' || lpad({K}::VARCHAR, 2, '0') || '-' || event_type || '.sql'
                AS f_script_file_name,
            CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS f_status,
            CASE WHEN event_type = 'error' THEN '{{"user": "u1", "Password": "*****"}}' END AS f_message,
            date_trunc('second', ts)::TIMESTAMP AS f_create_time
        FROM events""",
    "latest": """
        SELECT f_service_name, max(f_version) AS f_version, max(f_script_file_name) AS f_script_file_name,
            max(f_create_time) AS f_create_time, max(f_id) AS f_id
        FROM (
            SELECT *, row_number() OVER (PARTITION BY f_service_name ORDER BY f_create_time DESC, f_id DESC) AS place
            FROM history WHERE f_status = 'success')
        WHERE place = 1 GROUP BY f_service_name""",
    "statements": f"""
        SELECT CASE WHEN user_id % 37 = 0 THEN 'oracle' WHEN dialect = 'mariadb' AND user_id % 2 = 0 THEN 'tidb'
                ELSE dialect END AS dialect,
            CASE WHEN event_id % 2 = 0 THEN 'init' ELSE 'update' END AS file_kind,
            'svc-' || user_id AS file_id, event_id::INTEGER AS ord,
            CASE WHEN event_type = 'signup' AND dialect = 'mariadb' THEN 'USE `db_' || k || '`;'
                 WHEN event_type = 'signup' AND dialect = 'dm8' THEN 'SET SCHEMA "db_' || k || '";'
                 WHEN event_type = 'signup' THEN 'set search_path  to db_' || k
                 WHEN event_type = 'view' THEN 'CREATE OR REPLACE VIEW v_' || k || ' AS SELECT 1'
                 WHEN event_type = 'click' AND k < 50 THEN 'CREATE TABLE IF NOT EXISTS t_' || k || ' (f_id INT)'
                 WHEN event_type = 'click' THEN 'ALTER TABLE t_' || k || ' DROP COLUMN IF EXISTS f_x'
                 WHEN event_type = 'purchase' AND k < 30 THEN 'INSERT INTO t_' || k || ' VALUES (1)'
                 WHEN event_type = 'purchase' AND k < 60 THEN 'update t_' || k || ' set f_id = 1'
                 WHEN event_type = 'purchase' AND k < 90 THEN 'DROP DATABASE db_' || k
                 WHEN event_type = 'purchase' THEN ' ; '
                 WHEN k < 50 THEN 'COMMENT ON TABLE t_' || k || ' IS ''x'''
                 ELSE 'RENAME TABLE t_' || k || ' TO t_x' END AS sql,
            CASE WHEN event_type = 'signup' AND user_id % 37 <> 0 THEN 'db_' || k END AS switch_db
        FROM (SELECT *, {K} AS k,
                CASE user_id % 3 WHEN 0 THEN 'mariadb' WHEN 1 THEN 'dm8' ELSE 'kdb9' END AS dialect FROM events)""",
    "words": """
        SELECT *, trim(sql) IN ('', ';') AS is_blank,
            upper(regexp_extract(sql, '^\\s*(\\w+)', 1)) AS verb,
            upper(regexp_replace(regexp_extract(
                sql, '^\\s*\\w+\\s+(OR\\s+\\w+\\s+\\w+|ON\\s+\\w+|UNIQUE\\s+\\w+|\\w+)', 1, 'i'), '\\s+', ' ', 'g')) AS object
        FROM statements""",
    "change_texts": f"""
        SELECT event_id::VARCHAR AS file_id, k, user_id, event_type,
            CASE user_id % 3 WHEN 0 THEN 'mariadb' WHEN 1 THEN 'dm8' ELSE 'kdb9' END AS dialect,
            CASE WHEN event_type = 'signup' AND k < 50 THEN '"VARCHAR(64) DEFAULT ''''"'
                 WHEN event_type = 'signup' THEN '"TEXT NOT NULL default ''x''"' WHEN event_type = 'view' THEN '""'
                 WHEN event_type = 'click' THEN '"f_1"' WHEN event_type = 'purchase' THEN '5' END AS property
        FROM (SELECT *, {K} AS k FROM events)""",
    "definitions": """
        SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'dm8' WHEN '2' THEN 'kdb9' ELSE 'mariadb' END AS dialect,
            'db_' || lower(o_orderstatus) AS db_name,
            CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'T_' ELSE 't_' END || o_orderkey AS table_name,
            'svc-' || o_custkey AS file_id
        FROM orders""",
    "column_facts": """
        SELECT dialect, db_name, table_name, 'f_' || l_linenumber AS column_name, l_linenumber AS ordinal,
            CASE WHEN l_quantity > 40 THEN lower(type_word) ELSE type_word END AS data_type,
            CASE WHEN l_quantity <= 15 THEN NULL WHEN l_quantity <= 30 THEN l_quantity::INTEGER::VARCHAR
                ELSE l_quantity::INTEGER || ' CHAR' END AS type_length,
            CASE WHEN l_discount < 0.03 THEN NULL WHEN l_discount < 0.06 THEN 'null' ELSE '' END AS column_default
        FROM definitions JOIN (
            SELECT *, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'BIGINT' WHEN 'AO' THEN 'VARCHAR' WHEN 'NF' THEN 'TEXT'
                WHEN 'NO' THEN 'CHAR' WHEN 'RF' THEN 'INT' ELSE 'DECIMAL' END AS type_word FROM lineitem
        ) ON l_orderkey = o_orderkey""",
    "table_facts": """
        SELECT dialect, db_name, table_name, file_id,
            CASE WHEN o_totalprice > 250000 THEN ['ENGINE', 'TABLESPACE', 'ENGINE'] ELSE ['ENGINE', 'comment'] END AS option_names
        FROM definitions, generate_series(1, CASE WHEN o_totalprice > 250000 AND o_orderstatus = 'P' THEN 2 ELSE 1 END)""",
    "index_facts": """
        SELECT dialect, db_name,
            CASE WHEN o_totalprice < 20000 THEN 't_absent_' || o_orderkey ELSE table_name END AS table_name,
            i.index_name, i.kind, i.columns
        FROM (
            SELECT *, unnest(list_concat(
                CASE WHEN o_orderstatus <> 'P' THEN [{'index_name': 'PRIMARY', 'kind': 'PRIMARY', 'columns': ['f_1']}] ELSE [] END,
                [{'index_name': CASE WHEN o_orderstatus = 'O' THEN 'uk_' ELSE 'idx_' END || o_orderkey,
                  'kind': CASE o_orderpriority WHEN '2-HIGH' THEN 'UNIQUE' WHEN '5-LOW' THEN 'FOREIGN' ELSE 'INDEX' END,
                  'columns': ['f_' || month(o_orderdate), 'f_2', '10']}])) AS i
            FROM definitions)""",
    "comment_facts": """
        SELECT dialect, db_name,
            CASE WHEN o_totalprice < 20000 THEN 't_absent_' || o_orderkey ELSE table_name END AS table_name,
            CASE WHEN o_orderpriority <> '1-URGENT' THEN 'f_' || month(o_orderdate) END AS column_name,
            CASE WHEN o_totalprice > 450000 THEN ' '''' ' ELSE '''' || o_orderpriority || '''' END AS comment
        FROM definitions""",
    "written_names": """
        SELECT p_partkey, CASE WHEN p_size < 20 THEN 'mariadb' WHEN p_size < 35 THEN 'dm8' ELSE 'kdb9' END AS dialect,
            CASE p_type WHEN 'STANDARD' THEN ' `' || n || '`;' || chr(10) WHEN 'LARGE' THEN '"' || n || '"'
                WHEN 'ECONOMY' THEN 'db.' || n WHEN 'PROMO' THEN n || '(191)' ELSE n END AS written
        FROM (SELECT *, replace(p_name, ' ', '_') || p_partkey AS n FROM part)""",
    "cleaned_names": """
        SELECT *, CASE WHEN dialect = 'dm8' THEN trim(written, ' ";' || chr(10)) ELSE trim(written, ' `;' || chr(10)) END AS name
        FROM written_names""",
    "service_columns": """
        SELECT service, table_name, column_name, number, min(word) AS old_type, max(word) AS new_type, max(l_quantity) AS size
        FROM (
            SELECT 'svc-' || l_suppkey AS service, 't_' || l_partkey AS table_name, 'f_' || l_linenumber AS column_name,
                l_linenumber AS number, l_quantity,
                CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'BIGINT' WHEN 'AO' THEN 'VARCHAR' WHEN 'NF' THEN 'TEXT'
                    WHEN 'NO' THEN 'DATETIME' WHEN 'RF' THEN 'INT' ELSE 'BOOLEAN' END AS word
            FROM lineitem)
        GROUP BY service, table_name, column_name, number""",
    "dialect_columns": """
        SELECT c.*, 'db' AS db_name, d.dialect
        FROM service_columns c, (VALUES ('mariadb'), ('dm8'), ('kdb9')) d(dialect)""",
    "base_facts": """
        SELECT service, dialect, db_name, table_name, column_name, number, old_type AS data_type FROM dialect_columns
        WHERE number <= 5 AND NOT (dialect = 'kdb9' AND number = 1 AND size < 5)""",
    "chains": """
        SELECT *, lead(table_name) OVER (PARTITION BY service ORDER BY number) AS next,
            row_number() OVER (PARTITION BY service ORDER BY number) AS place, string_split(service, '-')[2]::INTEGER % 2 = 1 AS odd
        FROM (SELECT DISTINCT service, table_name, string_split(table_name, '_')[2]::INTEGER AS number
            FROM base_facts WHERE dialect = 'mariadb')""",
    "installed_facts": """
        SELECT service, dialect, db_name, table_name, CASE WHEN number = 5 THEN 'f_five' ELSE column_name END AS column_name,
            CASE WHEN number IN (3, 6, 7) THEN new_type ELSE old_type END AS data_type
        FROM dialect_columns WHERE number <> 4""",
    "service_changes": """
        SELECT service, dialect, db_name, table_name, column_name, number, new_type, size FROM dialect_columns
        WHERE NOT (dialect = 'dm8' AND number = 6 AND size > 45)""",
    # Changes that cannot be made: the second column twice in a step, a rename to nothing, an unknown operation.
    "refused_changes": """
        SELECT service, dialect, db_name, table_name,
            CASE number WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS step,
            CASE number WHEN 7 THEN 'TABLE' ELSE 'COLUMN' END AS object_type,
            CASE number WHEN 7 THEN 'TRUNCATE' WHEN 5 THEN 'RENAME' ELSE 'ADD' END AS operation_type,
            CASE number WHEN 2 THEN column_name ELSE 'f_99' END AS object_name,
            CASE number WHEN 2 THEN 'several_changes_in_a_step' WHEN 5 THEN 'new_name_missing' ELSE 'unknown_change' END AS problem
        FROM dialect_columns, (VALUES (1), (2)) copies(copy)
        WHERE size > 48 AND number IN (2, 5, 7) AND (number = 2 OR copy = 1)""",
    # Step 1: tables with a large fourth column go; column 3 gets its new type, column 4 goes, columns 1, 2
    # and 6 are added where they lack. Step 2: column 5 is renamed, column 7 added to tables that are left.
    "dropped_tables": """
        SELECT DISTINCT service, dialect, table_name FROM service_changes WHERE number = 4 AND size > 40""",
    "step_one": """
        WITH kept AS (
            SELECT b.* FROM base_facts b ANTI JOIN dropped_tables d USING (service, dialect, table_name)),
        tables AS (SELECT DISTINCT service, dialect, table_name FROM kept)
        SELECT k.service, k.dialect, k.db_name, k.table_name, k.column_name,
            CASE WHEN k.number = 3 THEN c.new_type ELSE k.data_type END AS data_type
        FROM kept k JOIN service_changes c USING (service, dialect, table_name, column_name)
        WHERE k.number <> 4
        UNION ALL
        SELECT c.service, c.dialect, c.db_name, c.table_name, c.column_name, c.new_type
        FROM service_changes c SEMI JOIN tables t USING (service, dialect, table_name)
        WHERE c.number IN (1, 2, 6) AND NOT EXISTS (
            SELECT 1 FROM kept k WHERE k.service = c.service AND k.dialect = c.dialect
                AND k.table_name = c.table_name AND k.column_name = c.column_name)""",
    "upgraded": """
        WITH tables AS (SELECT DISTINCT service, dialect, table_name FROM step_one)
        SELECT service, dialect, db_name, table_name,
            CASE WHEN column_name = 'f_5' THEN 'f_five' ELSE column_name END AS column_name, data_type
        FROM step_one
        UNION ALL
        SELECT c.service, c.dialect, c.db_name, c.table_name, c.column_name, c.new_type
        FROM service_changes c SEMI JOIN tables t USING (service, dialect, table_name) WHERE c.number = 7""",
}

# Category of the type words the facts above hold.
_CATEGORY = {
    "mariadb": "CASE WHEN {t} IN ('INT', 'BIGINT', 'BOOLEAN') THEN 'IntegerType' WHEN {t} = 'DECIMAL' THEN 'FixedPointType' "
    "WHEN {t} IN ('CHAR', 'VARCHAR', 'TEXT') THEN 'StringType' WHEN {t} = 'DATETIME' THEN 'DateAndTimeType' ELSE 'UNKNOWN' END",
    "dm8": "CASE WHEN {t} IN ('INT', 'BIGINT') THEN 'IntegerType' WHEN {t} = 'DECIMAL' THEN 'FixedPointType' "
    "WHEN {t} IN ('CHAR', 'VARCHAR', 'TEXT') THEN 'StringType' WHEN {t} = 'DATETIME' THEN 'DateAndTimeType' ELSE 'UNKNOWN' END",
    "kdb9": "CASE WHEN {t} IN ('INT', 'BIGINT') THEN 'IntegerType' WHEN {t} = 'DECIMAL' THEN 'FixedPointType' "
    "WHEN {t} = 'BOOLEAN' THEN 'BooleanType' WHEN {t} IN ('CHAR', 'VARCHAR', 'TEXT') THEN 'StringType' "
    "WHEN {t} = 'DATETIME' THEN 'DateAndTimeType' ELSE 'UNKNOWN' END",
}


def _category(type_name: str, dialect: str) -> str:
    if dialect in _CATEGORY:
        return _CATEGORY[dialect].format(t=type_name)
    cases = " ".join(f"WHEN '{d}' THEN {text.format(t=type_name)}" for d, text in _CATEGORY.items())
    return f"CASE {dialect} {cases} END"


def _schema_diff(base: str, check: str, keys: list[str], check_dialect: str) -> str:
    """Table, column and type differences of two sets of facts within ``keys``."""
    scope = [*keys, "db_name", "table_name"]
    listed, using = ", ".join(scope), f"USING ({', '.join(scope)})"
    with_column = f"USING ({', '.join([*scope, 'column_key'])})"
    base_category = _category("b.data_type", "mariadb")
    check_category = _category("c.data_type", check_dialect)
    return f"""
        WITH b AS (SELECT *, upper(column_name) AS column_key FROM {base}),
        c AS (SELECT *, upper(column_name) AS column_key FROM {check}),
        bt AS (SELECT DISTINCT {listed} FROM b), ct AS (SELECT DISTINCT {listed} FROM c),
        common AS (SELECT * FROM bt SEMI JOIN ct {using})
        SELECT {listed}, {VOID} AS column_name, 'missing_table' AS kind, 'error' AS severity, {VOID} AS detail
        FROM bt ANTI JOIN ct {using}
        UNION ALL SELECT {listed}, NULL, 'extra_table', 'warn', NULL FROM ct ANTI JOIN bt {using}
        UNION ALL SELECT {listed}, column_key, 'only_in_base', 'error', NULL
        FROM (SELECT * FROM b SEMI JOIN common {using}) b ANTI JOIN c {with_column}
        UNION ALL SELECT {listed}, column_key, 'only_in_check', 'error', NULL
        FROM (SELECT * FROM c SEMI JOIN common {using}) c ANTI JOIN b {with_column}
        UNION ALL SELECT {listed}, column_key, 'category_mismatch', 'warn', b.data_type || ' -> ' || c.data_type
        FROM b JOIN c {with_column} WHERE {base_category} <> {check_category}"""


ROLES["dialect_diff"] = _schema_diff(
    "(SELECT u.* REPLACE (d.dialect AS dialect) FROM upgraded u, (VALUES ('dm8'), ('kdb9')) d(dialect) WHERE u.dialect = 'mariadb')",
    "(SELECT * FROM upgraded WHERE dialect <> 'mariadb')",
    ["service", "dialect"],
    "c.dialect",
).replace("c.dialect", "dialect")


def _violation(rule: str, severity: str = "'error'", db: str = VOID, table: str = VOID, obj: str = VOID,
               file: str = VOID, detail: str = VOID, source: str = "") -> str:
    return (
        f"SELECT {rule} AS rule, {severity} AS severity, {db} AS db_name, {table} AS table_name, {obj} AS object_name, "
        f"{file} AS file_id, {detail} AS detail FROM {source}"
    )


_FILE = "service || '/' || db_type || '/' || version"
_IN_TABLE = {"db": "db_name", "table": "table_name"}
_STRICT = "regexp_matches(filename, '^[0-9]{2}-.*\\.(sql|py|json)$')"
_SCRIPT_EXT = "regexp_matches(filename, '\\.(sql|py|json)$')"

VIOLATIONS: dict[str, list[str]] = {
    "layout_report": [
        _violation(
            "r.rule", obj="filename", file=f"{_FILE} || '/' || filename",
            source=f"""scripts, (VALUES ('subdirectory_in_version'), ('unknown_file'), ('bad_script_name')) r(rule)
            WHERE {IS_VERSION} AND CASE r.rule
                WHEN 'subdirectory_in_version' THEN depth > 4
                WHEN 'unknown_file' THEN depth = 4 AND NOT {_SCRIPT_EXT}
                ELSE depth = 4 AND {_SCRIPT_EXT} AND filename <> 'init.sql' AND NOT {_STRICT} END""",
        ),
        _violation(
            "'duplicate_script_number'", obj="seq::VARCHAR", file=_FILE, detail="lo || ', ' || hi",
            source=f"""(SELECT service, db_type, version, {SEQ} AS seq, min(filename) AS lo, max(filename) AS hi
            FROM scripts WHERE {IS_VERSION} AND depth = 4 AND {_STRICT} GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation("'missing_init'", file=_FILE, source="versions WHERE has_init = 0"),
        _violation(
            "'empty_version'", file=_FILE,
            source=f"""(SELECT DISTINCT service, db_type, version FROM order_versions WHERE {IS_VERSION})
            ANTI JOIN versions USING (service, db_type, version)""",
        ),
    ],
    "statement_report": [
        _violation(
            "'first_statement_must_switch'", file="file_id", detail="sql",
            source="""(SELECT *, row_number() OVER (PARTITION BY dialect, file_kind, file_id ORDER BY ord) AS place
            FROM words WHERE NOT is_blank AND dialect <> 'oracle') WHERE place = 1 AND switch_db IS NULL""",
        ),
        _violation(
            "'unsupported_dialect'", file="file_id", detail="dialect",
            source="(SELECT DISTINCT dialect, file_kind, file_id FROM statements WHERE dialect = 'oracle')",
        ),
        _violation(
            "'statement_not_allowed'", obj="verb || ' ' || object", file="file_id", detail="sql",
            source="""words WHERE NOT is_blank AND dialect <> 'oracle' AND NOT CASE
                WHEN switch_db IS NOT NULL THEN true
                WHEN verb = 'CREATE' THEN object IN ('TABLE', 'UNIQUE INDEX', 'INDEX', 'VIEW', 'OR REPLACE VIEW')
                WHEN verb = 'INSERT' THEN true
                WHEN verb = 'COMMENT' THEN dialect = 'dm8' AND object IN ('ON TABLE', 'ON COLUMN')
                WHEN file_kind = 'init' THEN false
                WHEN verb IN ('UPDATE', 'DELETE') THEN true
                WHEN verb = 'DROP' THEN object IN ('INDEX', 'TABLE', 'VIEW')
                WHEN verb = 'ALTER' THEN object = 'TABLE'
                WHEN verb = 'RENAME' THEN dialect IN ('mariadb', 'tidb')
                ELSE false END""",
        ),
    ],
    "change_report": [
        _violation(
            "CASE WHEN k < 50 THEN 'empty_change_list' ELSE 'not_a_json_list' END", file="file_id",
            source="change_texts WHERE event_type = 'error'",
        ),
        _violation(
            "CASE event_type WHEN 'view' THEN 'unknown_object_type' WHEN 'click' THEN 'missing_field:object_comment' "
            "ELSE 'field_not_text:object_property' END",
            db="'db_' || k", table="'t_' || user_id", obj="'f_' || k", file="file_id", detail="'0'",
            source="change_texts WHERE event_type IN ('view', 'click', 'purchase')",
        ),
        _violation(
            "CASE WHEN k < 50 THEN 'varchar_length' ELSE 'default_on_text' END",
            db="'db_' || k", table="'t_' || user_id", obj="'f_' || k",
            detail="CASE WHEN k < 50 THEN 'VARCHAR 64' ELSE 'TEXT' END",
            source="change_texts WHERE event_type = 'signup' AND (k >= 50 OR dialect = 'dm8')",
        ),
    ],
    "duplicate_definitions": [
        _violation(
            "'duplicate_table'", obj="table_name", file="file_id", detail="n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, file_id, count(*) AS n FROM table_facts
            GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation(
            "'duplicate_column'", obj="column_name", detail="n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, column_name, count(*) AS n FROM column_facts
            GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation(
            "'duplicate_index'", obj="index_name", detail="n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, index_name, count(*) AS n FROM index_facts
            WHERE kind IN ('INDEX', 'UNIQUE') GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation(
            "'duplicate_primary_key'", detail="n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, count(*) AS n FROM index_facts
            WHERE kind = 'PRIMARY' GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation(
            "'duplicate_index_column'", obj="column_name", detail="index_name || ', ' || n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, index_name, column_name, count(*) AS n
            FROM (SELECT *, unnest(columns) AS column_name FROM index_facts)
            WHERE NOT regexp_full_match(column_name, '[0-9]+') GROUP BY ALL HAVING count(*) > 1)""",
        ),
        _violation(
            "'duplicate_option'", obj="option", file="file_id", detail="n || ' times'", **_IN_TABLE,
            source="""(SELECT dialect, db_name, table_name, file_id, option, count(*) AS n
            FROM (SELECT *, unnest(option_names) AS option FROM table_facts) GROUP BY ALL HAVING count(*) > 1)""",
        ),
    ],
    "key_rules": [
        _violation(
            "'primary_key_missing'", **_IN_TABLE,
            source="""(SELECT DISTINCT dialect, db_name, table_name FROM table_facts)
            ANTI JOIN (SELECT * FROM index_facts WHERE kind = 'PRIMARY') USING (dialect, db_name, table_name)""",
        ),
        _violation(
            "'foreign_key_present'", "'warn'", **_IN_TABLE,
            source="""(SELECT DISTINCT dialect, db_name, table_name FROM table_facts)
            SEMI JOIN (SELECT * FROM index_facts WHERE kind = 'FOREIGN') USING (dialect, db_name, table_name)""",
        ),
    ],
    "key_column_membership": [
        _violation(
            "'key_column_unknown'", obj="column_name", detail="index_name", **_IN_TABLE,
            source="""(SELECT *, unnest(columns) AS column_name FROM index_facts WHERE kind <> 'FOREIGN')
            ANTI JOIN column_facts USING (dialect, db_name, table_name, column_name)
            WHERE NOT regexp_full_match(column_name, '[0-9]+')""",
        )
    ],
    "index_table_exists": [
        _violation(
            "'index_table_unknown'", obj="index_name", **_IN_TABLE,
            source="index_facts ANTI JOIN table_facts USING (dialect, db_name, table_name)",
        )
    ],
    "comment_rules": [
        _violation(
            "'comment_empty'", obj="column_name", **_IN_TABLE, source="comment_facts WHERE dialect = 'dm8' AND trim(comment, ' ''') = ''",
        ),
        _violation(
            "'comment_table_unknown'", **_IN_TABLE,
            source="""comment_facts ANTI JOIN table_facts USING (dialect, db_name, table_name)
            WHERE dialect = 'dm8' AND column_name IS NULL""",
        ),
        _violation(
            "'comment_column_unknown'", obj="column_name", **_IN_TABLE,
            source="""comment_facts ANTI JOIN column_facts USING (dialect, db_name, table_name, column_name)
            WHERE dialect = 'dm8' AND column_name IS NOT NULL""",
        ),
    ],
    "column_rules": [
        _violation(
            "r.rule", obj="column_name", detail="data_type || coalesce(' ' || type_length, '')", **_IN_TABLE,
            source="""(SELECT * REPLACE (upper(data_type) AS data_type) FROM column_facts), (VALUES ('default_on_text'), ('char_type'), ('varchar_length'), ('integer_length')) r(rule)
            WHERE CASE r.rule
                WHEN 'default_on_text' THEN data_type = 'TEXT' AND upper(column_default) <> 'NULL'
                WHEN 'char_type' THEN dialect = 'dm8' AND data_type = 'CHAR'
                WHEN 'varchar_length' THEN dialect = 'dm8' AND data_type = 'VARCHAR' AND NOT coalesce(type_length LIKE '% CHAR', false)
                ELSE dialect = 'dm8' AND data_type IN ('INT', 'BIGINT') AND type_length IS NOT NULL END""",
        )
    ],
    "text_in_index": [
        _violation(
            "'text_in_index'", obj="column_name", detail="index_name", **_IN_TABLE,
            source="""(SELECT *, unnest(columns) AS column_name FROM index_facts
                WHERE dialect = 'dm8' AND kind IN ('INDEX', 'UNIQUE'))
            SEMI JOIN (SELECT * FROM column_facts WHERE upper(data_type) = 'TEXT')
            USING (dialect, db_name, table_name, column_name)""",
        )
    ],
    "table_option_rule": [
        _violation(
            "'table_option'", obj="option", file="file_id", **_IN_TABLE,
            source="""(SELECT *, unnest(list_distinct(option_names)) AS option FROM table_facts)
            WHERE dialect <> 'mariadb' OR upper(option) NOT IN ('ENGINE', 'COMMENT')""",
        )
    ],
    "naming_rules": [
        _violation(
            "'table_name'", "'warn'", obj="table_name", **_IN_TABLE,
            source="table_facts WHERE NOT regexp_full_match(table_name, 't_[a-z0-9_]{1,62}')",
        ),
        _violation(
            "'index_name'", "'warn'", obj="index_name", **_IN_TABLE,
            source="""index_facts WHERE CASE kind WHEN 'INDEX' THEN NOT regexp_full_match(index_name, 'idx_[a-z0-9_]{1,60}')
            WHEN 'UNIQUE' THEN NOT regexp_full_match(index_name, 'uk_[a-z0-9_]{1,61}') ELSE false END""",
        ),
    ],
    "verify_report": [
        _violation(
            "CASE WHEN n > 0 THEN 'not_after_upgrade' ELSE 'not_after_install' END", obj="column_name",
            file="service || '/' || dialect", detail="data_type", **_IN_TABLE,
            source="""(SELECT service, dialect, db_name, table_name, column_name, data_type, sum(side) AS n FROM (
                SELECT service, dialect, db_name, table_name, column_name, data_type, 1 AS side FROM installed_facts
                UNION ALL SELECT service, dialect, db_name, table_name, column_name, data_type, -1 FROM upgraded)
            GROUP BY ALL HAVING sum(side) <> 0)""",
        ),
        _violation(
            "kind", "severity", obj="column_name", file="service || '/' || dialect", detail="detail", **_IN_TABLE,
            source="dialect_diff",
        ),
        _violation(
            "problem", obj="object_name", file="service || '/' || dialect", detail="operation_type || ' ' || object_type",
            source="refused_changes", **_IN_TABLE,
        ),
    ],
}
VIOLATIONS["lint_report"] = [
    part
    for name in (
        "layout_report", "statement_report", "change_report", "duplicate_definitions", "key_rules",
        "key_column_membership", "index_table_exists", "comment_rules", "column_rules", "text_in_index",
        "table_option_rule", "naming_rules",
    )
    for part in VIOLATIONS[name]
]


def _union(name: str) -> str:
    return "\nUNION ALL ".join(VIOLATIONS[name])


_VERDICT = """SELECT {key} AS {name}, sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_errors,
    sum(CASE WHEN severity = 'error' THEN 0 ELSE 1 END)::BIGINT AS n_warnings,
    bool_or(severity = 'error') AS has_error FROM ({report}) GROUP BY 1"""

SELECTS: dict[str, str] = {
    "migration_plan": "SELECT * FROM plan",
    "plan_problems": """SELECT service, ordinal, db_type,
            CASE route WHEN 'upgrade' THEN 'installed_version_unreadable' ELSE 'install_script_missing' END AS problem,
            installed_version, target_version
        FROM state WHERE CASE route WHEN 'upgrade' THEN installed_vk IS NULL ELSE NOT can_install END""",
    "execution_order": f"""SELECT service, db_type, version, filename, {SEQ} AS seq FROM scripts
        WHERE {IS_VERSION} AND depth = 4 AND {IS_SCRIPT}""",
    "pending_scripts": "SELECT service, db_type, version, filename, seq, ordinal, installed_version, target_version FROM pending",
    "resume_skip": "SELECT service, live_version AS version, live_seq FROM live",
    "service_state": "SELECT * EXCLUDE (installed_vk) FROM state",
    "has_work": "SELECT service, count(p.filename) AS n_scripts FROM services LEFT JOIN plan p USING (service) GROUP BY service",
    "version_index": "SELECT * EXCLUDE (vk) FROM versions",
    "version_names": f"""SELECT service, count(*) FILTER ({IS_VERSION}) AS n_versions,
        count(*) FILTER (NOT {IS_VERSION}) AS n_others FROM order_versions GROUP BY service""",
    "version_extremes": """SELECT service, arg_min(version, (vk, version)) AS min_version,
        arg_max(version, (vk, version)) AS max_version, count(*) AS n_versions FROM distinct_versions GROUP BY service""",
    "version_compare": f"""SELECT o_orderkey, l_linenumber, version, previous_version,
        CASE WHEN a < b THEN '-1' WHEN a > b THEN '1' WHEN a = b THEN '0' END AS comparison
        FROM (SELECT *, {_vk('version')} AS a, {_vk('previous_version')} AS b FROM (
            SELECT o_orderkey, l_linenumber, version,
                year(l_shipdate) || '.' || month(l_shipdate) || '.0' AS previous_version
            FROM order_versions JOIN lineitem ON l_orderkey = o_orderkey))""",
    "version_order": "SELECT service, version, array_to_string(vk, '.') AS normal_version FROM distinct_versions",
    "versions_from": "SELECT service, version FROM distinct_versions WHERE vk >= [1998, 6]::BIGINT[]",
    "latest_n_versions": """SELECT * FROM (SELECT service, version,
        row_number() OVER (PARTITION BY service ORDER BY vk DESC, version DESC)::INTEGER AS recency FROM distinct_versions)
        WHERE recency <= 2""",
    "checked_versions": """SELECT service, db_type, version FROM (SELECT *,
        row_number() OVER (PARTITION BY service, db_type ORDER BY vk DESC, version DESC) AS place
        FROM versions WHERE vk >= [1998, 6]::BIGINT[]) WHERE place = 1""",
    "script_names": f"""SELECT service, version || '/' || filename AS relative_name, coalesce({SEQ}, -1)::DECIMAL(38,0) AS seq,
        regexp_extract(filename, '(\\.[^.]*)$', 1) AS extension, {IS_SCRIPT} AS is_script,
        regexp_matches(filename, '^[0-9]{{2}}-.*\\.(sql|py|json)$') AS is_strict FROM scripts""",
    "service_filter": "SELECT * FROM services WHERE service IN ('svc-1', 'svc-2', 'svc-30', 'svc-absent')",
    "existing_services": """SELECT *, EXISTS (SELECT 1 FROM order_versions v
        WHERE v.service = services.service AND v.o_orderstatus = 'F') AS has_scripts FROM services""",
    "install_script": """SELECT service, db_type, version, 'init.sql' AS filename FROM (SELECT *,
        row_number() OVER (PARTITION BY service, db_type ORDER BY vk DESC, version DESC) AS place FROM versions)
        WHERE place = 1 AND has_init = 1""",
    "source_choice": "SELECT service, wanted, db_type, n_rows FROM choices",
    "select_sources": """SELECT s.*, s.db_type AS wanted FROM scripts s
        UNION ALL SELECT s.*, w.wanted FROM scripts s, (VALUES ('dm8'), ('kdb9')) w(wanted)
        WHERE s.db_type = 'mariadb' AND NOT EXISTS (
            SELECT 1 FROM scripts o WHERE o.service = s.service AND o.db_type = w.wanted)""",
    "missing_sources": """SELECT s.service, w.wanted
        FROM (SELECT DISTINCT service FROM scripts WHERE db_type <> 'mariadb') s, (VALUES ('dm8'), ('kdb9')) w(wanted)
        WHERE NOT EXISTS (SELECT 1 FROM scripts o WHERE o.service = s.service AND o.db_type = w.wanted)""",
    "document_sources": """WITH d AS (SELECT source AS service, lang AS db_type, doc_id, n_chars FROM documents)
        SELECT *, db_type AS wanted FROM d WHERE db_type IN ('fr', 'de')
        UNION ALL SELECT d.*, w.wanted FROM d, (VALUES ('fr'), ('de')) w(wanted)
        WHERE d.db_type = 'en' AND NOT EXISTS (SELECT 1 FROM d o WHERE o.service = d.service AND o.db_type = w.wanted)""",
    "replay_roles": """SELECT service, version, lo = 1 AS is_base, lo <> 1 AS is_step, hi = 1 AS is_fresh_install FROM (
        SELECT *, row_number() OVER (PARTITION BY service ORDER BY vk, version) AS lo,
            row_number() OVER (PARTITION BY service ORDER BY vk DESC, version DESC) AS hi FROM distinct_versions)""",
    "version_completion": f"""SELECT service, db_type, version, arg_max(filename, (seq, filename)) AS last_script,
        count(*) AS n_scripts
        FROM (SELECT *, {SEQ} AS seq FROM scripts WHERE {IS_VERSION} AND depth = 4 AND {IS_SCRIPT})
        GROUP BY service, db_type, version""",
    "task_lookup": """SELECT s.service, s.ordinal, t.f_installed_version, t.f_script_file_name
        FROM services s LEFT JOIN task t ON t.f_service_name = s.service""",
    "history": "SELECT * FROM history",
    "history_append": "SELECT * FROM history",
    "ledger_latest": "SELECT * FROM latest",
    "fail_fast_prefix": """SELECT service, ts, event_id, status FROM (
        SELECT f_service_name AS service, f_create_time AS ts, f_id AS event_id, f_status AS status,
            max(CASE WHEN f_status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY f_service_name
                ORDER BY f_create_time, f_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed_before
        FROM history) WHERE coalesce(failed_before, 0) = 0""",
    "fail_fast_services": """SELECT event_id, user_id, event_type, value FROM events WHERE coalesce(user_id <= (
        SELECT min(user_id) FROM events WHERE event_type = 'error' AND value > 495), true)""",
    "rename_keys": """SELECT CASE f_service_name WHEN 'svc-1' THEN 'svc-first' WHEN 'svc-2' THEN 'svc-3'
        WHEN 'svc-one' THEN 'svc-first' ELSE f_service_name END AS f_service_name, f_installed_version FROM task""",
    "rename_collisions": """SELECT CASE f_service_name WHEN 'svc-1' THEN 'svc-first' WHEN 'svc-2' THEN 'svc-3'
        WHEN 'svc-one' THEN 'svc-first' ELSE f_service_name END AS f_service_name, count(*) AS n_rows
        FROM task GROUP BY 1 HAVING count(*) > 1""",
    "ledger_apply": """SELECT coalesce(t.f_service_name, d.f_service_name) AS f_service_name,
            coalesce(d.closed, t.f_installed_version, '') AS f_installed_version,
            coalesce(CASE WHEN d.closed IS NOT NULL THEN '9.9.9' END, t.f_target_version, '') AS f_target_version,
            coalesce(d.script, t.f_script_file_name, '') AS f_script_file_name,
            coalesce(t.f_create_time, d.first_ts) AS f_create_time, coalesce(d.last_ts, t.f_update_time) AS f_update_time
        FROM task t FULL JOIN (
            SELECT f_service_name, arg_max(f_script_file_name, (f_create_time, f_id)) AS script,
                arg_max(f_version, (f_create_time, f_id)) FILTER (f_script_file_name LIKE '%-purchase.sql') AS closed,
                min(f_create_time) AS first_ts, max(f_create_time) AS last_ts
            FROM history WHERE f_status = 'success' GROUP BY f_service_name) d ON d.f_service_name = t.f_service_name""",
    "ledger_stream": "SELECT * FROM latest",
    "mask_secrets": """SELECT id, regexp_replace(t, '("|'')(password|sentinelPassword)("|''):([ ]*)("|'')([^"'']*)("|'')',
            '\\1\\2\\3:\\4\\5*****\\7', 'gi') AS masked
        FROM (
            SELECT 'event-' || event_id AS id, props || ', {''PASSWORD'':  ''x' || trunc(value)::INTEGER ||
                ''', "sentinelPassword":"' || event_type || '", "user": "u"}' AS t FROM events
            UNION ALL SELECT 'document-' || doc_id, '{"password": "' || source || '"} ' || text FROM documents)""",
    "json_extract": """SELECT event_id, json_extract_string(props, '$.k') AS k,
        concat_ws(',', json_extract_string(props, '$.k'), json_extract_string(props, '$.absent')) AS "both" FROM events""",
    "text_to_bytes": """SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes, md5(text) AS digest FROM documents""",
    "event_time_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text FROM events",
    "identifiers": """SELECT p_partkey, name,
        CASE WHEN dialect = 'dm8' THEN trim(string_split(written, '(')[1], ' "' || chr(10))
             ELSE trim(string_split(written, '(')[1], ' `' || chr(10)) END AS column_name,
        string_split(written, '.')[-1] AS object_name,
        CASE WHEN dialect = 'dm8' THEN regexp_matches(name, '[.`'']') ELSE regexp_matches(name, '[."'']') END AS is_illegal
        FROM cleaned_names""",
    "type_parts": f"""SELECT table_name, column_name,
        data_type || coalesce('(' || type_length || ')', '') ||
            CASE WHEN column_default IS NULL THEN ' unsigned NOT NULL' ELSE ' NOT NULL' END AS written,
        type_length AS length, column_default IS NULL AS is_unsigned, {_category('upper(data_type)', 'dialect')} AS category
        FROM column_facts""",
    "statement_parts": """SELECT file_id, ord, is_blank, verb, object, switch_db AS database,
        trim(regexp_replace(sql, '\\bIF\\s+(NOT\\s+)?EXISTS\\b', '', 'gi')) AS bare_sql FROM words""",
    "current_database": """SELECT file_id, ord, last_value(switch_db IGNORE NULLS) OVER (PARTITION BY dialect, file_id
        ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_db FROM statements""",
    "statement_report": _union("statement_report"),
    "change_items": f"""SELECT file_id, 0 AS ord, 'db_' || k AS db_name, 't_' || user_id AS table_name,
        CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'INDEX' ELSE 'COLUMN' END AS object_type,
        'ADD' AS operation_type, 'f_' || k AS object_name, trim(property, '"') AS object_property,
        CASE WHEN event_type <> 'click' THEN '' END AS object_comment, {VOID} AS new_name
        FROM change_texts WHERE event_type <> 'error'""",
    "change_report": _union("change_report"),
    "duplicate_numbers": f"""SELECT service, db_type, version, {SEQ} AS seq, count(*) AS n_files,
        min(filename) AS first_file, max(filename) AS last_file
        FROM scripts WHERE {IS_VERSION} AND depth = 4 AND {_STRICT}
        GROUP BY service, db_type, version, {SEQ} HAVING count(*) > 1""",
    "layout_report": _union("layout_report"),
    "identifier_rule": _violation(
        "'illegal_character'", obj="written", detail="dialect",
        source="""cleaned_names WHERE CASE WHEN dialect = 'dm8' THEN regexp_matches(name, '[.`'']')
        ELSE regexp_matches(name, '[."'']') END""",
    ),
    "evolve_orders": """SELECT o_orderkey, o_custkey, trunc(o_totalprice)::BIGINT AS o_totalprice, o_orderdate,
        o_orderpriority AS o_priority, 'web' AS o_channel FROM orders""",
    "lossy_casts": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        WHERE NOT (trunc(l_extendedprice) BETWEEN -32768 AND 32767 AND trunc(l_extendedprice) = l_extendedprice)""",
    "lossy_lengths": "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 14",
    "modify_column": """SELECT l_orderkey, CASE WHEN l_partkey BETWEEN -128 AND 127 THEN l_partkey END::VARCHAR AS l_partkey,
        l_linenumber::BIGINT AS l_linenumber, l_suppkey FROM lineitem""",
    "apply_update": """SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
        o_orderdate,
        CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "apply_delete": """SELECT * FROM orders WHERE NOT coalesce(
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 250000 END, false)""",
    "apply_insert": """SELECT * FROM orders UNION ALL
        SELECT -c_custkey - 1, c_custkey, 'N', 0, NULL, NULL FROM customer""",
    "user_step": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
            lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_label, p_brand, p_type, p_size FROM part""",
    "change_problems": "SELECT * FROM refused_changes",
    "replay_facts": "SELECT service, dialect, db_name, table_name, column_name, data_type FROM upgraded",
    "rename_chains": """SELECT f.service, f.db_name, f.column_name, f.data_type,
            CASE WHEN odd AND place = 2 THEN 't_first' WHEN odd THEN f.table_name WHEN place = 1 THEN 't_first'
                 ELSE coalesce(next, 't_free') END AS table_name
        FROM base_facts f JOIN chains USING (service, table_name) WHERE dialect = 'mariadb'""",
    "rename_problems": """SELECT service, table_name, 1::INTEGER AS step, next AS new_name, 'new_name_taken' AS problem
        FROM chains WHERE odd AND next IS NOT NULL""",
    "create_and_drop_tables": """WITH kept AS (
            SELECT db_name, lower(table_name) AS table_name, column_name, data_type FROM column_facts
            WHERE dialect = 'mariadb' AND (table_name LIKE 'T\\_%' ESCAPE '\\' OR table_name NOT LIKE '%7')
                AND NOT (table_name LIKE 'T\\_%7' ESCAPE '\\' AND false)),
        created AS (
            SELECT db_name, table_name, column_name, data_type FROM column_facts WHERE dialect <> 'kdb9')
        SELECT * FROM kept WHERE db_name <> 'db_f' UNION ALL
        SELECT * FROM created c ANTI JOIN kept k USING (db_name, table_name) WHERE db_name <> 'db_f'""",
    "upgrade_equals_install": """SELECT o_orderkey, o_custkey, trunc(o_totalprice)::BIGINT AS o_totalprice, o_orderdate,
        o_orderpriority AS o_priority, 'web' AS o_channel, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM orders WHERE false""",
    "row_difference": """SELECT l_suppkey, l_quantity, greatest(n, 0)::BIGINT AS n_missing, greatest(-n, 0)::BIGINT AS n_extra
        FROM (SELECT l_suppkey, l_quantity, sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END) AS n
            FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) WHERE n <> 0""",
    "name_difference": """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
        EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "key_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows, 'duplicate' AS reason
        FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "null_key_violations": """SELECT owner, placed, count(*) AS n_rows,
        CASE WHEN owner IS NULL OR placed IS NULL THEN 'null' ELSE 'duplicate' END AS reason
        FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END AS owner, year(o_orderdate)::INTEGER AS placed FROM orders)
        GROUP BY owner, placed HAVING count(*) > 1 OR owner IS NULL OR placed IS NULL""",
    "orphans": """SELECT l_partkey, count(*) AS n_rows FROM lineitem
        WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey""",
    "appended_keys": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
        CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null' ELSE 'duplicate' END AS reason
        FROM (SELECT l_orderkey, CASE WHEN l_discount < 0.1 THEN l_linenumber END AS l_linenumber FROM lineitem)
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "appended_orphans": """SELECT l_partkey, count(*) AS n_rows FROM lineitem
        WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey""",
    "batch_steps": """SELECT * EXCLUDE (p_name, p_size, p_retailprice), p_name AS p_label,
        list_aggregate(list_transform(regexp_extract_all(p_name, '\\S+'), lambda w: left(w, 1)), 'string_agg', '') AS p_initials,
        (p_size // 10)::VARCHAR AS p_class FROM part""",
    "partition_update": """SELECT * EXCLUDE (dear) REPLACE (
            CASE WHEN dear THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
            CASE WHEN dear THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
        FROM (SELECT *, year(o_orderdate)::INTEGER AS placed, year(o_orderdate) IN (1996, 1998) AND o_totalprice > 100000 AS dear FROM orders)""",
    "partition_delete": """SELECT *, year(o_orderdate)::INTEGER AS placed FROM orders
        WHERE NOT (placed = 1995 OR (placed = 1997 AND o_orderstatus <> 'F'))""",
    "constraint_violations": """SELECT o_custkey, count(*) AS n_rows FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY o_custkey""",
    "check_violations": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE NOT (l_quantity < 45 OR l_discount > 0.05)""",
    "schema_diff": _schema_diff(
        "(SELECT * FROM base_facts WHERE dialect = 'mariadb')", "(SELECT * FROM installed_facts WHERE dialect = 'kdb9')",
        ["service"], "kdb9",
    ),
    "table_diff": f"""WITH b AS (SELECT DISTINCT service, db_name, table_name FROM base_facts WHERE dialect = 'mariadb'),
        c AS (SELECT DISTINCT service, db_name, table_name FROM base_facts WHERE dialect = 'kdb9')
        SELECT *, {VOID} AS column_name, 'missing_table' AS kind, 'error' AS severity, {VOID} AS detail
        FROM b ANTI JOIN c USING (service, db_name, table_name)
        UNION ALL SELECT *, NULL, 'extra_table', 'warn', NULL FROM c ANTI JOIN b USING (service, db_name, table_name)""",
    "existing_columns": """SELECT c.service, c.dialect, c.db_name, c.table_name, upper(c.column_name) AS column_name,
        b.is_present IS NOT NULL AS is_present FROM service_changes c LEFT JOIN (
            SELECT DISTINCT service, dialect, table_name, column_name, true AS is_present FROM base_facts) b
        ON b.service = c.service AND b.dialect = c.dialect AND b.table_name = c.table_name AND b.column_name = c.column_name""",
    "existing_tables": """SELECT c.service, c.dialect, c.db_name, c.table_name, b.is_present IS NOT NULL AS is_present, count(*) AS n_changes
        FROM service_changes c LEFT JOIN (SELECT DISTINCT service, dialect, table_name, true AS is_present FROM base_facts) b
        ON b.service = c.service AND b.dialect = c.dialect AND b.table_name = c.table_name GROUP BY 1, 2, 3, 4, 5""",
    "existing_constraints": """SELECT dialect, db_name, table_name, 'UK_' || o_orderkey AS index_name,
            o_orderstatus = 'O' AND o_totalprice >= 20000 AS is_present FROM definitions""",
    "existing_databases": """SELECT upper(db_name) AS db_name, db_name IN (
            SELECT db_name FROM column_facts WHERE db_name <> 'db_p') AS is_present, count(*) AS n_tables
        FROM table_facts GROUP BY 1, 2""",
    "verify_report": _union("verify_report"),
    "verify_verdict": f"""SELECT service, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings,
            coalesce(has_error, false) AS has_error
        FROM (SELECT 'svc-' || s_suppkey AS service FROM supplier) FULL JOIN (
            {_VERDICT.format(key="string_split(file_id, '/')[1]", name="service", report=_union("verify_report"))}) USING (service)""",
    "lint_report": _union("lint_report"),
    "lint_verdict": _VERDICT.format(key="rule", name="rule", report=_union("lint_report")),
}
SELECTS["task_stream"] = SELECTS["ledger_apply"]
ROLES["script_files"] = """SELECT 'svc-' || l_suppkey AS service, CASE WHEN part % 3 = 0 THEN 'dm8' ELSE 'mariadb' END AS db_type,
        CASE WHEN part % 7 = 0 THEN 'latest' ELSE '1.' || number END AS version,
        CASE WHEN number = 1 THEN 'init.sql' WHEN size % 5 = 0 THEN '0' || number || '-deep.sql'
             WHEN number = 4 THEN '04-change ' || part || '.json' ELSE '0' || number || '-rows.sql' END AS filename,
        CASE WHEN number <> 1 AND size % 5 = 0 THEN 5 ELSE 4 END::INTEGER AS depth, n, size, part,
        'USE db;' || chr(10) || 'INSERT INTO t_' || part || ' VALUES (' || n || ');' || chr(10) AS text
    FROM (SELECT l_suppkey, l_linenumber AS number, count(*) AS n, trunc(max(l_quantity))::INTEGER AS size, min(l_partkey) AS part
        FROM lineitem GROUP BY ALL)"""
SELECTS["scan_scripts"] = "SELECT service, db_type, version, filename, depth FROM script_files WHERE version <> 'latest'"
SELECTS["scan_script_text"] = "SELECT service, db_type, version, filename, depth, text FROM script_files WHERE filename LIKE '%.sql'"
SELECTS["scan_change_lists"] = f"""SELECT service || '/' || db_type || '/' || version || '/' || filename AS file_id, ord::INTEGER AS ord,
        CASE ord WHEN 0 THEN 'db' END AS db_name, CASE ord WHEN 0 THEN 'f_' || n END AS object_name, CASE ord WHEN 1 THEN 'f_' || size END AS new_name
    FROM script_files, (VALUES (0), (1)) o(ord) WHERE filename LIKE '%.json'"""
SELECTS["stored_facts"] = """SELECT table_name, column_name, (ordinal_position - 1)::INTEGER AS ordinal,
        CASE data_type WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'DATETIME' ELSE data_type END AS data_type, true AS is_nullable
    FROM information_schema.columns WHERE data_type NOT LIKE '%[]' AND table_name IN ('region', 'nation', 'customer', 'supplier', 'part',
        'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')"""
SELECTS["lossy_short_lengths"] = "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 9"
SELECTS["install_differences"] = f"""WITH u AS ({SELECTS["evolve_orders"]}),
        i AS (SELECT * REPLACE (CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
            FROM u WHERE o_orderkey % 1500 <> 3)
    SELECT * EXCLUDE (side), greatest(sum(side), 0)::BIGINT AS n_missing, greatest(-sum(side), 0)::BIGINT AS n_extra
    FROM (SELECT *, 1 AS side FROM i UNION ALL SELECT *, 1 FROM i WHERE o_orderkey % 2000 = 5 UNION ALL SELECT *, -1 FROM u)
    GROUP BY ALL HAVING sum(side) <> 0"""
# The same facts, with those of mariadb where a service has no scripts of a dialect.
ROLES["sources"] = """SELECT s.service, d.dialect,
        CASE WHEN d.dialect = 'kdb9' AND string_split(s.service, '-')[2]::INTEGER % 3 = 0 THEN 'mariadb' ELSE d.dialect END AS source
    FROM (SELECT DISTINCT service FROM base_facts) s, (VALUES ('mariadb'), ('dm8'), ('kdb9')) d(dialect)"""
for _name in ("upgraded", "installed_facts"):
    ROLES[f"chosen_{_name}"] = f"""SELECT u.* REPLACE (s.dialect AS dialect) FROM {_name} u
        JOIN sources s ON s.service = u.service AND s.source = u.dialect"""
ROLES["chosen_diff"] = ROLES["dialect_diff"].replace("upgraded", "chosen_upgraded")
VIOLATIONS["verify_versions"] = [
    part.replace("upgraded", "chosen_upgraded").replace("not_after_chosen_upgraded", "not_after_upgrade")
    .replace("installed_facts", "chosen_installed_facts").replace("dialect_diff", "chosen_diff")
    for part in VIOLATIONS["verify_report"][:2]
]
# Scripts of the latest version of each tree from 1998.6 on.
ROLES["latest_versions"] = """SELECT * EXCLUDE (place) FROM (SELECT *,
        row_number() OVER (PARTITION BY service, db_type ORDER BY vk DESC, version DESC) AS place
        FROM versions WHERE vk >= [1998, 6]::BIGINT[]) WHERE place = 1"""
ROLES["latest_scripts"] = "SELECT s.* FROM scripts s SEMI JOIN latest_versions v USING (service, db_type, version)"
VIOLATIONS["checked_layout"] = [
    part.replace("FROM scripts", "FROM latest_scripts").replace("FROM versions", "FROM latest_versions") for part in VIOLATIONS["layout_report"][:3]
]
SELECTS["service_verdict"] = f"""SELECT service, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings,
        coalesce(has_error, false) AS has_error
    FROM (SELECT DISTINCT service FROM services) FULL JOIN (
        {_VERDICT.format(key="string_split(file_id, '/')[1]", name="service", report=_union("checked_layout") + " UNION ALL " + _union("statement_report"))}) USING (service)"""
SELECTS["execution_number"] = f"""SELECT service, db_type, version, filename,
        row_number() OVER (ORDER BY service, db_type, {_vk('version')}, version, {SEQ}, filename) AS number
    FROM scripts WHERE {IS_VERSION} AND depth = 4 AND {IS_SCRIPT}"""
for _name in VIOLATIONS:
    SELECTS.setdefault(_name, _union(_name))


def _needed(sql: str, found: list[str]) -> list[str]:
    """Roles that ``sql`` uses, each after the ones it uses itself."""
    for name, body in ROLES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def _complete(sql: str) -> str:
    parts = [f"{name} AS ({ROLES[name]})" for name in _needed(sql, [])]
    return f"WITH {', '.join(parts)}\nSELECT * FROM ({sql})" if parts else sql


ORACLE_SQL: dict[str, str] = {name: _complete(sql) for name, sql in SELECTS.items()}
