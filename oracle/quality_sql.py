"""Oracle SQL for the data-quality queries, generated from the declared rules.

The rules (NOT NULL, allowed values, fit, soft keys, minimum counts) come
from ``ledgermart.sources.schemas``; the columns of each fixture view from
``ledgermart.sources.testviews.VIEW_COLUMNS``.  The SQL is written
independently of the Spark code path: plain per-rule scans and joins.
"""

from __future__ import annotations

from ledgermart.sources import schemas as S
from ledgermart.sources.testviews import VIEW_COLUMNS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules(table: str):
    present = set(VIEW_COLUMNS.get(table, []))
    for c in S.columns(table):
        if c.name not in present:
            continue
        if not c.nullable:
            yield c.name, "not_null", f"{c.name} is null"
        if c.domain:
            vals = ", ".join(_q(v) for v in c.domain)
            yield c.name, "domain", f"coalesce(cast({c.name} as varchar) not in ({vals}), false)"
        if c.max_len:
            yield c.name, "fit", f"coalesce(length(cast({c.name} as varchar)) > {c.max_len}, false)"
        elif c.dtype.startswith("decimal") or c.dtype in ("smallint", "int", "bigint"):
            yield c.name, "fit", f"({c.name} is not null and try_cast({c.name} as {c.dtype}) is null)"


def quality_profile_sql() -> str:
    parts = []
    for t in S.TABLES:
        if t not in VIEW_COLUMNS:
            continue
        for col, rule, pred in _rules(t):
            parts.append(f"select {_q(t)} as table_name, {_q(col)} as column_name, {_q(rule)} as rule, "
                         f"cast(count(case when {pred} then 1 end) as bigint) as failing_rows from {t}")
    return "\nunion all\n".join(parts)


def soft_key_sql() -> str:
    parts = []
    for t, fk, dim, pk in S.soft_foreign_keys():
        if t in VIEW_COLUMNS and dim in VIEW_COLUMNS and fk in VIEW_COLUMNS[t] and pk in VIEW_COLUMNS[dim]:
            parts.append(
                f"select {_q(t)} as table_name, {_q(fk)} as fk_column, {_q(dim)} as dim_table, "
                f"cast(coalesce(sum(case when f.{fk} is not null and d.__pk is null then 1 else 0 end), 0) as bigint) as orphan_rows, "
                f"cast(coalesce(sum(case when f.{fk} is null then 1 else 0 end), 0) as bigint) as null_fk_rows "
                f"from {t} f left join (select distinct {pk} as __pk from {dim}) d on d.__pk = f.{fk}")
    return "\nunion all\n".join(parts)


def soft_key_coverage_sql() -> str:
    rows = ", ".join(f"({_q(t)}, {_q(fk)}, {_q(dim)})" for t, fk, dim, _ in S.soft_foreign_keys())
    return (f"select l.t as table_name, l.fk as fk_column, l.d as dim_table, case when k.orphan_rows is null then 'skipped' "
            f"when k.orphan_rows > 0 then 'orphans' else 'ok' end as status, k.orphan_rows, k.null_fk_rows "
            f"from (values {rows}) l(t, fk, d) left join ({soft_key_sql()}) k on k.table_name = l.t and k.fk_column = l.fk")


def row_count_sql() -> str:
    parts = []
    for t, m in S.ROW_MINIMUMS.items():
        if t in VIEW_COLUMNS:
            parts.append(f"select {_q(t)} as table_name, count(*) as actual_rows, cast({m} as bigint) as expected_min, "
                         f"case when count(*) >= {m} then 'OK' else 'LOW' end as status from {t}")
        else:
            parts.append(f"select {_q(t)} as table_name, cast(null as bigint) as actual_rows, "
                         f"cast({m} as bigint) as expected_min, 'ERROR' as status")
    return "\nunion all\n".join(parts)


def unique_sql() -> str:
    parts = []
    for t, key in S.UNIQUE_KEYS.items():
        if t in VIEW_COLUMNS and key in VIEW_COLUMNS[t]:
            parts.append(
                f"select 'unique' as rule, {_q(t)} as table_name, {_q(key)} as subject, "
                f"cast(coalesce(sum(cnt), 0) as bigint) as failing_rows from "
                f"(select {key}, count(*) as cnt from {t} where {key} is not null group by {key} having count(*) > 1) u")
    return "\nunion all\n".join(parts)


def suite_sql() -> str:
    parts = [
        f"select rule, table_name, column_name as subject, failing_rows from ({quality_profile_sql()}) p",
        f"select 'foreign_key' as rule, table_name, fk_column || '->' || dim_table as subject, orphan_rows as failing_rows from ({soft_key_sql()}) k",
        f"select 'row_count' as rule, table_name, '*' as subject, cast(case when status = 'OK' then 0 else 1 end as bigint) as failing_rows from ({row_count_sql()}) r",
    ]
    u = unique_sql()
    if u:
        parts.append(u)
    body = "\nunion all\n".join(parts)
    return f"select *, failing_rows = 0 as passed from ({body}) s"


def split_valid_sql() -> str:
    parts = []
    for t in S.TABLES:
        if t not in VIEW_COLUMNS:
            continue
        preds = [p for _, _, p in _rules(t)]
        bad = " or ".join(f"({p})" for p in preds) if preds else "false"
        parts.append(f"select {_q(t)} as table_name, "
                     f"cast(count(case when not ({bad}) then 1 end) as bigint) as good_rows, "
                     f"cast(count(case when {bad} then 1 end) as bigint) as rejected_rows from {t}")
    return "\nunion all\n".join(parts)


QUALITY = {
    "row_count_check": row_count_sql(),
    "quality_profile": quality_profile_sql(),
    "soft_key_suite": soft_key_sql(),
    "quality_suite": suite_sql(),
    "soft_key_coverage": soft_key_coverage_sql(),
    "split_valid_counts": split_valid_sql(),
    "unique_currency_code": "select currency_code, count(*) as cnt from dim_currency where currency_code is not null "
                            "group by currency_code having count(*) > 1",
    "rate_fanout_check": "select from_currency_code, to_currency_code, rate_type, count(*) as cnt from exchange_rate "
                         "where valid_to_datetime is null group by from_currency_code, to_currency_code, rate_type "
                         "having count(*) > 1",
}
