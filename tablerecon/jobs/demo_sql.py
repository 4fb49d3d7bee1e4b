"""DuckDB SQL of the demonstration queries, and the feed and target that both engines share."""

from __future__ import annotations

#: feed with seeded defects; {date} is the engine's ISO date text of o_orderdate
FEED_SQL = """
select case when k % 73 = 17 then cast(k - 1 as string) when k % 67 = 9 then concat('abc', cast(k as string)) else cast(k as string) end as o_orderkey,
 cast(o_custkey as string) as o_custkey,
 case when k % 83 = 11 then 'Z' else o_orderstatus end as o_orderstatus,
 case when k % 89 = 7 then '-1.00' else cast(cast(o_totalprice as decimal(18,2)) as string) end as o_totalprice,
 case when k % 79 = 13 then 'not-a-date' else {date} end as o_orderdate,
 case when k % 97 = 5 then '' when k % 71 = 3 then concat('  ', o_orderpriority, '  ') else o_orderpriority end as o_orderpriority,
 k as seq
from (select *, o_orderkey as k from orders) t"""
#: the same feed without defects
CLEAN_SQL = """
select cast(o_orderkey as string) as o_orderkey, cast(o_custkey as string) as o_custkey, o_orderstatus,
 cast(cast(o_totalprice as decimal(18,2)) as string) as o_totalprice, {date} as o_orderdate, o_orderpriority, o_orderkey as seq
from orders"""
#: target that drifted from the feed
TARGET_SQL = """
select order_id, customer_id, case when order_id % 37 = 0 then upper(code) else lower(code) end as status, code as status_code,
 cast(round(price, 1) + case when order_id % 41 = 0 then 0.01 else 0.00 end as decimal(38,2)) as total, day as order_date,
 case when order_id % 31 = 0 then null else o_orderpriority end as priority, concat(o_orderpriority, '/', code) as label
from (
 select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as code, cast(o_totalprice as decimal(18,2)) as price, cast(o_orderdate as date) as day, o_orderpriority
 from orders where o_orderkey % 50 <> 0
 union all
 select o_orderkey + 10000000, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)), cast(o_orderdate as date), o_orderpriority
 from orders where o_orderkey % 61 = 0) t"""
#: target with planted patterns of differences
PATTERNED_SQL = """
select k as order_id, case when k % 29 = 0 then -o_custkey else o_custkey end as customer_id,
 case when k % 19 = 0 then o_orderstatus else lower(o_orderstatus) end as status, case when k % 19 = 0 then lower(o_orderstatus) else o_orderstatus end as status_code,
 cast(case k % 11 when 0 then round(price, 1) + 0.5 when 1 then round(price, 1) * 100 when 2 then round(price, 1) + k + 0.01 else round(price, 1) end as decimal(38,2)) as total,
 case when k % 13 = 0 then date_add(day, -1) when k % 13 = 1 and extract(day from day) <= 12
  then make_date(cast(extract(year from day) as int), cast(extract(day from day) as int), cast(extract(month from day) as int)) else day end as order_date,
 case k % 17 when 0 then substring(o_orderpriority, 1, 5) when 1 then lower(o_orderpriority) when 2 then replace(o_orderpriority, ' ', '') else o_orderpriority end as priority,
 case k % 23 when 0 then concat('X-', o_orderpriority, '/', o_orderstatus) when 1 then null else concat(o_orderpriority, '/', o_orderstatus) end as label
from (select *, o_orderkey as k, cast(o_totalprice as decimal(18,2)) as price, cast(o_orderdate as date) as day from orders) t"""
_DUCK_DATE = "strftime(o_orderdate, '%Y-%m-%d')"
DUCK_FEED = FEED_SQL.replace("{date}", _DUCK_DATE)

_CELLS = ["customer_id", "status", "status_code", "total", "order_date", "priority", "label"]
_SIDES = ", ".join(f"e.{c} as e_{c}, a.{c} as a_{c}" for c in _CELLS)
_DIFFS = " union all ".join(f"""select order_id, '{c}' as "column", e_{c} as expected, a_{c} as actual from j where kind = 'matched' and e_{c} is distinct from a_{c}""" for c in _CELLS)
#: feed, target, their normal forms e and a, the join j, differing cells d, failing flags f, the rule report r
CTE = f"""with feed as ({DUCK_FEED}), target as ({TARGET_SQL}),
e0 as (select seq, try_cast(trim(o_orderkey) as decimal(38,10)) as kd, trim(o_orderkey) as kraw, trim(o_custkey) as customer_id,
 nullif(trim(lower(o_orderstatus)), '') as status, nullif(trim(o_orderstatus), '') as status_code,
 cast(cast(round(try_cast(trim(o_totalprice) as decimal(38,10)), 1) as decimal(38,2)) as varchar) as total,
 coalesce(cast(cast(try_strptime(trim(o_orderdate), '%Y-%m-%d') as date) as varchar), trim(o_orderdate)) as order_date,
 nullif(trim(o_orderpriority), '') as priority, trim(concat(o_orderpriority, '/', o_orderstatus)) as label from feed),
e1 as (select *, case when kd is null then kraw else cast(cast(trunc(kd) as bigint) as varchar) end as order_id from e0),
e as (select * from e1 qualify row_number() over (partition by order_id order by seq desc) = 1),
a as (select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, status, status_code, cast(total as varchar) as total,
 cast(order_date as varchar) as order_date, priority, label from target),
j as (select coalesce(e.order_id, a.order_id) as order_id,
 case when a.order_id is null then 'missing' when e.order_id is null then 'extra' else 'matched' end as kind, {_SIDES} from e full join a on e.order_id = a.order_id),
d as ({_DIFFS}),
f as (select seq, o_orderkey as sample, unnest([
 case when trim(o_orderpriority) = '' then 'transform_input_not_null:o_orderpriority' end,
 case when trim(o_orderpriority) = '' then 'not_null:priority' end,
 case when not regexp_matches(trim(o_orderkey), '^[+-]?[0-9]+$') then 'type:order_id' end,
 case when try_strptime(trim(o_orderdate), '%Y-%m-%d') is null then 'type:order_date' end,
 case when try_cast(trim(o_totalprice) as decimal(18,2)) not between 0 and 1000000 then 'range:total' end,
 case when trim(o_orderstatus) not in ('F', 'O', 'P') then 'allowed_values:status_code' end,
 case when trim(o_orderpriority) <> '' and length(o_orderpriority) > 15 then 'max_length:priority' end,
 case when length(o_orderstatus) > 1 then 'max_length:status_code' end,
 case when trim(o_orderpriority) <> '' and not regexp_matches(trim(o_orderpriority), '^[1-4]-[A-Z]') then 'regex:priority' end,
 case when count(*) over (partition by o_orderkey) > 1 then 'unique:order_id' end]) as rule_id from feed),
r as (select rule_id, split_part(rule_id, ':', 2) as "column", count(*) as failing_rows, to_json((array_agg(sample order by seq))[1:5]) as samples
 from f where rule_id is not null group by rule_id)
"""
#: line items with the place of each among those of its key, last first
LINES = """with l as (
 select l_orderkey as order_id, l_linenumber as line, cast(l_quantity as decimal(18,2)) as quantity, l_returnflag as flag, l_partkey,
  row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc,
   l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc, l_shipdate desc) as n
 from lineitem)
"""
_COUNTS = """(select count(*) from feed) as source_count, (select count(*) from target) as target_count,
 (select count(*) from j where kind = 'missing') as missing, (select count(*) from j where kind = 'extra') as extra, (select count(*) from d) as diffs"""
_KIND = """case when expected is null or actual is null then 'null-vs-value' when lower(expected) = lower(actual) then 'case-only'
 when regexp_replace(expected, '\\s', '', 'g') = regexp_replace(actual, '\\s', '', 'g') then 'whitespace-only'
 when try_cast(expected as decimal(38,10)) is not null and try_cast(actual as decimal(38,10)) is not null then 'numeric-delta' else 'other' end"""
RULES = ["transform_input_not_null", "not_null", "type", "range", "max_length", "regex", "allowed_values", "unique"]
_TYPES = [("order_id", "bigint"), ("customer_id", "bigint"), ("status", "string"), ("status_code", "string"), ("total", "decimal(38,2)"), ("order_date", "date"), ("priority", "string"), ("label", "string")]
_TYPED = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(_TYPES, 1))
_LOADED = """select cast(cast(trunc(kd) as bigint) as varchar) as order_id, e1.customer_id, e1.status, e1.status_code, e1.total,
 case when order_date = 'not-a-date' then null else order_date end as order_date, nullif(f.o_orderpriority, '') as priority, e1.label from e1 join feed f using (seq)"""


def _nulls(table: str) -> str:
    return " union all ".join(f"select '{c}' as name, count(*) as n_rows, count(*) filter (where {c} is null) as n_nulls from {table}" for c, _ in _TYPES)


_BATCH = "[cast(count(*) as varchar), cast(sum(cast(total as decimal(18,2))) as varchar), cast(count(distinct customer_id) as varchar)]"
_SUMMARY = f"""select 'orders' as contract, '1.0' as contract_version, 'test' as environment, target_count, source_count,
 missing + extra + diffs as mismatch_count, (select cast(sum(failing_rows) as bigint) from r) as validation_rule_failures, (select cast(count(*) > 0 as bigint) from target where priority is null) as schema_errors,
 'FAIL' as final_status, '2024-01-01T00:00:00' as timestamp from (select {_COUNTS})"""


def _gate(stopped_at: str | None, target: str = "0", source: str = "(select count(*) from orders)", mismatches: str = "0", failures: str = "0", errors: int = 0) -> str:
    status = "FAIL" if stopped_at else "PASS"
    stop = f"'{stopped_at}'" if stopped_at else "cast(null as varchar)"
    return f"""select 'orders_run' as contract, '1.0' as contract_version, 'test' as environment, cast({target} as bigint) as target_count,
 cast({source} as bigint) as source_count, cast({mismatches} as bigint) as mismatch_count, cast({failures} as bigint) as validation_rule_failures,
 cast({errors} as bigint) as schema_errors, '{status}' as final_status, '1970-01-01T00:00:00' as timestamp, {stop} as stopped_at"""


_ALL = "(select count(*) from orders)"
_EDGE_ROWS = {
    "integer": [("12.99999999999", "12"), ("-12.7", "-12"), ("+5", "5"), ("1e3", "1000"), ("NaN", None), ("1_000", "1000"), (".7", "0"), ("99999999999999999999999", None)],
    "decimal": [("2.675", "2.68"), ("1.005", "1.01"), ("-0.005", "-0.01"), ("1e3", "1000.00"), ("NaN", None), ("123456789012345678901234567890.125", "123456789012345678901234567890.13"), ("abc", None), ("1_0.5", "10.50")],
    "date": [("2024-1-2", None), ("02.01.2024", "2024-01-02"), ("30.02.2024", None), ("2024-01-02", None), ("2.1.2024", "2024-01-02"), ("NaN", None), ("02.01.24", None), ("x", None)],
}
#: texts at the edges of each type (dates are declared as %d.%m.%Y) and their normal forms
EDGES = {kind: [text for text, _ in rows] for kind, rows in _EDGE_ROWS.items()}


def _edges() -> str:
    """Expected normal forms and unreadable texts, by kind and place of the text."""
    rows = []
    for kind, own in _EDGE_ROWS.items():
        for i, (text, value) in enumerate(own):
            said = "null" if value is None else f"'{value}'"
            rows.append(f"('{kind}', {i}, {said}, " + (f"'{text}')" if value is None else "null)"))
    return f"""select o_orderkey as k, x.kind, x.value, x.unreadable from orders join (values {", ".join(rows)}) x(kind, i, value, unreadable) on o_orderkey % 8 = x.i"""


_RANGES = [("5", True), ("-1", False), ("10000000000000000000000", False), ("100.000", True), ("100.0000000001", False), ("1e2", True), ("1e30", False), ("99999999999999999999999999999999999999999999", False)]
#: numbers against the range 0 to 100
RANGES = [text for text, _ in _RANGES]

SQL: dict[str, str] = {
    "read_feed": f"select * exclude (seq) replace (nullif(o_orderpriority, '') as o_orderpriority) from ({DUCK_FEED})",
    "read_target": f"select order_id, customer_id, status, cast(total as varchar) as total, cast(order_date as varchar) as order_date, priority, label from ({TARGET_SQL})",
    "target_query": f"select order_id, customer_id from ({TARGET_SQL}) where order_id % 50 = 1",
    "row_counts": f"select 'source' as side, count(*) as n from ({DUCK_FEED}) union all select 'target', count(*) from ({TARGET_SQL})",
    "describe_schema": f"with t as ({TARGET_SQL}) select x.*, n_rows, n_nulls from (values {_TYPED}) x(position, name, type) join ({_nulls('t')}) using (name)",
    "load_expected": CTE + f"select order_id, customer_id, status, total, order_date, priority from ({_LOADED})",
    "contract_schema": CTE + f", t as ({_LOADED}) select x.name, x.type, false as nullable, n_rows, n_nulls from (values {_TYPED}) x(position, name, type) join ({_nulls('t')}) using (name)",
    "run_summary": CTE + _SUMMARY,
    "feed_files": f"select o_orderstatus as part, count(*) + 1 as records, count(*) as rows from ({DUCK_FEED}) group by o_orderstatus",
    "header_errors": """select 'header_name' as "check", cast(4 as bigint) as position, 'header column 4: expected ''o_totalprice'', got ''total_price''' as message""",
    "header_count_errors": """select * from (values ('header_count', cast(5 as bigint), 'header column count: expected 6, got 5'), ('header_name', 4, 'header column 4: expected ''o_totalprice'', got ''o_orderdate'''),
 ('header_name', 5, 'header column 5: expected ''o_orderdate'', got ''o_orderpriority''')) x("check", position, message)""",
    "encoding_errors": """select 'encoding' as "check", count(*) as position, 'file not decodable as utf-8: ' || count(*) || ' lines' as message from customer where c_custkey % 29 = 0""",
    "encoding_declared": """select 'encoding' as "check", count(*) as position, 'file not decodable as cp1252: ' || count(*) || ' lines' as message from customer where c_custkey % 23 = 0""",
    "ragged_rows": f"""select concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate) as record, n as number, 5 as width, 6 as expected
 from (select *, row_number() over (order by seq) as n from ({DUCK_FEED})) where seq % 53 = 1""",
    "ragged_errors": f"""select 'ragged' as "check", min(n) as position, 'ragged rows (col count != 6) at lines [' || string_agg(cast(n as varchar), ', ' order by n) || ']' as message
 from (select n from (select seq, row_number() over (order by seq) as n from ({DUCK_FEED})) where seq % 53 = 1 order by n limit 5)""",
    "quoted_records": """select count(*) as records, cast(sum(lines) as bigint) as lines, cast(0 as bigint) as undecodable, cast(2 as bigint) as width, count(*) filter (where more) as ragged,
 array_to_string((array_agg(n order by n) filter (where more))[1:5], ',') as first_ragged
 from (select row_number() over (order by c_custkey) as n, case when c_custkey % 5 = 0 then 2 else 1 end as lines, c_custkey % 31 = 7 as more from customer)""",
    "quoted_ragged": """select n as number, cast(3 as bigint) as width, cast(2 as bigint) as expected,
 c_custkey || ',' || case when c_custkey % 5 = 0 then '"' || c_name || chr(10) || '""x"", ' || c_mktsegment || '"' else c_name end || ',more' as record
 from (select *, row_number() over (order by c_custkey) as n from customer) where c_custkey % 31 = 7""",
    "encoded_feeds": """select encoding, count(*) + 1 as records, cast(2 as bigint) as width, cast(0 as bigint) as undecodable, cast(0 as bigint) as ragged, 'clé,prénom' as header
 from customer, (values ('UTF-16LE'), ('ISO-8859-1'), ('UTF-8')) e(encoding) group by encoding""",
    "header_of_files": """select distinct cast(c_nationkey as varchar) as nation, c_mktsegment as segment, 'header_name' as "check", cast(2 as bigint) as position,
 'header column 2: expected ''c_fullname'', got ''c_name''' as message from customer""",
    "date_edges": """with t as (select o_orderkey as k, cast(o_orderdate as date) as day, strftime(o_orderdate, '%Y-%m-%d') as iso from orders)
select k, case when k % 5 in (0, 2) then iso end as value, case k % 5 when 1 then iso[1:9] || 'T' when 3 then iso || ' 00:00:00' when 4 then strftime(day, '%d.%m.%Y') end as unreadable,
 k % 5 in (0, 2) as passes from t""",
    "timestamp_zone_edges": "select event_id as k, '2024-03-31 02:' || strftime(ts, '%M:%S') as value, cast(null as varchar) as unreadable from events",
    "range_large_bounds": "select o_orderkey as k, o_orderkey % 3 <> 2 and cast(o_orderkey as hugeint) * 10000000000000000000 <= 10000000000000000000000 as passes from orders",
    "transform_unknown": f"select o_orderkey as order_id, o_orderpriority || '//' as label from ({DUCK_FEED})",
    "missing_table": f"""select 'exists' as "check", cast(null as varchar) as "column", 'table orders_target does not exist' as message, count(*) as rows from ({DUCK_FEED})""",
    "digest_column_diffs": CTE + "select * from d",
    "digest_missing_and_extra": CTE + "select order_id, kind from j where kind <> 'matched'",
    "digest_composite_keys": LINES + """, e as (select * from l where n = 1),
a as (select * from (select * exclude (n), row_number() over (partition by order_id, line order by n) as n from l where order_id % 50 <> 0) where n = 1)
select cast(order_id as varchar) as order_id, cast(line as varchar) as line, 'quantity' as "column", cast(quantity as varchar) as expected, cast(cast(quantity + 1 as decimal(18,2)) as varchar) as actual
 from e semi join a using (order_id, line) where l_partkey % 41 = 0""",
    "batch_key_sets": """select strftime(o_orderdate, '%Y-%m') as "group", count(*) as expected_rows, count(*) filter (where o_orderkey % 400 <> 7) as actual_rows,
 count(*) filter (where o_orderkey % 400 = 7) = 0 as agrees, count(*) filter (where o_orderkey % 400 = 7) as only_expected, cast(0 as bigint) as only_actual from orders group by 1""",
    "control_totals_met": "select cast(null as varchar) as \"column\", cast(null as varchar) as measure, cast(null as varchar) as expected, cast(null as varchar) as got, cast(null as varchar) as message from orders where false",
    "control_totals_missed": """with t as (select sum(cast(o_totalprice as decimal(18,2))) as s, count(*) as n from orders),
f as (select 'sum' as measure, cast(s + 1 as varchar) as expected, cast(s as varchar) as got from t union all select 'count', cast(n + 1 as varchar), cast(n as varchar) from t),
g as (select measure, case when measure = 'sum' then regexp_replace(regexp_replace(expected, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') else expected end as expected,
 case when measure = 'sum' then regexp_replace(regexp_replace(got, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') else got end as got from f)
select 'o_totalprice' as "column", *, 'control total o_totalprice ' || measure || ': expected ' || expected || ', got ' || got as message from g""",
    "load_versions": CTE + f"select order_id, total, priority from ({_LOADED})",
    "run_audit": CTE + """select run_id, (select count(*) from feed) as source_count, (select count(*) from j where kind = 'missing') as missing, count(*) as diffs, count(*) as stored, min(order_id) as first_key
 from d join (values ('r1', 'total'), ('r2', 'status')) x(run_id, c) on d."column" = x.c group by run_id""",
    "feed_increment": "select distinct c_mktsegment as part, 'new' as state from customer where c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY' and c_custkey % 2 = 0",
    "row_count_errors": f"""select 'empty' as "check", cast(0 as bigint) as position, 'file is empty' as message
 union all select 'row_count', count(*), 'row count: expected 7, got ' || count(*) from ({DUCK_FEED})""",
    "row_count_check": f"select count(*) as n, 'row count: expected 7, got ' || count(*) as message from ({DUCK_FEED})",
    "control_totals": """select count(value) as n, cast(sum(cast(value as decimal(18,2))) as varchar) as total, cast(min(cast(value as decimal(18,2))) as varchar) as least,
 cast(max(cast(value as decimal(18,2))) as varchar) as greatest from events""",
    "map_columns": f"select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status_code from ({DUCK_FEED})",
    "transform_template": "select c_custkey as k, concat(c_name, ' <', c_mktsegment, '>') as value from customer",
    "transform_lower": "select c_custkey as k, lower(c_name) as value from customer",
    "transform_upper": "select c_custkey as k, upper(concat(c_mktsegment, '-', c_name)) as value from customer",
    "transform_strip": "select c_custkey as k, c_mktsegment as value from customer",
    "transform_round": """select c_custkey as k, cast(cast(round(cast(c_acctbal as decimal(18,2)), 1) as decimal(38,1)) as varchar) as value,
 cast(cast(round(cast(c_acctbal as decimal(18,2)) / 100) * 100 as bigint) as varchar) as hundreds, '123456789012345678901234567890.13' as large from customer""",
    "transform_direct_call": "select c_custkey as k, upper(c_mktsegment) as value from customer",
    "expected_rows": f"""select o_orderkey as order_id, o_custkey as customer_id, lower(o_orderstatus) as status, o_orderstatus as status_code,
 cast(cast(round(cast(o_totalprice as decimal(38,2)), 1) as decimal(38,1)) as varchar) as total, o_orderdate as order_date, o_orderpriority as priority,
 concat(o_orderpriority, '/', o_orderstatus) as label from ({DUCK_FEED})""",
    "normalize_integer": """select o_orderkey as k, case when o_orderkey % 3 = 0 then cast(case when o_orderkey = 0 then 0 else -o_orderkey end as varchar)
 when o_orderkey % 3 = 2 then cast(o_orderkey as varchar) end as value, case when o_orderkey % 3 = 1 then 'x' || o_orderkey end as unreadable from orders""",
    "normalize_decimal": "select o_orderkey as k, cast(cast(round(cast(o_totalprice as decimal(18,2)), 1) as decimal(38,1)) as varchar) as value, cast(null as varchar) as unreadable from orders",
    "normalize_date": """select o_orderkey as k, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as value,
 case when o_orderkey % 7 = 0 then '2024-02-30' end as unreadable from orders""",
    "normalize_timestamp": """select event_id as k, case when event_id % 5 <> 0 then regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') end as value,
 case when event_id % 5 = 0 then 'soon' end as unreadable from events""",
    "normalize_boolean": """select o_orderkey as k, case when o_orderkey % 6 < 3 then 'true' when o_orderkey % 6 < 5 then 'false' end as value,
 cast(null as varchar) as unreadable from orders""",
    "normalize_string": "select c_custkey as k, c_name as value, cast(null as varchar) as unreadable from customer",
    "normalize_blank": """select o_orderkey as k, case when o_orderkey % 5 = 3 then 'NaN' when o_orderkey % 5 > 1 then o_orderpriority end as value,
 cast(null as varchar) as unreadable, o_orderkey % 2 = 0 as nan_is_null from orders""",
    "normalize_edges": _edges(),
    "range_edges": "select o_orderkey as k, case o_orderkey % 8 " + " ".join(f"when {i} then {str(ok).lower()}" for i, (_, ok) in enumerate(_RANGES)) + " end as passes from orders",
    **{f"rule_{x}": CTE + f"""select rule_id, "column", failing_rows from r where split_part(rule_id, ':', 1) = '{x}'""" for x in RULES},
    "dq_report": CTE + 'select rule_id, "column", failing_rows from r',
    "dq_samples": CTE + "select rule_id, cast(samples as varchar) as samples from r",
    "dq_totals": CTE + "select count(*) as failing_rules, cast(sum(failing_rows) as bigint) as failing_rows from r",
    "schema_errors": """with n as (select count(*) as rows from orders) select x.*, case when x."check" = 'nullability' then (select count(*) from orders where o_orderkey % 31 = 0) else rows end as rows
 from n, (values ('order', null, 'column order/count mismatch: expected [''order_id'', ''customer_id'', ''status'', ''status_code'', ''total'', ''order_date'', ''priority'', ''label''], got [''order_id'', ''customer_id'', ''status'', ''status_code'', ''total'', ''order_date'', ''priority'']'),
 ('type', 'total', 'column ''total'' type mismatch: expected decimal, got double'), ('missing', 'label', 'missing column ''label'''),
 ('nullability', 'priority', 'column ''priority'' nullability mismatch: expected nullable=False, got True')) x("check", "column", message)""",
    "nullability_check": " union all ".join(f"""select '{c}' as "column", count(*) filter (where {c} is null) as nulls from ({TARGET_SQL})""" for c, _ in _TYPES),
    "key_integrity": """select cast(0 as bigint) as null_keys, count(*) filter (where n > 1) as duplicate_keys, cast(sum(n - 1) as bigint) as surplus_rows
 from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""",
    "normalized_keys": CTE + "select seq, case when kd is null then 'B:' || kraw else 'V:' || order_id end as key from e1",
    "last_wins": LINES + "select cast(order_id as varchar) as order_id, cast(line as varchar) as line, cast(quantity as varchar) as quantity, flag from l where n = 1",
    "missing_in_target": CTE + "select order_id from j where kind = 'missing'",
    "extra_in_target": CTE + "select order_id from j where kind = 'extra'",
    "column_diffs": CTE + "select * from d",
    "column_diffs_subset": CTE + """select * from d where "column" in ('total', 'priority')""",
    "recon_counts": CTE + f"select *, missing + extra + diffs as mismatch_count from (select {_COUNTS})",
    "transform_diffs": CTE + """select * from d where "column" in ('status', 'total', 'label')""",
    "mismatch_detail": CTE + """select * from (select order_id, null as "column", null as expected, null as actual, kind from j where kind = 'missing' order by order_id limit 10)
 union all select * from (select order_id, null, null, null, kind from j where kind = 'extra' order by order_id limit 10)
 union all select * from (select *, 'diff' from d order by order_id, "column" limit 10)""",
    "composite_key_compare": LINES + """, e as (select * from l where n = 1),
a as (select * from (select * exclude (n), row_number() over (partition by order_id, line order by n) as n from l where order_id % 50 <> 0) where n = 1),
c as (select (select count(*) from l) as source_count, (select count(*) from l where order_id % 50 <> 0) as target_count,
 (select count(*) from e anti join a using (order_id, line)) as missing, cast(0 as bigint) as extra, (select count(*) from a where l_partkey % 41 = 0) as diffs)
select *, missing + extra + diffs as mismatch_count from c""",
    "full_reconciliation": CTE + _SUMMARY,
    "gate_pass": _gate(None, target=_ALL),
    "gate_files": _gate("files", source="0"),
    "gate_rules": CTE + _gate("rules", failures="(select sum(failing_rows) from r where rule_id <> 'regex:priority')"),
    "gate_schema": _gate("schema", errors=2),
    "gate_nulls": _gate("schema", errors=1),
    "gate_keys": _gate("schema", errors=1),
    "gate_count": _gate("count", target="(select count(*) from orders where o_orderkey % 50 <> 0)"),
    "gate_compare": _gate("compare", target=_ALL, mismatches="(select count(*) from orders where o_orderkey % 41 = 0)"),
    "failure_layers": CTE + """select layer, cast(sum(n) as bigint) as failures from (select 'source data' as layer, failing_rows as n from r
 union all select 'load', 1 from j where kind <> 'matched'
 union all select case when "column" in ('status', 'total', 'label') then 'transform' else 'load' end, 1 from d) group by layer""",
    "mismatch_clusters": CTE + f'select "column", {_KIND} as kind, count(*) as cells, min(order_id) as example from d group by 1, 2',
    "batch_aggregates": CTE + f"""select metric, expected, actual, expected = actual as agrees from (select unnest(['rows', 'total', 'customers']) as metric,
 unnest((select {_BATCH} from e1)) as expected, unnest((select {_BATCH} from target)) as actual)""",
    "mismatch_patterns": """with t as (select o_orderkey as k, o_custkey as c, o_orderpriority as p, extract(day from o_orderdate) as day, extract(month from o_orderdate) as month from orders),
x as (select 'customer_id' as "column", 'ratio' as pattern, '-1' as parameter, k from t where k % 29 = 0 and c <> 0
 union all select 'status', 'swapped with', 'status_code', k from t where k % 19 = 0
 union all select 'status_code', 'swapped with', 'status', k from t where k % 19 = 0
 union all select 'total', case k % 11 when 0 then 'delta' when 1 then 'ratio' else 'other' end, case k % 11 when 0 then '0.5' when 1 then '100' end, k from t where k % 11 < 3
 union all select 'order_date', 'days', '-1', k from t where k % 13 = 0
 union all select 'order_date', 'day and month swapped', null, k from t where k % 13 = 1 and day <= 12 and day <> month
 union all select 'priority', 'cut to', '5', k from t where k % 17 = 0 and length(p) > 5
 union all select 'priority', 'case', null, k from t where k % 17 = 1 and lower(p) <> p
 union all select 'priority', 'blanks', null, k from t where k % 17 = 2 and p like '% %'
 union all select 'label', 'prefix added', 'X-', k from t where k % 23 = 0
 union all select 'label', 'null for value', null, k from t where k % 23 = 1)
select "column", pattern, parameter, count(*) as cells, cast(sum(count(*)) over (partition by "column") as bigint) as column_cells, min(cast(k as varchar)) as example from x group by 1, 2, 3""",
    "mismatch_pattern_times": """with x as (select 'ts' as "column", case event_id % 7 when 0 then 'zone' else 'seconds' end as pattern, case event_id % 7 when 0 then '+05:30' else '-5' end as parameter, event_id from events where event_id % 7 < 2
 union all select 'event_type', case event_id % 11 when 0 then 'suffix added' else 'cut to' end, case event_id % 11 when 0 then '_v2' else '2' end, event_id from events where event_id % 11 < 2 and event_type is not null)
select "column", pattern, parameter, count(*) as cells, cast(sum(count(*)) over (partition by "column") as bigint) as column_cells, min(cast(event_id as varchar)) as example from x group by 1, 2, 3""",
    "row_hash_compare": CTE + "select distinct order_id from d",
    "run_trend": """select 'orders' as contract, 'test' as environment, y || '-01-01T00:00:00' as timestamp, 'run-' || y as run_id, n as mismatch_count,
 cast(lag(n) over (order by y) as varchar) as before, cast(n - lag(n) over (order by y) as varchar) as change
 from (select cast(year(o_orderdate) as varchar) as y, count(*) filter (where o_totalprice > 200000) as n from orders group by 1)""",
}
