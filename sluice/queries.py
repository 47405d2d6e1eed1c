"""Queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Options, Query, shared_folder
from .sources import DELIMITERS


@dataclass(frozen=True)
class Case:
    """source: the table that the query reads; tables: others that it names; key: of a record, for record scope.

    written: the format in which the table is written first, to a folder that the query names as {path}."""

    source: str
    kql: str
    sql: str | None
    scope: str = "table"
    key: str | None = None
    tables: tuple[str, ...] = ()
    options: Options | None = None
    written: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        kql = self.kql if self.written is None else self.kql.replace("{path}", _files(read(self.source), self.written))
        query = Query(kql, options=self.options, tables={n: read(n) for n in self.tables})
        return query.apply(read(self.source), self.scope, self.key)


def _files(df: DataFrame, kind: str) -> str:
    """A folder, that driver and executors share, with the rows of a small table as lines of a format."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/external-{uuid.uuid4().hex}"
    each = F.to_json(F.struct(*df.columns))
    if kind in DELIMITERS:
        lines = df.select(F.concat_ws(DELIMITERS[kind], *df.columns))
    elif kind == "json":  # one document
        lines = df.agg(F.concat(F.lit("["), F.array_join(F.collect_list(each), ","), F.lit("]")))
    else:
        lines = df.select(each if kind in ("multijson", "jsonl", "json-lines") else df.columns[1])
    lines.coalesce(1).write.text(path)
    return path.removeprefix("file:")


CASES: dict[str, Case] = {}


def case(name: str, source: str, kql: str, sql: str | None, scope: str = "table", key: str | None = None, tables: tuple[str, ...] = (), options: Options | None = None, written: str | None = None) -> None:
    CASES[name] = Case(source, kql, sql, scope, key, tables, options, written)


# --- row operators
FLAGSHIP = "source | where event_type == 'purchase' and value > 50 | extend band = iff(value > 200, 'high', 'low') | project event_id, user_id, value, band"
case("where_extend_project", "events", FLAGSHIP, "SELECT event_id, user_id, value, CASE WHEN value > 200 THEN 'high' ELSE 'low' END AS band FROM events WHERE event_type = 'purchase' AND value > 50")
case("has_word", "documents", "source | where text has 'license' | project doc_id", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])license($|[^A-Za-z0-9])')")
case("has_any_all", "documents", "source | extend a = text has_any ('license', 'scum'), b = text has_all ('the', 'of') | where a or b | project doc_id, a, b",
     r"SELECT * FROM (SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(license|scum)($|[^A-Za-z0-9])') AS a, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])of($|[^A-Za-z0-9])') AS b FROM documents) WHERE a OR b")
case("string_ops", "part", "source | project p_partkey, c = p_name contains 'A', s = p_type startswith 'e', e = p_type endswith_cs 'R', i = p_brand in ('Brand#1', 'Brand#2', 'Brand#11'), m = p_name matches regex '[0-9]{2}', q = p_brand =~ 'BRAND#1', n = p_name !contains 'z'",
     "SELECT p_partkey, contains(lower(p_name), 'a') AS c, starts_with(lower(p_type), 'e') AS s, ends_with(p_type, 'R') AS e, p_brand IN ('Brand#1', 'Brand#2', 'Brand#11') AS i, regexp_matches(p_name, '[0-9]{2}') AS m, lower(p_brand) = 'brand#1' AS q, NOT contains(lower(p_name), 'z') AS n FROM part")
case("parse_name", "customer", "source | parse c_name with 'Customer#' num:long | project c_custkey, num", "SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, 'Customer#(.*)', 1), '') AS BIGINT) AS num FROM customer")
case("parse_regex_where", "pages", "source | parse-where kind=regex url with 'https?://' host '[.]example[.]' * '/' lang '/' rest | project page_id, host, lang, rest",
     "SELECT page_id, regexp_extract(url, 'https?://(.*?)[.]example[.].*?/(.*?)/(.*)', 1) AS host, regexp_extract(url, 'https?://(.*?)[.]example[.].*?/(.*?)/(.*)', 2) AS lang, regexp_extract(url, 'https?://(.*?)[.]example[.].*?/(.*?)/(.*)', 3) AS rest FROM pages WHERE regexp_matches(url, 'https?://(.*?)[.]example[.].*?/(.*?)/(.*)')")
case("parse_kv", "pages", "source | extend q = extract('[?]([^#]*)', 1, url) | where isnotempty(q) | parse-kv q as (page: long, ref: string) with (pair_delimiter='&', kv_delimiter='=') | project page_id, page, ref",
     "SELECT page_id, TRY_CAST(nullif(regexp_extract(q, '(^|&)page=([^&]*)', 2), '') AS BIGINT) AS page, CASE WHEN regexp_matches(q, '(^|&)ref=') THEN regexp_extract(q, '(^|&)ref=([^&]*)', 2) END AS ref FROM (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages) WHERE q <> ''")
case("project_forms", "nation", "source | extend x = n_nationkey * 2 | project-rename id = n_nationkey | project-reorder x, id | project-away n_regionkey | project-keep id, x, n_name", "SELECT n_nationkey AS id, n_nationkey * 2 AS x, n_name FROM nation")
case("column_if_exists", "nation", "source | project n_nationkey, a = columnifexists('n_name', 'none'), b = columnifexists('missing', 'none')", "SELECT n_nationkey, n_name AS a, 'none' AS b FROM nation")
case("dynamic_access", "events", "source | extend k = toint(parse_json(props).k) | project event_id, k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
case("bag_unpack", "events", "source | extend p = parse_json(props) | project event_id, p | evaluate bag_unpack(p, 'p_') | extend p_k = tolong(p_k) | project event_id, p_k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p_k FROM events")
case("let_scalars", "events", "let low = 20; let high = low * 2; source | where value > low and value <= high | project event_id, over = value - low", "SELECT event_id, value - 20 AS over FROM events WHERE value > 20 AND value <= 40")
case("print_row", "region", "print a = 2 + 3, b = strcat('x', 'y'), 7 % -3", "SELECT 5 AS a, 'xy' AS b, -2 AS print_2")
case("datatable_head", "region", "datatable(a: long, b: string)[1, 'x', 2, 'y', '3', 'z'] | where a > 1", "SELECT * FROM (VALUES (2, 'y'), (3, 'z')) t(a, b)")
case("range_head", "region", "range x from 1 to 20 step 3 | extend y = x * x", "SELECT x, x * x AS y FROM (SELECT unnest(range(1, 21, 3)) AS x)")
# --- grouping
case("summarize_by", "lineitem", "source | summarize q = sum(l_quantity), a = avg(l_quantity), lo = min(l_extendedprice), hi = max(l_extendedprice), n = count(), parts = dcount(l_partkey) by l_returnflag, l_linestatus | extend a = round(a, 6)",
     "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(avg(l_quantity), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
case("summarize_if", "lineitem", "source | summarize c = countif(l_discount > 0.05), s = sumif(l_quantity, l_tax > 0.04), a = avgif(l_quantity, l_returnflag == 'R') by l_linestatus | extend a = round(a, 6)",
     "SELECT l_linestatus, count(*) FILTER (l_discount > 0.05::DOUBLE) AS c, sum(l_quantity) FILTER (l_tax > 0.04::DOUBLE) AS s, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS a FROM lineitem GROUP BY ALL")
case("summarize_keys", "orders", "source | summarize by o_orderstatus, y = getyear(o_orderdate)", "SELECT DISTINCT o_orderstatus, year(o_orderdate) AS y FROM orders")
case("summarize_none", "orders", "source | where o_totalprice < 0 | summarize n = count()", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
case("make_list_set", "orders", "source | summarize s = make_set(o_orderpriority), l = make_list(o_orderkey) by o_orderstatus | project o_orderstatus, s = strcat_array(array_sort_asc(s), ','), n = array_length(l), t = array_sum(l)",
     "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS t FROM orders GROUP BY ALL")
case("take_any", "nation", "source | summarize x = any(n_regionkey), y = take_any(n_regionkey) by n_regionkey", "SELECT n_regionkey, n_regionkey AS x, n_regionkey AS y FROM nation GROUP BY ALL")
case("distinct", "customer", "source | distinct c_nationkey, c_mktsegment", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
case("count", "lineitem", "source | where l_quantity > 25 | count", 'SELECT count(*) AS "Count" FROM lineitem WHERE l_quantity > 25')
case("getschema", "nation", "source | getschema", """SELECT * FROM (VALUES ('n_nationkey', 0, 'long'), ('n_name', 1, 'string'), ('n_regionkey', 2, 'long')) t("ColumnName", "ColumnOrdinal", "ColumnType")""")
case("make_series", "events", "source | make-series n = count(), s = sum(event_id) default = 0 on d from 0 to 10 step 1 by event_type | mv-expand d, n, s | project event_type, d = tolong(d), n = tolong(n), s = tolong(s)".replace("source |", "source | extend d = tolong(user_id) % 12 |"),
     "SELECT t.event_type, b.d, count(e.event_id) AS n, CAST(coalesce(sum(e.event_id), 0) AS BIGINT) AS s FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range(0, 10)) AS d) b LEFT JOIN events e ON e.event_type = t.event_type AND e.user_id % 12 = b.d GROUP BY ALL")
case("make_series_dates", "orders", "source | make-series n = count() on o_orderdate step 30d by o_orderstatus | mv-expand o_orderdate, n | project o_orderstatus, d = format_datetime(o_orderdate, 'yyyy-MM-dd'), n",
     "WITH e AS (SELECT CAST(floor(min(epoch(o_orderdate)) / 2592000) AS BIGINT) AS lo, CAST(floor(max(epoch(o_orderdate)) / 2592000) AS BIGINT) AS hi FROM orders) SELECT t.o_orderstatus, strftime(make_timestamp(b.k * 2592000 * 1000000), '%Y-%m-%d') AS d, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) t CROSS JOIN (SELECT unnest(range(lo, hi + 1)) AS k FROM e) b LEFT JOIN orders o ON o.o_orderstatus = t.o_orderstatus AND CAST(floor(epoch(o.o_orderdate) / 2592000) AS BIGINT) = b.k GROUP BY ALL")
# --- order
case("sort_take", "orders", "source | sort by o_totalprice desc, o_orderkey asc | take 25 | project o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
case("top_n", "lineitem", "source | top 20 by l_extendedprice, l_orderkey asc, l_linenumber asc | project l_orderkey, l_linenumber, l_extendedprice", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
case("partition_top", "events", "source | partition by event_type (top 3 by value, event_id asc) | project event_type, event_id, value", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3")
case("sample_all", "nation", "source | sample 1000 | project n_nationkey", "SELECT n_nationkey FROM nation")
case("sample_distinct", "nation", "source | sample-distinct 100 of n_regionkey", "SELECT DISTINCT n_regionkey FROM nation")
case("sample_count", "lineitem", "source | sample 100 | count", 'SELECT 100 AS "Count"', options=Options(random_seed=3))
case("serialize_windows", "events", "source | partition by user_id (sort by ts asc, event_id asc | serialize rn = row_number(), before = prev(event_id, 1, -1), after = next(event_id), total = row_cumsum(event_id)) | project event_id, rn, before, after, total",
     "SELECT event_id, row_number() OVER w AS rn, coalesce(lag(event_id) OVER w, -1) AS before, lead(event_id) OVER w AS after, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
case("serialize_restart", "events", "source | partition by user_id (sort by event_id asc | serialize rn = row_number(1, event_type == 'purchase'), c = row_cumsum(1, event_type == 'purchase')) | project event_id, rn, c",
     "WITH s AS (SELECT *, row_number() OVER w AS r, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w - CASE WHEN first_value(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS c FROM s")
# --- several tables
case("lookup_nation", "customer", "let N = datatable(c_nationkey: long, label: string)[0, 'zero', 1, 'one', 1, 'again', 2, 'two']; source | lookup N on c_nationkey | project c_custkey, label", "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS label FROM customer")
case("lookup_inner_table", "customer", "source | lookup kind=inner nation on c_nationkey == n_nationkey | project c_custkey, n_name, n_regionkey", "SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey", tables=("nation",))
_LEFT, _RIGHT = "(SELECT o_orderkey, o_custkey FROM orders)", "customer"
for _kind, _sql in {
    "inner": f"SELECT * FROM {_LEFT} JOIN {_RIGHT} ON o_custkey = c_custkey", "leftouter": f"SELECT * FROM {_LEFT} LEFT JOIN {_RIGHT} ON o_custkey = c_custkey", "rightouter": f"SELECT * FROM {_LEFT} RIGHT JOIN {_RIGHT} ON o_custkey = c_custkey",
    "fullouter": f"SELECT * FROM {_LEFT} FULL JOIN {_RIGHT} ON o_custkey = c_custkey", "leftsemi": f"SELECT * FROM {_LEFT} SEMI JOIN {_RIGHT} ON o_custkey = c_custkey", "leftanti": f"SELECT * FROM {_LEFT} ANTI JOIN {_RIGHT} ON o_custkey = c_custkey",
    "rightsemi": f"SELECT * FROM {_RIGHT} SEMI JOIN {_LEFT} ON o_custkey = c_custkey", "rightanti": f"SELECT * FROM {_RIGHT} ANTI JOIN {_LEFT} ON o_custkey = c_custkey",
}.items():
    case(f"join_{_kind}", "orders", f"source | project o_orderkey, o_custkey | join kind={_kind} customer on o_custkey == c_custkey", _sql, tables=("customer",))
case("join_innerunique", "orders", "source | sort by o_orderkey asc | project o_orderkey, o_custkey | join nation on o_custkey == n_nationkey | project o_orderkey, n_name", "SELECT min(o_orderkey) AS o_orderkey, n_name FROM orders JOIN nation ON o_custkey = n_nationkey GROUP BY n_name", tables=("nation",))
case("join_subquery", "lineitem", "source | summarize q = sum(l_quantity) by l_suppkey | join kind=inner (source | summarize n = count() by l_suppkey) on l_suppkey | project l_suppkey, q, n", "SELECT l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL")
case("union_outer", "nation", "source | project a = n_nationkey, b = n_name | union (source | where n_nationkey < 3 | project a = n_nationkey, c = n_regionkey)", "SELECT n_nationkey AS a, n_name AS b, NULL::INT AS c FROM nation UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey < 3")
case("union_inner", "nation", "source | project a = n_nationkey, b = n_name | union kind=inner (source | project a = n_nationkey, c = n_regionkey)", "SELECT n_nationkey AS a FROM nation UNION ALL SELECT n_nationkey FROM nation")
case("case_route", "customer", "source | case (c_acctbal > 5000, (project c_custkey, rich = c_acctbal), c_acctbal < 0, (summarize debt = min(c_acctbal)), (project c_custkey, plain = 1))",
     "SELECT c_custkey, c_acctbal AS rich, NULL::DOUBLE AS debt, NULL::BIGINT AS plain FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT NULL, NULL, min(c_acctbal), NULL FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT c_custkey, NULL, NULL, 1 FROM customer WHERE NOT (c_acctbal > 5000) AND NOT (c_acctbal < 0)")
case("fork_union", "nation", "source | fork A = (where n_regionkey == 0 | project k = n_nationkey) B = (where n_regionkey == 1 | project k = n_nationkey) | project k = n_nationkey | union A, B", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1)")
case("as_selfjoin", "nation", "source | as All | join kind=inner All on n_regionkey | project a = n_nationkey, b = n_nationkey1", "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey")
# --- records
case("summarize_record", "events", "source | summarize n = count() by event_id", "SELECT event_id, 1 AS n FROM events", "record", "event_id")
case("mv_expand", "documents", "source | mv-expand with_itemindex=i w = split(text, ' ') | project doc_id, i, w", "SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS w FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)", "record", "doc_id")
case("mv_expand_summarize", "documents", "source | mv-expand w = split(text, ' ') | summarize n = count(), d = dcount(w) by doc_id", "SELECT doc_id, count(*) AS n, count(DISTINCT w) AS d FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL", "record", "doc_id")
case("mv_apply_top", "documents", "source | project doc_id, ws = split(text, ' ') | mv-apply w = ws on (extend l = strlen(w) | top 2 by l, w asc) | project doc_id, w, l", "SELECT doc_id, w, length(w) AS l FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) <= 2", "record", "doc_id")
case("mv_apply_fold", "embeddings", "source | mv-apply x = embedding on (summarize n = count(), hi = max(x), lo = min(x)) | project vec_id, n, hi = round(hi, 5), lo = round(lo, 5)", "SELECT vec_id, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 5) AS hi, round(list_min(embedding)::DOUBLE, 5) AS lo FROM embeddings", "record", "vec_id")
case("record_join", "nation", "let T = datatable(n_regionkey: long, v: string)[0, 'a', 1, 'b', 99, 'c']; source | join kind=rightouter T on n_regionkey | project n_nationkey, v", "SELECT CASE WHEN n_regionkey = r THEN n_nationkey END AS n_nationkey, v FROM nation, (VALUES (0, 'a'), (1, 'b'), (99, 'c')) t(r, v)", "record", "n_nationkey")
case("record_head", "nation", "range x from 1 to 3 step 1 | where x > 1", "SELECT x FROM nation, (VALUES (2), (3)) t(x)", "record", "n_nationkey")
# --- functions
case("datetime_fns", "orders", "source | project o_orderkey, y = getyear(o_orderdate), m = monthofyear(o_orderdate), d = dayofmonth(o_orderdate), j = dayofyear(o_orderdate), w = weekofyear(o_orderdate), s = format_datetime(startofmonth(o_orderdate), 'yyyy-MM-dd'), e = format_datetime(endofyear(o_orderdate), 'yyyy-MM-dd HH:mm:ss'), a = format_datetime(datetime_add('month', 1, startofmonth(o_orderdate)), 'yyyy-MM-dd'), x = datetime_diff('day', o_orderdate, make_datetime(1992, 1, 1)), p = datetime_part('month', o_orderdate), o = (o_orderdate - make_datetime(1992, 1, 1)) / 1d",
     "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS j, weekofyear(o_orderdate) AS w, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS s, strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS e, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS a, CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01')) / 86400) AS BIGINT) AS x, month(o_orderdate) AS p, (epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01')) / 86400 AS o FROM orders")
case("math_fns", "lineitem", "source | project l_orderkey, l_linenumber, f = floor(l_extendedprice), c = ceiling(l_extendedprice), b = bin(l_partkey, 10), s = sign(l_discount - 0.05), r = round(sqrt(l_quantity), 6), g = gcd(l_partkey, l_suppkey), l = lcm(l_linenumber, 6), p = pow(l_linenumber, 2), m = l_partkey % 7, n = -l_linenumber % 5",
     "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, l_partkey // 10 * 10 AS b, CAST(sign(l_discount - 0.05::DOUBLE) AS BIGINT) AS s, round(sqrt(l_quantity), 6) AS r, gcd(l_partkey, l_suppkey) AS g, lcm(l_linenumber, 6) AS l, l_linenumber * l_linenumber AS p, l_partkey % 7 AS m, (5 - l_linenumber % 5) % 5 AS n FROM lineitem")
case("hash_fns", "nation", "source | project n_nationkey, m = hash_md5(n_name), s = hash_sha1(n_name), h = hash_sha256(n_name), e = base64_encodestring(n_name), d = base64_decodestring(base64_encodestring(n_name))", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS h, base64(encode(n_name)) AS e, n_name AS d FROM nation")
case("bitwise_fns", "nation", "source | project k = n_nationkey, a = binary_and(n_nationkey, 6), o = binary_or(n_nationkey, 6), x = binary_xor(n_nationkey, 6), l = binary_shift_left(n_nationkey, 3), r = binary_shift_right(n_nationkey, 1), n = binary_not(n_nationkey), h = tohex(n_nationkey)", "SELECT n_nationkey AS k, n_nationkey & 6 AS a, n_nationkey | 6 AS o, xor(n_nationkey, 6) AS x, n_nationkey * 8 AS l, n_nationkey >> 1 AS r, -n_nationkey - 1 AS n, lower(printf('%x', n_nationkey)) AS h FROM nation")
case("ipv4_fns", "nation", "source | extend ip = format_ipv4(n_nationkey * 16909060) | project k = n_nationkey, ip, v = parse_ipv4(ip), p = ipv4_is_private(ip), r = ipv4_is_in_range(ip, '16.0.0.0/5'), c = ipv4_compare(ip, '10.20.30.40')",
     "SELECT k, ip, v, ip LIKE '10.%' OR ip LIKE '0.%' AS p, v BETWEEN 268435456 AND 402653183 AS r, CASE WHEN v < 169090600 THEN -1 WHEN v > 169090600 THEN 1 ELSE 0 END AS c FROM (SELECT n_nationkey AS k, v, (v // 16777216) || '.' || (v // 65536 % 256) || '.' || (v // 256 % 256) || '.' || (v % 256) AS ip FROM (SELECT n_nationkey, n_nationkey::BIGINT * 16909060 AS v FROM nation))")
case("text_fns", "part", "source | project p_partkey, u = toupper(p_name), n = strlen(p_name), s = substring(p_type, 1, 4), i = indexof(p_name, 'a'), r = replace(p_name, 'a', '_'), c = countof(p_name, 'e'), x = extract('([0-9]+)', 1, p_brand), v = reverse(p_type), t = trim('[A-Z]', p_type), z = strcat_delim('-', p_brand, p_size)",
     "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_type, 2, 4) AS s, strpos(p_name, 'a') - 1 AS i, replace(p_name, 'a', '_') AS r, length(p_name) - length(replace(p_name, 'e', '')) AS c, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS x, reverse(p_type) AS v, regexp_replace(regexp_replace(p_type, '^([A-Z])+', ''), '([A-Z])+$', '') AS t, p_brand || '-' || p_size AS z FROM part")
case("set_fns", "conversations", "source | summarize a = make_set(turn) by conv_id | extend b = pack_array(0, 1, 2, 9) | project conv_id, u = array_sum(set_union(a, b)), i = array_length(set_intersect(a, b)), d = array_length(set_difference(b, a)), f = array_index_of(array_sort_asc(a), 1)",
     "SELECT conv_id, CAST(list_sum(list_distinct(list_concat(a, [0, 1, 2, 9]))) AS BIGINT) AS u, len(list_intersect(a, [0, 1, 2, 9])) AS i, len(list_filter([0, 1, 2, 9], lambda x: NOT list_contains(a, x))) AS d, coalesce(list_position(list_sort(a), 1) - 1, -1) AS f FROM (SELECT conv_id, list_distinct(list(turn)) AS a FROM conversations GROUP BY ALL)")
case("url_fns", "pages", "source | extend u = parse_url(url) | project page_id, h = tostring(u.Host), p = tostring(u.Path), f = tostring(u.Fragment), e = url_encode_component(url), d = url_decode(url_encode(url))",
     "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '#(.*)$', 1) AS f, replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS e, url AS d FROM pages")
case("conditions", "customer", "source | project c_custkey, a = case(c_acctbal < 0, 'debt', c_acctbal < 1000, 'low', 'high'), b = coalesce(null, '', c_mktsegment), m = max_of(c_custkey, 100, 7), l = min_of(c_acctbal, 10), n = isnull(c_name), g = gettype(c_acctbal), t = tostring(c_nationkey), i = toint('12.9')",
     "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS a, c_mktsegment AS b, greatest(c_custkey, 100, 7) AS m, least(c_acctbal, 10) AS l, c_name IS NULL AS n, 'real' AS g, CAST(c_nationkey AS VARCHAR) AS t, 12 AS i FROM customer")

# --- more operators and their other names
case("negations", "part", "source | filter p_size != 24 and not(p_type =~ 'economy') | project p_partkey, a = p_name has_cs 'widget', b = p_name !has 'cold', c = p_name contains_cs 'Wid', d = p_size !in (1, 2, 3), e = p_type !~ 'STANDARD', f = p_name !startswith 'c', g = p_name !endswith_cs 't', h = p_name !contains_cs 'x' | order by p_partkey asc | limit 100",
     "SELECT p_partkey, regexp_matches(p_name, '(^|[^A-Za-z0-9])widget($|[^A-Za-z0-9])') AS a, NOT regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])cold($|[^A-Za-z0-9])') AS b, contains(p_name, 'Wid') AS c, p_size NOT IN (1, 2, 3) AS d, lower(p_type) <> 'standard' AS e, NOT starts_with(lower(p_name), 'c') AS f, NOT ends_with(p_name, 't') AS g, NOT contains(p_name, 'x') AS h FROM part WHERE p_size <> 24 AND lower(p_type) <> 'economy' ORDER BY p_partkey LIMIT 100")
case("matches_column", "part", "source | project p_partkey, m = p_name matches regex strcat('^', substring(p_name, 0, 2), '.*t$'), bad = isnull(p_name matches regex strcat('(', p_type))", "SELECT p_partkey, ends_with(p_name, 't') AS m, true AS bad FROM part")
case("parse_relaxed", "part", "source | parse kind=relaxed p_brand with 'Brand#' n:long | project p_partkey, n", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, 'Brand#(.*)', 1) AS BIGINT) AS n FROM part")
case("mvexpand_words", "part", "source | mvexpand w = split(p_name, ' ') | project p_partkey, w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
case("mv_expand_limit", "documents", "source | mv-expand with_itemindex=i w = split(text, ' ') limit 5 | project doc_id, i, w", "SELECT doc_id, unnest(range(0, least(len(w), 5))) AS i, unnest(w[1:5]) AS w FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)", "record", "doc_id")
case("let_range", "nation", "let T = range n_regionkey from 0 to 2 step 1; source | join kind=inner T on n_regionkey | project n_nationkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <= 2")
case("range_dates", "region", "range d from todatetime('2021-01-01') to todatetime('2021-03-01') step 7d | project s = format_datetime(d, 'yyyy-MM-dd')", "SELECT strftime(unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2021-03-01', INTERVAL 7 DAY)), '%Y-%m-%d') AS s")
case("make_list_order", "orders", "source | sort by o_orderkey asc | summarize l = make_list(o_orderkey) by o_orderstatus | project o_orderstatus, l = strcat_array(l, ',')", "SELECT o_orderstatus, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS l FROM orders GROUP BY ALL")
case("take_any_first", "customer", "source | sort by c_custkey asc | summarize x = take_any(c_name) by c_nationkey", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS x FROM customer GROUP BY ALL")
case("sample_rows", "events", "source | project k = event_id | sample 100 | join kind=leftsemi (source | project k = event_id) on k | summarize n = count(), d = dcount(k)", "SELECT 100 AS n, 100 AS d")
case("sample_distinct_some", "orders", "source | sample-distinct 50 of o_custkey | join kind=leftsemi customer on o_custkey == c_custkey | summarize n = count(), d = dcount(o_custkey)", "SELECT 50 AS n, 50 AS d", tables=("customer",))
case("rightsemi_record", "nation", "source | join kind=rightsemi supplier on n_nationkey == s_nationkey | project s_suppkey", "SELECT s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey", "record", "n_nationkey", tables=("supplier",))
for _format in ("csv", "tsv", "scsv", "psv", "json", "multijson", "jsonl", "json-lines"):
    case(f"externaldata_{_format.replace('-', '_')}", "nation", f'externaldata(n_nationkey: long, n_name: string, n_regionkey: long)["{{path}}"] with (format="{_format}") | where n_nationkey > 2', "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 2", written=_format)
for _format in ("txt", "raw"):
    case(f"externaldata_{_format}", "nation", f'externaldata(line: string)["{{path}}"] with (format="{_format}")', "SELECT n_name AS line FROM nation", written=_format)
# --- the other functions
case("text_more", "part", "source | project p_partkey, l = tolower(p_brand), rs = replace_string(p_name, 'id', '_'), rr = replace_regex(p_name, '[aeiou]+', '.'), ir = indexof_regex(p_name, '[dg]+'), ts = trim_start('[A-Z]', p_type), te = trim_end('[0-9]+', p_brand), sc = strcmp(p_name, p_type), tr = translate('abc', 'xyz', p_name), ie = isempty(p_name), b = base64_encode_tostring(p_name), d = base64_decode_tostring(base64_encode_tostring(p_type)), xa = strcat_array(extract_all('([aeiou])', p_name), ''), cn = array_length(parse_csv(strcat(p_name, ',', p_type))), c1 = tostring(parse_csv(strcat(p_name, ',', p_type))[1]), a = isascii(p_name)",
     "SELECT p_partkey, lower(p_brand) AS l, replace(p_name, 'id', '_') AS rs, regexp_replace(p_name, '[aeiou]+', '.', 'g') AS rr, CASE WHEN regexp_matches(p_name, '[dg]') THEN strpos(p_name, regexp_extract(p_name, '[dg]+')) - 1 ELSE -1 END AS ir, regexp_replace(p_type, '^([A-Z])+', '') AS ts, regexp_replace(p_brand, '[0-9]+$', '') AS te, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS sc, translate(p_name, 'abc', 'xyz') AS tr, p_name = '' AS ie, base64(encode(p_name)) AS b, p_type AS d, array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') AS xa, 2 AS cn, p_type AS c1, true AS a FROM part")
case("conversions", "customer", "source | project c_custkey, r = toreal(tostring(c_acctbal)), d = todouble(c_custkey), b = tobool(iff(c_nationkey > 10, 'true', 'nope')), t = format_datetime(todatetime(strcat('2021-01-', iff(c_nationkey > 8, '15', '03'))), 'yyyy-MM-dd'), s = totimespan(strcat(tostring(c_nationkey), 'h')) / 1h, e = todouble(todecimal(tostring(c_acctbal))), g = toguid(strcat('1234567812341234123412345678', tostring(1000 + c_nationkey))), y = tolong(todynamic(strcat('{\"v\": ', tostring(c_nationkey), '}')).v), i = iif(c_acctbal < 0, 'debt', 'fine'), n = isnotnull(c_name), o = tolong(pack('k', c_custkey)['k'])",
     "SELECT c_custkey, c_acctbal AS r, CAST(c_custkey AS DOUBLE) AS d, CASE WHEN c_nationkey > 10 THEN true END AS b, CASE WHEN c_nationkey > 8 THEN '2021-01-15' ELSE '2021-01-03' END AS t, CAST(c_nationkey AS DOUBLE) AS s, c_acctbal AS e, '12345678-1234-1234-1234-12345678' || (1000 + c_nationkey) AS g, CAST(c_nationkey AS BIGINT) AS y, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS i, true AS n, c_custkey AS o FROM customer")
case("dates_more", "orders", "source | project o_orderkey, h = hourofday(o_orderdate), g = getmonth(o_orderdate), w = dayofweek(o_orderdate) / 1d, k = week_of_year(o_orderdate), sd = format_datetime(startofday(o_orderdate + 5h), 'yyyy-MM-dd HH:mm:ss'), sy = format_datetime(startofyear(o_orderdate), 'yyyy-MM-dd'), ed = format_datetime(endofday(o_orderdate), 'yyyy-MM-dd HH:mm:ss'), em = format_datetime(endofmonth(o_orderdate), 'yyyy-MM-dd HH:mm:ss'), mt = make_timespan(1, 30) / 1m, us = format_datetime(unixtime_seconds_todatetime(o_orderkey * 3600), 'yyyy-MM-dd HH:mm:ss'), um = format_datetime(unixtime_milliseconds_todatetime(o_orderkey * 3600000), 'yyyy-MM-dd HH:mm:ss'), uu = format_datetime(unixtime_microseconds_todatetime(o_orderkey * 3600000000), 'yyyy-MM-dd HH:mm:ss'), nw = (now() - o_orderdate) / 1d, ag = ago(365d) > o_orderdate",
     "SELECT o_orderkey, hour(o_orderdate) AS h, month(o_orderdate) AS g, CAST(dayofweek(o_orderdate) AS DOUBLE) AS w, weekofyear(o_orderdate) AS k, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS sd, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS sy, strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS ed, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS em, 90.0::DOUBLE AS mt, strftime(make_timestamp(o_orderkey * 3600000000), '%Y-%m-%d %H:%M:%S') AS us, strftime(make_timestamp(o_orderkey * 3600000000), '%Y-%m-%d %H:%M:%S') AS um, strftime(make_timestamp(o_orderkey * 3600000000), '%Y-%m-%d %H:%M:%S') AS uu, (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400 AS nw, o_orderdate < TIMESTAMP '1997-01-01' AS ag FROM orders", options=Options(now=datetime(1998, 1, 1, tzinfo=timezone.utc)))
case("array_more", "conversations", "source | summarize l = make_list(turn) by conv_id | extend a = array_sort_asc(l) | project conv_id, c = array_sum(array_concat(a, a)), s = strcat_array(array_slice(a, 1, 2), ','), p = array_length(array_split(a, 1)), d = strcat_array(array_sort_desc(l), ','), v = strcat_array(array_reverse(a), ','), rl = strcat_array(array_rotate_left(a, 1), ','), rr = strcat_array(array_rotate_right(a, 1), ',')",
     "SELECT conv_id, 2 * CAST(list_sum(a) AS BIGINT) AS c, array_to_string(a[2:3], ',') AS s, 2 AS p, array_to_string(list_reverse(a), ',') AS d, array_to_string(list_reverse(a), ',') AS v, array_to_string(list_concat(a[2:], a[1:1]), ',') AS rl, array_to_string(list_concat(a[len(a):], a[1:len(a) - 1]), ',') AS rr FROM (SELECT conv_id, list_sort(list(turn)) AS a FROM conversations GROUP BY ALL)")
case("bags", "events", "source | extend e = parse_json(props) | project event_id, k = strcat_array(bag_keys(e), ','), m = tolong(bag_merge(e, pack('z', event_id)).z), o = tolong(bag_merge(pack('k', event_id), e).k), r = array_length(bag_keys(bag_remove_keys(bag_merge(e, pack('z', 1)), pack_array('k')))), i = tolong(e['k'])",
     "SELECT event_id, 'k' AS k, event_id AS m, event_id AS o, 1 AS r, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i FROM events")
case("math_more", "lineitem", "source | project l_orderkey, l_linenumber, a = round(abs(l_discount - 0.05), 6), e = round(exp(l_tax), 6), e2 = round(exp2(l_linenumber), 6), e10 = round(exp10(l_tax), 6), ln = round(log(l_quantity), 6), l2 = round(log2(l_quantity), 6), l10 = round(log10(l_quantity), 6), n = isnan(l_tax), i = isinf(l_tax), f = isfinite(l_tax), at2 = round(atan2(l_tax, l_discount + 1), 6), s = round(sin(l_quantity), 6), c = round(cos(l_quantity), 6), t = round(tan(l_tax), 6), asn = round(asin(l_tax), 6), acs = round(acos(l_tax), 6), atn = round(atan(l_quantity), 6), dg = round(degrees(l_tax), 6), rd = round(radians(l_quantity), 6), g = round(gamma(l_linenumber), 6), lg = round(log_gamma(l_quantity), 6)",
     "SELECT l_orderkey, l_linenumber, round(abs(l_discount - 0.05::DOUBLE), 6) AS a, round(exp(l_tax), 6) AS e, round(pow(2.0::DOUBLE, l_linenumber), 6) AS e2, round(pow(10.0::DOUBLE, l_tax), 6) AS e10, round(ln(l_quantity), 6) AS ln, round(log2(l_quantity), 6) AS l2, round(log10(l_quantity), 6) AS l10, isnan(l_tax) AS n, isinf(l_tax) AS i, isfinite(l_tax) AS f, round(atan2(l_tax, l_discount + 1), 6) AS at2, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_tax), 6) AS t, round(asin(l_tax), 6) AS asn, round(acos(l_tax), 6) AS acs, round(atan(l_quantity), 6) AS atn, round(degrees(l_tax), 6) AS dg, round(radians(l_quantity), 6) AS rd, round(gamma(l_linenumber), 6) AS g, round(lgamma(l_quantity), 6) AS lg FROM lineitem")
case("network_more", "nation", "source | project k = n_nationkey, s = ipv4_netmask_suffix(strcat(format_ipv4(n_nationkey * 16909060), '/', tostring(n_nationkey))), w = ipv4_netmask_suffix(format_ipv4(n_nationkey))", "SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) AS s, 32 AS w FROM nation")
case("url_more", "pages", "source | extend q = parse_urlquery(url) | project page_id, p = tostring(q['Query Parameters'].page), r = tostring(q['Query Parameters'].ref), d = url_decode(strcat('100%+', url))",
     "SELECT page_id, regexp_extract(q, '(^|&)page=([^&]*)', 2) AS p, regexp_extract(q, '(^|&)ref=([^&]*)', 2) AS r, '100% ' || url AS d FROM (SELECT page_id, url, substr(url, strpos(url, '?') + 1) AS q FROM pages)")
case("cef_events", "events", "source | extend c = parse_cef_dictionary(strcat('CEF:0|v|p|1|', tostring(event_id), '|', event_type, '|5|user=', tostring(user_id), ' act=a b')), h = parse_cef_dictionary(strcat('CEF:0|', event_type)) | project event_id, n = tostring(c.Name), g = tolong(c.SignatureId), u = tolong(c.Extension.user), a = tostring(c.Extension.act), v = tostring(h.DeviceVendor), s = tostring(h.Severity)",
     "SELECT event_id, event_type AS n, event_id AS g, user_id AS u, 'a b' AS a, event_type AS v, '' AS s FROM events")
case("xml_events", "events", "source | extend x = parse_xml(strcat('<e id=\"', tostring(event_id), '\"><t>', event_type, '</t><u/></e>')) | project event_id, i = tolong(x.e['@id']), t = tostring(x.e.t), u = isnull(x.e.u)", "SELECT event_id, event_id AS i, event_type AS t, true AS u FROM events")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: c.run for name, c in CASES.items()}


def oracles() -> dict[str, str]:
    return {name: c.sql for name, c in CASES.items() if c.sql}
