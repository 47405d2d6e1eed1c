"""Every scalar function, by name."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest

import sluice
from sluice import Options
from sluice.functions import FUNCTIONS

from .test_operators import same

NOW = datetime(2021, 6, 1, 12, tzinfo=timezone.utc)
D = "todatetime('2021-02-10T13:14:15.5Z')"
F = "format_datetime({}, 'yyyy-MM-dd HH:mm:ss')"
RECORD = {"s": "Hello World", "n": None, "x": 5, "f": 2.5, "b": True, "a": [3, 1, 2], "w": ["b", None, "a", 2], "o": {"k": 1, "m": "v"}, "p": {"k": 9, "z": [1]}, "e": "", "j": '{"q": [1, {"r": "t"}]}'}
EXPECTED = {
    # text
    "strcat(s, 1, n, true, f)": "Hello World1true2.5", "strcat_delim('-', 'a', n, 1)": "a--1", "strcat_array(a, '-')": "3-1-2", "strcat_array(w, ',')": "b,,a,2", "strcat_array(s, ',')": None, "strlen(s)": 11, "strlen(n)": None, "toupper(s)": "HELLO WORLD", "tolower(s)": "hello world",
    "substring(s, 0, 3)": "Hel", "substring(s, 6)": "World", "substring(s, -3)": "rld", "substring(s, -99, 2)": "He", "substring(s, 99)": "", "split('a.b..c', '.')": ["a", "b", "", "c"], "split('a@b', '@', 1)": "b", "split('a@b', '@', 7)": None, "split('a@b', '@', -1)": "b", "split(s, '')": None, "split(n, ',')": [""],
    "replace('a.b', '.', '$1')": "a$1b", "replace_string('aaa', 'a', 'b')": "bbb", "replace_regex('a1b22', '([0-9]+)', '<\\\\1$>')": "a<1$>b<22$>", "replace_regex('a', '(', 'x')": None, "extract('o (W)', 1, s)": "W", "extract('zz', 0, s)": None, "extract('H(x)?', 1, s)": None, "extract('(', 1, s)": None, "extract('(x*)H', 1, s)": "",
    "extract_all('[a-z]o', s)": ["lo"], "extract_all('(l)(.)', s)": [["l", "l"], ["l", "d"]], "extract_all('(o)', s)": ["o", "o"], "indexof(s, 'World')": 6, "indexof(s, 'x')": -1, "indexof(n, '')": 0, "indexof_regex('ab12', '[0-9]+')": 2, "indexof_regex('ab12ab', 'a', 1)": 4, "indexof_regex(n, 'a')": -1, "countof('aaaa', 'aa')": 2, "countof(s, 'z')": 0,
    "isempty(n)": True, "isempty(s)": False, "isnotempty(e)": False, "trim('x', 'xxhixx')": "hi", "trim_start('[xy]', 'xyhix')": "hix", "trim_end('x', 'xhixx')": "xhi", "reverse(s)": "dlroW olleH", "reverse(a)": [2, 1, 3], "strcmp('a', 'b')": -1, "strcmp('b', 'a')": 1, "strcmp('a', 'a')": 0, "translate('lo', '0', s)": "He00 Wr0d" if False else "He00 Wr0d",
    "parse_csv('a,\"b,c\",d')": ["a", "b,c", "d"], "parse_csv(n)": [], "base64_encodestring('hi')": "aGk=", "base64_encode_tostring('é')": "w6k=", "base64_decodestring('aGk=')": "hi", "base64_decode_tostring('!')": None,
    # conversion
    "tostring(n)": "", "tostring(b)": "true", "tostring(2.0)": "2.0", "tostring(12345678.5)": "12345678.5", "tostring(o.k)": "1", "tostring(o.m)": "v", "toint('3.9')": 3, "toint('x')": None, "toint('-2e3')": -2000, "tolong(true)": 1, "tolong(f)": 2, "toreal('1.5')": 1.5, "toreal('5d')": None, "todouble(x)": 5.0, "tobool('TRUE')": True, "tobool('0')": False, "tobool(2)": True, "tobool('x')": None,
    "todatetime('2021-01-02') == make_datetime(2021, 1, 2)": True, "todatetime('nope')": None, "todatetime('2021-01-02T03:04:05+02:00')": datetime(2021, 1, 2, 1, 4, 5, tzinfo=timezone.utc), "totimespan('2h')": timedelta(hours=2), "totimespan('1.5')": timedelta(days=1.5), "totimespan('500ms')": timedelta(milliseconds=500), "totimespan('5microsecond')": None,
    "toguid('12345678123412341234123456789ABC')": "12345678-1234-1234-1234-123456789abc", "toguid('x')": None, "todecimal('1.25')": Decimal("1.25"), "todecimal('x')": None, "tohex(255)": "ff", "tohex(-1)": "f" * 16, "todynamic(j).q[1].r": "t", "parse_json(j).q[0]": 1, "parse_json('{bad')": None, "parse_json('null')": None, "parse_json(o).k": 1,
    # dates
    f"getyear({D})": 2021, "getmonth('2021-02-10')": 2, f"monthofyear({D})": 2, f"dayofmonth({D})": 10, f"hourofday({D})": 13, f"dayofyear({D})": 41, f"dayofweek({D}) / 1d": 3.0, "weekofyear('2021-01-04')": 1, "week_of_year('2021-01-03')": 53,
    F.format(f"startofday({D})"): "2021-02-10 00:00:00", F.format(f"startofmonth({D})"): "2021-02-01 00:00:00", F.format(f"startofyear({D})"): "2021-01-01 00:00:00", F.format(f"endofday({D})"): "2021-02-10 23:59:59", F.format(f"endofmonth({D})"): "2021-02-28 23:59:59", F.format(f"endofyear({D})"): "2021-12-31 23:59:59",
    f"endofday({D})": datetime(2021, 2, 10, 23, 59, 59, 999999, tzinfo=timezone.utc), "datetime_add('month', 1, '2021-01-31')": None, "datetime_add('month', -2, '2021-01-15')": datetime(2020, 11, 15, tzinfo=timezone.utc), "datetime_add('year', 1, '2020-02-29')": None, "datetime_add('week', 1, '2021-01-01')": datetime(2021, 1, 8, tzinfo=timezone.utc), f"datetime_add('month', 1, {D})": datetime(2021, 3, 10, 13, 14, 15, 500000, tzinfo=timezone.utc),
    "datetime_add('eon', 1, '2021-01-01')": None, "datetime_diff('day', '2021-01-11', '2021-01-01')": 10, "datetime_diff('hour', '2021-01-01', '2021-01-01T00:30:00')": -1, "datetime_diff('month', '2021-03-01', '2021-01-31')": 2, "datetime_diff('year', '2021-01-01', '2020-12-31')": 1, "datetime_diff('eon', '2021-01-01', '2020-12-31')": None, f"datetime_part('minute', {D})": 14, f"datetime_part('eon', {D})": None,
    f"format_datetime({D}, 'dd/MM/yyyy HH-mm-ss x')": "10/02/2021 13-14-15 x", "make_datetime(2021, 2, 30)": None, "make_datetime(2021, 3, 5, 9, 30, 1.9)": datetime(2021, 3, 5, 9, 30, 1, tzinfo=timezone.utc), "make_timespan(1, 30)": timedelta(minutes=90), "make_timespan(0, 0, 1.5)": timedelta(seconds=1.5),
    "unixtime_seconds_todatetime(86400)": datetime(1970, 1, 2, tzinfo=timezone.utc), "unixtime_milliseconds_todatetime(1500)": datetime(1970, 1, 1, 0, 0, 1, 500000, tzinfo=timezone.utc), "unixtime_microseconds_todatetime(1)": datetime(1970, 1, 1, 0, 0, 0, 1, tzinfo=timezone.utc), "now()": NOW, "ago(2h)": NOW - timedelta(hours=2), "ago(5)": None,
    # collections
    "parse_xml('<r><i>h</i><i>g</i><k a=\"1\">t<u/></k></r>').r": {"i": ["h", "g"], "k": {"@a": "1", "u": None, "#text": "t"}}, "parse_xml('<bad')": None, "pack('a', 1, 'b', 'x', 'a', 2)": {"a": 2, "b": "x"}, "pack_array(1, 'x', n)": [1, "x", None], "pack_array(1, 2)": [1, 2], "array_length(a)": 3, "array_length(s)": 11, "array_length(x)": None, "array_concat(a, 9, n, w)": [3, 1, 2, 9, "b", None, "a", 2],
    "array_index_of(a, 1)": 1, "array_index_of(w, 'a')": 2, "array_index_of(a, 7)": -1, "array_index_of(x, 7)": None, "array_slice(a, 1, 2)": [1, 2], "array_slice(a, 0, -1)": [], "array_slice(a, -2, 9)": [1, 2], "array_split(a, 1)": [[3], [1, 2]], "array_split(a, pack_array(1, 2))": [[3], [1], [2]], "array_sort_asc(a)": [1, 2, 3], "array_sort_asc(w)": [2, "a", "b", None], "array_sort_desc(w)": [None, "b", "a", 2],
    "array_sort_asc(x)": None, "array_reverse(a)": [2, 1, 3], "array_reverse(s)": None, "array_sum(a)": 6, "array_sum(w)": 2, "array_sum(pack_array(1, 2.5))": 3.5, "array_rotate_left(a, 1)": [1, 2, 3], "array_rotate_right(a, 1)": [2, 3, 1], "array_rotate_left(a, -4)": [2, 3, 1], "bag_keys(o)": ["k", "m"], "bag_keys(x)": None, "bag_merge(o, p)": {"k": 1, "m": "v", "z": [1]}, "bag_remove_keys(o, pack_array('k'))": {"m": "v"}, "bag_remove_keys(x, a)": 5,
    "set_union(a, pack_array(2, 9))": [3, 1, 2, 9], "set_intersect(a, pack_array(1, 3))": [3, 1], "set_intersect(a, s)": [3, 1, 2], "set_difference(a, pack_array(1))": [3, 2], "set_union(w, w)": ["b", None, "a", 2],
    # numbers
    "abs(-3)": 3, "abs('-2.5')": 2.5, "abs(b)": None, "ceiling(7.1)": 8, "floor(7.8)": 7, "floor(-7.5)": -8, "floor(17, 5)": 15, "floor(1.7, 0.5)": 1.5, "floor(1, 0)": None, "bin(-3, 5)": -5, "bin(todatetime('2021-01-01'), 1)": None, "round(2.5)": 2, "round(3.14159, 2)": 3.14, "sign(-5)": -1, "sign(0.0)": 0, "pow(2, 10)": 1024, "pow(2.0, 0.5)": 2**0.5, "sqrt(16)": 4.0, "sqrt(-1)": None, "exp(1)": math.e, "exp2(3)": 8.0, "exp10(2)": 100.0,
    "log(1)": 0.0, "log(0)": None, "log2(8)": 3.0, "log10(1000)": 3.0, "isnan(toreal('nan'))": True, "isnan(x)": False, "isinf(toreal('-inf'))": True, "isfinite(f)": True, "isfinite(s)": False, "atan2(1, 1)": math.pi / 4, "gcd(12, 18)": 6, "gcd(0, 5)": 5, "lcm(4, 6)": 12, "lcm(0, 6)": 0, "sin(0)": 0.0, "cos(0)": 1.0, "tan(0)": 0.0, "asin(1)": math.pi / 2, "asin(2)": None, "acos(1)": 0.0, "atan(1)": math.pi / 4, "degrees(3.141592653589793)": 180.0, "radians(180)": math.pi, "gamma(5)": 24.0, "gamma(0)": None, "log_gamma(1)": 0.0,
    "binary_and(12, 10)": 8, "binary_or(12, 10)": 14, "binary_xor(12, 10)": 6, "binary_not(5)": -6, "binary_shift_left(1, 4)": 16, "binary_shift_right(-8, 1)": -4,
    # conditions
    "iff(x > 3, 'y', 'n')": "y", "iif(n, 1, 2)": 2, "iff(x, 1, 'a')": "a", "case(x < 1, 'a', x < 9, 'b', 'c')": "b", "case(x < 1, 'a')": None, "coalesce(n, '', 'z')": "z", "coalesce(n, x)": 5, "max_of(1, n, 7)": 7, "min_of(2.5, 3)": 2.5, "isnull(n)": True, "isnotnull(x)": True, "gettype(n)": "null", "gettype(x)": "long", "gettype(f)": "real", "gettype(b)": "bool", "gettype(s)": "string", "gettype(a)": "array", "gettype(o)": "dynamic", f"gettype({D})": "string", "isascii(s)": True, "isascii('é')": False, "isascii(x)": False,
    # network
    "hash_sha256('a')": hashlib.sha256(b"a").hexdigest(), "hash_md5('abc')": hashlib.md5(b"abc").hexdigest(), "hash_sha1(n)": hashlib.sha1(b"").hexdigest(), "url_encode('a b/*~')": "a+b%2F%2A~", "url_encode_component('a b/c')": "a%20b%2Fc", "url_decode('a%20b+c')": "a b c", "url_decode('%zz')": "%zz",
    "parse_url('https://u:p@Host.com:8080/a/b?x=1&y=2#frag')": {"Scheme": "https", "Host": "host.com", "Port": "8080", "Path": "/a/b", "Username": "u", "Password": "p", "Query Parameters": {"x": "1", "y": "2"}, "Fragment": "frag"}, "parse_urlquery('a=1&a=2&b=')": {"Query Parameters": {"a": "1"}},
    "parse_ipv4('1.2.3.4')": 16909060, "parse_ipv4('1.2.3.4/24')": 16909060, "parse_ipv4('1.2.3')": None, "parse_ipv4('256.1.1.1')": None, "format_ipv4('1.2.3.4', 24)": "1.2.3.0", "format_ipv4(16909060)": "1.2.3.4", "ipv4_is_private('10.0.0.1')": True, "ipv4_is_private('8.8.8.8')": False, "ipv4_is_private('x')": None, "ipv4_netmask_suffix('1.2.3.4/24')": 24, "ipv4_netmask_suffix('1.2.3.4')": 32, "ipv4_is_in_range('10.0.0.5', '10.0.0.0/24')": True, "ipv4_is_in_range('10.0.1.5', '10.0.0.0/24')": False, "ipv4_compare('1.2.3.4', '1.2.3.5')": -1, "ipv4_compare('1.2.3.4/24', '1.2.3.5/24')": 0, "ipv4_compare('1.2.3.4', '1.2.3.5', 24)": 0,
    "parse_cef_dictionary('CEF:0|V|P|1.0|100|Some Event|5|src=1.2.3.4 msg=a b')": {"Version": "0", "DeviceVendor": "V", "DeviceProduct": "P", "DeviceVersion": "1.0", "SignatureId": "100", "Name": "Some Event", "Severity": "5", "Extension": {"src": "1.2.3.4", "msg": "a b"}}, "parse_cef_dictionary('a=1 b=2')": {"Extension": {"a": "1", "b": "2"}},
    "parse_urlquery('https://x/y?a=1&b=2')": {"Query Parameters": {"a": "1", "b": "2"}}, "parse_cef_dictionary('CEF:0|a|b|1|2|n|5|')": {"Version": "0", "DeviceVendor": "a", "DeviceProduct": "b", "DeviceVersion": "1", "SignatureId": "2", "Name": "n", "Severity": "5", "Extension": {}},
    "parse_cef_dictionary('CEF:0|a')": {"Version": "0", "DeviceVendor": "a", "DeviceProduct": "", "DeviceVersion": "", "SignatureId": "", "Name": "", "Severity": "", "Extension": {}}, "parse_cef_dictionary('a=b c d=e=f')": {"Extension": {"a": "b c", "d": "e=f"}}, "parse_cef_dictionary(n)": {"Extension": {}},
    "parse_xml('<a/>')": {"a": None}, "url_decode('100%+%zz%41%')": "100% %zzA%", "s matches regex strcat('W', 'o')": True, "s matches regex strcat(e, '(')": None,
    "columnifexists('x', 0)": 5, "columnifexists('no', 'd')": "d", "STRLEN(s)": 11, "strlen()": None,
}
CHUNK = 24
CHUNKS = [list(EXPECTED)[i : i + CHUNK] for i in range(0, len(EXPECTED), CHUNK)]


@pytest.mark.parametrize("chunk", range(len(CHUNKS)))
def test_values(spark, chunk):
    names = CHUNKS[chunk]
    query = sluice.compile("source | project " + ", ".join(f"c{i} = {e}" for i, e in enumerate(names)), options=Options(now=NOW))
    (got,) = query.transform(RECORD)
    wrong = {e: got[f"c{i}"] for i, e in enumerate(names) if not same(got[f"c{i}"], EXPECTED[e])}
    assert not wrong


def test_every_function_has_a_case():
    text = " ".join(EXPECTED).lower()
    assert not [name for name in FUNCTIONS if f"{name}(" not in text]
    assert len(FUNCTIONS) >= 149


def test_greatest_common_divisors(spark):
    """Of neighbours in Fibonacci's series, which need the most steps, and of large and negative numbers and zeros."""
    pairs, a, b = [(0, 0), (0, 7), (7, 0), (-12, 18), (2**62, 2**61), (2**63 - 1, 3), (6, 4)], 1, 1
    while b < 2**62:
        pairs += [(a, b), (b, a), (2 * a, 2 * b)]
        a, b = b, a + b
    frame = spark.createDataFrame([(x, y) for x, y in pairs], "x long, y long")
    got = sluice.compile("source | project x, y, g = gcd(x, y)").apply(frame, "table").collect()
    assert [r.g for r in got] == [math.gcd(r.x, r.y) for r in got]


def test_user_functions(spark):
    @sluice.function("Twice")
    def twice(x):
        return [x, x]

    @sluice.function("fails", returns="long")
    def fails(x):
        raise ValueError(x)

    query = "source | project a = twice(x), b = fails(x), c = TWICE(o)[1].k"
    assert sluice.compile(query).transform(RECORD) == [{"a": [5, 5], "b": None, "c": 1}]
    with pytest.raises(sluice.KqlEvalError):
        sluice.compile(query, options=Options(strict_types=True)).transform(RECORD)
    for name in ("twice", "fails"):
        FUNCTIONS.pop(name)
