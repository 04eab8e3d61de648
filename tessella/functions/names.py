"""Functions of the three dialects as Spark SQL templates.

{0}, {1} and so on are arguments, {*} all of them. A list of templates is chosen from by the number of arguments,
the first for the smallest number that fits. Names that are not here mean the same in Spark.
"""

from __future__ import annotations

NUMERIC_PREFIX = r"cast(coalesce(nullif(regexp_extract(cast({0} as string), '^\\s*([+-]?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?)', 1), ''), '0') as double)"
NOW, TODAY = "current_timestamp()", "current_date()"
CLOCK = "date_format(current_timestamp(), 'HH:mm:ss')"
IPV4 = r"'^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'"
IPV6 = r"'^([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$'"
TRUNCATE = "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))"
PERIOD = "to_date(concat(cast({0} as string), '01'), 'yyyyMMdd')"

SUNDAY = "date_sub({0}, dayofweek({0}) - 1)"
TIME_TEXT = "make_dt_interval(0, cast(split({1}, ':')[0] as int), cast(split({1}, ':')[1] as int), cast(split({1}, ':')[2] as decimal(18, 6)))"
SECONDS_TEXT = "concat(if({0} < 0, '-', ''), format_string('%02d:%02d:%02d', cast(abs({0}) div 3600 as int), cast(abs({0}) div 60 % 60 as int), cast(abs({0}) % 60 as int)))"
GCD = "aggregate(sequence(1, 100), named_struct('a', abs(cast({0} as bigint)), 'b', abs(cast({1} as bigint))), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a)"
# Formats by kind and region.
GET_FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}

COMMON = {
    "ucase": "upper({0})", "lcase": "lower({0})", "char_length": "length({0})", "character_length": "length({0})", "current_user": "current_user()", "session_user": "current_user()", "user": "current_user()",
    "localtime": "localtimestamp()", "localtimestamp": "localtimestamp()", "current_date": TODAY, "current_timestamp": NOW, "current_time": CLOCK, "now": NOW, "sysdate": NOW, "systimestamp": NOW,
    "cume_dist": "cume_dist()", "ceiling": "ceil({0})", "power": "power({0}, {1})", "pow": "power({0}, {1})", "std": "stddev_pop({0})", "nvl": "coalesce({0}, {1})", "nvl2": "CASE WHEN {0} IS NOT NULL THEN {1} ELSE {2} END",
    "bit_length": "bit_length({0})", "json_valid": "CASE WHEN {0} IS NULL THEN NULL ELSE cast(try_parse_json({0}) IS NOT NULL AS int) END",
    "xmlcomment": "concat('<!--', {0}, '-->')", "xmlconcat": "concat_ws('', {*})", "json_value": "get_json_object({0}, {1})", "json_query": "get_json_object({0}, {1})",
    
    "st_x": "({0}).x", "st_y": "({0}).y", "st_distance": "sqrt(power(({0}).x - ({1}).x, 2) + power(({0}).y - ({1}).y, 2))", "st_astext": "concat('POINT(', ({0}).x, ' ', ({0}).y, ')')",
    "approx_count_distinct": "approx_count_distinct({0})", "greatest": "greatest({*})", "least": "least({*})",
}

MYSQL = {
    "length": "octet_length({0})", "octet_length": "octet_length({0})", "log": ["ln({0})", "log({0}, {1})"], "ifnull": "coalesce({0}, {1})", "if": "if({0}, {1}, {2})", "database": "current_database()", "schema": "current_database()",
    "adddate": "date_add({0}, {1})", "subdate": "date_sub({0}, {1})", "datediff": "datediff({0}, {1})", "date": "to_date({0})", "time": "date_format({0}, 'HH:mm:ss')", "dayname": "date_format({0}, 'EEEE')", "monthname": "date_format({0}, 'MMMM')",
    "dayofmonth": "day({0})", "curdate": TODAY, "utc_date": TODAY, "curtime": CLOCK, "utc_time": CLOCK, "utc_timestamp": NOW, "microsecond": "cast(date_part('SECOND', {0}) * 1000000 as int) % 1000000",
    "last_day": "last_day({0})", "makedate": "date_add(make_date({0}, 1, 1), {1} - 1)", "maketime": "format_string('%02d:%02d:%02d', cast({0} as int), cast({1} as int), cast({2} as int))", "sec_to_time": SECONDS_TEXT,
    "time_to_sec": "hour({0}) * 3600 + minute({0}) * 60 + second({0})", "to_days": "datediff({0}, DATE'1970-01-01') + 719528", "from_days": "date_add(DATE'1970-01-01', {0} - 719528)", "to_seconds": "(datediff({0}, DATE'1970-01-01') + 719528) * 86400L + hour({0}) * 3600 + minute({0}) * 60 + second({0})",
    "period_add": "cast(date_format(add_months(" + PERIOD + ", {1}), 'yyyyMM') as int)", "period_diff": "cast(months_between(" + PERIOD + ", " + PERIOD.replace("{0}", "{1}") + ") as int)",
    "weekofyear": "weekofyear({0})", "week": "cast(floor((dayofyear({0}) + 6 - (dayofweek({0}) - 1)) / 7) as int)", "weekday": "weekday({0})", "yearweek": f"(year({SUNDAY}) * 100 + cast(floor((dayofyear({SUNDAY}) + 6) / 7) as int))", "quarter": "quarter({0})",
    "unix_timestamp": ["unix_timestamp()", "unix_timestamp({0})"], "convert_tz": "convert_timezone({1}, {2}, {0})", "timediff": "(" + SECONDS_TEXT.replace("{0}", "((unix_micros(cast({0} as timestamp)) - unix_micros(cast({1} as timestamp))) div 1000000)") + " || if((unix_micros(cast({0} as timestamp)) - unix_micros(cast({1} as timestamp))) % 1000000 = 0, '', format_string('.%06d', abs((unix_micros(cast({0} as timestamp)) - unix_micros(cast({1} as timestamp))) % 1000000))))", "addtime": "{0} + " + TIME_TEXT, "subtime": "{0} - " + TIME_TEXT, "system_user": "current_user()", "uuid_short": "monotonically_increasing_id()", "json_storage_free": "CASE WHEN try_parse_json({0}) IS NOT NULL THEN 0 END",
    "is_ipv4_compat": "cast(regexp_like(hex({0}), '^0{24}[0-9A-F]{8}$') AND NOT regexp_like(hex({0}), '^0{31}[01]$') as int)", "is_ipv4_mapped": "cast(regexp_like(hex({0}), '^0{20}FFFF[0-9A-F]{8}$') as int)",
    "conv": "conv({0}, {1}, {2})", "bin": "bin({0})", "oct": "conv({0}, 10, 8)", "hex": "hex({0})", "truncate": TRUNCATE, "rand": ["rand()", "rand({0})"], "mod": "({0} % {1})", "crc32": "crc32({0})",
    "elt": "elt({*})", "field": "array_position(array({rest}), {0})", "find_in_set": "find_in_set({0}, {1})", "insert": "CASE WHEN {1} < 1 OR {1} > length({0}) THEN {0} ELSE overlay({0} PLACING {3} FROM {1} FOR {2}) END",
    "instr": "instr({0}, {1})", "locate": ["locate({0}, {1})", "locate({0}, {1})", "locate({0}, {1}, {2})"], "position": "position({0}, {1})", "mid": "substring({*})", "substr": "substring({*})", "substring": "substring({*})", "ord": "ascii({0})",
    "quote": "concat('''', replace(replace({0}, '\\\\', '\\\\\\\\'), '''', '\\\\'''), '''')", "strcmp": "CASE WHEN {0} = {1} THEN 0 WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 END", "to_base64": "base64(cast({0} as binary))", "from_base64": "cast(unbase64({0}) as string)",
    "unhex": "unhex({0})", "uuid": "uuid()", "format": "format_number({0}, {1})", "regexp_like": "regexp_like({0}, {1})", "regexp_replace": "regexp_replace({0}, {1}, {2})", "regexp_substr": "regexp_substr({0}, {1})", "regexp_instr": "regexp_instr({0}, {1})",
    "group_concat": None, "bit_and": "coalesce(bit_and({0}), -1)", "bit_or": "coalesce(bit_or({0}), 0)", "bit_xor": "coalesce(bit_xor({0}), 0)", "stddev": "stddev_pop({0})", "variance": "var_pop({0})", "std": "stddev_pop({0})",
    "inet_aton": "cast(split({0}, '[.]')[0] as bigint) * 16777216 + cast(split({0}, '[.]')[1] as bigint) * 65536 + cast(split({0}, '[.]')[2] as bigint) * 256 + cast(split({0}, '[.]')[3] as bigint)",
    "inet_ntoa": "concat_ws('.', shiftright({0}, 24) & 255, shiftright({0}, 16) & 255, shiftright({0}, 8) & 255, {0} & 255)", "is_ipv4": "cast(regexp_like({0}, " + IPV4 + ") as int)", "is_ipv6": "cast(regexp_like({0}, " + IPV6 + ") as int)",
    "json_unquote": "CASE WHEN startswith({0}, '\"') THEN get_json_object(concat('{\"v\":', {0}, '}'), '$.v') ELSE {0} END", "json_length": "coalesce(json_array_length({0}), size(json_object_keys({0})))", "json_keys": "concat('[\"', array_join(json_object_keys({0}), '\", \"'), '\"]')", "json_contains_path": "cast(get_json_object({0}, {2}) IS NOT NULL as int)",
    "json_quote": "substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)", "json_object": None, "json_type": "CASE regexp_extract(upper(schema_of_variant(parse_json({0}))), '^[A-Z]+', 0) WHEN 'BIGINT' THEN 'INTEGER' WHEN 'VOID' THEN 'NULL' WHEN 'DECIMAL' THEN 'DOUBLE' ELSE regexp_extract(upper(schema_of_variant(parse_json({0}))), '^[A-Z]+', 0) END", "json_pretty": "tessella_json_pretty({0})", "json_overlaps": "cast(arrays_overlap(from_json({0}, 'array<string>'), from_json({1}, 'array<string>')) as int)",
    "json_contains": "cast(array_contains(from_json({0}, 'array<string>'), {1}) as int)", "point": "named_struct('x', cast({0} as double), 'y', cast({1} as double))", "st_point": "named_struct('x', cast({0} as double), 'y', cast({1} as double))", "x": "({0}).x", "y": "({0}).y",
    "extractvalue": "xpath_string({0}, {1})", "any_value": "any_value({0})", "char": "concat({chr})", "charset": "'utf8mb4'", "collation": "'utf8mb4_bin'", "coercibility": "0", "benchmark": "0", "name_const": "{1}", "sha": "sha({0})", "sha1": "sha({0})",
    "make_set": "concat_ws(',', filter(transform(array({rest}), (x, i) -> CASE WHEN (shiftright({0}, i) & 1) = 1 THEN x END), x -> x IS NOT NULL))", "export_set": "array_join(transform(sequence(0, 63), i -> CASE WHEN (shiftright({0}, i) & 1) = 1 THEN {1} ELSE {2} END), ',')",
    "isnull": "cast({0} IS NULL as int)", "uncompressed_length": "cast(conv(concat(substring(hex({0}), 7, 2), substring(hex({0}), 5, 2), substring(hex({0}), 3, 2), substring(hex({0}), 1, 2)), 16, 10) as int)", "random_bytes": "unhex(substring(array_join(transform(sequence(1, cast(ceil({0} / 32.0) as int)), i -> sha2(concat(i, uuid()), 256)), ''), 1, 2 * {0}))", "aes_encrypt": "aes_encrypt({0}, {1}, 'ECB')", "aes_decrypt": "aes_decrypt({0}, {1}, 'ECB')", "space": "space({0})", "interval": "size(filter(array({rest}), x -> x <= {0}))",
}

PG = {
    "length": "length({0})", "log": ["log10({0})", "log({0}, {1})"], "random": "rand()", "trunc": ["cast(sign({0}) * floor(abs({0})) as double)", TRUNCATE], "div": "({0} div {1})", "mod": "({0} % {1})", "scale": "coalesce(length(nullif(substring_index(cast({0} as string), '.', -1), cast({0} as string))), 0)",
    "acosd": "degrees(acos({0}))", "asind": "degrees(asin({0}))", "atand": "degrees(atan({0}))", "atan2d": "degrees(atan2({0}, {1}))", "cosd": "cos(radians({0}))", "cotd": "cot(radians({0}))", "sind": "sin(radians({0}))", "tand": "tan(radians({0}))",
    "gcd": GCD, "lcm": "CASE WHEN {0} = 0 OR {1} = 0 THEN 0 ELSE abs(cast({0} as bigint) div " + GCD + " * {1}) END", "make_timestamptz": "make_timestamp({*})", "make_time": "concat(format_string('%02d:%02d:', cast({0} as int), cast({1} as int)), if({2} < 10, '0', ''), rtrim('.', rtrim('0', cast(cast({2} as decimal(9, 6)) as string))))", "xmlagg": "listagg({0}, '')", "current_role": "current_user()", "current_catalog": "current_catalog()", "current_schema": "current_schema()", "trim_scale": "regexp_replace(cast({0} as string), '[.]?0+$', '')", "min_scale": "length(regexp_extract(cast({0} as string), '[.]([0-9]*[1-9])0*$', 1))",
    "width_bucket": "width_bucket({*})", "cbrt": "cbrt({0})", "concat": "concat_ws('', {*})", "strpos": "instr({0}, {1})", "substr": "substring({*})", "substring": ["substring({0}, {1})", "substring({0}, {1})", "substring({0}, {1}, {2})"], "ltrim": ["ltrim({0})", "ltrim({1}, {0})"], "rtrim": ["rtrim({0})", "rtrim({1}, {0})"], "btrim": ["trim({0})", "trim(BOTH {1} FROM {0})"],
    "to_hex": "lower(hex({0}))", "chr": "chr({0})", "quote_ident": "CASE WHEN regexp_like({0}, '^[a-z_][a-z0-9_]*$') THEN {0} ELSE concat('\"', replace({0}, '\"', '\"\"'), '\"') END", "quote_literal": "concat('''', replace({0}, '''', ''''''), '''')", "quote_nullable": "coalesce(concat('''', replace({0}, '''', ''''''), ''''), 'NULL')",
    "split_part": "split_part({0}, {1}, {2})", "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "regexp_split_to_array": "split({0}, {1})", "regexp_count": "regexp_count({0}, {1})", "regexp_like": "regexp_like({0}, {1})", "regexp_substr": "regexp_substr({0}, {1})", "regexp_instr": "regexp_instr({0}, {1})",
    "regexp_replace": None, "starts_with": "startswith({0}, {1})", "reverse": "reverse({0})", "initcap": "initcap({0})", "md5": "md5({0})", "sha256": "unhex(sha2({0}, 256))", "encode": "CASE WHEN {1} = 'hex' THEN lower(hex({0})) ELSE base64(cast({0} as binary)) END", "format": None, "overlay": "overlay({0} PLACING {1} FROM {2} FOR {3})",
    "date_trunc": "date_trunc({0}, {1})", "date_part": "date_part({0}, {1})", "make_date": "make_date({*})", "make_timestamp": "make_timestamp({*})", "make_interval": "make_interval({*})", "clock_timestamp": NOW, "statement_timestamp": NOW, "transaction_timestamp": NOW, "timeofday": "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss yyyy')",
    "isfinite": "CASE WHEN {0} IS NOT NULL THEN true END", "date_bin": "timestamp_micros(floor((unix_micros(cast({1} as timestamp)) - unix_micros(cast({2} as timestamp))) / {0:us}) * {0:us} + unix_micros(cast({2} as timestamp)))", "generate_series": "sequence({*})", "unnest": "explode({0})", "array_length": "size({0})", "cardinality": "size({0})", "array_upper": "size({0})", "array_lower": "1",
    "array_append": "array_append({0}, {1})", "array_prepend": "array_prepend({1}, {0})", "array_cat": "concat({0}, {1})", "array_position": "nullif(array_position({0}, {1}), 0)", "array_remove": "array_remove({0}, {1})", "array_to_string": "array_join({*})", "array_agg": None, "string_agg": None, "bool_and": "bool_and({0})", "bool_or": "bool_or({0})", "every": "every({0})",
    "stddev": "stddev_samp({0})", "variance": "var_samp({0})", "json_build_object": "to_json(named_struct({*}))", "jsonb_build_object": "to_json(named_struct({*}))", "to_json": "to_json({0})", "row_to_json": "to_json({0})", "json_agg": "to_json(collect_list({0}))", "jsonb_agg": "to_json(collect_list({0}))", "json_array_length": "json_array_length({0})", "jsonb_array_length": "json_array_length({0})",
    "json_object_agg": "to_json(map_from_entries(collect_list(struct({0}, {1}))))", "json_extract_path_text": "get_json_object({0}, concat('$.', {1}))", "json_typeof": "CASE lower(regexp_extract(schema_of_variant(parse_json({0})), '^[A-Za-z]+', 0)) WHEN 'bigint' THEN 'number' WHEN 'double' THEN 'number' WHEN 'decimal' THEN 'number' WHEN 'void' THEN 'null' ELSE lower(regexp_extract(schema_of_variant(parse_json({0})), '^[A-Za-z]+', 0)) END", "pg_client_encoding": "'UTF8'", "xpath": "xpath({1}, {0})", "xmlexists": "xpath_boolean({1}, {0})", "ascii": "ascii({0})", "to_ascii": "translate({0}, 'áéíóúàèìòùäëïöüâêîôûçñ', 'aeiouaeiouaeiouaeioucn')",
    "st_makepoint": "named_struct('x', cast({0} as double), 'y', cast({1} as double))", "st_point": "named_struct('x', cast({0} as double), 'y', cast({1} as double))", "setseed": "NULL", "num_nulls": "size(filter(array({*}), x -> x IS NULL))", "num_nonnulls": "size(filter(array({*}), x -> x IS NOT NULL))", "percentile_cont": None, "parse_ident": "split({0}, '[.]')",
}

ORACLE = {
    "length": "length({0})", "lengthb": "octet_length({0})", "log": "log({0}, {1})", "substr": "substring({*})", "instr": ["instr({0}, {1})", "instr({0}, {1})", "locate({1}, {0}, {2})"], "nullif": "nullif({0}, {1})", "decode": None, "mod": "({0} % {1})", "bitand": "({0} & {1})", "remainder": "({0} - {1} * rint({0} / {1}))",
    "trunc": None, "round": None, "add_months": "add_months({0}, {1})", "months_between": "months_between({0}, {1})", "last_day": "last_day({0})", "next_day": "next_day({0}, {1})", "ltrim": ["ltrim({0})", "ltrim({1}, {0})"], "rtrim": ["rtrim({0})", "rtrim({1}, {0})"], "initcap": "initcap({0})", "lpad": "lpad({*})", "rpad": "rpad({*})",
    "regexp_like": "regexp_like({0}, {1})", "regexp_replace": ["regexp_replace({0}, {1}, '')", "regexp_replace({0}, {1}, '')", "regexp_replace({0}, {1}, {2})"], "regexp_substr": "regexp_substr({0}, {1})", "regexp_instr": "regexp_instr({0}, {1})", "regexp_count": "regexp_count({0}, {1})", "replace": ["replace({0}, {1})", "replace({0}, {1})", "replace({0}, {1}, {2})"],
    "to_number": "cast({0} as double)", "to_binary_double": "cast({0} as double)", "to_binary_float": "cast({0} as float)", "to_dsinterval": "cast({0} as interval day to second)", "to_yminterval": "cast({0} as interval year to month)", "numtodsinterval": "make_dt_interval(0, 0, 0, {0:secs})", "lnnvl": "NOT coalesce({0}, false)", "stddev": "stddev_samp({0})", "variance": "var_samp({0})",
    "wm_concat": "listagg(cast({0} as string), ',')", "listagg": None, "collect": "collect_list({0})", "median": "median({0})", "ratio_to_report": None, "vsize": "octet_length({0})", "rawtohex": "hex({0})", "hextoraw": "unhex({0})", "chr": "chr({0})", "nanvl": "nanvl({0}, {1})", "sys_guid": "replace(uuid(), '-', '')", "soundex": "soundex({0})",
    "validate_conversion": "cast({0} IS NULL OR {1} IS NOT NULL as int)", "extract_value": "xpath_string({0}, {1})", "extractvalue": "xpath_string({0}, {1})", "xmlagg": "listagg({0}, '')", "sdo_point": "named_struct('x', cast({0} as double), 'y', cast({1} as double))", "cardinality": "size({0})", "powermultiset": "transform(sequence(1, cast(power(2, size({0})) as int) - 1), m -> filter({0}, (v, i) -> shiftright(m, i) & 1 = 1))", "json_serialize": "{0}", "lag_diff": None, "from_tz": "convert_timezone({1}, 'UTC', {0})", "tz_offset": "{0}", "dbtimezone": "'+00:00'", "sessiontimezone": "'+00:00'",
}

BY_DIALECT = {"mysql": COMMON | MYSQL, "pg": COMMON | PG, "oracle": COMMON | ORACLE}

# Names that belong to servers, sessions, replication and keys, and those whose results only their server can make; a query that calls them is refused.
OUT_OF_SCOPE = set(
    "asymmetric_decrypt asymmetric_derive asymmetric_encrypt asymmetric_sign asymmetric_verify connection_id create_asymmetric_priv_key create_asymmetric_pub_key create_dh_parameters create_digest "
    "des_decrypt des_encrypt encrypt get_lock gtid_subset gtid_subtract is_free_lock is_used_lock last_insert_id load_file master_pos_wait release_lock sleep validate_password_strength "
    "found_rows row_count password old_password weight_string json_storage_size ora_hash wait_until_sql_thread_after_gtids sql_thread_wait_after_gtids st_union st_intersection st_difference st_symdifference st_buffer buffer "
    "prediction prediction_cost prediction_details prediction_probability prediction_set".split()
)
