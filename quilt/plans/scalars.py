"""One query for each scalar function, over part names and order numbers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quilt.functions import numbers as N
from quilt.functions import strings as S
from quilt.sources import adapters as A

#: Every ASCII character but NUL.
_CH = "chr(CAST(p_partkey % 127 + 1 AS INT))"
_MESSAGES = {0: "Success", 1: "Operation not permitted", 2: "No such file or directory"}

_CMP = "coalesce(list_filter([ascii(substr({0}, i, 1)) - ascii(substr({1}, i, 1)) FOR i IN range(1, greatest(length({0}), length({1})) + 2)], lambda g: g <> 0)[1], 0)"
#: name: (column of the inputs below, DuckDB expression)
STRINGS = {
    "strlen": (lambda s, t, ch: S.strlen(s), "strlen(p_name)"),
    "strnlen": (lambda s, t, ch: S.strnlen(s, 9), "least(strlen(p_name), 9)"),
    "strcmp": (lambda s, t, ch: S.strcmp(s, t), _CMP.format("p_name", "p_type")),
    "strncmp": (lambda s, t, ch: S.strncmp(s, t, 2), _CMP.format("left(p_name, 2)", "left(p_type, 2)")),
    "memcmp": (lambda s, t, ch: S.strncmp(s, t, 8), _CMP.format("left(p_name, 8)", "left(p_type, 8)")),
    "memchr": (lambda s, t, ch: S.memchr(s, "t", 12), "nullif(instr(left(p_name, 12), 't'), 0) - 1"),
    "strchr": (lambda s, t, ch: S.strchr(s, "t"), "CASE WHEN instr(p_name, 't') > 0 THEN substr(p_name, instr(p_name, 't')) END"),
    "strrchr": (lambda s, t, ch: S.strrchr(s, "t"), "CASE WHEN contains(p_name, 't') THEN substr(p_name, length(p_name) - instr(reverse(p_name), 't') + 1) END"),
    "strstr": (lambda s, t, ch: S.strstr(s, "ar"), "CASE WHEN instr(p_name, 'ar') > 0 THEN substr(p_name, instr(p_name, 'ar')) END"),
    "strstr_empty": (lambda s, t, ch: S.strstr(s, ""), "p_name"),
    "strspn": (lambda s, t, ch: S.strspn(s, "part"), "length(p_name) - length(ltrim(p_name, 'part'))"),
    "strspn_empty": (lambda s, t, ch: S.strspn(s, ""), "0"),
    "strcspn": (lambda s, t, ch: S.strcspn(s, " -0"), "length(regexp_extract(p_name, '^[^ 0-]*'))"),
    "strpbrk": (lambda s, t, ch: S.strpbrk(s, "0123456789"), "CASE WHEN regexp_matches(p_name, '[0-9]') THEN regexp_replace(p_name, '^[^0-9]*', '') END"),
    "strtok": (lambda s, t, ch: F.concat_ws("/", S.strtok(s, " -a")), "array_to_string(list_filter(string_split_regex(p_name, '[ \\-a]'), lambda x: x <> ''), '/')"),
    "strsep": (lambda s, t, ch: F.concat_ws("/", S.strsep(s, " -a")), "array_to_string(string_split_regex(p_name, '[ \\-a]'), '/')"),
    "strcat": (lambda s, t, ch: S.strcat(s, t), "p_name || p_type"),
    "strncat": (lambda s, t, ch: S.strncat(s, t, 3), "p_name || left(p_type, 3)"),
    "strcpy": (lambda s, t, ch: S.strdup(s), "p_name"),
    "strncpy": (lambda s, t, ch: S.strncpy(s, 5), "left(p_name, 5)"),
    "stpcpy": (lambda s, t, ch: S.strlen(S.strdup(s)), "strlen(p_name)"),
    "stpncpy": (lambda s, t, ch: S.strncpy(s, 7), "left(p_name, 7)"),
    "strdup": (lambda s, t, ch: S.strdup(s), "p_name"),
    "strndup": (lambda s, t, ch: S.strndup(s, 4), "left(p_name, 4)"),
    "strlwr": (lambda s, t, ch: S.strlwr(t), "lower(p_type)"),
    "strupr": (lambda s, t, ch: S.strupr(s), "upper(p_name)"),
    "strrev": (lambda s, t, ch: S.strrev(s), "reverse(p_name)"),
    "strerror": (lambda s, t, ch: S.strerror((F.col("p_size") % 5).cast("int"), _MESSAGES), "CASE p_size % 5 WHEN 0 THEN 'Success' WHEN 1 THEN 'Operation not permitted' WHEN 2 THEN 'No such file or directory' ELSE 'Unknown error' END"),
    "memset": (lambda s, t, ch: S.memset("x", F.col("p_size")), "repeat('x', p_size)"),
    "memcpy": (lambda s, t, ch: S.memcpy(t, s, 3), "left(p_name, 3) || substr(p_type, 4)"),
    "memmove": (lambda s, t, ch: S.memmove(t, s, 2), "left(p_name, 2) || substr(p_type, 3)"),
    "atoi": (lambda s, t, ch: S.atoi(F.concat(F.lit(" \t-"), F.col("p_size").cast("string"), s)), "-p_size"),
    "atol": (lambda s, t, ch: S.atol(F.concat(F.col("p_partkey").cast("string"), F.lit("x"))), "p_partkey"),
    "isdigit": (lambda s, t, ch: S.isdigit(ch), f"regexp_full_match({_CH}, '[0-9]')"),
    "islower": (lambda s, t, ch: S.islower(ch), f"regexp_full_match({_CH}, '[a-z]')"),
    "isupper": (lambda s, t, ch: S.isupper(ch), f"regexp_full_match({_CH}, '[A-Z]')"),
    "isalpha": (lambda s, t, ch: S.isalpha(ch), f"regexp_full_match({_CH}, '[A-Za-z]')"),
    "isalnum": (lambda s, t, ch: S.isalnum(ch), f"regexp_full_match({_CH}, '[A-Za-z0-9]')"),
    "iscntrl": (lambda s, t, ch: S.iscntrl(ch), f"ascii({_CH}) <= 31 OR ascii({_CH}) = 127"),
    "isprint": (lambda s, t, ch: S.isprint(ch), f"NOT (ascii({_CH}) <= 31 OR ascii({_CH}) = 127)"),
    "isgraph": (lambda s, t, ch: S.isgraph(ch), f"NOT (ascii({_CH}) <= 31 OR ascii({_CH}) = 127) AND {_CH} <> ' '"),
    "ispunct": (lambda s, t, ch: S.ispunct(ch), f"regexp_full_match({_CH}, '[[:punct:]]')"),
    "isspace": (lambda s, t, ch: S.isspace(ch), f"regexp_full_match({_CH}, '[\\t-\\r ]')"),
    "isxdigit": (lambda s, t, ch: S.isxdigit(ch), f"regexp_full_match({_CH}, '[0-9A-Fa-f]')"),
    "isblank": (lambda s, t, ch: S.isblank(ch), f"{_CH} IN (' ', chr(9))"),
    "tolower": (lambda s, t, ch: S.tolower(ch), f"lower({_CH})"),
    "toupper": (lambda s, t, ch: S.toupper(ch), f"upper({_CH})"),
}

_WIDE = "CAST(o_orderkey AS HUGEINT) * 600000000000000"
_FITS = "CASE WHEN {0} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST({0} AS BIGINT) END"
_HALF = "CASE WHEN {0} % 32768 >= 31744 AND {0} % 1024 > 0 THEN 'nan' ELSE CASE WHEN {0} >= 32768 THEN '-' ELSE '' END || CASE WHEN {0} % 32768 = 31744 THEN 'inf' ELSE CAST(CAST(floor(CASE WHEN {0} // 1024 % 32 = 0 THEN 0 ELSE (1 + {0} % 1024 / 1024.0::DOUBLE) * pow(2, {0} // 1024 % 32 - 15) END) AS BIGINT) AS VARCHAR) END END"


def _label(x):
    """A double as text: nan, inf, -inf, or sign and whole part."""
    inf = F.lit(float("inf"))
    whole = F.floor(F.abs(F.when(~F.isnan(x) & (F.abs(x) < inf), x))).cast("string")
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(F.isnan(x), "nan").otherwise(F.concat(F.when(negative, "-").otherwise(""), F.when(F.abs(x) == inf, "inf").otherwise(whole)))


def _label_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 'nan' ELSE CASE WHEN {a} < 0 THEN '-' ELSE '' END || CASE WHEN {b} = 0 THEN 'inf' ELSE CAST(CAST(floor(abs({a} / {b})) AS BIGINT) AS VARCHAR) END END"


def _parts(k, c):
    """(3 or infinite, and NaN then) + 2i times (c % 5) + (c % 3)i."""
    return F.when(k % 2 == 0, float("inf")).otherwise(3.0), F.when(k % 2 == 0, float("inf")).otherwise(2.0), (c % 5).cast("double"), (c % 3).cast("double")


NUMBERS = {
    "add": (lambda k, c, price, big, signed: N.checked_add(big, F.lit(N.MAX - 10**18)), _FITS.format(f"({_WIDE} + 8223372036854775807)")),
    "sub": (lambda k, c, price, big, signed: N.checked_sub(-big, F.lit(10**18)), _FITS.format(f"(-({_WIDE}) - 1000000000000000000)")),
    "mul": (lambda k, c, price, big, signed: N.checked_mul(big, c + 1), _FITS.format(f"({_WIDE} * (o_custkey + 1))")),
    "mulo": (lambda k, c, price, big, signed: N.overflows_mul(big, c + 1), f"({_WIDE}) * (o_custkey + 1) > 9223372036854775807"),
    "neg": (lambda k, c, price, big, signed: N.neg(signed), "-(o_orderkey - 7000)"),
    "abs": (lambda k, c, price, big, signed: N.checked_abs(signed), "abs(o_orderkey - 7000)"),
    "shl": (lambda k, c, price, big, signed: F.shiftleft(k, 3), "o_orderkey * 8"),
    "shr": (lambda k, c, price, big, signed: F.shiftright(signed, 2), "CAST(floor((o_orderkey - 7000) / 4) AS BIGINT)"),
    "shru": (lambda k, c, price, big, signed: F.shiftrightunsigned(k, 2), "o_orderkey // 4"),
    "bswap": (lambda k, c, price, big, signed: N.bswap32(k), "(o_orderkey & 255) * 16777216 + ((o_orderkey >> 8) & 255) * 65536 + ((o_orderkey >> 16) & 255) * 256 + ((o_orderkey >> 24) & 255)"),
    "clz": (lambda k, c, price, big, signed: N.clz(k), "CASE WHEN o_orderkey = 0 THEN 64 ELSE 63 - CAST(floor(log2(o_orderkey)) AS INTEGER) END"),
    "ctz": (lambda k, c, price, big, signed: N.ctz(k + 1), "bit_count(((o_orderkey + 1) & -(o_orderkey + 1)) - 1)"),
    "ffs": (lambda k, c, price, big, signed: N.ffs(k), "CASE WHEN o_orderkey = 0 THEN 0 ELSE bit_count((o_orderkey & -o_orderkey) - 1) + 1 END"),
    "parity": (lambda k, c, price, big, signed: N.parity(k), "bit_count(o_orderkey) % 2"),
    "popcount": (lambda k, c, price, big, signed: N.popcount(k), "bit_count(o_orderkey)"),
    "cmp": (lambda k, c, price, big, signed: N.cmp(k, c), "CASE WHEN o_orderkey < o_custkey THEN 0 WHEN o_orderkey = o_custkey THEN 1 ELSE 2 END"),
    "ucmp": (lambda k, c, price, big, signed: N.ucmp(signed, c), "CASE WHEN o_orderkey < 7000 THEN 2 WHEN o_orderkey - 7000 < o_custkey THEN 0 WHEN o_orderkey - 7000 = o_custkey THEN 1 ELSE 2 END"),
    "div": (lambda k, c, price, big, signed: N.quot("(o_orderkey - 7000)", "(o_custkey % 7)"), "CASE WHEN o_custkey % 7 <> 0 THEN (o_orderkey - 7000) // (o_custkey % 7) END"),
    "mod": (lambda k, c, price, big, signed: N.rem("(o_orderkey - 7000)", "(o_custkey % 7)"), "CASE WHEN o_custkey % 7 <> 0 THEN (o_orderkey - 7000) % (o_custkey % 7) END"),
    "udiv": (lambda k, c, price, big, signed: N.quot("o_orderkey", "(o_custkey + 1)"), "o_orderkey // (o_custkey + 1)"),
    "umul": (lambda k, c, price, big, signed: k * c, "o_orderkey * o_custkey"),
    "fadd": (lambda k, c, price, big, signed: price + 0.5, "o_totalprice + 0.5::DOUBLE"),
    "fmul": (lambda k, c, price, big, signed: price * 2.5, "o_totalprice * 2.5::DOUBLE"),
    "fdiv": (lambda k, c, price, big, signed: _label(N.fdiv((-k * (k % 3)).cast("double"), (c % 2).cast("double"))), _label_sql("(-o_orderkey * (o_orderkey % 3))::DOUBLE", "(o_custkey % 2)")),
    "fsub": (lambda k, c, price, big, signed: price - 0.25, "o_totalprice - 0.25::DOUBLE"),
    "fle": (lambda k, c, price, big, signed: N.fle(price, F.lit(150000.0)), "o_totalprice <= 150000"),
    "funord": (lambda k, c, price, big, signed: N.unordered(price, F.when(k % 3 == 0, float("nan")).otherwise(price)), "o_orderkey % 3 = 0"),
    "fneg": (lambda k, c, price, big, signed: -price, "-o_totalprice"),
    "fix": (lambda k, c, price, big, signed: N.fix(-price), "CAST(trunc(-o_totalprice) AS BIGINT)"),
    "fix_clamp": (lambda k, c, price, big, signed: N.fix(F.when(k % 3 == 0, price * 1e30).when(k % 3 == 1, price * -1e30).otherwise(price)), "CASE o_orderkey % 3 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN -9223372036854775808 ELSE CAST(trunc(o_totalprice) AS BIGINT) END"),
    "fixuns": (lambda k, c, price, big, signed: N.fixuns(price - 250000), "CAST(greatest(trunc(o_totalprice - 250000), 0) AS BIGINT)"),
    "float": (lambda k, c, price, big, signed: k.cast("double"), "CAST(o_orderkey AS DOUBLE)"),
    "extend": (lambda k, c, price, big, signed: k.cast("float").cast("double"), "CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE)"),
    "powi": (lambda k, c, price, big, signed: N.powi((k % 50).cast("double"), 3), "CAST((o_orderkey % 50) * (o_orderkey % 50) * (o_orderkey % 50) AS DOUBLE)"),
    "complex_re": (lambda k, c, price, big, signed: N.complex_mul(k, c, c, k + 1)[0], "o_orderkey * o_custkey - o_custkey * (o_orderkey + 1)"),
    "complex_inf_re": (lambda k, c, price, big, signed: _label(N.complex_mul_inf(*_parts(k, c))[0]), "CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 > 0 AND o_custkey % 3 > 0 THEN 'nan' WHEN o_custkey % 5 > 0 THEN 'inf' WHEN o_custkey % 3 > 0 THEN '-inf' ELSE 'nan' END ELSE CAST(3 * (o_custkey % 5) - 2 * (o_custkey % 3) AS VARCHAR) END"),
    "complex_inf_im": (lambda k, c, price, big, signed: _label(N.complex_mul_inf(*_parts(k, c))[1]), "CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 + o_custkey % 3 > 0 THEN 'inf' ELSE 'nan' END ELSE CAST(3 * (o_custkey % 3) + 2 * (o_custkey % 5) AS VARCHAR) END"),
    "bswap64": (lambda k, c, price, big, signed: N.bswap64(k), "CAST(" + " + ".join(f"((o_orderkey >> {8 * i}) & 255)::HUGEINT * {1 << (56 - 8 * i)}" for i in range(8)) + " - CASE WHEN o_orderkey & 255 >= 128 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT)"),
    "clz32": (lambda k, c, price, big, signed: N.clz32(signed), "CASE WHEN o_orderkey < 7000 THEN 0 WHEN o_orderkey = 7000 THEN 32 ELSE 31 - CAST(floor(log2(o_orderkey - 7000)) AS INTEGER) END"),
    "ffs32": (lambda k, c, price, big, signed: N.ffs32(signed), "CASE WHEN o_orderkey = 7000 THEN 0 ELSE bit_count(((o_orderkey - 7000) & -(o_orderkey - 7000)) - 1) + 1 END"),
    "ffs128": (lambda k, c, price, big, signed: N.ffs128(k, F.when(k % 2 == 0, c).otherwise(0)), "CASE WHEN o_orderkey % 2 = 0 AND o_custkey <> 0 THEN bit_count((o_custkey & -o_custkey) - 1) + 1 WHEN o_orderkey = 0 THEN 0 ELSE 65 + bit_count((o_orderkey & -o_orderkey) - 1) END"),
    "umod": (lambda k, c, price, big, signed: N.umod(signed, c + 1), "CAST((CASE WHEN o_orderkey < 7000 THEN 18446744073709551616::HUGEINT ELSE 0 END + o_orderkey - 7000) % (o_custkey + 1) AS BIGINT)"),
    "udiv_wide": (lambda k, c, price, big, signed: N.udiv(signed, c + 3), "CAST((CASE WHEN o_orderkey < 7000 THEN 18446744073709551616::HUGEINT ELSE 0 END + o_orderkey - 7000) // (o_custkey + 3) AS BIGINT)"),
    "extend_half": (lambda k, c, price, big, signed: _label(N.extend_half(k * 13 % 65536)), _HALF.format("(o_orderkey * 13 % 65536)")),
    "trunc_half": (lambda k, c, price, big, signed: N.trunc_half(signed.cast("double") / 64), "CAST(CASE WHEN o_orderkey < 7000 THEN 32768 ELSE 0 END + CASE WHEN o_orderkey = 7000 THEN 0 ELSE (floor(log2(abs(o_orderkey - 7000) / 64.0::DOUBLE)) + 15) * 1024 + round_even((abs(o_orderkey - 7000) / 64.0::DOUBLE / pow(2, floor(log2(abs(o_orderkey - 7000) / 64.0::DOUBLE))) - 1) * 1024, 0) END AS BIGINT)"),
    "complex_im": (lambda k, c, price, big, signed: N.complex_mul(k, c, c, k)[1], "o_orderkey * o_orderkey + o_custkey * o_custkey"),
    "labs": (lambda k, c, price, big, signed: F.abs(signed), "abs(o_orderkey - 7000)"),
    "ldiv_quot": (lambda k, c, price, big, signed: N.quot("(o_orderkey - 7000)", "9"), "(o_orderkey - 7000) // 9"),
    "ldiv_rem": (lambda k, c, price, big, signed: N.rem("(o_orderkey - 7000)", "9"), "(o_orderkey - 7000) % 9"),
    "align8": (lambda k, c, price, big, signed: N.align("o_orderkey", 8), "(o_orderkey + 7) // 8 * 8"),
    "align2": (lambda k, c, price, big, signed: N.align("o_orderkey", 2), "(o_orderkey + 1) // 2 * 2"),
    "next_power_of_2": (lambda k, c, price, big, signed: N.next_power_of_2(k), "CAST(CASE WHEN o_orderkey <= 1 THEN 1 ELSE pow(2, ceil(log2(o_orderkey))) END AS BIGINT)"),
}


def _strings():
    return F.col("p_name"), F.col("p_type"), F.expr("char(p_partkey % 127 + 1)")


def _numbers():
    k = F.col("o_orderkey")
    return k, F.col("o_custkey"), F.col("o_totalprice"), N.wide(k) * 600_000_000_000_000, k - 7000


def _query(table, key, inputs, column, spark, d):
    return A.table(spark, d, table).select(F.col(key).alias("id"), column(*inputs()).alias("v"))


_GROUPS = (("str", "part", "p_partkey", _strings, STRINGS), ("math", "orders", "o_orderkey", _numbers, NUMBERS))
QUERIES = {f"{prefix}_{name}": partial(_query, table, key, inputs, column) for prefix, table, key, inputs, found in _GROUPS for name, (column, _) in found.items()}
ORACLES = {f"{prefix}_{name}": f"SELECT {key} AS id, {sql} AS v FROM {table}" for prefix, table, key, _, found in _GROUPS for name, (_, sql) in found.items()}
