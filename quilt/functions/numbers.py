"""Arithmetic, bit and conversion functions as columns of longs or doubles; nulls give nulls."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN, MAX = -(1 << 63), (1 << 63) - 1
#: 2^64, which no long holds.
_TWO_64 = Decimal(1 << 64)


def wide(a: Column) -> Column:
    """A long as a whole decimal, for products and sums that no long holds."""
    return a.cast("decimal(38,0)")


def _fitting(a: Column) -> Column:
    """The long of a whole decimal, null where none holds it."""
    return F.when((a >= Decimal(MIN)) & (a <= Decimal(MAX)), a).cast("long")


def checked_add(a: Column, b: Column) -> Column:
    """a + b of longs or whole decimals as a long, null where none holds it; a + b itself raises."""
    return _fitting(F.try_add(wide(a), wide(b)))


def checked_sub(a: Column, b: Column) -> Column:
    return _fitting(F.try_subtract(wide(a), wide(b)))


def checked_mul(a: Column, b: Column) -> Column:
    return _fitting(F.try_multiply(wide(a), wide(b)))


def overflows_mul(a: Column, b: Column) -> Column:
    """Whether no long holds a * b of longs or whole decimals."""
    return F.when(a.isNotNull() & b.isNotNull(), _fitting(F.try_multiply(wide(a), wide(b))).isNull())


def neg(a: Column) -> Column:
    """Two's complement: the least number stays."""
    return F.when(a == MIN, a).otherwise(F.negative(F.when(a != MIN, a)))


def checked_abs(a: Column) -> Column:
    return F.when(a != MIN, F.abs(F.when(a != MIN, a)))


def bswap32(a: Column) -> Column:
    byte = lambda k: F.shiftrightunsigned(a, k).bitwiseAND(0xFF)
    return F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(8), 16)).bitwiseOR(F.shiftleft(byte(16), 8)).bitwiseOR(byte(24))


def clz(a: Column) -> Column:
    return F.when(a < 0, 0).when(a == 0, 64).otherwise(64 - F.length(F.bin(a)))


def clz32(a: Column) -> Column:
    """Leading zeros of the low 32 bits."""
    low = a.bitwiseAND(0xFFFFFFFF)
    return F.when(low == 0, 32).otherwise(32 - F.length(F.bin(low)))


def bswap64(a: Column) -> Column:
    swapped = F.lit(0).cast("long")
    for k in range(8):
        swapped = swapped.bitwiseOR(F.shiftleft(F.shiftrightunsigned(a, 8 * k).bitwiseAND(0xFF), 56 - 8 * k))
    return swapped


def ffs32(a: Column) -> Column:
    return ffs(a.bitwiseAND(0xFFFFFFFF))


def ffs128(high: Column, low: Column) -> Column:
    """Of a number given as two longs."""
    return F.when(low != 0, ffs(low)).when(high != 0, 64 + ffs(high)).otherwise(0)


def _unsigned(a: Column) -> Column:
    whole = a.cast("decimal(20,0)")
    return F.when(a < 0, whole + _TWO_64).otherwise(whole)


def _signed(a: Column) -> Column:
    """The long with the bits of an unsigned number."""
    return F.when(a > MAX, a - _TWO_64).otherwise(a).cast("long")


def umod(a: Column, b: Column) -> Column:
    """Remainder of longs as unsigned numbers; null by zero."""
    return _signed((_unsigned(a) % F.when(b != 0, _unsigned(b))).cast("decimal(21,0)"))


def udiv(a: Column, b: Column) -> Column:
    """Quotient of longs as unsigned numbers; null by zero."""
    x, y = _unsigned(a), F.when(b != 0, _unsigned(b))
    return _signed(((x - x % y) / y).cast("decimal(21,0)"))


def ctz(a: Column) -> Column:
    return F.bit_count(a.bitwiseAND(F.negative(a)) - 1)


def ffs(a: Column) -> Column:
    return F.when(a == 0, 0).otherwise(ctz(F.when(a != 0, a)) + 1)


def popcount(a: Column) -> Column:
    return F.bit_count(a)


def parity(a: Column) -> Column:
    return F.bit_count(a) % 2


def cmp(a: Column, b: Column) -> Column:
    """0, 1, 2 for less, equal, greater."""
    return F.when(a < b, 0).when(a == b, 1).otherwise(2)


def ucmp(a: Column, b: Column) -> Column:
    flip = F.lit(MIN)
    return cmp(a.bitwiseXOR(flip), b.bitwiseXOR(flip))


def quot(a: str, b: str) -> Column:
    """Division towards zero; null by zero."""
    return F.expr(f"CASE WHEN {b} <> 0 THEN {a} div nullif({b}, 0) END")


def rem(a: str, b: str) -> Column:
    return F.expr(f"CASE WHEN {b} <> 0 THEN {a} % nullif({b}, 0) END")


def fdiv(a: Column, b: Column) -> Column:
    """Division by IEEE rules: infinities and NaN by zero."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)


def fle(a: Column, b: Column) -> Column:
    """a <= b, false if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a <= b)


def unordered(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def fix(a: Column) -> Column:
    """Double to long towards zero, clamped; NaN to the greatest."""
    return F.when(F.isnan(a) | (a >= 2.0**63), F.lit(MAX)).when(a <= -(2.0**63), F.lit(MIN)).otherwise(F.when(~F.isnan(a) & (F.abs(a) < 2.0**63), a).cast("long"))


def fixuns(a: Column) -> Column:
    return F.when(a <= 0, F.lit(0).cast("long")).otherwise(fix(a))


def powi(a: Column, n: int) -> Column:
    return F.pow(a, F.lit(float(n)))


def complex_mul(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    return a * c - b * d, a * d + b * c


def _let(value: Column, use) -> Column:
    """use(value), with value computed once; keeps large expressions out of generated code, which has a size limit."""
    return F.transform(F.array(value), use)[0]


def complex_mul_inf(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """The product of doubles where parts may be infinite: an infinite factor times one that isn't 0 is infinite, not NaN."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    is_inf = lambda x: F.abs(x) == inf
    sign = lambda x: F.when((x < 0) | (x.cast("string") == "-0.0"), -1.0).otherwise(1.0)
    unit = lambda x: sign(x) * F.when(is_inf(x), 1.0).otherwise(0.0)
    zero = lambda x, other: F.when(F.isnan(x) & other, sign(x) * 0.0).otherwise(x)
    times = lambda x: F.when(x > 0, inf).when(x < 0, -inf).otherwise(nan)

    def products(x: Column) -> Column:
        found = {"ac": x["a"] * x["c"], "bd": x["b"] * x["d"], "ad": x["a"] * x["d"], "bc": x["b"] * x["c"]}
        left, right = is_inf(x["a"]) | is_inf(x["b"]), is_inf(x["c"]) | is_inf(x["d"])
        return F.struct(*[x[n].alias(n) for n in "abcd"], *[v.alias(n) for n, v in found.items()], left.alias("left"), right.alias("right"))

    def parts(x: Column) -> Column:
        """The plain product, whether it has to be found again, and the factors for that."""
        left, right = x["left"], x["right"]
        large = is_inf(x["ac"]) | is_inf(x["bd"]) | is_inf(x["ad"]) | is_inf(x["bc"])
        re, im = x["ac"] - x["bd"], x["ad"] + x["bc"]
        one = [F.when(left, unit(x[n])).otherwise(zero(x[n], right | large)).alias(n) for n in "ab"]
        two = [F.when(right, unit(x[n])).otherwise(zero(x[n], left | large)).alias(n) for n in "cd"]
        return F.struct(*one, *two, re.alias("re"), im.alias("im"), (F.isnan(re) & F.isnan(im) & (left | right | large)).alias("again"))

    whole = _let(_let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), products), parts)
    real = _let(whole, lambda x: F.when(x["again"], times(x["a"] * x["c"] - x["b"] * x["d"])).otherwise(x["re"]))
    return real, _let(whole, lambda x: F.when(x["again"], times(x["a"] * x["d"] + x["b"] * x["c"])).otherwise(x["im"]))


def extend_half(h: Column) -> Column:
    """Double of a half float's 16 bits."""
    e, m = F.shiftright(h, 10).bitwiseAND(31), h.bitwiseAND(1023).cast("double")
    size = F.when(e == 0, m * 2.0**-24).when((e == 31) & (m == 0), F.lit(float("inf"))).when(e == 31, F.lit(float("nan"))).otherwise((1 + m / 1024) * F.pow(F.lit(2.0), (e - 15).cast("double")))
    return F.when(h.bitwiseAND(0x8000) != 0, -size).otherwise(size)


def trunc_half(x: Column) -> Column:
    """The 16 bits of the nearest half float, ties to even."""
    size = F.abs(x)
    guess = F.floor(F.log2(F.when((size > 0) & (size < 65520), size))).cast("double")
    e = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    normal = (e + 15) * 1024 + F.rint((size / F.pow(F.lit(2.0), e) - 1) * 1024)
    bits = F.when(F.isnan(x), F.lit(0x7E00)).when(size >= 65520, F.lit(0x7C00)).when(size < 2.0**-14, F.rint(size * 2.0**24)).otherwise(normal).cast("long")
    return F.when((x < 0) | (x.cast("string") == "-0.0"), bits + 0x8000).otherwise(bits)


def align(x: str, to: int) -> Column:
    return F.expr(f"({x} + {to - 1}) div {to} * {to}")


def next_power_of_2(x: Column) -> Column:
    return F.when(x <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.when(x > 1, x))))).cast("long")
