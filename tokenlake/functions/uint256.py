"""Exact unsigned 256-bit integers with built-in Spark expressions only.

Spark decimals stop at 38 digits, a uint256 needs 78. A value is carried as
nine base-10^9 chunks ``c0`` (least significant) .. ``c8`` in a struct of BIGINTs:

* decode: the 64 hex digits are cut into four 64-bit words (``conv``), each
  split into four 16-bit limbs; chunk j collects ``limb_i * digit_j(2^(16 i))``
  (every term below 2^16 * 10^9, so a BIGINT never overflows), then one carry
  pass normalises the chunks;
* sum: each chunk is summed as DECIMAL (partial + final aggregate, exact up to
  10^19 rows per group) and the carry is applied once per group;
* text: the highest non-zero chunk, then the lower ones zero-padded.

Everything stays in JVM expressions, without a UDF. The generated method of the decode is over the
JVM's 8000 bytes for compiled methods, so sessions set ``spark.sql.codegen.hugeMethodLimit=8000``
and Spark runs that stage operator by operator instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECIMAL128_DIGITS, TOKEN_DECIMALS

CHUNK_DIGITS = 9
CHUNK_BASE = 10**CHUNK_DIGITS
N_CHUNKS = 9  # 81 digits >= 78 digits of 2**256 - 1
LIMB_BITS = 16
N_LIMBS = 256 // LIMB_BITS
CHUNK_NAMES = [f"c{j}" for j in range(N_CHUNKS)]

_TMP = "__u256"


def _limb_weights() -> list[list[int]]:
    """Base-10^9 digits (little-endian) of 2**(16*i), for each limb i."""
    table = []
    for i in range(N_LIMBS):
        w = 1 << (LIMB_BITS * i)
        digits = []
        while w:
            w, d = divmod(w, CHUNK_BASE)
            digits.append(d)
        table.append(digits)
    return table


_WEIGHTS = _limb_weights()


def with_value_parts(df: DataFrame, hex64: str, out: str = "value_parts") -> DataFrame:
    """Add struct column ``out`` = exact chunks of the 64-hex-digit column ``hex64``.

    ``hex64`` must hold exactly 64 hex digits (no prefix); rows that do not are
    filtered out by the decode guards before this is applied.
    """
    # four 64-bit words; base -10 gives the signed (two's complement) text, so
    # every 16-hex-digit word fits a BIGINT; limbs are unsigned 16-bit slices
    words = {
        f"{_TMP}_w{k}": F.conv(F.substring(F.col(hex64), 1 + 16 * k, 16), 16, -10).cast("bigint")
        for k in range(4)
    }
    df = df.withColumns(words)
    limbs = {}
    for i in range(N_LIMBS):
        word = f"{_TMP}_w{3 - i // 4}"  # word 3 holds the least significant 64 bits
        shift = 16 * (i % 4)
        limbs[f"{_TMP}_l{i}"] = F.expr(f"shiftrightunsigned({word}, {shift}) & 65535")
    df = df.withColumns(limbs)
    raw = {}
    for j in range(N_CHUNKS):
        terms = [
            f"{_TMP}_l{i} * {_WEIGHTS[i][j]}"
            for i in range(N_LIMBS)
            if j < len(_WEIGHTS[i]) and _WEIGHTS[i][j]
        ]
        raw[f"{_TMP}_r{j}"] = F.expr(" + ".join(terms) if terms else "CAST(0 AS BIGINT)")
    df = df.withColumns(raw)
    # carry pass: x_j = r_j + x_{j-1} div B; chunk_j = x_j % B
    carried = {}
    prev = None
    for j in range(N_CHUNKS):
        x = f"{_TMP}_r{j}" if prev is None else f"({_TMP}_r{j} + ({prev}) div {CHUNK_BASE})"
        carried[f"{_TMP}_x{j}"] = F.expr(x)
        prev = f"{_TMP}_x{j}"
    # materialise x_j one step at a time so the nesting stays linear
    for name, expr in carried.items():
        df = df.withColumn(name, expr)
    parts = F.struct(*[(F.col(f"{_TMP}_x{j}") % CHUNK_BASE).alias(c) for j, c in enumerate(CHUNK_NAMES)])
    df = df.withColumn(out, parts)
    return df.drop(*[c for c in df.columns if c.startswith(_TMP)])


def parts_from_decimal_text(text: Column) -> Column:
    """Chunks of a non-negative integer given as decimal text (legacy rows).

    The text is left-padded to 81 digits and cut into nine 9-digit slices.
    """
    padded = F.lpad(text, N_CHUNKS * CHUNK_DIGITS, "0")
    width = N_CHUNKS * CHUNK_DIGITS
    return F.struct(
        *[
            F.substring(padded, width - CHUNK_DIGITS * (j + 1) + 1, CHUNK_DIGITS).cast("bigint").alias(c)
            for j, c in enumerate(CHUNK_NAMES)
        ]
    )


def _strip_leading_zeros(s: Column) -> Column:
    t = F.ltrim(s, F.lit("0"))
    return F.when(t == "", F.lit("0")).otherwise(t)


def parts_to_string(parts: Column) -> Column:
    """Decimal text of normalised chunks (each chunk < 10^9).

    The branch of the highest non-zero chunk prints it unpadded and the lower
    ones zero-padded, so no trimming pass is needed.
    """
    chunk = [parts.getField(c) for c in CHUNK_NAMES]
    text = lambda top: F.concat(
        chunk[top].cast("string"),
        *[F.lpad(chunk[j].cast("string"), CHUNK_DIGITS, "0") for j in reversed(range(top))],
    )
    out = F.when(chunk[N_CHUNKS - 1] > 0, text(N_CHUNKS - 1))
    for top in reversed(range(1, N_CHUNKS - 1)):
        out = out.when(chunk[top] > 0, text(top))
    return out.otherwise(chunk[0].cast("string"))


def sum_parts_exprs(parts: Column, prefix: str = "__sum") -> list[Column]:
    """Aggregate expressions: one exact DECIMAL sum per chunk (map-side combinable)."""
    return [
        F.sum(parts.getField(c).cast("decimal(18,0)")).alias(f"{prefix}_{c}")
        for c in CHUNK_NAMES
    ]


def carried_sum_string(df: DataFrame, prefix: str = "__sum", out: str = "total") -> DataFrame:
    """Turn per-chunk sums (from ``sum_parts_exprs``) into exact decimal text.

    A group with no rows (all sums NULL) gives NULL text.
    """
    sums = [f"coalesce({prefix}_{c}, CAST(0 AS DECIMAL(28,0)))" for c in CHUNK_NAMES]
    prev = None
    for j in range(N_CHUNKS):
        x = sums[j] if prev is None else f"({sums[j]} + ({prev} div {CHUNK_BASE}))"
        df = df.withColumn(f"{prefix}_x{j}", F.expr(x))
        prev = f"{prefix}_x{j}"
    top = F.col(f"{prefix}_x{N_CHUNKS - 1}").cast("decimal(38,0)").cast("string")
    pieces = [top] + [
        F.lpad((F.col(f"{prefix}_x{j}") % CHUNK_BASE).cast("bigint").cast("string"), CHUNK_DIGITS, "0")
        for j in reversed(range(N_CHUNKS - 1))
    ]
    text = _strip_leading_zeros(F.concat(*pieces))
    empty = F.col(f"{prefix}_{CHUNK_NAMES[0]}").isNull()
    df = df.withColumn(out, F.when(empty, F.lit(None).cast("string")).otherwise(text))
    return df.drop(*[c for c in df.columns if c.startswith(prefix + "_")])


def scaled_double(value_string: Column, decimals: int = TOKEN_DECIMALS) -> Column:
    """``value / 10^decimals`` as the nearest double: the decimal point is placed in
    the text and the text is parsed once (one rounding, not two)."""
    # lpad truncates longer text, so pad only short values
    short = F.length(value_string) <= decimals
    padded = F.when(short, F.lpad(value_string, decimals + 1, "0")).otherwise(value_string)
    n = F.length(padded)
    text = F.concat(F.substring(padded, 1, n - decimals), F.lit("."), F.substring(padded, n - decimals + 1, decimals))
    return F.when(value_string.isNull(), F.lit(None).cast("double")).otherwise(text.cast("double"))


def dec128_ok(value_string: Column) -> Column:
    """True when the value parses as a 34-digit Decimal128 (trailing zeros go to the exponent)."""
    stripped = F.rtrim(value_string, F.lit("0"))
    return F.length(stripped) <= DECIMAL128_DIGITS


def value_dec128(value_string: Column, ok: Column) -> Column:
    """What the store keeps: the value, or 0 when it does not parse; NULL past DECIMAL(38,0)."""
    return F.when(ok, value_string.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
