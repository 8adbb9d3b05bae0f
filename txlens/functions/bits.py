"""64-bit wrap-around arithmetic on signed columns, and sampling built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
MIX_CONST = 0x9E3779B185EBCA87
SAMPLE_SEED = 0x5EED0F7A1B2C3D

LOW = 0xFFFFFFFF


def _halves(c: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(c, 32).bitwiseAND(F.lit(LOW)), c.bitwiseAND(F.lit(LOW))


def mix_halves(seed: int, ident: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit halves of x ^ (x >> 30) with x = (seed + ident) * MIX_CONST modulo 2^64."""
    high, low = _halves(ident.cast("bigint"))
    low = low + F.lit(seed & LOW)
    high = (high + F.lit(seed >> 32) + F.shiftright(low, 32)).bitwiseAND(F.lit(LOW))
    low = low.bitwiseAND(F.lit(LOW))
    c = [(MIX_CONST >> (16 * i)) & 0xFFFF for i in range(4)]
    mask16 = F.lit(0xFFFF)
    p0, p1 = low * F.lit(c[0]), low * F.lit(c[1])
    first = p0.bitwiseAND(F.lit(LOW)) + F.shiftleft(p1.bitwiseAND(mask16), 16)
    x_low = first.bitwiseAND(F.lit(LOW))
    x_high = (F.shiftright(p0, 32) + F.shiftright(p1, 16) + low * F.lit(c[2])
              + F.shiftleft((low * F.lit(c[3])).bitwiseAND(mask16), 16)
              + high * F.lit(c[0]) + F.shiftleft((high * F.lit(c[1])).bitwiseAND(mask16), 16)
              + F.shiftright(first, 32)).bitwiseAND(F.lit(LOW))
    # x >> 30 moves the top two bits of the high half into the high half, the rest into the low half.
    s_high = F.shiftright(x_high, 30)
    s_low = (F.shiftleft(x_high, 2) + F.shiftright(x_low, 30)).bitwiseAND(F.lit(LOW))
    return x_high.bitwiseXOR(s_high), x_low.bitwiseXOR(s_low)


def mix_mod(seed: int, ident: Column, modulus: int) -> Column:
    high, low = mix_halves(seed, ident)
    return ((high % F.lit(modulus)) * F.lit((1 << 32) % modulus) + low) % F.lit(modulus)


def sampled(ident: Column, ppm: int) -> Column:
    """True for about ppm / 1e6 of all ids, always the same ones."""
    return mix_mod(SAMPLE_SEED, ident, 1_000_000) < F.lit(ppm)


def unsigned_order(c: Column) -> tuple[Column, Column]:
    """Sort keys that order a BIGINT bit pattern as an unsigned number: negatives come last, each half in order."""
    return (c < 0).asc(), c.asc()


def discriminator(name: Column) -> Column:
    """First eight bytes of the SHA-256 of "global:<name>": how an instruction is told from others."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit("global:"), name), 256)), 1, 8)


def u64_at(data: Column, offset: int) -> Column:
    """Unsigned little-endian 64-bit number at a byte offset, as a decimal; null if the bytes end before."""
    digits = F.hex(F.substring(data, offset + 1, 8))
    turned = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    return F.when(F.octet_length(data) >= offset + 8, F.conv(turned, 16, 10).cast("decimal(20,0)"))
