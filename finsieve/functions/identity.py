"""Display name and IBAN of an account, derived from its id alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finsieve import vocab


def _bits(digest: Column, hex_digits: int) -> Column:
    """The leading hex digits of the digest as a number."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("decimal(20,0)")


def _pick(values: list[str] | tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def display_identity(account: Column, version: str = vocab.IDENTITY_VERSION) -> Column:
    """struct(iban, name). One digest picks bank, names and the optional second name."""
    digest = F.sha2(F.concat(F.lit(version + ":"), account), 256)
    half = len(vocab.FIRST_NAMES) // 2
    # Eight digest bytes form the number; dropping trailing bytes shifts it right.
    bank = _pick(vocab.DISPLAY_BANK_CODES, _bits(digest, 16) % len(vocab.DISPLAY_BANK_CODES))
    first_at = _bits(digest, 14) % len(vocab.FIRST_NAMES)
    first = _pick(vocab.FIRST_NAMES, first_at)
    last = _pick(vocab.LAST_NAMES, _bits(digest, 12) % len(vocab.LAST_NAMES))
    gender_start = F.when(first_at < half, F.lit(0)).otherwise(F.lit(half))
    second = _pick(vocab.FIRST_NAMES, gender_start + _bits(digest, 8) % half)
    doubled = (_bits(digest, 10) % 100 < vocab.DOUBLE_NAME_PERCENT) & (second != first)
    name = F.concat_ws(" ", first, F.when(doubled, second), last)
    return F.struct(tr_iban(account, bank).alias("iban"), name.alias("name"))


def tr_iban(account: Column, bank_code: Column) -> Column:
    """``TR``, two mod-97 check digits, bank code, a zero and the 16-digit account."""
    digits = account.cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(digits) < 16, F.lpad(digits, 16, "0")).otherwise(digits)
    bban = F.concat(bank_code, F.lit("0"), padded)
    # Check digits are computed over the number with country letters as 29 and 27.
    remainder = F.concat(bban, F.lit("292700")).cast("decimal(38,0)") % F.lit(97)
    check = F.lpad((F.lit(98) - remainder).cast("int").cast("string"), 2, "0")
    return F.concat(F.lit("TR"), check, bban)
