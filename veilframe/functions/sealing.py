"""Authenticated messages from built-in hash and cipher expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_TYPE = "model_update"
NO_COUNTER = -1
# Fixed values of HMAC (RFC 2104): pad bytes repeated to 32 bits, block of 64 bytes.
_INNER, _OUTER = 0x36363636, 0x5C5C5C5C
_WORD_DIGITS, _BLOCK_WORDS = 8, 16


def counter_or_default(counter: str = "counter") -> Column:
    """A message without a counter counts as -1 and is therefore a replay."""
    return F.coalesce(F.col(counter).cast("bigint"), F.lit(NO_COUNTER).cast("bigint"))


def aad(client: str = "client_id", counter: str = "counter") -> Column:
    """Associated data: compact JSON with sorted keys."""
    fields = {"client_id": F.col(client), "counter": counter_or_default(counter), "type": F.lit(MESSAGE_TYPE)}
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def canonical_json(cols: list[str]) -> Column:
    """Compact JSON of the columns with sorted keys; NULL stays visible."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def seal(text: Column, key: Column, associated: Column) -> Column:
    """AES-256-GCM; the result is nonce, ciphertext and tag. The nonce is fresh, so write the result once."""
    return F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), associated)


def unseal(sealed: Column, key: Column, associated: Column) -> Column:
    """Text of a sealed message; NULL when key, associated data or bytes do not fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), associated).cast("string")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hmac_pads(key: Column) -> tuple[Column, Column]:
    """Inner and outer HMAC pad of a 32-byte key, computed once per key."""
    padded = F.rpad(F.hex(key), _WORD_DIGITS * _BLOCK_WORDS, "0")

    def xor_with(word: int) -> Column:
        def one(i: Column) -> Column:
            value = F.conv(F.substr(padded, i * _WORD_DIGITS + 1, F.lit(_WORD_DIGITS)), 16, 10).cast("bigint")
            return F.lpad(F.hex(value.bitwiseXOR(F.lit(word).cast("bigint"))), _WORD_DIGITS, "0")

        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_BLOCK_WORDS - 1)), one), ""))

    return xor_with(_INNER), xor_with(_OUTER)


def tag(text: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 of the text as hex."""
    first = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)
