"""Fernet tokens as columns: made and opened by built-in functions alone.

A token is, in base64 for URLs: the byte 80, the time in eight bytes, a start vector of 16 bytes, the text under AES-128 in CBC
mode, and the HMAC-SHA256 of all before it. A key holds 16 bytes to sign and 16 to encrypt. The HMAC is checked before anything
is decrypted.

Results for odd input: a null text has no token; a token that is null, cut short, changed, signed with another key, or older than
`ttl` has no text. A key of another length is an error.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

_HMAC_BLOCK = 64


def _halves(key: str) -> tuple[bytes, bytes]:
    raw = base64.urlsafe_b64decode(key)
    if len(raw) != 32:
        raise ValueError("a key has 32 bytes, in base64 for URLs")
    return raw[:16], raw[16:]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The 32 bytes that sign a binary column."""
    if len(key) > _HMAC_BLOCK:
        raise ValueError(f"keys of more than {_HMAC_BLOCK} bytes have to be hashed first")
    padded = key.ljust(_HMAC_BLOCK, b"\0")
    pad = lambda byte: F.lit(bytes(k ^ byte for k in padded))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def _url_safe(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def encrypted(text: Column, key: str, seconds: Column | None = None, vector: Column | None = None) -> Column:
    """A token for each text. seconds: the time in it, now if not given; vector: 16 bytes, random if not given."""
    sign, secret = _halves(key)
    seconds = F.unix_timestamp() if seconds is None else seconds.cast("long")
    # of CBC, the vector comes before the encrypted text
    options = (F.lit("CBC"), F.lit("DEFAULT"), *(() if vector is None else (vector,)))
    body = F.concat(F.lit(b"\x80"), F.unhex(F.lpad(F.hex(seconds), 16, "0")), F.aes_encrypt(text.cast("binary"), F.lit(secret), *options))
    # the body is computed once, as a random vector would differ
    return F.get(F.transform(F.array(body), lambda b: _url_safe(F.concat(b, hmac_sha256(sign, b)))), F.lit(0))


def decrypted(token: Column, key: str, ttl: int | None = None, now: Column | None = None) -> Column:
    """The text of each token, null where it does not hold; ttl: how many seconds old it may be, at `now` or the current time."""
    sign, secret = _halves(key)
    clean = F.when(token.rlike(r"^[A-Za-z0-9_-]+={0,2}$") & (F.length(token) % 4 == 0), F.translate(token, "-_", "+/"))
    raw = F.try_to_binary(clean, F.lit("base64"))

    def opened(t: Column) -> Column:
        size = F.octet_length(t)
        body, mark = F.substr(t, F.lit(1), size - 32), F.substr(t, size - 31, F.lit(32))
        made = F.conv(F.hex(F.substr(t, F.lit(2), F.lit(8))), 16, 10).cast("long")
        right = (size >= 1 + 8 + 16 + 16 + 32) & (F.hex(F.substr(t, F.lit(1), F.lit(1))) == "80") & (mark == hmac_sha256(sign, body))
        if ttl is not None:
            right = right & (made + ttl >= (F.unix_timestamp() if now is None else now))
        return F.when(right, F.try_aes_decrypt(F.substr(body, F.lit(10), size - 41), F.lit(secret), F.lit("CBC"), F.lit("DEFAULT")).cast("string"))

    return F.get(F.transform(F.array(raw), opened), F.lit(0))
