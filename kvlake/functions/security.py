"""Hashes, tokens and their shapes."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_LENGTH = 128


def password_hash(salt: Column, password: Column) -> Column:
    """Base64 of the SHA-512 of salt and password, in one line."""
    return F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(salt, password), 512))), r"\s", "")


def fingerprint(mac: Column, salt: Column) -> Column:
    return F.sha2(F.concat(mac, salt), 256)


def hardware_token(*parts: Column) -> Column:
    """SHA-512 of the given descriptions of a machine; none is read from the machine."""
    return F.sha2(F.concat_ws("", *parts), 512)


def hex_token_valid(token: Column) -> Column:
    return F.coalesce(token.rlike(rf"^[0-9a-f]{{{TOKEN_LENGTH}}}$"), F.lit(False))


def token_shaped(token: Column) -> Column:
    return F.coalesce(token.rlike(rf"^[A-Za-z0-9]{{{TOKEN_LENGTH}}}$"), F.lit(False))


def mac_text(address: Column) -> Column:
    """Upper-case pairs of hex digits, joined by colons, of a binary address."""
    return F.array_join(F.regexp_extract_all(F.hex(address), F.lit("(..)"), 1), ":")


def new_token() -> str:
    raw = base64.urlsafe_b64encode(secrets.token_bytes(96)).decode()
    return "".join(c if c.isalnum() else "x" for c in raw)


def new_salt() -> str:
    return base64.b64encode(secrets.token_bytes(64)).decode()


def new_password() -> str:
    return base64.b64encode(secrets.token_bytes(16)).decode()
