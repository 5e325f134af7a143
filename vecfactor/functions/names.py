"""Model names: validation and generation."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the alphabet and length of generated model names
NAME_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
NAME_LENGTH = 32
# a model name is one path piece of letters, digits, '_' or '-'
NAME_PATTERN = r"^[0-9A-Za-z_-]+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_name(name) -> Column:
    return F.coalesce(_col(name).rlike(NAME_PATTERN), F.lit(False))


def last_path_piece(name) -> Column:
    """What the service kept of a name on load: the text after the last '/'."""
    return F.element_at(F.split(_col(name), "/", -1), -1)


def generate_name() -> str:
    """One random name (driver side: a name is control data, not table data)."""
    return "".join(secrets.choice(NAME_ALPHABET) for _ in range(NAME_LENGTH))


def generated_names(*key_cols, nonce: str | None = None) -> Column:
    """A 32-character name per row from the row key and a nonce.

    Hex digits are a subset of the name alphabet; the nonce is a literal in
    the plan, so a recomputed task yields the same name. Without a ``nonce`` each
    call draws its own; with one (a batch's key) the same batch gets the same names.
    """
    nonce = secrets.token_hex(16) if nonce is None else nonce
    parts = [F.lit(nonce)] + [_col(c).cast("string") for c in key_cols]
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, NAME_LENGTH)
