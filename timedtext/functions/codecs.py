"""Bytes to text and back.

UTF-8, ASCII and Latin-1 stay in the JVM. All other codecs are Python's, called on Arrow
batches; a row that needs no Python codec sends null there.
"""

from __future__ import annotations

import codecs
from encodings import normalize_encoding
from functools import lru_cache
from importlib import import_module

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# --- fixed values -----------------------------------------------------------
UTF8_NAMES = ["utf-8", "utf8"]
UTF8_BOM_NAMES = ["utf-8-sig"]
ASCII_NAMES = ["ascii", "us-ascii"]
LATIN1_NAMES = ["iso8859-1", "iso-8859-1", "latin-1", "latin1"]
# --- end of fixed values ----------------------------------------------------

NATIVE = UTF8_NAMES + UTF8_BOM_NAMES + ASCII_NAMES + LATIN1_NAMES
BOM = bytearray(b"\xef\xbb\xbf")


@F.pandas_udf(StringType())
def python_decode(content: pd.Series, name: pd.Series) -> pd.Series:
    def decode(data: bytes | None, codec: str | None) -> str | None:
        if data is None or codec is None:
            return None
        try:
            return data.decode(codec)
        except (UnicodeError, LookupError):
            return None

    return pd.Series([decode(d, c) for d, c in zip(content, name)], dtype=object)


@F.pandas_udf(BinaryType())
def python_encode(text: pd.Series, name: pd.Series) -> pd.Series:
    def encode(value: str | None, codec: str | None) -> bytes | None:
        if value is None or codec is None:
            return None
        try:
            return value.encode(codec, errors="replace")
        except (UnicodeError, LookupError):
            return None

    return pd.Series([encode(t, c) for t, c in zip(text, name)], dtype=object)


CHUNK_BYTES = 1 << 16


@lru_cache(maxsize=None)
def table_bytes(name: str) -> bytes | None:
    """The bytes that a codec of one byte a character can decode; null for other codecs."""
    module = normalize_encoding(codecs.lookup(name).name)
    try:
        table = import_module(f"encodings.{module}").decoding_table
    except (ImportError, AttributeError):
        return None
    return bytes(b for b, char in enumerate(table) if char != "\ufffe")


def decoded_length(data: bytes, name: str) -> int | None:
    """How many characters the bytes are in a codec, CRLF counted once; null if they do not fit.

    A table codec needs no decoding: only which bytes there are. Others get the bytes in chunks,
    each once, and stop at the first that does not fit; no decoded text is held.
    """
    known = table_bytes(name)
    if known is not None:
        return None if data.translate(None, known) else len(data) - crlf_bytes(data, name)
    if codecs.lookup(name).name in UTF8_BOM_NAMES:  # in chunks it would take half a mark for none
        data, name = data.removeprefix(BOM), "utf-8"
    decoder = codecs.getincrementaldecoder(name)()
    length, carriage = 0, False
    try:
        for at in range(0, max(1, len(data)), CHUNK_BYTES):
            text = decoder.decode(data[at : at + CHUNK_BYTES], at + CHUNK_BYTES >= len(data))
            length += len(text) - text.count("\r\n") - (carriage and text.startswith("\n"))
            carriage = text.endswith("\r") if text else carriage
    except UnicodeError:
        return None
    return length


def crlf_bytes(data: bytes, name: str) -> int:
    """How many CRLF there are in the bytes of a table codec, whatever bytes it has for them."""
    return data.count("\r\n".encode(name))


def known_codec(name: str) -> bool:
    try:
        codecs.lookup(name)
    except LookupError:
        return False
    return True


def decode_bytes(content: Column, name: Column) -> Column:
    """Strict decoding; null where the bytes do not fit or the codec is unknown."""
    codec = F.lower(name)
    utf8 = F.try_validate_utf8(content.cast("string"))
    ascii_only = ~F.rlike(utf8, F.lit(r"[^\x00-\x7F]"))
    other = ~codec.isin(NATIVE)
    return (
        F.when(codec.isin(UTF8_NAMES), utf8)
        .when(codec.isin(UTF8_BOM_NAMES), F.regexp_replace(utf8, r"\A\x{FEFF}", ""))
        .when(codec.isin(ASCII_NAMES), F.when(ascii_only, utf8))
        .when(codec.isin(LATIN1_NAMES), F.decode(content, "ISO-8859-1"))
        .otherwise(python_decode(F.when(other, content), F.when(other, codec)))
    )


def encode_text(text: Column, name: Column) -> Column:
    """Bytes with ``?`` for what the codec cannot say; null for an unknown codec.

    ``utf-8-sig`` puts a byte-order mark in front, also where the text has one.
    """
    codec = F.lower(name)
    other = ~codec.isin(NATIVE)
    utf8 = text.cast("binary")

    def single_byte(pattern: str, charset: str) -> Column:
        return F.encode(F.regexp_replace(text, pattern, "?"), charset)

    return (
        F.when(codec.isin(UTF8_NAMES), utf8)
        .when(codec.isin(UTF8_BOM_NAMES), F.concat(F.lit(BOM), utf8))
        .when(codec.isin(ASCII_NAMES), single_byte(r"[^\x00-\x7F]", "US-ASCII"))
        .when(codec.isin(LATIN1_NAMES), single_byte(r"[^\x00-\xFF]", "ISO-8859-1"))
        .otherwise(python_encode(F.when(other, text), F.when(other, codec)))
    )
