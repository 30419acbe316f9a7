"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalized(text: Column, blanks: int = 0) -> Column:
    """Line ends as LF, trailing white space of every line gone, exactly one final LF (the text must be NFC). ``blanks``: how many
    blank lines may follow each other, of more the rest goes (0: all stay)."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.transform(F.split(unix, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    joined = F.array_join(lines, "\n")
    if blanks:
        joined = F.regexp_replace(F.regexp_replace(joined, rf"\A\n{{{blanks},}}", "\n" * blanks), rf"\n{{{blanks + 1},}}", "\n" * (blanks + 1))
    return F.concat(F.regexp_replace(joined, r"\n+\z", ""), F.lit("\n"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_digest(text: Column) -> Column:
    """Digest of the normalised text: what quotes and contexts are compared by."""
    return sha256(normalized(text))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC from two SHA-256 calls, JVM-side."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))), 256)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though lambdas inside use it for every element."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, quote: Column) -> Column:
    """0-based places of all occurrences of the quote, overlapping ones too.

    The first two are searched for. Only where there are two is the text cut before each occurrence in one pass (a
    look-ahead of the quoted text); places are the running lengths of the pieces.
    """
    none = F.array().cast("array<int>")
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    start = F.struct(F.lit(0).alias("at"), none.alias("places"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.when(s["at"] > 0, F.array_append(s["places"], s["at"])).otherwise(s["places"]).alias("places"))
    first = F.when(F.startswith(text, quote), F.array(F.lit(0))).otherwise(none)
    every = F.concat(first, F.aggregate(F.split(text, ahead, -1), start, step)["places"])
    found = let(F.position(quote, text), lambda p: F.when(p == 0, none).when(F.position(quote, text, p + 1) == 0, F.array(p - 1)).otherwise(every))
    return F.when(F.length(quote) > 0, found).otherwise(none)


def context(text: Column, start: Column, end: Column, reach: int = 64) -> Column:
    """Up to ``reach`` code points on either side, joined by NUL."""
    begin = F.greatest(start - reach, F.lit(0))
    return F.concat(F.substring(text, begin + 1, start - begin), F.lit("\0"), F.substring(text, end + 1, F.lit(reach)))


def codepoint_offset(text: Column, byte: Column) -> Column:
    """Code points before a byte offset of the UTF-8 form; null off a boundary."""
    head = F.substring(text.cast("binary"), F.lit(1), byte)
    return F.when(F.is_valid_utf8(head), F.length(head.cast("string")))


def mention_id(document: Column, cue: Column, start: Column, end: Column, kind: Column) -> Column:
    name = F.concat_ws("|", F.lit("annalist:mention:v1"), document, cue.cast("string"), start.cast("string"), end.cast("string"), kind)
    return F.concat(F.lit("MEN-"), F.substring(sha256(name), 1, 24))


def milliseconds(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    """Milliseconds of a time code; a short fraction is padded on the right."""
    return ((h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")) * 1000 + F.rpad(fraction, 3, "0").cast("long")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """NFC, then full case folding, which no built-in function does (lower keeps the sharp s)."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which no built-in function does."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: The code points that are ignorable by default (Unicode 15.1), as ranges.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
IGNORABLE_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IGNORABLE) + "]"


def ignorables(text: Column) -> Column:
    """How many of a text's code points are ignorable by default."""
    return F.length(text) - F.length(F.regexp_replace(text, IGNORABLE_CLASS, ""))


#: Tokens, model values, references and digests (whole texts).
TOKEN, MODEL_VALUE, REFERENCE, SHA256 = r"^[A-Za-z0-9_.:@/+\-]{3,64}\z", r"^[A-Za-z0-9_.:@/ +\-]{1,128}\z", r"(?U)^[\w.:@/+\-]{3,64}\z", r"^[0-9a-f]{64}\z"


def label_problem(label: Column) -> Column:
    """Why a label isn't visible text of 1 to 128 code points; null if it is: length, space, control, ignorable, base."""
    return (
        F.when(label.isNull() | ~F.length(label).between(1, 128), "length").when(label.rlike("^ | \\z|  "), "space")
        .when(label.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]"), "control").when(ignorables(label) > 0, "ignorable")
        .when(label.rlike(r"[\p{Zs}&&[^ ]]"), "space").when(~label.rlike(r"[\p{L}\p{N}]"), "base")
    )


def zoned_time(text: Column) -> Column:
    """The time of an ISO text with a zone; null without a zone or if it is no time."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)\z")
    return F.when(zoned, F.try_to_timestamp(text))


def record_name(value: Column, prefix: str, digits: int = 3) -> Column:
    """``7`` or ``PREFIX-007`` as ``PREFIX-007``; null for anything else."""
    bare = F.trim(value)
    number = F.regexp_replace(bare, "^0+(?=[0-9])", "")
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return F.when(bare.rlike(r"^[0-9]+\z"), F.concat(F.lit(f"{prefix}-"), padded)).when(bare.rlike(rf"^{prefix}-[0-9]{{{digits}}}\z"), bare)


def base_name(path: Column) -> Column:
    """The last part of a path; null if nothing usable is left. No folder may stay in a journal that is never erased."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.isin("", ".", "..") | name.contains("\\"), None).otherwise(name)


def decision_id(reference: Column, subject: Column) -> Column:
    return F.concat_ws("@", reference, F.left(subject, F.lit(12)))
