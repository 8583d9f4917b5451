"""Text functions as column expressions, with Arrow UDFs only for Unicode normalisation beyond Latin letters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Between the words of a pair.
JOINER = "␟"
#: Texts for which normalising changes nothing, and folding case is lower() but for one letter.
_PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
_WORD = re.compile(r"[^\W_]+")

#: Words looked for in a URL's path, in order of precedence.
PATH_INTENTS = ("login", "signin", "verify", "account", "password", "payment", "invoice", "update")
#: Patterns of personal data.
EMAIL = r"(?i)(?<![\w.+-])[\w.+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![\w-])"
PHONE = r"(?<!\w)(?:\+?\d[\d(). -]{7,}\d)(?!\w)"
LONG_NUMBER = r"(?<!\w)\d{8,}(?!\w)"
ACTIVE_URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"


@F.pandas_udf(ArrayType(StringType()))
def _folded_tokens(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _WORD.findall(unicodedata.normalize("NFKC", t).casefold()) for t in text], dtype="object")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in text], dtype="object")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the NFKC-normalised, case-folded text. Null has none.

    Texts of Latin letters stay in the JVM; the others alone are passed to Python.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_like(text, F.lit(_PLAIN))
    native = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.when(plain, native).otherwise(_folded_tokens(F.when(~plain, text)))


def pairs(words: Column) -> Column:
    """Neighbouring words joined; a lone word itself."""
    n = F.size(words)
    joined = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(JOINER), b))
    return F.when(n < 2, words).otherwise(joined)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def content_digest(subject: Column, body: Column) -> Column:
    """SHA-256 of the normalised subject and body: NFC, line ends as \\n, stripped."""
    both = [F.coalesce(c, F.lit("")) for c in (subject, body)]
    plain = [F.when(F.regexp_like(c, F.lit(_PLAIN)), c).otherwise(_nfc(F.when(~F.regexp_like(c, F.lit(_PLAIN)), c))) for c in both]
    lines = F.regexp_replace(plain[1], r"\r\n?", "\n")
    return F.sha2(F.concat(strip(plain[0]), F.lit("\n\n"), strip(lines)), 256)


def sample_id(source: Column, path: Column, index: Column, raw_sha: Column) -> Column:
    """A message's id, from where it lies and what it holds; a missing index prints as None."""
    locator = F.concat_ws(":", source, path, F.coalesce(index.cast("string"), F.lit("None")), raw_sha)
    return F.concat(F.lit("sample_"), F.substring(F.sha2(locator, 256), 1, 24))


def duplicate_group_id(content_sha: Column) -> Column:
    return F.concat(F.lit("exact_"), F.substring(content_sha, 1, 24))


def seeded(seed: int, *parts: Column) -> Column:
    """A hexadecimal digest to order by."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def safe(value: object) -> str:
    """Of the first 80 characters of a text the letters, digits, dots, underscores and dashes; "unknown" if there are none."""
    kept = filter(lambda c: c.isalnum() or c in "._-", value[:80]) if isinstance(value, str) else ()
    return "".join(kept) or "unknown"


@F.pandas_udf(StringType())
def safe_diagnostic(text: pd.Series) -> pd.Series:
    return pd.Series([safe(t) for t in text], dtype="object")
