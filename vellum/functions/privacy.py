"""Free text made safe to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of fields whose values are secret.
SECRET = "password|passwd|pwd|secret|token|cookie|authorization|session|credential|api[_-]?key|private[_-]?key|access[_-]?key"


def redacted_text(text: Column) -> Column:
    """Bearer and basic credentials, values of secret fields, local file paths and mail addresses are replaced."""
    out = F.regexp_replace(text, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 <redacted>")
    out = F.regexp_replace(out, rf"(?i)\b((?:\w+[_-])?(?:{SECRET}))(\s*[=:]\s*)[^\s,;]+", "$1$2<redacted>")
    out = F.regexp_replace(out, r"\b[A-Za-z]:\\[^\s\"']+|\\\\[^\s\"']+", "<path>")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<mail>")


def message(text: Column, most: int = 500) -> Column:
    """The first line that isn't blank, without markup, cut at a length, redacted."""
    line = F.regexp_extract(text, r"^\s*([^\r\n]+)", 1)
    return F.substring(F.trim(redacted_text(F.regexp_replace(line, "<[^>]*>.*$", ""))), 1, most)


# Parts of names of fields that hold secrets.
SENSITIVE_SEGMENTS = (
    "auth", "authentication", "authorization", "bearer", "cookie", "credential", "credentials", "csrf", "password", "passwd", "secret", "session", "sessionid", "sig", "signature", "ticket", "token",
)


def is_sensitive_key(key: Column) -> Column:
    """A part of the name, parted by signs or by capitals, names a secret, or it ends as a key's name does."""
    parted = F.regexp_replace(F.lower(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+", "_")
    plain = F.regexp_replace(parted, "^_+|_+$", "")
    return F.arrays_overlap(F.split(plain, "_"), F.array(*map(F.lit, SENSITIVE_SEGMENTS))) | plain.rlike("(?:api|private)_?key$")
