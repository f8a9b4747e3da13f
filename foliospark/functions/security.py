"""Masking of secrets in text columns, as a fold of ordered patterns."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"


@dataclass(frozen=True)
class StringMask:
    """A literal or a regular expression, replaced everywhere."""

    pattern: str
    regex: bool = False
    replacement: str = MASK

    def apply(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern if self.regex else quoted(self.pattern), self.replacement.replace("$", "\\$"))


@dataclass(frozen=True)
class KeyMask:
    """The value that follows a field name and a colon or equals sign, in any case."""

    field: str
    pattern: str = r"[A-Za-z0-9\-_.~%+/=@]+"
    replacement: str = MASK

    def apply(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"""(?i)({quoted(self.field)}["']?\s*[:=]\s*["']?)({self.pattern})""", "$1" + self.replacement.replace("$", "\\$"))


@dataclass(frozen=True)
class FuzzyKeyMask:
    """Like KeyMask for several field-name patterns, the longest first."""

    fields: tuple[str, ...]
    pattern: str = r"[A-Za-z0-9\-_.~%+/=@]+"
    replacement: str = MASK

    def apply(self, text: Column) -> Column:
        names = "|".join(sorted(self.fields, key=lambda f: (-len(f), f)))
        return F.regexp_replace(text, rf"""(?i)((?:{names})["']?\s*[:=]\s*["']?)({self.pattern})""", "$1" + self.replacement.replace("$", "\\$"))


DEFAULT_MASKS = (
    FuzzyKeyMask(("api_?key", "password", "passwd", "secret", "token")),
    KeyMask("mailto", r"[A-Za-z0-9._%+-]+(?:@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    StringMask(r"[A-Za-z0-9._%+-]+(?:@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}", regex=True),
    StringMask(r"(?i)bearer [A-Za-z0-9._~+/-]+=*", regex=True),
)


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def mask_text(text: Column, masks: tuple = DEFAULT_MASKS) -> Column:
    for mask in masks:
        text = mask.apply(text)
    return text


def mask_string(text: str, masks: tuple = DEFAULT_MASKS) -> str:
    """The same masks on one text of the driver."""
    for m in masks:
        if isinstance(m, StringMask):
            text = re.sub(m.pattern if m.regex else re.escape(m.pattern), lambda _, m=m: m.replacement, text)
            continue
        fields = m.fields if isinstance(m, FuzzyKeyMask) else (re.escape(m.field),)
        names = "|".join(sorted(fields, key=lambda f: (-len(f), f)))
        text = re.sub(rf"""((?:{names})["']?\s*[:=]\s*["']?)({m.pattern})""", lambda x, m=m: x[1] + m.replacement, text, flags=re.I)
    return text


class MaskingFilter(logging.Filter):
    """Masks a log record's message and its text arguments."""

    def __init__(self, masks: tuple = DEFAULT_MASKS) -> None:
        super().__init__()
        self.masks = masks

    def filter(self, record: logging.LogRecord) -> bool:
        masked = lambda x: mask_string(x, self.masks) if isinstance(x, str) else x
        record.msg = masked(record.msg)
        if isinstance(record.args, dict):
            record.args = {k: masked(v) for k, v in record.args.items()}
        elif record.args:
            record.args = tuple(map(masked, record.args))
        return True
