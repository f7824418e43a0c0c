"""Logging that keeps personal data out of messages."""

from __future__ import annotations

import logging
import re

from nestwright.functions.scalars import EMAIL, PRIVATE_FIELDS, REDACTED, SSN


def scrub(value, name: str = ""):
    """A copy without personal data: named fields whole, texts by pattern, nested values inside."""
    if name.lower() in PRIVATE_FIELDS:
        return REDACTED
    if isinstance(value, str):
        return re.sub(EMAIL, REDACTED, re.sub(SSN, REDACTED, value))
    if isinstance(value, dict):
        return {k: scrub(v, str(k)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(scrub(v) for v in value)
    return value


class PrivacyFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = scrub(record.getMessage()), None
        return True


def get_logger(name: str) -> logging.Logger:
    log = logging.getLogger(name)
    if not any(isinstance(f, PrivacyFilter) for f in log.filters):
        log.addFilter(PrivacyFilter())
    return log
