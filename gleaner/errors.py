"""Error codes that tables carry in place of exceptions, and the exceptions of strict calls."""

from __future__ import annotations

CODES = ("blank", "invalid_channel", "api_error", "quota", "not_found", "extraction_failed", "rate_limit", "token_limit", "authentication", "validation", "template", "invalid_video", "cancelled")


class GleanerError(Exception):
    """``code`` is one of CODES."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(message or code)
        self.code = code


def code_of_status(status: str, message: str = "''") -> str:
    """SQL expression: error code of a failed call by its HTTP status and message."""
    return f"CASE WHEN {status} = 429 THEN 'rate_limit' WHEN {status} = 401 THEN 'authentication' WHEN {status} = 403 THEN 'quota' WHEN {status} = 404 THEN 'not_found' WHEN {status} = 400 AND lower({message}) LIKE '%token%' THEN 'token_limit' WHEN {status} = 400 THEN 'validation' ELSE 'api_error' END"
