"""Limits of a run and errors that may be shown."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


class UserFacingError(Exception):
    """An error with a code and a message that never holds content of the input."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class Config:
    """0 is no limit; a cluster needs none. Environment names are WA_ and the field in capitals; bad values are passed over."""

    max_upload_mb: float = 10.0
    max_parsed_rows: int = 0
    max_text_messages: int = 0
    tiny_chat_text_messages: int = 3
    small_chat_text_messages: int = 50
    min_term_messages: int = 2
    top_k_default: int = 15

    @property
    def max_upload_bytes(self) -> int:
        return int(self.max_upload_mb * (1 << 20))

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> Config:
        environ = dict(os.environ) if environ is None else environ
        out = {}
        for f in fields(cls):
            try:
                out[f.name] = type(f.default)(environ[f"WA_{f.name.upper()}"])
            except (KeyError, ValueError):
                continue
        return cls(**out)
