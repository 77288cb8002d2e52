"""Errors and warnings with the codes and exit statuses that the command line reports."""
from __future__ import annotations

#: Kind -> (code, exit status).
KINDS = {
    "usage": ("KC1001", 2), "io": ("KC1002", 3), "parse": ("KC1003", 4), "validation": ("KC1004", 5), "unsupported": ("KC1005", 6), "internal": ("KC1006", 10),
}
WARNING = "KW2001"


class SeqError(Exception):
    def __init__(self, kind: str, message: str):
        self.kind = kind
        self.code, self.status = KINDS[kind]
        super().__init__(f"{self.code} {message}")
