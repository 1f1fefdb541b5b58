"""Words of whole texts as bytes: only A-Z lowered; ASCII digits and letters and everything beyond ASCII belong to words."""

from __future__ import annotations

import re

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(data: bytes | None) -> list[bytes]:
    """``bytes.lower`` touches A-Z alone, and every byte of a character beyond ASCII is over 0x7F."""
    return TERM.findall(data.lower()) if data else []
