"""Pre-tokens by the public byte-level pattern."""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import regex

_WHOLE = regex.compile(public_tokenizers.PATTERN)
_LATIN_END = 0x250


@lru_cache(maxsize=1)
def _latin() -> tuple[re.Pattern, re.Pattern]:
    """The same pattern for texts below U+0250, its character classes written out for the faster engine."""
    chars = [chr(c) for c in range(_LATIN_END)]

    def of(pattern: str) -> str:
        test = regex.compile(pattern)
        return "".join(f"\\u{ord(c):04x}" for c in chars if test.match(c))

    letters, numbers, blanks = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    fast = (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+"
        f"|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )
    return re.compile(fast), re.compile(f"[^\\u0000-\\u{_LATIN_END - 1:04x}]")


def pretokens(text: str) -> list[str]:
    fast, beyond = _latin()
    return _WHOLE.findall(text) if beyond.search(text) else fast.findall(text)
