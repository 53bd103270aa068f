"""Cutting long texts where a byte-level pre-tokenizer never joins the two sides."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Unicode white space, as the tokenizer libraries define it.
WHITE = r"\t-\r \x85\xa0  -     　"
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def safe_pieces(text: str, limit: int = 1 << 16) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, or of more where there is no safe place.

    A cut lies between a character that is not white space and the white space after it: every alternative of the
    pattern that ends in other characters stops there, and none of them looks back.
    """
    start = 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text
