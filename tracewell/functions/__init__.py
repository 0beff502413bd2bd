"""Names as the lineage engine compares them."""

from __future__ import annotations


def normalized(name: str | None) -> str | None:
    """An identifier without outer white space and quotes, in lower case; null stays null."""
    return None if name is None else name.strip().strip("`").strip('"').lower()
