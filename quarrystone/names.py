"""System columns and sizes shared by all layers."""

from __future__ import annotations

#: The two columns a normalised table ends with.
ROW_ID = "__row_id__"
ACTIVE = "__activator__"
SYSTEM = (ROW_ID, ACTIVE)


def next_power_of_two(n: int) -> int:
    """The least power of two not below ``n``; 0 for an empty table."""
    return 0 if n <= 0 else 1 << (n - 1).bit_length()


def data_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in SYSTEM]
