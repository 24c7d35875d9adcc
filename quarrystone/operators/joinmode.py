"""How a join is to be carried out, from key constraints."""

from __future__ import annotations

from dataclasses import dataclass

MANY_TO_MANY, ONE_TO_MANY, MANY_TO_ONE, ONE_TO_ONE = "many_to_many", "one_to_many", "many_to_one", "one_to_one"


@dataclass(frozen=True)
class Keys:
    """What is known of one side: its table, unique column sets, and foreign keys as (columns, table, columns)."""

    table: str = ""
    unique: tuple[frozenset[str], ...] = ()
    foreign: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    filtered: bool = False


def refers(fk: Keys, pk: Keys, on: list[tuple[str, str]]) -> bool:
    """The pairs (fk column, pk column) are a declared foreign key to unique columns of the other side."""
    if frozenset(b for _, b in on) not in pk.unique:
        return False
    return any(target == pk.table and set(zip(columns, ref, strict=True)) == set(on) for columns, target, ref in fk.foreign)


def join_mode(left: Keys, right: Keys, on: list[tuple[str, str]], how: str = "inner", residual: bool = False) -> str:
    """One side may keep its rows only if the join is inner, on columns alone, and the key side is not filtered."""
    if how != "inner" or not on or residual:
        return MANY_TO_MANY
    swapped = [(b, a) for a, b in on]
    if len(on) == 1 and frozenset([on[0][0]]) in left.unique and frozenset([on[0][1]]) in right.unique and not (left.filtered or right.filtered):
        return ONE_TO_ONE
    if refers(left, right, on) and not right.filtered:
        return MANY_TO_ONE
    if refers(right, left, swapped) and not left.filtered:
        return ONE_TO_MANY
    return MANY_TO_MANY
