"""Session-wide switches."""

from __future__ import annotations

import logging

log = logging.getLogger("verbena")
_values = {"order_groups": True, "optimise": True, "inform": False}


def get(name: str) -> bool:
    return _values[name]


def set_order_groups(flag: bool) -> None:
    """Whether one-row-per-group verbs sort their result by the keys unless told otherwise."""
    _values["order_groups"] = flag


def group_by_order_default(x: object = None) -> bool:
    """Whether groups come sorted: a grouped frame's own flag, else the session's."""
    return x.ordered if getattr(x, "groups", None) else _values["order_groups"]


def enable_optimisations() -> None:
    _values["optimise"] = True


def disable_optimisations() -> None:
    """Aggregates of the expression library go through pandas, group by group: slow, to cross-check the native plans."""
    _values["optimise"] = False


def enable_informative_msgs() -> None:
    _values["inform"] = True


def disable_informative_msgs() -> None:
    _values["inform"] = False


def inform(text: str, *args: object) -> None:
    if _values["inform"]:
        log.warning(text, *args)
