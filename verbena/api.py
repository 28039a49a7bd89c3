"""Verbs as functions of a frame: ``f_mutate(df, ...)`` is ``tidy(df).mutate(...)``."""

from __future__ import annotations

from .functions import expressions, scalars
from .functions.expressions import (
    across, c_across, col, cur_column, cur_data, cur_group, cur_group_id, cur_group_rows, first, group_function, if_all, if_any, lag, last, lead, max, mean, median, min, n, n_distinct, pick, prod, row_number, sd, sum, var,
)
from .functions.scalars import get_group_unaware_fns
from .functions.selectors import all_of, any_of, contains, ends_with, everything, last_col, matches, nothing, num_range, span, starts_with, where
from .operators.frame import Desc, Tidy, bind_cols, bind_rows, desc, tidy
from .settings import disable_informative_msgs, disable_optimisations, enable_informative_msgs, enable_optimisations, group_by_order_default
from .sources.tables import as_tbl, crossing, deframe, enframe, list_tidy, nesting, new_tbl

_VERBS = (
    "select rename pull mutate filter fill group_by ungroup summarise summarize reframe count add_count distinct duplicates arrange "
    "slice slice_head slice_tail slice_min slice_max slice_sample left_join right_join inner_join full_join semi_join anti_join cross_join "
    "union union_all expand complete nest_by group_split rowwise group_data group_keys group_vars group_rows group_indices group_size n_groups"
).split()
_PLAIN = "add_group_id add_row_id add_consecutive_id remove_rows_if_any_na remove_rows_if_all_na group_ordered".split()


def _verb(name: str):
    def verb(data: object, *args: object, **named: object):
        return getattr(tidy(data), name)(*args, **named)

    verb.__name__ = name
    verb.__doc__ = getattr(Tidy, name).__doc__
    return verb


globals().update({f"f_{v}": _verb(v) for v in _VERBS} | {v: _verb(v) for v in _PLAIN})
f_bind_rows, f_bind_cols, f_enframe, f_deframe = bind_rows, bind_cols, enframe, deframe


def tidy_quantiles(data: object, *columns: object, **named: object) -> Tidy:
    return tidy(data).quantiles(*columns, **named)


def group_id(data: object, *columns: object, **named: object) -> Tidy:
    return tidy(data).add_group_id(*columns, name="group_id", **named).select("group_id")


def row_id(data: object, *columns: object, **named: object) -> Tidy:
    return tidy(data).add_row_id(*columns, name="row_id", **named).select("row_id")


def f_consecutive_id(data: object, *columns: object, **named: object) -> Tidy:
    return tidy(data).add_consecutive_id(*columns, name="consecutive_id", **named).select("consecutive_id")
