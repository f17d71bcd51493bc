"""tessera: a grammar of data manipulation compiled to plain Spark DataFrame plans.

Verbs are functions of frames: ``select(df, "a", starts_with("b"))``. Frames are ordinary
``pyspark.sql.DataFrame``s; ``group_by`` gives a ``Grouped`` that every verb takes as well.
"""

from .access import as_type, column, row, rows, values
from .errors import (
    ColumnTypeCastError,
    DuplicatedColumnNameError,
    InvalidColumnOperationError,
    InvalidColumnSelectError,
    InvalidSortingPredicateError,
    MissingValueError,
    NonScalarValueError,
    OrderRequiredError,
    TesseraError,
    UnknownColumnError,
)
from .functions.aggs import (
    SumFuns,
    aggregate,
    count_where,
    first,
    has_nulls,
    last,
    length,
    maximum,
    mean,
    median,
    minimum,
    n,
    n_na,
    sd,
    total,
)
from .functions.exprs import (
    and_,
    const,
    eq,
    ge,
    gt,
    ieee_div,
    in_list,
    is_matching,
    is_na,
    is_not_na,
    le,
    lt,
    map_series,
    map_values,
    not_,
    or_,
    to_booleans,
    to_doubles,
    to_ints,
    to_longs,
    to_strings,
    where,
    xor,
)
from .functions.selectors import by_type, col_range, ends_with, everything, except_, matches, one_of, starts_with, where_
from .functions.windows import cum_sum, filled, lag, lead, order_positions, pct_change, rank, row_number
from .grouped import Grouped
from .names import c
from .operators.bind import add_row, bind_cols, bind_columns, bind_rows
from .operators.grouping import (
    count,
    count_expr,
    cube,
    group_by,
    group_by_expr,
    grouped_by,
    groups,
    rollup,
    rowwise,
    summarize,
    summarize_at,
    summarize_udf,
    totals_row,
    transform_groups,
    ungroup,
)
from .operators.joins import anti_join, cross_product, inner_join, left_join, outer_join, right_join, semi_join
from .operators.reshape import complete, expand, flatten, gather, nest, separate, spread, unfold, unite, unnest
from .operators.verbs import (
    add_column,
    add_columns,
    add_row_number,
    as_factor,
    distinct,
    fill,
    filter_by_row,
    filter_not_null,
    filter_rows,
    head,
    insert_column,
    move_left,
    move_right,
    one_hot,
    remove,
    remove_if,
    remove_type,
    rename,
    sample_frac,
    sample_n,
    select,
    select_if,
    select_type,
    set_names,
    shuffle,
    slice_rows,
    sorted_by,
    sorted_by_desc,
    tail,
    take,
    take_last,
    transmute,
)
from .order import desc, with_index, with_row_id
from .render import as_string, column_types, equal, schema_string, shape, show, to_html

__all__ = [name for name in dir() if not name.startswith("_")]
