"""The stateless operators on a stream of tickets: the same columns as in batch, so nothing is kept between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sieveline.operators import access, filterlang


def filter_stream(issues: DataFrame, text: str) -> DataFrame:
    """The filter of a query over a streaming view; a sort key is an error, as a stream has no end to sort at."""
    q = filterlang.parse(text)
    if q.order_field:
        raise filterlang.FilterSyntaxError("ORDER BY needs a finite input")
    return issues.filter(filterlang.compile_tree(q.where))


def access_stream(issues: DataFrame, user_id: str, profiles: DataFrame) -> DataFrame:
    """Allowed rows of a streaming view, comments redacted; profiles are a static table."""
    return access.redacted(access.for_user(issues, user_id, profiles))
