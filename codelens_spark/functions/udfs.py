"""Optional Arrow-batched plug-ins; the built-in estimates need none of them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def token_counter(encode: Callable[[str], list]):
    """pandas_udf counting tokens with a tokenizer's `encode`; null and empty texts count 0.

    Pass it as `counter` to `operators.aggregates.token_totals`.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def embedder(embed: Callable[[list[str]], list]):
    """pandas_udf turning text batches into vectors with a user's batch function."""

    @F.pandas_udf("array<float>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed([t or "" for t in texts])), index=texts.index)

    return apply
