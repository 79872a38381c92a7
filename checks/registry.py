"""Registry of queries and their SQL, and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL it is compared to if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# The borders between two rounded values lie off the decimal halves: means of a few prices hit
# a half exactly, and there the last bit of a sum would decide which way a value is rounded.
BORDER = 0.4871


def fixed(column: str | Column, digits: int = 6) -> Column:
    """Round to ``digits``, with the same arithmetic as :func:`fixed_sql`."""
    c = F.col(column) if isinstance(column, str) else column
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + F.lit(BORDER)) / scale


def fixed_sql(expression: str, digits: int = 6) -> str:
    return f"floor(CAST({expression} AS DOUBLE) * 1e{digits} + {BORDER}) / 1e{digits}"


def shaped(
    df: DataFrame,
    keys: Sequence[str] = (),
    doubles: Mapping[str, int] | Sequence[str] = (),
    integers: Sequence[str] = (),
    texts: Sequence[str] = (),
) -> DataFrame:
    """The compared columns: keys as text, doubles rounded, integers as BIGINT."""
    digits = doubles if isinstance(doubles, Mapping) else dict.fromkeys(doubles, 6)
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in (*keys, *texts)],
        *[fixed(F.col(c), d).alias(c) for c, d in digits.items()],
        *[F.col(c).cast("bigint").alias(c) for c in integers],
    )


def shaped_sql(
    source: str,
    keys: Sequence[str] = (),
    doubles: Mapping[str, int] | Sequence[str] = (),
    integers: Sequence[str] = (),
    texts: Sequence[str] = (),
) -> str:
    """The SELECT that matches :func:`shaped`."""
    digits = doubles if isinstance(doubles, Mapping) else dict.fromkeys(doubles, 6)
    columns = [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in (*keys, *texts)]
    columns += [f'{fixed_sql(chr(34) + c + chr(34), d)} AS "{c}"' for c, d in digits.items()]
    columns += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in integers]
    return f"SELECT {', '.join(columns)} FROM {source}"
