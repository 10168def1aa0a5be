"""Registering a query with its SQL: both sides round the same columns alike."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import STAR_SQL, star_lines

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimals, where a query doesn't name its own.
RATIO = 6
#: Moves values off the ties of rounding, where sums in another order fall on either side.
NUDGE = 1.000000000001


def _digits(spec: str) -> dict[str, int]:
    """'a b:2' is {'a': 6, 'b': 2}."""
    return {p.split(":")[0]: int(p.split(":")[1]) if ":" in p else RATIO for p in spec.split()}


def register(name: str, build: Callable[[DataFrame], DataFrame] | None, sql: str | None, doubles: str = "", source: Callable[..., DataFrame] | None = None) -> None:
    """build gets the sales lines. sql may start with WITH; tx is defined before it. doubles: columns to round, as name or name:decimals."""
    digits = _digits(doubles)

    def run(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
        """tx: sales lines that several queries share, in place of those of the folder."""
        df = (source(spark, sf_dir) if tx is None else source(spark, sf_dir, tx)) if source else build(star_lines(spark, sf_dir) if tx is None else tx)
        # adding 0.0 turns -0.0 into 0.0
        return df.withColumns({c: F.round(F.col(c).cast("double") * NUDGE, d) + F.lit(0.0) for c, d in digits.items()}) if digits else df

    QUERIES[name] = run
    if sql is None:
        return
    body = sql.strip()
    text = f"WITH {STAR_SQL}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {STAR_SQL} {body}"
    if digits:
        text = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) * {NUDGE!r}, {d}) + 0.0 AS {c}' for c, d in digits.items())}) FROM ({text})"
    ORACLE_SQL[name] = text
