"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Null for a null or whitespace-only string, else the value itself."""
    c = as_col(c)
    return F.when(F.trim(c.cast("string")) != "", c)


def seeded_key(seed: int, *keys: str | Column) -> Column:
    """Order key that shuffles rows the same way on every run: md5("seed:key[:key...]")."""
    parts = [F.lit(str(seed))] + [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def label_set(c: str | Column, sep: str = ",") -> Column:
    """Trimmed, lower-cased, non-empty members of a separated label list."""
    members = F.transform(F.split(as_col(c), sep), lambda x: F.lower(F.trim(x)))
    return F.filter(members, lambda x: x != "")


def messages(*rules: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose predicate holds, in rule order (null predicate = no)."""
    return F.array_compact(
        F.array(*[F.when(p, F.lit(m) if isinstance(m, str) else m) for p, m in rules])
    )


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, with ``empty`` where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def fixed(c: str | Column, digits: int) -> Column:
    """Decimal text of a non-negative double rounded half-even on its exact binary value.

    ``format_string`` rounds the shortest decimal form half-up, which gives another last
    digit for values such as 0.285 or 0.125. The product with 10**digits is split into its
    rounded value and its exact error; the sign of what lies beyond the half moves the value
    off the tie before it is formatted.
    """
    x = as_col(c).cast("double")
    scale = float(10**digits)
    prod = x * F.lit(scale)
    big = x * F.lit(134217729.0)
    hi = big - (big - x)
    beyond_half = (prod - F.floor(prod) - F.lit(0.5)) + ((hi * F.lit(scale) - prod) + (x - hi) * F.lit(scale))
    tie = (x * F.lit(2.0 ** (digits + 1))) % 2 == 1
    down = F.when(tie & (F.floor(prod) % 2 == 0), 1.0).otherwise(0.0)
    moved = x + (F.signum(beyond_half) - down) * F.lit(10.0 ** -(digits + 4))
    return F.format_string(f"%.{digits}f", F.greatest(moved, F.lit(0.0)))


def fixed_micros(c: str | Column, digits: int) -> Column:
    """Seconds text, rounded half-even, of a non-negative whole number of microseconds."""
    unit = 10 ** (6 - digits)
    m = as_col(c).cast("bigint")
    # Half up, but one less on a tie below an even number of units.
    even_tie = m % F.lit(2 * unit) == unit // 2
    shifted = m + F.lit(unit // 2) - F.when(even_tie, 1).otherwise(0)
    units = (shifted - shifted % F.lit(unit)) / F.lit(unit)
    return F.format_string(f"%.{digits}f", units / F.lit(float(10**digits)))
