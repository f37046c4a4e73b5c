"""Column expressions built from Spark's built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def padded_id(prefix: str, col, width: int) -> Column:
    """``prefix`` followed by the zero-padded non-negative integer; a number
    wider than ``width`` is kept whole (lpad alone would truncate it)."""
    s = _c(col).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def cycle_pick(values: list[str], col) -> Column:
    """Element ``col mod len(values)`` of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(_c(col), F.lit(len(values))) + 1).cast("int"))


def dec(col, p: int, s: int) -> Column:
    return _c(col).cast(f"decimal({p},{s})")


def concentration_band(weight: Column) -> Column:
    expr = None
    for bound, label in K.CONCENTRATION_BANDS:
        cond = weight > F.lit(bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(K.CONCENTRATION_DEFAULT)


def fx_bucket(currency: Column) -> Column:
    return (F.when(currency == "USD", "DOMESTIC")
            .when(currency.isin(*K.MAJOR_FX), "MAJOR_FX")
            .otherwise("EM_FX"))


def cross_currency_flag(currency: Column) -> Column:
    """1 when the raw currency differs from 'USD'; NULL counts as 0."""
    return F.when(currency != "USD", 1).otherwise(0)


def asset_class_display(asset_class: Column) -> Column:
    expr = None
    for code, label in K.ASSET_CLASS_DISPLAY:
        cond = asset_class == code
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(K.ASSET_CLASS_DISPLAY_DEFAULT)


def ratio6(num: Column, den: Column, zero_value) -> Column:
    """ROUND(num/den, 6) as double; ``zero_value`` when den is 0 or NULL.

    Both sums are cast to decimal(38,2): Spark then types the quotient as
    decimal(38,6), i.e. it is rounded half up once, exactly, at 6 places,
    and only then turned into a double.
    """
    n = num.cast("decimal(38,2)")
    d = den.cast("decimal(38,2)")
    return (F.when((d == 0) | d.isNull(), F.lit(zero_value).cast("double"))
            .otherwise(F.round(n / d, 6).cast("double")))


def int_div(a: Column, b: Column) -> Column:
    """Exact floor(a / b) for integers, b > 0 (a minus its remainder divides b)."""
    a = a.cast("decimal(38,0)")
    b = b.cast("decimal(38,0)")
    return ((a - F.pmod(a, b)) / b).cast("long")


def half_up_div(a: Column, b: Column) -> Column:
    """round(a / b) for integers with b > 0; halves go away from zero."""
    size = int_div(F.abs(a) * 2 + b, b * 2)
    return F.when(a < 0, -size).otherwise(size)


def tenths_text(tenths: Column) -> Column:
    """Integer tenths -> 'd.d'."""
    return F.concat(int_div(tenths, F.lit(10)).cast("string"), F.lit("."),
                    F.pmod(tenths, F.lit(10)).cast("string"))


def hundredths_text(h: Column) -> Column:
    """Integer hundredths -> 'd.dd'."""
    return F.concat(int_div(h, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"))


def layer_name(target_name: Column, target_schema: Column, custom: Column) -> Column:
    """Schema for a model: none -> target schema; prod -> custom; else both."""
    return (F.when(custom.isNull(), target_schema)
            .when(target_name == "prod", F.trim(custom))
            .otherwise(F.concat_ws("_", target_schema, F.trim(custom))))


def layer_name_py(target_name: str, target_schema: str, custom: str | None) -> str:
    """Same rule for driver-side path naming."""
    if custom is None:
        return target_schema
    if target_name == "prod":
        return custom.strip()
    return f"{target_schema}_{custom.strip()}"


def money_sum(col) -> Column:
    """SUM of a 2-place money column, as decimal(38,2)."""
    return F.sum(_c(col)).cast("decimal(38,2)")


def money_max(col) -> Column:
    """MAX of a 2-place money column, as decimal(20,2)."""
    return F.max(_c(col)).cast("decimal(20,2)")
