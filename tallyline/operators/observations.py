"""Values that people noted: read by the type of their key, and admitted or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import small

#: Words for yes and for no.
YES = ("yes", "y", "true", "1", "예", "네", "o", "ㅇ")
NO = ("no", "n", "false", "0", "아니오", "아니요", "x")

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(text: Column) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def noted_number(text: Column) -> Column:
    """A number written with a point or a comma; words for what is no finite number give NaN, all else null."""
    t = F.replace(stripped(text), F.lit(","), F.lit("."))
    return F.when(F.rlike(t, F.lit(NUMBER)), t.try_cast("double")).when(F.rlike(F.lower(t), F.lit("^[+-]?(nan|inf|infinity)$")), F.lit(float("nan")))


def _bad(number: Column) -> Column:
    return F.isnan(number) | (number < 0) | (number == float("inf"))


def typed_values(rows: DataFrame, spec: DataFrame, key: str = "key", raw: str = "value") -> DataFrame:
    """rows with number, flag, text (the one that the key's type fills) and error, null if the value could be read.

    spec: (key, type, allowed): a row for each key, of type color, px, hz, ratio (above 0, at most 2), bool or enum (one of allowed).
    A color is #RRGGBB in capitals; px and hz are finite numbers of at least 0. A null value is an empty one; columns of rows named as
    the results are replaced. Null or unlisted keys are unknown.
    """
    kinds = spec.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("type", "allowed")).alias("_spec"))
    s, kind = stripped(F.col(raw).cast("string")), F.col("_spec.type")
    number, hex_ = noted_number(s), F.regexp_extract(s, "^#*([0-9A-Fa-f]{6})$", 1)
    flag = F.when(F.lower(s).isin(*YES), True).when(F.lower(s).isin(*NO), False)
    listed = F.coalesce(F.array_contains("_spec.allowed", s), F.lit(False))
    measured = kind.isin("px", "hz", "ratio")
    error = (
        F.when(kind.isNull(), "unknown key")
        .when(s == "", "empty")
        .when((kind == "color") & (hex_ == ""), "not a color")
        .when(measured & number.isNull(), "not a number")
        .when(measured & _bad(number), "not a finite number of at least 0")
        .when((kind == "ratio") & ~((number > 0) & (number <= 2)), "ratio outside 0 to 2")
        .when((kind == "bool") & flag.isNull(), "not yes or no")
        .when((kind == "enum") & ~listed, "not an allowed value")
        .when(~kind.isin("color", "px", "hz", "ratio", "bool", "enum"), "unknown type")
    )
    good = error.isNull()
    out = rows.join(small(kinds), F.col(key) == F.col("_key"), "left").withColumns({
        "_number": F.when(good & measured, number), "_flag": F.when(good & (kind == "bool"), flag),
        "_text": F.when(good & (kind == "color"), F.concat(F.lit("#"), F.upper(hex_))).when(good & (kind == "enum"), s), "_error": error,
    })
    kept = [c for c in rows.columns if c not in ("number", "flag", "text", "error")]
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in ("number", "flag", "text", "error")])


def admit(rows: DataFrame, spec: DataFrame, basis: DataFrame, reference: DataFrame, entity: str, long_kinds: tuple[str, ...] = ("video",)) -> DataFrame:
    """(the columns of rows, t as a number, number, flag, text, reason): reason is null for rows that may be used, else the first of

    not watched, no observer, unknown key, for reference only (in reference, not in basis), not in the basis, long form (a kind of
    long_kinds), no time (not a finite number of at least 0), or the error of the value.

    rows: (entity, t, key, value, observed_by, watched) as text; basis: (entity, kind), of several kinds of one entity the smallest;
    reference: (entity). Each meets the rows by its key in an equi-join, so no side has to be small. Refused rows have no values.
    """
    known = basis.groupBy(F.col(entity).alias("_e")).agg(F.min("kind").alias("_kind"), F.lit(True).alias("_known"))
    older = reference.select(F.col(entity).alias("_o")).distinct().withColumn("_older", F.lit(True))
    typed = typed_values(rows, spec).join(known, F.col(entity) == F.col("_e"), "left").join(older, F.col(entity) == F.col("_o"), "left")
    at = noted_number(F.col("t").cast("string"))
    reason = (
        F.when(~F.lower(stripped(F.col("watched"))).isin(*YES), "not watched")
        .when(stripped(F.col("observed_by")) == "", "no observer")
        .when(F.col("error") == "unknown key", "unknown key")
        .when(F.col("_known").isNull() & F.col("_older").isNotNull(), "for reference only")
        .when(F.col("_known").isNull(), "not in the basis")
        .when(F.col("_kind").isin(*long_kinds), "long form")
        .when(at.isNull() | _bad(at), "no time")
        .otherwise(F.col("error"))
    )
    out = typed.withColumn("reason", reason).withColumn("t", F.when(F.col("reason").isNull(), at))
    values = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("number", "flag", "text")]
    return out.select(*[c for c in rows.columns if c not in ("number", "flag", "text", "reason", "error")], *values, "reason")
