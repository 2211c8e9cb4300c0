"""Checks of Russian tax and bank identifiers, as column expressions and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Weights of the control digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
LENGTHS = {"kpp": 9, "bik": 9, "rs": 20, "ks": 20}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D+", "")


def _digit(text: Column, at: int) -> Column:
    return F.substring(text, at + 1, 1).try_cast("int")


def _control(text: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for at, weight in enumerate(weights):
        total = total + _digit(text, at) * weight
    return total % 11 % 10


def valid_inn(text: Column) -> Column:
    d = digits(text)
    ten = _control(d, INN10) == _digit(d, 9)
    twelve = (_control(d, INN11) == _digit(d, 10)) & (_control(d, INN12) == _digit(d, 11))
    return F.coalesce(F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve), F.lit(False))


def valid_ogrn(text: Column) -> Column:
    d = digits(text)
    return F.coalesce((F.length(d) == 13) & (F.substring(d, 1, 12).try_cast("bigint") % 11 % 10 == _digit(d, 12)), F.lit(False))


def valid_length(text: Column, length: int) -> Column:
    return F.coalesce(F.length(digits(text)) == length, F.lit(False))


VALIDATORS = {"INN": valid_inn, "OGRN": valid_ogrn} | {k.upper(): (lambda text, n=n: valid_length(text, n)) for k, n in LENGTHS.items()}


def _sql_control(weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"try_cast(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ") % 11 % 10"


def register(spark: SparkSession) -> None:
    """validate_inn, _ogrn, _kpp, _bik, _rs and _ks as SQL functions that the optimizer inlines."""
    digit = lambda at: f"try_cast(substr(d, {at + 1}, 1) AS INT)"
    wrapped = lambda body: f"coalesce((SELECT {body} FROM (SELECT regexp_replace(s, '(?U)\\\\D+', '') AS d)), false)"
    bodies = {
        "inn": f"CASE length(d) WHEN 10 THEN {_sql_control(INN10)} = {digit(9)} WHEN 12 THEN {_sql_control(INN11)} = {digit(10)} AND {_sql_control(INN12)} = {digit(11)} END",
        "ogrn": f"length(d) = 13 AND try_cast(substr(d, 1, 12) AS BIGINT) % 11 % 10 = {digit(12)}",
    } | {k: f"length(d) = {n}" for k, n in LENGTHS.items()}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION validate_{name}(s STRING) RETURNS BOOLEAN RETURN {wrapped(body)}")
