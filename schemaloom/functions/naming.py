"""Names of generated code from names of schema objects, as column expressions."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = sorted({*keyword.kwlist, *keyword.softkwlist} - {"_"})
_RESERVED = rf"^(?:{'|'.join(RESERVED)})\z"


def identifier(name: Column) -> Column:
    """A Python identifier: other characters become one underscore, a leading digit gets one, reserved words get one behind."""
    x = F.regexp_replace(F.regexp_replace(name, "^([0-9])", "_$1"), "[^A-Za-z0-9_]", "_")
    x = F.regexp_replace(x, "_+", "_")
    x = F.when(~name.endswith("_") & (F.length(x) > 1), F.regexp_replace(x, "(?<=.)_+$", "")).otherwise(x)
    x = F.when(x.rlike(_RESERVED), F.concat(x, F.lit("_"))).otherwise(x)
    return F.when(name == "", "_empty").when(x.isin("", "_"), "_field").otherwise(x)


def attribute(name: Column) -> Column:
    """A model's attribute: an identifier in snake case."""
    x = F.lower(F.regexp_replace(identifier(name), "(?<=[a-z0-9])([A-Z])", "_$1"))
    return F.when(x.rlike(_RESERVED), F.concat(x, F.lit("_"))).otherwise(x)


def singular(name: Column) -> Column:
    keep = name.rlike("(ss|us|is)$")
    return F.when(name.endswith("ies") & (F.length(name) > 3), F.regexp_replace(name, "ies$", "y")).when(name.endswith("s") & ~keep & (F.length(name) > 1), F.regexp_replace(name, "s$", "")).otherwise(name)


def pascal(name: Column) -> Column:
    words = F.filter(F.split(name, "[_ -]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def class_name(table: Column) -> Column:
    x = pascal(singular(table))
    return F.when(x == "", "Model").otherwise(x)


def snake(name: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(name, "(?<=[^A-Z])([A-Z])", "_$1")), "- ", "__")


def module_name(table: Column) -> Column:
    """The module of a table: snake case, singular by a final s alone."""
    x = snake(table)
    return F.when(x.endswith("s") & ~x.rlike("(ss|us|is)$") & (F.length(x) > 1), F.regexp_replace(x, "s$", "")).otherwise(x)
