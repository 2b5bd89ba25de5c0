"""Field schemas: the catalog, look-up by name, and schemas from a list of fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.text import strip

CATALOG_SCHEMA = (
    "schema_key string, ordinal int, field string, description string, "
    "spec_type string, required boolean, min_val double, max_val double"
)


def list_schemas() -> dict[str, dict[str, str]]:
    """All built-in schemas in alphabetical order."""
    return dict(sorted(fv.SCHEMAS.items()))


def catalog_rows(schemas: dict[str, dict]) -> list[tuple]:
    rows = []
    for key, fields in schemas.items():
        for i, (field, spec) in enumerate(fields.items()):
            if isinstance(spec, dict):
                low, high = spec.get("min"), spec.get("max")
                rows.append(
                    (key, i, field, spec.get("description", ""), spec.get("type"),
                     bool(spec.get("required")), None if low is None else float(low),
                     None if high is None else float(high))
                )
            else:
                rows.append((key, i, field, spec, None, False, None, None))
    return rows


def schema_catalog(spark: SparkSession, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per field; a constant of the program, so it may be broadcast."""
    return spark.createDataFrame(catalog_rows(schemas or list_schemas()), CATALOG_SCHEMA)


_SEPARATORS, _PLAIN = "- ", "__"


def schema_key(name: Column) -> Column:
    """Name as the catalog spells it: upper case, ``-`` and blank as ``_``."""
    return F.translate(F.upper(name), _SEPARATORS, _PLAIN)


def _described(fields: Iterable[str]) -> dict[str, str]:
    return {field: fv.CUSTOM_DESCRIPTION.format(field) for field in fields}


def get_schema(name: str) -> dict[str, str]:
    """A built-in schema under any spelling of its name."""
    found = fv.SCHEMAS.get(name.upper().translate(str.maketrans(_SEPARATORS, _PLAIN)))
    if found is None:
        raise ValueError(fv.UNKNOWN_SCHEMA.format(name, ", ".join(list_schemas())))
    return found


def custom_schema(fields: str) -> dict[str, str]:
    """Schema from a comma list; a list without a name is an error."""
    schema = _described(filter(None, map(str.strip, fields.split(","))))
    if schema:
        return schema
    raise ValueError(fv.NO_FIELDS)


def _around(pattern: str, value: Column) -> list[Column]:
    before, after = pattern.split("{}")
    return [F.lit(before), value, F.lit(after)]


def custom_fields(comma_list: Column) -> Column:
    """The same for a column of comma lists: an array of ``struct<field, description>``.

    A repeated name counts once; a list without a name gives null.
    """
    names = F.array_distinct(
        F.filter(F.transform(F.split(comma_list, ","), strip), lambda f: f != "")
    )
    described = F.transform(
        names,
        lambda f: F.struct(
            f.alias("field"),
            F.concat(*_around(fv.CUSTOM_DESCRIPTION, f)).alias("description"),
        ),
    )
    return F.when(F.size(names) > 0, described)


def schema_fields(requests: DataFrame, schemas: dict[str, dict] | None = None, name: str = "schema") -> DataFrame:
    """One row per field of the schema that each request names, with all that is known of it.

    ``schemas`` replaces the built-in ones and is keyed as ``schema_key`` spells names.
    Requests for unknown names give no row.
    """
    catalog = schema_catalog(requests.sparkSession, schemas)
    return requests.withColumn("schema_key", schema_key(F.col(name))).join(
        F.broadcast(catalog), "schema_key"
    )


def resolve_names(requests: DataFrame, name: str = "schema") -> DataFrame:
    """``requests`` with schema_key and its fields; unknown names get null fields."""
    spark = requests.sparkSession
    fields = (
        schema_catalog(spark)
        .groupBy("schema_key")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "field"))).alias("_f"))
        .select("schema_key", F.transform("_f", lambda f: f["field"]).alias("fields"))
    )
    return requests.withColumn("schema_key", schema_key(F.col(name))).join(
        F.broadcast(fields), "schema_key", "left"
    )
