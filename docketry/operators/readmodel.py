"""JSON records: summaries, heads over payloads, arrays to rows and back, and the split of field maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(payload: Column, paths: dict[str, str]) -> Column:
    """A JSON object of named paths, each with its own JSON type; what is absent or null has no member (PRJ-01, PRJ-04, JSN-04, JSN-05).

    Text that isn't JSON gives an empty object.
    """
    parsed = F.try_parse_json(payload)
    return F.to_json(F.struct(*[F.try_variant_get(parsed, path, "variant").alias(name) for name, path in paths.items()]))


def with_head(rows: DataFrame, payload: str, ddl: str, head: list[str]) -> DataFrame:
    """The members of a payload as columns, with the row's own columns ``head`` over those of the same name (PRJ-02, PRJ-03, PRJ-05)."""
    parsed = rows.select(*head, F.from_json(payload, ddl).alias("__payload"))
    own = [f.name for f in parsed.schema["__payload"].dataType.fields if f.name not in head]
    return parsed.select(*head, *[F.col(f"__payload.{c}").alias(c) for c in own])


def unnest(rows: DataFrame, payload: str, path: str, element: str, keep: list[str]) -> DataFrame:
    """A row for each element of an array in a payload, numbered from zero; none for a missing or empty array (JSN-02, JOIN-09)."""
    items = F.from_json(F.get_json_object(payload, path), f"array<{element}>")
    return rows.select(*keep, F.posexplode(items).alias("place", "item"))


def regroup(items: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The items of each record as one JSON array in ``order``, which must be total (JSN-03).  A group is one record, so its size is bounded by it."""
    place, row = F.struct(*order).alias("o"), F.struct(*columns).alias("r")
    listed = F.array_sort(F.collect_list(F.struct(place, row)))
    return items.groupBy(*keys).agg(F.to_json(F.transform(listed, lambda x: x["r"])).alias("items"))


def split_fields(fields: Column, shown: list[str]) -> tuple[Column, Column]:
    """Fields that are shown, and all others (PRJ-06, MAP-02)."""
    return F.map_filter(fields, lambda k, _: k.isin(*shown)), F.map_filter(fields, lambda k, _: ~k.isin(*shown))


def merge_known(older: Column, newer: Column) -> Column:
    """Two maps as one; the newer value unless it is null (MAP-03)."""
    return F.map_zip_with(older, newer, lambda _, a, b: F.coalesce(b, a))
