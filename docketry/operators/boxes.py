"""From text boxes to structured rows: lines, columns, labels, overlaps and page types.

Boxes have a page key and text, x, y, width, height (shares of the page) and
confidence; order-dependent steps pass over each page's boxes in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import measures


def skew(boxes: DataFrame, page: str, header: Column) -> DataFrame:
    """Slope of the header boxes' centres on each page, clamped to 0.05 either way; zero with fewer than three (AGG-31)."""
    return boxes.groupBy(page).agg(slope(header).alias("slope"))


def slope(header: Column, window: WindowSpec | None = None) -> Column:
    """The aggregate of ``skew``, or the same over a window."""
    over = lambda c: c if window is None else c.over(window)
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    found = F.coalesce(measures.slope(F.when(header, cy), F.when(header, cx), over), F.lit(0.0))
    bounded = F.greatest(F.least(found, F.lit(0.05)), F.lit(-0.05))
    return F.when(over(F.count(F.when(header, 1))) >= 3, bounded).otherwise(0.0)


def _numbers(batch: pa.RecordBatch, column: str) -> list[float]:
    """A column's numbers, NaN for null."""
    return batch.column(column).to_numpy(zero_copy_only=False).tolist()


def lines(boxes: DataFrame, page: str, tolerance: float = 0.0075, share: float = 0.75) -> DataFrame:
    """Add ``line``: boxes by rising centre join the open line while they lie within the tolerance of its running mean, else open the next (WIN-19).

    The tolerance of a box is the greater of ``tolerance`` and ``share`` of its
    height.  Ties go by x, then text.
    """

    schema = boxes.withColumn("line", F.lit(0)).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mean, n, line = None, 0.0, 0, -1
        for batch in batches:
            out = []
            for key, y, h in zip(batch.column(page).to_pylist(), _numbers(batch, "y"), _numbers(batch, "height")):
                centre = y + h / 2
                if line < 0 or key != at:
                    at, mean, n, line = key, centre, 1, 0
                elif abs(centre - mean) > max(tolerance, share * h):
                    mean, n, line = centre, 1, line + 1
                else:
                    n += 1
                    mean += (centre - mean) / n
                out.append(line)
            # Texts and other columns pass as they are.
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()) if c == "line" else batch.column(c) for c in schema.names], names=schema.names)

    # Pages lie together and in order, so one pass with a little state is enough.  They are dealt by a hash of the page:
    # where boxes are a union of tables that are dealt by page already, adaptive execution would leave out the exchange.
    ordered = boxes.repartition(F.xxhash64(page)).sortWithinPartitions(page, F.col("y") + F.col("height") / 2, "x", "text")
    return ordered.mapInArrow(number, schema)


def lines_of_pages(boxes: DataFrame, page: str, tolerance: float = 0.0075, share: float = 0.75) -> DataFrame:
    """The lines of ``lines``, one a row: page, ``line``, and ``boxes``, an array of its boxes in order.

    A page's boxes have to fit in a row.  For that, boxes that are dealt by page
    aren't shuffled, and what follows may group by page without a shuffle too.
    """
    rest = [c for c in boxes.columns if c not in (page, "x", "text")]
    box = F.struct((F.col("y") + F.col("height") / 2).alias("__centre"), "x", "text", *rest)
    pages = boxes.groupBy(page).agg(F.sort_array(F.collect_list(box)).alias("__boxes"))
    state = lambda mean, n, at, starts: F.struct(mean.alias("mean"), n.alias("n"), at.alias("at"), starts.alias("starts"))

    def step(opened: Column, b: Column) -> Column:
        mean, n, at, starts = (opened[c] for c in ("mean", "n", "at", "starts"))
        off = b["__centre"] - mean
        apart = F.coalesce(F.abs(off) > F.greatest(F.lit(tolerance), share * b["height"]), F.lit(False))
        return F.when((at == 0) | apart, state(b["__centre"], F.lit(1), at + 1, F.concat(starts, F.array(at)))).otherwise(state(mean + off / (n + 1), n + 1, at + 1, starts))

    # Where each line begins, from 0.
    starts = F.aggregate("__boxes", state(F.lit(0.0), F.lit(0), F.lit(0), F.expr("cast(array() as array<int>)")), step, lambda s: s["starts"])
    end = lambda i: F.coalesce(F.try_element_at("__starts", i + 2), F.size("__boxes"))
    cut = F.transform("__starts", lambda start, i: F.slice("__boxes", start + 1, end(i) - start))
    # No page is without boxes; but for plain explode, Spark would infer a filter that works out the lines once more.
    return pages.withColumn("__starts", starts).select(page, F.posexplode_outer(cut).alias("line", "boxes"))


def columns(boxes: DataFrame, edges: Sequence[tuple[str, float]]) -> DataFrame:
    """Add ``column``: the last whose left edge isn't right of the box's centre; null left of all (TBF-04)."""
    centre = F.col("x") + F.col("width") / 2
    name = F.coalesce(*[F.when(centre >= edge, F.lit(column)) for column, edge in sorted(edges, key=lambda e: -e[1])])
    return boxes.withColumn("column", name)


def table_rows(boxes: DataFrame, page: str, edges: Sequence[tuple[str, float]], number: str, least_cells: int = 2) -> DataFrame:
    """One row per line that has a number of one to four digits and ``least_cells`` more cells (TBF-03).

    Texts of one cell are joined from left to right; the row's confidence is
    the least of its boxes'.
    """
    placed = columns(lines(boxes, page), edges).filter(F.col("column").isNotNull())
    cell = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("x", "text")))), lambda s: s["text"]), "")
    rows = placed.groupBy(page, "line").agg(*[cell(c).alias(c) for c, _ in edges], F.min("confidence").alias("confidence"))
    filled = sum(((F.col(c) != "").cast("int") for c, _ in edges if c != number), F.lit(0))
    return rows.filter(F.col(number).rlike("^[0-9]{1,4}$") & (filled >= least_cells))


def right_of_labels(boxes: DataFrame, page: str, labels: dict[str, list[str]], reach: float = 0.65) -> DataFrame:
    """For each field the text after its label in the same box, else the nearest box to the right on the line (TBF-01, JOIN-18).

    ``labels`` maps fields to their spellings; the topmost label of a field counts.
    """
    known = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("label")) for f, some in labels.items() for s in some]
    starts = boxes.select("*", F.explode(F.array(*known)).alias("l")).filter(F.startswith("text", F.col("l.label")))
    rank = F.row_number().over(Window.partitionBy(page, "field").orderBy("y", "x", F.desc(F.length("label"))))
    first = starts.select(F.col(page), F.col("l.field").alias("field"), F.col("l.label").alias("label"), F.col("text").alias("own"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("width").alias("lw"), F.col("height").alias("lh"), "y", "x").withColumn("rank", rank).filter("rank = 1").drop("rank", "x", "y")
    inline = F.trim(F.regexp_replace(F.substring("own", F.length("label") + 1, F.length("own")), r"^[\s_：:]+", ""))
    first = first.withColumn("inline", inline)
    near = first.join(boxes, page).filter((F.col("x") >= F.col("lx") + reach * F.col("lw")) & (F.abs(F.col("y") + F.col("height") / 2 - F.col("ly") - F.col("lh") / 2) <= F.greatest("lh", "height") * 0.75) & (F.col("text") != F.col("own")))
    best = near.groupBy(page, "field").agg(F.min(F.struct("x", "y", "text")).alias("n"))
    return first.join(best, [page, "field"], "left").select(page, "field", F.coalesce(F.nullif("inline", F.lit("")), "n.text", F.lit("")).alias("value"))


def page_type(boxes: DataFrame, page: str, keywords: dict[str, list[str]], least: int = 2) -> DataFrame:
    """The type with the most different keywords on the page, if it has ``least`` and no other has as many; else unknown (TBF-05)."""
    text = F.concat_ws("\n", F.collect_list("text"))
    joined = boxes.groupBy(page).agg(text.alias("t"))
    hits = {k: sum((F.contains("t", F.lit(w)).cast("int") for w in some), F.lit(0)) for k, some in keywords.items()}
    counted = joined.select(page, *[n.alias(k) for k, n in hits.items()])
    most = F.greatest(*hits) if len(hits) > 1 else F.col(next(iter(hits)))
    winners = F.filter(F.array(*[F.when(F.col(k) == most, F.lit(k)) for k in hits]), F.isnotnull)
    return counted.select(page, F.when((most >= least) & (F.size(winners) == 1), winners[0]).otherwise("unknown").alias("type"), most.alias("hits"))


def suppress_overlaps(boxes: DataFrame, page: str, most: float = 0.1) -> DataFrame:
    """Boxes kept by falling confidence unless they share more than ``most`` (intersection over union) with one kept before (IMG-03, JOIN-27)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            out = []
            for key, x, y, w, h in zip(batch.column(page).to_pylist(), *[_numbers(batch, c) for c in ("x", "y", "width", "height")]):
                if key != at:
                    at, kept = key, []
                right, bottom, area = x + w, y + h, w * h
                for a, b, c, d, other in kept:
                    # Most boxes lie apart, which four comparisons tell.
                    shared = (min(right, c) - max(x, a)) * (min(bottom, d) - max(y, b)) if a < right and x < c and b < bottom and y < d else 0.0
                    if not shared <= most * (area + other - shared):
                        out.append(False)
                        break
                else:
                    kept.append((x, y, right, bottom, area))
                    out.append(True)
            yield batch.filter(pa.array(out, pa.bool_()))

    return boxes.repartition(page).sortWithinPartitions(page, F.desc("confidence"), "x", "y").mapInArrow(keep, boxes.schema)


def band_pairs(left: DataFrame, right: DataFrame, page: str, reach: float) -> DataFrame:
    """Pairs of one page whose centres differ by ``reach`` or less in y: an equi-join on bands of that height, then the exact test (JOIN-17)."""
    centre = F.col("y") + F.col("height") / 2
    a = left.select(F.col(page), F.col("text").alias("left"), centre.alias("ly"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(centre / reach) + d)).alias("band"))
    b = right.select(F.col(page), F.col("text").alias("right"), centre.alias("ry"), F.floor(centre / reach).alias("band"))
    return a.join(b, [page, "band"]).filter(F.abs(F.col("ly") - F.col("ry")) <= reach).select(page, "left", "right", (F.col("ry") - F.col("ly")).alias("offset"))
