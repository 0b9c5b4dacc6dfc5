"""The product table of a page in full: tilt taken out, merged boxes split, cells joined, repaired and rated.

Boxes have a page, text, x, y, width, height (shares of the page) and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ean13_valid
from . import boxes as plain

# The columns with their left edges, patterns of cells, and what a valid cell is worth at least.
COLUMNS = (("行号", 0.0), ("产品类别", 0.115), ("物料编号", 0.22), ("等级", 0.43), ("出库仓库", 0.49), ("数量", 0.59), ("重量", 0.675), ("体积", 0.755), ("EAN码", 0.82))
NUMBER, KIND, MATERIAL, GRADE, STORE, COUNT, WEIGHT, VOLUME, EAN = (name for name, _ in COLUMNS)
RIGHT_EDGE = 1.0
MATERIAL_AND_GRADE, TWO_DECIMALS = r"(?i)^(.+(?:[0-9]{2,4}G|[0-9]+TB))([A-Z])$", r"^(0?[.][0-9]{3})(0?[.][0-9]{3})$"
MARKETS = ("CHC", "EGCN", "GCN", "CNFC", "YC")
VALID = {NUMBER: r"^[0-9]+([.][0-9]+)?$", COUNT: r"^[0-9]+([.][0-9]+)?$", WEIGHT: r"^[0-9]+([.][0-9]+)?$", VOLUME: r"^[0-9]+([.][0-9]+)?$", STORE: r"(?i)^[A-Z]{1,3}[0-9]{1,4}$", GRADE: r"(?i)^[A-Z][A-Z0-9]?$", KIND: r"(?i)^[A-Z][0-9]$", MATERIAL: r"^(?=.*[A-Za-z0-9]).{7,}$", EAN: r"^[0-9]{13}$"}
FLOORS = {EAN: 0.99, NUMBER: 0.9, COUNT: 0.9, WEIGHT: 0.9, VOLUME: 0.9, STORE: 0.88, GRADE: 0.85, KIND: 0.86, MATERIAL: 0.70}
HEADER_REACH, LEAST_WIDTH = 0.025, 0.001
_SPACE = r"(?U)\s+"


def levelled(boxes: DataFrame, page: str) -> DataFrame:
    """Boxes with the table's tilt, the slope of its header's boxes, taken out of y (TBF-03, AGG-31).

    The header is the line of column names around the highest box that has the
    first one's name; fewer than three names leave the page as it is.
    """
    text, named = F.col("__tight"), F.lit(False)
    for name, _ in COLUMNS:
        named = named | text.contains(name)
    # Windows of one page, so the boxes are shuffled once and nothing is joined to them again.
    w = Window.partitionBy(page)
    top = F.min(F.when(text.contains(NUMBER), F.col("y"))).over(w)
    marked = boxes.withColumn("__tight", F.regexp_replace("text", _SPACE, "")).withColumn("__header", F.col(page).isNotNull() & F.coalesce(named & (F.abs(F.col("y") - top) <= HEADER_REACH), F.lit(False)))
    tilted = marked.withColumn("slope", plain.slope(F.col("__header"), w)).withColumn("y", F.col("y") - F.col("slope") * (F.col("x") + F.col("width") / 2))
    return tilted.select(*boxes.columns)


def _split(boxes: DataFrame) -> DataFrame:
    """Add ``__cells``: the cells that a box belongs to, their column, text, x and width (TBF-04).

    A box is split in two at the edge that it crosses if it is a material that
    ends in a capacity, followed by a grade, or two decimals of three places.
    Others belong to the column of their centre; boxes right of all have none.
    """
    text, right = F.col("__tight"), F.col("x") + F.col("width")
    edges = dict(COLUMNS)
    crosses = lambda edge: (F.col("x") < edge) & (right > edge)

    def halves(pattern: str, left: str, other: str) -> Column:
        edge = edges[other]
        part = lambda name, n, x, width: F.struct(F.lit(name).alias("column"), F.upper(F.regexp_extract(text, pattern, n)).alias("text") if name == GRADE else F.regexp_extract(text, pattern, n).alias("text"), x.alias("x"), F.greatest(F.lit(LEAST_WIDTH), width).alias("width"))
        return F.array(part(left, 1, F.col("x"), edge - F.col("x")), part(other, 2, F.lit(edge), right - edge))

    centre = F.col("x") + F.col("width") / 2
    own = F.coalesce(*[F.when(centre >= edge, F.lit(name)) for name, edge in reversed(COLUMNS)])
    whole = F.array(F.struct(F.when((centre < RIGHT_EDGE) & (centre >= 0), own).alias("column"), F.col("text").alias("text"), F.col("x").alias("x"), F.col("width").alias("width")))
    # A box that crosses no edge isn't held against the patterns.
    cells = F.when(crosses(edges[GRADE]) & text.rlike(MATERIAL_AND_GRADE), halves(MATERIAL_AND_GRADE, MATERIAL, GRADE)).when(crosses(edges[VOLUME]) & text.rlike(TWO_DECIMALS), halves(TWO_DECIMALS, WEIGHT, VOLUME)).otherwise(whole)
    return boxes.withColumn("__tight", F.regexp_replace("text", _SPACE, "")).withColumn("__cells", cells).drop("__tight")


def assigned(boxes: DataFrame) -> DataFrame:
    """A row for each cell that a box belongs to: column, and its own text, x and width (TBF-04)."""
    rest = [c for c in boxes.columns if c not in ("text", "x", "width")]
    return _split(boxes).select(*rest, F.explode("__cells").alias("__cell")).select(*rest, "__cell.*").filter("column is not null")


def repaired(column: Column, value: Column) -> Column:
    """A cell's text after the repairs of its column (STR-12): joined digits, edge noise, letters misread for digits."""
    v = F.trim(F.coalesce(value, F.lit("")))
    joined = F.regexp_replace(v, _SPACE, "")
    only = F.regexp_extract(joined, r"^[^0-9]*([0-9]+(?:[.][0-9]+)?)[^0-9]*$", 1)
    code = F.regexp_extract(joined, r"^[^0-9]*([0-9]{13})[^0-9]*$", 1)
    short = F.regexp_replace(F.translate(F.upper(v), "IL", "11"), "^[^A-Z0-9]+|[^A-Z0-9]+$", "")
    store = F.when(F.upper(v).rlike("^W[O0][0-9]{2}$"), F.concat(F.lit("W0"), F.substring(v, 3, 2))).otherwise(F.upper(v))
    sku = F.regexp_replace(v, "(?i)^(?:SW|SI)-", "SM-")
    head = F.regexp_extract(sku, "^([A-Za-z]{1,3}-[A-Za-z0-9-]{6,})", 1)
    upper = F.upper(head)
    market = F.lit(False)
    for m in MARKETS:
        market = market | upper.endswith(m)
    material = F.when(upper.contains("O") & upper.rlike("[0-9]") & market, F.concat(F.translate(upper, "O", "0"), F.substring(sku, F.length(head) + 1, F.length(sku)))).otherwise(sku)
    return (
        F.when(column.isin(WEIGHT, VOLUME), F.when(only != "", only).otherwise(joined)).when(column == EAN, F.when((code != "") & ean13_valid(code), code).otherwise(joined)).when(column.isin(NUMBER, COUNT), joined)
        .when(column.isin(KIND, GRADE), short).when(column == STORE, store).when(column == MATERIAL, material).otherwise(v)
    )


def rated(column: Column, value: Column, weighted: Column, letters: Column) -> Column:
    """A cell's confidence: the mean of its boxes' by their letters, at least its column's floor if the value is valid (AGG-30)."""
    joined = F.regexp_replace(F.coalesce(value, F.lit("")), _SPACE, "")
    floor = F.lit(0.0)
    for name, pattern in VALID.items():
        ok = joined.rlike(pattern) & ean13_valid(joined) if name == EAN else joined.rlike(pattern)
        floor = F.when((column == name) & ok, FLOORS[name]).otherwise(floor)
    raw = F.greatest(F.coalesce(F.try_divide(weighted, letters), F.lit(0.0)), floor)
    return F.when(joined == "", 0.0).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3))


def _product_lines(boxes: DataFrame, page: str) -> DataFrame:
    """One row per line of a page: for each column i its cell's original text o<i> (null if there is none), value v<i> and confidence c<i>.

    Boxes are levelled, put on lines and assigned to columns; the texts of one
    cell are joined from left to right.  Boxes without a letter or digit go.
    Boxes are dealt by page in the first step; nothing is shuffled again.
    """
    split = _split(levelled(boxes, page)).select(page, "x", "y", "height", "text", "confidence", "__cells")
    found = plain.lines_of_pages(split, page).select(page, "line", F.flatten(F.transform("boxes", lambda b: F.transform(b["__cells"], lambda c: F.struct(c["column"].alias("column"), c["x"].alias("x"), F.trim(c["text"]).alias("text"), b["confidence"].alias("confidence"))))).alias("__cells"))
    found = found.withColumn("__cells", F.filter("__cells", lambda c: c["text"].rlike(r"[0-9A-Za-z一-鿿]")))
    numbers = range(len(COLUMNS))
    # A column's own expressions are simpler than those of any column, and aren't made twice where they stand in a select of their own.
    of = lambda name: F.sort_array(F.filter("__cells", lambda c: c["column"] == name))
    own = found.select(page, "line", *[of(name).alias(f"p{i}") for i, (name, _) in enumerate(COLUMNS)])
    letters = lambda c: F.greatest(F.length(c["text"]), F.lit(1))
    total = lambda i, what, zero: F.aggregate(f"p{i}", zero, lambda s, c: s + what(c))
    joined = [F.when(F.size(f"p{i}") > 0, F.array_join(F.transform(f"p{i}", lambda c: c["text"]), " ")).alias(f"o{i}") for i in numbers]
    weights = [total(i, lambda c: F.coalesce(c["confidence"] * letters(c), F.lit(0.0)), F.lit(0.0)).alias(f"w{i}") for i in numbers]
    texts = own.select(page, "line", *joined, *weights, *[total(i, letters, F.lit(0)).alias(f"n{i}") for i in numbers])
    fixed = texts.select("*", *[F.when(F.col(f"o{i}").isNotNull(), repaired(F.lit(name), F.col(f"o{i}"))).alias(f"v{i}") for i, (name, _) in enumerate(COLUMNS)])
    return fixed.select(page, "line", *[f"o{i}" for i in numbers], *[f"v{i}" for i in numbers], *[F.when(F.col(f"o{i}").isNotNull(), rated(F.lit(name), F.col(f"v{i}"), F.col(f"w{i}"), F.col(f"n{i}"))).alias(f"c{i}") for i, (name, _) in enumerate(COLUMNS)])


def product_cells(boxes: DataFrame, page: str) -> DataFrame:
    """The cells of the product tables: page, line, column, original and repaired value, and confidence (TBF-03, TBF-04, TBF-13)."""
    cells = [F.struct(F.lit(name).alias("column"), F.col(f"o{i}").alias("original"), F.col(f"v{i}").alias("value"), F.col(f"c{i}").alias("confidence"), (F.col(f"v{i}") != F.col(f"o{i}")).alias("repaired")) for i, (name, _) in enumerate(COLUMNS)]
    return _product_lines(boxes, page).select(page, "line", F.explode(F.array(*cells)).alias("c")).select(page, "line", "c.*").filter("original is not null")


def product_table(boxes: DataFrame, page: str, least_cells: int = 2) -> DataFrame:
    """One row per line that has a number of one to four digits and ``least_cells`` more cells; the columns as a map, and its text (STR-22)."""
    numbers = range(len(COLUMNS))
    named = [F.coalesce(F.col(f"v{i}"), F.lit("")) for i in numbers]
    cells = F.map_from_entries(F.filter(F.array(*[F.when(F.col(f"o{i}").isNotNull(), F.struct(F.lit(name).alias("key"), F.col(f"v{i}").alias("value"))) for i, (name, _) in enumerate(COLUMNS)]), lambda c: c.isNotNull()))
    confidence = F.round(sum((F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in numbers), F.lit(0.0)) / len(COLUMNS), 3)
    at = [name for name, _ in COLUMNS].index(NUMBER)
    filled = sum(((named[i] != "").cast("int") for i in numbers if i != at), F.lit(0))
    kept = named[at].rlike("^[0-9]{1,4}$") & (filled >= least_cells)
    row = F.struct(cells.alias("cells"), F.array_join(F.array(*named), " | ").alias("text"), confidence.alias("confidence"))
    # A filter on the values would be pushed down to where they are made, and make them twice.
    return _product_lines(boxes, page).select(page, "line", F.explode_outer(F.when(kept, F.array(row))).alias("r")).filter("r is not null").select(page, "line", "r.*")
