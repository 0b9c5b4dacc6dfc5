"""JSON records of any depth as rows of paths and values: merge patches, differences, rewriting and searching.

A path is an array of steps: ``.name`` for a member, ``[0000000012`` for an
element, so paths sort in the order of elements.  A leaf is a scalar, or an
object or array that is empty or isn't entered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_STEPS = "array<string>"
_STRING = r'"(?:[^"\\]|\\.)*"'


def shape(payload: Column) -> Column:
    """The brackets of a JSON text."""
    return F.regexp_replace(payload, _STRING + r'|[^\[\]{}"]+|"', "")


def depth(payload: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested."""
    brackets = F.filter(F.split(shape(payload), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at, b):
        now = at["now"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda at: at["most"])


def deepest(rows: DataFrame, payload: str) -> int:
    """How deep the deepest of the records is; one pass over them."""
    shapes = rows.groupBy(shape(F.col(payload)).alias("__shape")).agg(F.count("*").alias("__n"))
    return shapes.agg(F.max(depth(F.col("__shape"))), F.sum("__n")).first()[0] or 0  # without the sum the optimizer drops the grouping


def leaves(rows: DataFrame, keys: list[str], payload: str, arrays: bool = True) -> DataFrame:
    """The leaves of each record: the keys, path and value (a variant); arrays are leaves unless ``arrays``.

    Null payloads and text that isn't JSON have none.  One pass finds how deep
    the records' shapes are; then each level is one generator, and nothing is shuffled.
    """
    out = rows.select(*keys, F.array().cast(_NO_STEPS).alias("path"), F.try_parse_json(payload).alias("value")).filter("value is not null")
    # Scalars and what is empty have nothing to enter, so only arrays that aren't empty need telling apart.
    entered = F.lit(True) if arrays else F.try_variant_get("value", "$[0]", "variant").isNull()
    for _ in range(deepest(rows, payload)):
        inner = out.withColumn("__node", F.when(entered, F.col("value")))
        members = rows.sparkSession.tvf.variant_explode_outer(F.col("__node").outer()).toDF("__pos", "__key", "__value")
        step = F.when(F.col("__key").isNotNull(), F.concat(F.lit("."), "__key")).otherwise(F.concat(F.lit("["), F.lpad(F.col("__pos").cast("string"), 10, "0")))
        out = inner.lateralJoin(members).select(
            *keys, F.when(F.col("__pos").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"), F.when(F.col("__pos").isNull(), F.col("value")).otherwise(F.col("__value")).alias("value")
        )
    return out


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _turn(steps: Column, opened: bool) -> Column:
    """The brackets of containers that are entered by these steps, or left again."""
    mark = lambda s: F.when(s.startswith("."), F.lit("{" if opened else "}")).otherwise(F.lit("[" if opened else "]"))
    return F.array_join(F.transform(steps if opened else F.reverse(steps), mark), "")


def json_of(found: Column) -> Column:
    """The JSON text of one record from an array of (path, text) of all its leaves; null for none.

    The leaves are sorted by path.  Between two of them, containers that only
    the first is in are left and those that only the second is in are entered.
    """
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"))))
    # As a lambda's variable the sorted array is made once, not again for every leaf.
    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(ordered), _written), 1))


def _written(ordered: Column) -> Column:
    label = lambda s: F.when(s.startswith("."), F.concat(_quoted(F.substring(s, F.lit(2), F.length(s))), F.lit(":"))).otherwise(F.lit(""))

    def common(a: Column, b: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda j: F.get(a, j) == F.get(b, j))
        return F.element_at(F.transform(F.array(same), lambda x: F.when(F.array_position(x, False) > 0, F.array_position(x, False) - 1).otherwise(F.size(x)).cast("int")), 1)

    def entered(path: Column, kept: Column) -> Column:
        """Labels and brackets from the step after ``kept`` common ones on."""
        rest = F.slice(path, kept + 1, F.greatest(F.size(path) - kept, F.lit(0)))
        return F.array_join(F.transform(rest, lambda s, i: F.concat(F.when(i > 0, _turn(F.array(s), True)).otherwise(F.lit("")), label(s))), "")

    def left(path: Column, kept: Column) -> Column:
        return _turn(F.slice(path, kept + 2, F.greatest(F.size(path) - kept - 1, F.lit(0))), False)

    def piece(x: Column, i: Column) -> Column:
        before = F.get(ordered, i - 1)["path"]
        first = F.when(F.size(x["path"]) > 0, F.concat(_turn(F.slice(x["path"], 1, 1), True), entered(x["path"], F.lit(0)))).otherwise(F.lit(""))
        joined = F.element_at(F.transform(F.array(common(before, x["path"])), lambda kept: F.concat(left(before, kept), F.lit(","), entered(x["path"], kept))), 1)
        return F.concat(F.when(i == 0, first).otherwise(joined), x["text"])

    return F.concat(F.array_join(F.transform(ordered, piece), ""), _turn(F.element_at(ordered, -1)["path"], False))


def assemble(found: DataFrame, keys: list[str], name: str = "payload") -> DataFrame:
    """One JSON text per record from all its leaves (path and value); a group is one record, so its size is bounded by it."""
    own = F.collect_list(F.struct("path", F.to_json("value").alias("text")))
    return found.groupBy(*keys).agg(json_of(own).alias(name))


def _two_sides(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The leaves of two payloads of each record as arrays a and b of (path, text); arrays in the payloads are leaves."""
    side = lambda c, n: F.struct(F.lit(n).alias("__side"), F.col(c).alias("__payload"))
    both = rows.select(*keys, F.explode(F.array(side(left, "a"), side(right, "b"))).alias("__s")).select(*keys, "__s.*")
    leaf = F.struct("path", F.to_json("value").alias("text"))
    own = lambda n: F.collect_list(F.when(F.col("__side") == n, F.col("leaf"))).alias(n)
    return leaves(both, [*keys, "__side"], "__payload", arrays=False).select(*keys, "__side", leaf.alias("leaf")).groupBy(*keys).agg(own("a"), own("b"))


def _begins(path: Column, other: Column) -> Column:
    """Whether ``path`` is the beginning of ``other`` or all of it."""
    return (F.size(path) <= F.size(other)) & (F.slice(other, F.lit(1), F.size(path)) == path)


# Fixed value: levels of objects that are gone through within a row. Spark resolves functions inside functions level by level, at most 100 times.
IN_ROW = 8


def _by_depth(rows: DataFrame, payload: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows whose payload has at most ``IN_ROW`` levels, the others (None if there are none) and how many levels the first have at most."""
    deep = deepest(rows, payload)
    if deep <= IN_ROW:
        return rows, None, deep
    far = F.coalesce(depth(shape(F.col(payload))) > IN_ROW, F.lit(False))
    return rows.filter(~far), rows.filter(far), IN_ROW


def _members(value: Column) -> Column:
    """A variant's members by name if it is an object, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _patched(target: Column, patch: Column, deep: int) -> Column:
    """A variant with a patch of at most ``deep`` objects in each other applied; a missing target is an empty object."""
    if deep == 0:
        return patch

    def member(_, p: Column, t: Column) -> Column:
        return F.when(p.isNull(), t).when(~F.is_variant_null(p), _patched(t, p, deep - 1))

    # The patch stands first: where it isn't an object, the target isn't looked at.
    both = F.map_zip_with(_members(patch), F.coalesce(_members(target), F.create_map().cast("map<string,variant>")), member)
    return F.coalesce(F.to_variant_object(F.map_filter(both, lambda _, value: value.isNotNull())), patch)


def _parent(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def merge_patch(rows: DataFrame, keys: list[str], target: str, patch: str, name: str = "merged") -> DataFrame:
    """Each record's target with its merge patch applied, by the rules of RFC 7396 (JSN-05).

    Members of the patch replace those of the target, objects are merged to any
    depth, null members are removed, and arrays are replaced as a whole.
    Members come out in the order of their names.  A missing patch changes
    nothing, records without a target start from an empty object, and those
    without either are left out.  One pass finds how deep the patches are; then
    each record is merged within its row, and nothing is shuffled.  Only records
    with patches of more than ``IN_ROW`` levels are taken apart into leaves.
    """
    near, far, deep = _by_depth(rows, patch)
    t, p = F.col("__target"), F.col("__patch")
    values = near.select(*keys, F.try_parse_json(target).alias("__target"), F.try_parse_json(patch).alias("__patch"))
    merged = F.to_json(F.when(p.isNull(), t).otherwise(_patched(t, p, deep)))
    out = values.select(*keys, F.explode(F.array_compact(F.array(merged))).alias(name))  # a filter would make the text twice
    return out if far is None else out.unionByName(_merge_leaves(far, keys, target, patch, name))


def _merge_leaves(rows: DataFrame, keys: list[str], target: str, patch: str, name: str) -> DataFrame:
    """What ``merge_patch`` gives, from the leaves of both sides, for patches of any depth."""
    is_null = lambda x: (x["text"] == "null") & (F.size(x["path"]) > 0)
    is_open = lambda x: x["text"] == "{}"
    sides = _two_sides(rows, keys, target, patch)
    # Objects that the patch needs to be there, though nothing may be left in them.
    needed = F.array_union(F.transform(F.filter("b", is_null), lambda x: _parent(x["path"])), F.transform(F.filter("b", is_open), lambda x: x["path"]))
    # A leaf of the target goes if the patch has a leaf above it, in its place or below; an object in its place, or above, is merged.
    covered = lambda t: F.exists("b", lambda p: (~is_open(p) & _begins(p["path"], t["path"])) | _begins(t["path"], p["path"]))
    kept = F.concat(F.filter("a", lambda t: ~covered(t)), F.filter("b", lambda p: ~is_null(p) & ~is_open(p)))
    whole = sides.withColumns({"__kept": kept, "__needed": F.array_distinct(needed)})
    bare = F.filter("__needed", lambda w: ~F.exists("__kept", lambda x: _begins(w, x["path"])) & ~F.exists("__needed", lambda v: (v != w) & _begins(w, v)))
    found = whole.select(*keys, F.concat("__kept", F.transform(bare, lambda w: F.struct(w.alias("path"), F.lit("{}").alias("text")))).alias("__found"))
    return found.select(*keys, json_of(F.col("__found")).alias(name))


def _written_anew(old: Column, new: Column, deep: int) -> Column:
    """What a patch must hold to make ``old`` into ``new``, of at most ``deep`` objects in each other; null for nothing."""
    other = F.when(~F.to_json(old).eqNullSafe(F.to_json(new)), new)
    if deep == 0:
        return other

    def member(_, n: Column, o: Column) -> Column:
        return F.when(n.isNull(), F.parse_json(F.lit("null"))).when(~F.is_variant_null(n), _written_anew(o, n, deep - 1))

    both = F.map_zip_with(_members(new), F.coalesce(_members(old), F.create_map().cast("map<string,variant>")), member)

    def written(m: Column) -> Column:
        made = _members(old).isNull() & (F.size(_members(new)) == 0)  # an empty object where there was none
        return F.when(m.isNull(), other).when(F.size(m) > 0, F.to_variant_object(m)).when(made, new)

    # As a lambda's variable the map is made once.
    return F.element_at(F.transform(F.array(F.map_filter(both, lambda _, value: value.isNotNull())), written), 1)


def _can_be_patched(old: Column, new: Column, deep: int) -> Column:
    """Whether ``new`` has no null member but where ``old`` has it too."""
    if deep == 0:
        return F.lit(True)

    def holds(e: Column) -> Column:
        was = F.try_element_at(_members(old), e["key"])
        return F.when(F.is_variant_null(e["value"]), F.coalesce(F.is_variant_null(was), F.lit(False))).otherwise(_can_be_patched(was, e["value"], deep - 1))

    return F.coalesce(F.forall(F.map_entries(_members(new)), holds), F.lit(True))


def merge_diff(rows: DataFrame, keys: list[str], old: str, new: str, name: str = "patch") -> DataFrame:
    """The smallest merge patch that makes ``old`` into ``new``, and ``exact``: whether a merge patch can (JSN-05, REC-06).

    ``{}`` if nothing changes.  A null member that is new can't be expressed;
    the patch then leaves it out.  Each record is compared within its row, as in
    ``merge_patch``; only those whose new side has more than ``IN_ROW`` levels
    are taken apart into leaves.
    """
    near, far, deep = _by_depth(rows, new)
    o, n = F.col("__old"), F.col("__new")
    values = near.select(*keys, F.col(new).alias("__text"), F.try_parse_json(old).alias("__old"), F.try_parse_json(new).alias("__new"))
    to = F.coalesce(n, F.parse_json(F.lit("{}")))
    patch = F.when(_members(to).isNull(), n).otherwise(_written_anew(o, to, max(deep, 1)))  # what is missing is an empty object
    exact = F.when(F.contains("__text", F.lit("null")), _can_be_patched(o, n, deep)).otherwise(True)
    result = F.struct(F.coalesce(F.to_json(patch), F.lit("{}")).alias(name), exact.alias("exact"))
    out = values.select(*keys, F.inline(F.array_compact(F.array(F.when(o.isNotNull() | n.isNotNull(), result)))))
    return out if far is None else out.unionByName(_diff_leaves(far, keys, old, new, name))


def _diff_leaves(rows: DataFrame, keys: list[str], old: str, new: str, name: str) -> DataFrame:
    """What ``merge_diff`` gives, from the leaves of both sides, for records of any depth."""
    # What both have needs no further look; each column is made once.
    sides = _two_sides(rows, keys, old, new).withColumns({"__old": F.array_except("a", "b"), "__new": F.array_except("b", "a")})
    inside = lambda leaves_, x: F.exists(leaves_, lambda y: (F.size(y["path"]) > F.size(x["path"])) & _begins(x["path"], y["path"]))
    whole = F.exists("b", lambda x: (F.size(x["path"]) == 0) & (x["text"] != "{}"))  # the new record isn't an object
    lost = lambda x: (x["text"] == "null") & (F.size(x["path"]) > 0)
    fresh = F.filter("__new", lambda x: ~((x["text"] == "{}") & inside("a", x)))
    # Of a path that is gone, the shortest beginning that the new record hasn't.
    top = lambda x: F.element_at(F.filter(F.transform(F.sequence(F.lit(1), F.size(x["path"])), lambda n: F.slice(x["path"], F.lit(1), n)), lambda p: ~F.exists("b", lambda y: _begins(p, y["path"]))), 1)
    # Where the new record has a scalar or an array at or above the path, that replaces it; where it has an object below, it merges.
    gone = F.filter("__old", lambda x: (F.size(x["path"]) > 0) & ~F.exists("b", lambda y: _begins(x["path"], y["path"]) | (_begins(y["path"], x["path"]) & (y["text"] != "{}"))))
    made = sides.select(*keys, "b", whole.alias("__whole"), fresh.alias("__fresh"), F.array_distinct(F.transform(gone, top)).alias("__gone"))
    nulls = F.transform("__gone", lambda p: F.struct(p.alias("path"), F.lit("null").alias("text")))
    found = F.when(F.col("__whole"), F.col("b")).otherwise(F.concat(F.filter("__fresh", lambda x: ~lost(x)), nulls))
    result = made.select(*keys, found.alias("__found"), (F.col("__whole") | ~F.exists("__fresh", lost)).alias("exact"))
    return result.select(*keys, F.coalesce(json_of(F.col("__found")), F.lit("{}")).alias(name), "exact")


def rewrite_strings(rows: DataFrame, keys: list[str], payload: str, renamed: DataFrame) -> DataFrame:
    """Every string of the records, at any depth, whose part before ``?`` is ``old`` in ``renamed`` gets ``new`` in its place (PRJ-11)."""
    found = leaves(rows, keys, payload)
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    cut = F.instr(text, "?")
    split = found.withColumns({"__base": F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text), "__rest": F.when(cut > 0, F.substring(text, cut, F.length(text))).otherwise("")})
    named = renamed.groupBy(F.col("old").alias("__base")).agg(F.min("new").alias("__new"))
    joined = split.join(named, "__base", "left")
    return assemble(joined.withColumn("value", F.when(F.col("__new").isNotNull(), F.to_variant_object(F.array(F.concat("__new", "__rest")))).otherwise(F.col("value"))).withColumn("value", F.when(F.col("__new").isNotNull(), F.variant_get("value", "$[0]", "variant")).otherwise(F.col("value"))), keys, payload)


def name_of(path: Column) -> Column:
    """A path as text, elements as ``[]``."""
    return F.array_join(F.transform(path, lambda s: F.when(s.startswith("."), s).otherwise("[]")), "")


# Marks of a person's work.
HUMAN, CONFIRMED = "人工", ("确认通过", "确认不通过")
_VARIANT = r"^(\.recognition_variants\.[^.\[]+\[\](\.details|\.result))*"
_CHECKS = r"(\.date_check|\.seal_check|\.signature_check|\.field_metadata\.[^.\[]+)"


def has_human_edits(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Whether a person's decision is anywhere in a record: in itself or in a reading inside a reading, to any depth (FLT-15).

    That is a confirming review, a note, an override of the review, a check or
    field whose source, reader or confirmation is human, or such a cell.
    """
    at, text = name_of(F.col("path")), F.to_json("value")
    truthy = ~text.isin("null", "false", '""', "0", "{}", "[]", "0.0")
    ends = lambda pattern: at.rlike(_VARIANT + pattern + "$")
    below = lambda pattern: at.rlike(_VARIANT + pattern)
    mark = (
        (ends(r"\.review_status") & text.isin(*[f'"{x}"' for x in CONFIRMED])) | (below(r"\.(human_note|page_review_override)($|[.\[])") & truthy)
        | (ends(_CHECKS + r"\.(source|backend)") & text.contains(HUMAN)) | (below(_CHECKS + r"\.human_confirmed($|[.\[])") & truthy) | below(_CHECKS + r"\.human_confirmed_match($|[.\[])")
        | (ends(r"\.product_table\.rows\[\]\.sources\.[^.\[]+") & text.contains(HUMAN))
    )
    return leaves(rows, keys, payload).groupBy(*keys).agg(F.bool_or(mark).alias("edited"))
