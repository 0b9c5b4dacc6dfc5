"""A stamp's text put together from readings of its parts (MCH-15).

No letter is taken from the requirement that wasn't read: every rule joins
fragments that are exact parts of it, or gives an empty text.  All texts are
compared in their general normal form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

# Names of readings whose fragments may be joined, endings, kinds of stamps and lengths.
UNWRAPPED = "圆章展开分带"
SAFE_READINGS = (UNWRAPPED, "保留章色旋转对照图", "圆章/矩形校正图")
SERVICE_CENTRE, COMPANY, ACCEPTANCE, SPECIAL, REPAIR = "服务中心", "有限公司", "业务受理", "专用章", "维修专用章"
REPAIR_ENDINGS = ("维修专章", "维修专用章")
LONG_ENDINGS = ("商店", "维修站", "服务中心")
KINDS = ("售后业务专用章", "手机售后专用章", "售后服务专用章", "业务受理专用章", "检测专用章", "业务专用章", "维修专用章", "服务专用章", "收货专用章")
KINDS_WITH_STORE = (*KINDS, "仓储部收货章")
CUSTOMER = "收货客户章"
LEAST_LENGTH, LEAST_FRAGMENT, ANCHOR_FRAGMENT, MOST_PIECES = 10, 2, 4, 3
BAND_CONFIDENCE, OVERLAP = 0.75, 0.35
SUFFIX_SHARE, SUFFIX_LEAST, SUFFIX_OMITTED = 0.70, 8, 3
_HAN = r"[一-鿿]"
_LEGAL = "有限责任公司|有限公司|分公司"


def _known(texts: Column) -> Column:
    """Texts in normal form, without empty ones."""
    return F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), normalize), lambda t: t != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is worked out once: inside lambdas it would be again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _company(need: Column) -> Column:
    """The requirement up to its first company ending; null without one."""
    at = F.instr(need, COMPANY)
    return F.when(at > 0, F.substring(need, F.lit(1), at + len(COMPANY) - 1))


def _rest(need: Column, head: Column) -> Column:
    return F.substring(need, F.length(head) + 1, F.length(need))


def joined_organization(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The keys' service organizations that two or three fragments of different readings cover in order, without overlap.

    ``readings`` has the keys, requirement, label and text.  Fragments of two
    letters or more of safe readings are placed wherever the requirement has
    them; a path of places leads from its beginning to its end.  Two readings
    must take part, an unwrapped one among them, and one fragment of four
    letters or more.  A step is a join on the place where the last one ended.
    """
    need, text = normalize(F.col("requirement")), normalize(F.col("text"))
    safe = F.lit(False)
    for name in SAFE_READINGS:
        safe = safe | F.col("label").startswith(name)
    fit = (F.length("need") >= LEAST_LENGTH) & F.col("need").rlike(f"^{_HAN}+$") & F.col("need").endswith(SERVICE_CENTRE) & safe & (F.length("part") >= LEAST_FRAGMENT)
    parts = readings.withColumns({"need": need, "part": text}).filter(fit).select(*keys, "need", "label", "part").distinct()
    at = F.filter(F.sequence(F.lit(1), F.length("need")), lambda p: F.substring(F.col("need"), p, F.length("part")) == F.col("part"))
    placed = parts.select(*keys, "need", "label", F.length("part").alias("size"), F.explode(at).alias("begin")).withColumn("end", F.col("begin") + F.col("size"))
    steps = placed.select(*keys, F.col("label").alias("__label"), F.col("size").alias("__size"), F.col("begin").alias("end"), F.col("end").alias("__end"))
    paths = placed.filter("begin = 1").select(*keys, "need", "end", F.array("label").alias("labels"), F.col("size").alias("longest"))
    found = None
    for _ in range(MOST_PIECES - 1):
        paths = paths.join(steps, [*keys, "end"]).select(*keys, "need", F.col("__end").alias("end"), F.array_union("labels", F.array("__label")).alias("labels"), F.greatest("longest", "__size").alias("longest")).distinct()
        found = paths if found is None else found.union(paths)
    whole = (F.col("end") > F.length("need")) & (F.size("labels") >= 2) & F.exists("labels", lambda x: x.startswith(UNWRAPPED)) & (F.col("longest") >= ANCHOR_FRAGMENT)
    return found.filter(whole).select(*keys, F.col("need").alias("text")).distinct()


def acceptance_stamp(requirement: Column, texts: Column, conflict: Column) -> Column:
    """Company and acceptance stamp, from two readings that are exactly the company's two parts and one that has the kind.

    Not where a reading has the whole company, or companies conflict.
    """
    def made(need, read, company):
        kind = F.concat(F.lit(ACCEPTANCE), F.regexp_extract(need, f"{ACCEPTANCE}([0-9]+)", 1))
        cuts = F.sequence(F.lit(2), F.greatest(F.length(company) - 8, F.lit(2)))
        split = F.exists(cuts, lambda n: (n <= F.length(company) - 8) & F.array_contains(read, F.substring(company, F.lit(1), n)) & _other(read, F.substring(company, F.lit(1), n), F.substring(company, n + 1, F.length(company))))
        ok = company.isNotNull() & _rest(need, company).contains(ACCEPTANCE) & F.exists(read, lambda t: t.contains(kind)) & ~F.coalesce(conflict, F.lit(False)) & ~F.exists(read, lambda t: t.contains(company)) & split
        return F.when(ok, F.concat(company, kind)).otherwise("")

    return _once(normalize(requirement), lambda need: _once(_known(texts), lambda read: _once(_company(need), lambda company: made(need, read, company))))


def _other(read: Column, left: Column, right: Column) -> Column:
    """Whether ``right`` is a reading besides the one that is ``left``."""
    return F.when(left == right, F.size(F.filter(read, lambda t: t == left)) > 1).otherwise(F.array_contains(read, right))


def _organization_seen(read: Column, organization: Column) -> Column:
    return F.exists(read, lambda t: t.startswith(organization) & F.substring(t, F.length(organization) + 1, F.length(t)).rlike("^([0-9]{6,16})?$"))


def company_stamp(requirement: Column, texts: Column, conflict: Column) -> Column:
    """Organization, kind and short number, each read exactly in one region."""
    def made(need, read):
        pattern = f"^(.*(?:{_LEGAL}))({_HAN}{{0,3}}?(?:{'|'.join(KINDS_WITH_STORE)}))([0-9]{{0,3}})$"
        organization, kind, number = (F.regexp_extract(need, pattern, i) for i in (1, 2, 3))
        ok = (organization != "") & _organization_seen(read, organization) & F.array_contains(read, kind) & ~F.coalesce(conflict, F.lit(False)) & ((number == "") | F.array_contains(read, number))
        return F.when(ok, F.concat(organization, kind, number)).otherwise("")

    return _once(normalize(requirement), lambda need: _once(_known(texts), lambda read: made(need, read)))


def type_band_stamp(requirement: Column, texts: Column, band: Column, conflict: Column) -> Column:
    """Organization as read, and the kind of stamp where one confident reading of its band differs in one letter.

    ``band`` is an array of (text, confidence).  No other complete organization may have been read.
    """
    def made(need, read, kind, organization):
        near = lambda t: (F.length(t) >= F.length(organization) - 2) & (F.length(t) <= F.length(organization) + 16)
        complete = F.filter(F.transform(F.filter(read, near), lambda t: F.regexp_extract(t, f"^(.+?(?:{_LEGAL}))(?:[0-9]{{6,16}})?$", 1)), lambda t: t != "")
        differ = lambda t: F.size(F.filter(F.sequence(F.lit(1), F.length(kind)), lambda i: F.substring(kind, i, F.lit(1)) != F.substring(t, i, F.lit(1))))
        one = F.exists(band, lambda b: (b["confidence"] >= BAND_CONFIDENCE) & normalize(b["text"]).endswith(SPECIAL) & (F.length(normalize(b["text"])) == F.length(kind)) & (differ(normalize(b["text"])) == 1))
        ok = kind.isNotNull() & organization.rlike(f"({_LEGAL})$") & _organization_seen(read, organization) & F.forall(complete, lambda c: c == organization) & ~F.coalesce(conflict, F.lit(False)) & one
        return F.when(ok, F.concat(organization, kind)).otherwise("")

    return _once(normalize(requirement), lambda need: _once(_known(texts), lambda read: _once(F.coalesce(*[F.when(need.endswith(k), F.lit(k)) for k in KINDS]), lambda kind: _once(F.substring(need, F.lit(1), F.length(need) - F.length(kind)), lambda organization: made(need, read, kind, organization)))))


def band_company(requirement: Column, bands: Column, texts: Column) -> Column:
    """Company as one band has it and no band has another, and the acceptance kind as a whole reading; the ending isn't added."""
    def made(need, lines, company):
        rest = _rest(need, company)
        branch = F.regexp_extract(rest, f"{ACCEPTANCE}([0-9]{{1,3}})", 1)
        kind = F.concat(F.lit(ACCEPTANCE), branch)
        every = F.concat(_known(texts), lines)
        ok = (
            company.isNotNull() & rest.contains(ACCEPTANCE) & F.array_contains(lines, company) & ~F.exists(lines, lambda t: t.contains(COMPANY) & (t != company))
            & F.exists(every, lambda t: (t == kind) | ((branch == "") & (t == ACCEPTANCE + SPECIAL)))
        )
        return F.when(ok, F.concat(company, kind)).otherwise("")

    return _once(normalize(requirement), lambda need: _once(_known(bands), lambda lines: _once(_company(need), lambda company: made(need, lines, company))))


def shared_suffix(requirement: Column, first: Column, second: Column) -> Column:
    """The longest end of an organization's name that both readers have, if it is at most three letters short."""
    def made(need, a, b):
        least = F.greatest(F.lit(SUFFIX_LEAST), F.bround(F.length(need) * F.lit(SUFFIX_SHARE)).cast("int"))
        most = F.least(F.lit(SUFFIX_OMITTED), F.length(need) - least)
        ends = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SUFFIX_OMITTED)), lambda n: F.when(n <= most, F.substring(need, n + 1, F.length(need)))), F.isnotnull)
        both = F.filter(ends, lambda e: F.exists(a, lambda t: t.contains(e)) & F.exists(b, lambda t: t.contains(e)))
        ok = (F.length(need) >= LEAST_LENGTH) & need.rlike(f"^{_HAN}+$") & need.rlike(f"({'|'.join(LONG_ENDINGS)})$")
        return F.when(ok, F.coalesce(F.get(both, F.lit(0)), F.lit(""))).otherwise("")

    return _once(normalize(requirement), lambda need: _once(_known(first), lambda a: _once(_known(second), lambda b: made(need, a, b))))


def overlapping_repairs(regions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Repair stamps whose company is read in two parts in two customer stamps on top of each other.

    ``regions`` has the keys, requirement, the order of regions, x, y, width,
    height, color, role, texts and conflict.  The first pair in order counts.
    """
    r = regions.withColumns({"need": normalize(F.col("requirement")), "read": _known(F.col("texts"))}).withColumn("company", _company(F.col("need")))
    r = r.filter(F.col("company").isNotNull() & _rest(F.col("need"), F.col("company")).isin(*REPAIR_ENDINGS) & (F.col("role") == CUSTOMER) & ~F.coalesce("conflict", F.lit(False)))
    a, b = r.alias("a"), r.alias("b")
    wide = F.least(F.col("a.x") + F.col("a.width"), F.col("b.x") + F.col("b.width")) - F.greatest("a.x", "b.x")
    high = F.least(F.col("a.y") + F.col("a.height"), F.col("b.y") + F.col("b.height")) - F.greatest("a.y", "b.y")
    common = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    smaller = F.least(F.col("a.width") * F.col("a.height"), F.col("b.width") * F.col("b.height"))
    same = (F.col(f"a.{order}") < F.col(f"b.{order}")) & (F.col("a.color") == F.col("b.color")) & (common >= OVERLAP * smaller) & (smaller > 0)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    company = F.col("a.company")
    cut = lambda n: (F.substring(company, F.lit(1), n), F.substring(company, n + 1, F.length(company)))
    has = lambda side, t: F.array_contains(F.col(f"{side}.read"), t)
    parted = F.exists(F.sequence(F.lit(2), F.greatest(F.length(company) - 2, F.lit(2))), lambda n: (has("a", cut(n)[0]) & has("b", cut(n)[1])) | (has("b", cut(n)[0]) & has("a", cut(n)[1])))
    found = a.join(b, same).filter((has("a", F.lit(REPAIR)) | has("b", F.lit(REPAIR))) & parted)
    made = F.struct(F.col(f"a.{order}").alias("i"), F.col(f"b.{order}").alias("j"), F.concat(company, F.lit(REPAIR)).alias("text"))
    return found.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.min(made).alias("m")).select(*keys, "m.text")
