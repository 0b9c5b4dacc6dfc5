"""The wording of a stamp, taken apart from both ends into typed fields, and the comparison of such fields.

Every stage is a column of its own: it looks at one end of what is left, and
what it peels off is a field.  Nothing is guessed; what no stage knows stays
unclassified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Purposes, name endings by kind of body, and the patterns of fields.
PURPOSES = (
    "收货专用章", "收货章", "收讫专用章", "收讫章", "签收专用章", "签收章", "验收专用章", "验收章", "业务专用章", "业务专章", "业务章", "业务受理专用章", "业务受理章", "业务受理", "合同专用章", "合同章", "财务专用章", "财务章", "发票专用章", "发票章",
    "结算专用章", "结算章", "货物收讫章", "出入库专用章", "出库专用章", "入库专用章", "收发货专用章", "仓库专用章", "维修专用章", "检测专用章", "售后业务专用章", "手机售后专用章", "三星售后服务专用章", "三星售后专用章", "北售后服务专用章",
    "售后服务专用章", "售后专用章", "维修中心专用章", "取机专用章", "维修业务专用章", "服务专用章", "公章", "印章",
)
AUTHORIZATION, STATION = "授权代码", "站代码"
HAN, CODE = r"[㐀-鿿]", "[A-Za-z0-9-]+"
NUMBER = r"(\([0-9]{1,3}\)|[①-⑳㉑-㊿](?:[/／、,，][①-⑳㉑-㊿])*)$"
PHONE = r"(?i)(?:(?:电话|TEL)[:：]?)?(0[1-9][0-9]{1,2}-[0-9]{7,8})$"
WAREHOUSE = r"((?=[A-Za-z0-9-]*[0-9])(?=[A-Za-z0-9-]*[A-Za-z])[A-Za-z0-9-]+)$"
LEGAL = r"^(.+?(?:有限责任公司|股份有限公司|有限公司|股份公司|集团公司|总公司|公司))(.*)$"
GENERIC = r"三星(?:电子)?(?:授权)?(?:维修|服务|维修服务)中心"
AMBIGUOUS = r"[、,，;；/／]|(?:公司|中心)(?:或者|或|以及|及|与|和)"
BRANCH = f"^({HAN}{{1,16}}?(?:分公司|分部|仓库|仓储部|客户服务中心))"
BRANCH_ENDINGS = r"(分公司|分部|仓库|部|中心|服务站)$"
KINDS = ((r"(商店|门店|经营部|经营店|专卖店)$", "商店／门店"), (r"(维修部|服务部|服务总汇)$", "维修／服务机构"), (r"(服务站|工作站|售后站)$|^三星售后$", "服务站"), (r"中心$", "服务／维修中心"), (r"分公司$", "分公司"), (r"公司$", "公司"))
_WIDE, _NARROW = "（）０１２３４５６７８９", "()0123456789"
_SPACE = r"(?U)\s+"


def normalized_name(text: Column) -> Column:
    """Without white space, brackets and digits of one width; traditional letters stay."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, ""), _WIDE, _NARROW)


def entity_type(name: Column, warehouse: Column) -> Column:
    """The kind of body that a name's ending says; empty if none."""
    shop = F.when(name.contains("授权体验店"), "授权体验店").otherwise("体验店")
    out = F.when(warehouse | name.rlike("(仓库|仓)$"), "仓库").when(name.contains("体验店"), shop)
    for pattern, kind in KINDS:
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise("")


def _field(kind: Column | str, label: Column | str, value: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(value != "", F.struct(lit(kind).alias("kind"), lit(label).alias("label"), value.alias("value")))


def with_terms(rows: DataFrame, column: str, name: str = "terms") -> DataFrame:
    """Add the typed fields of a stamp's wording as a struct (STR-18); null counts as empty.

    company, branch, name (both), entity_type, purpose, number,
    identity_fields (kind, label, value), unclassified, parse_status (parsed,
    partial, unparsed), supported, correction_supported and groupable.  A
    number that ends the wording, codes, phones, station and registration
    numbers, the purpose and a warehouse code are taken off the end, in this
    order, a labelled code before a name off the front.
    """
    out = rows.withColumn("__rest", normalized_name(F.col(column)))

    def peel(df: DataFrame, stage: str, pattern: str, group: int = 1, front: bool = False) -> DataFrame:
        """Move what the pattern finds at an end of the rest to a column of its own."""
        whole = F.regexp_extract("__rest", f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", 1)
        left = F.substring(F.col("__rest"), F.length(whole) + 1, F.length("__rest")) if front else F.substring(F.col("__rest"), F.lit(1), F.length("__rest") - F.length(whole))
        df = df.withColumns({f"__{stage}": F.regexp_extract("__rest", pattern, group), f"__{stage}_label": F.regexp_extract("__rest", pattern, 1), f"__{stage}_left": left})
        return df.withColumn("__rest", F.col(f"__{stage}_left")).drop(f"__{stage}_left")

    coded = f"({AUTHORIZATION}|{STATION})[:：]?({CODE})"
    out = peel(out, "lead", f"^{coded}(?={HAN})", 2, front=True)
    out = peel(out, "number", NUMBER)
    out = peel(out, "code", f"{coded}$", 2)
    out = peel(out, "phone", PHONE)
    out = peel(out, "station", "([0-9]{4,12})站$")
    out = peel(out, "digits", "([0-9]{6,14})$")
    out = out.withColumn("__centre", F.col("__rest").rlike("(维修中心|服务中心)$"))
    out = peel(out, "purpose", f"({'|'.join(sorted(PURPOSES, key=len, reverse=True))})$")
    out = peel(out, "store", WAREHOUSE)
    out = out.withColumn("__is_store", (F.col("__store") != "") & (F.upper("__store").contains("DC") | F.col("__rest").rlike("(仓|仓库)$")))

    code_kind = lambda c: F.when(F.col(f"{c}_label") == AUTHORIZATION, "authorization_code").otherwise("station_code")
    digits = F.col("__digits")
    digits_kind = F.when(F.col("__centre"), "station_code").when(digits.rlike("^0[1-9][0-9]{9,10}$"), "phone").otherwise("registration_code")
    digits_label = F.when(F.col("__centre"), "站点编号").when(digits.rlike("^0[1-9][0-9]{9,10}$"), "电话").otherwise("登记编号")
    fields = F.array_compact(F.array(
        _field(code_kind("__lead"), F.col("__lead_label"), F.col("__lead")), _field(code_kind("__code"), F.col("__code_label"), F.col("__code")), _field("phone", "电话", F.col("__phone")), _field("station_code", "站点编号", F.col("__station")),
        _field(digits_kind, digits_label, digits), _field(F.when(F.col("__is_store"), "warehouse_code").otherwise("registration_code"), F.when(F.col("__is_store"), "仓库代码").otherwise("登记代码"), F.col("__store")),
    ))
    rest, purpose = F.col("__rest"), F.col("__purpose")
    clear = (rest != "") & ~rest.rlike(AMBIGUOUS)
    out = out.withColumns({"__fields": fields, "__clear": clear, "__legal": F.when(clear, F.regexp_extract("__rest", LEGAL, 1)).otherwise(""), "__tail": F.when(clear, F.regexp_replace(F.regexp_extract("__rest", LEGAL, 2), r"^\((.*)\)$", "$1")).otherwise("")})
    has_station = F.exists("__fields", lambda f: f["kind"] == "station_code")
    split = f"^({GENERIC})({HAN}{{2,18}})$"
    centre = F.when(clear & (F.col("__legal") == "") & has_station, F.regexp_extract("__rest", split, 1)).otherwise("")
    out = out.withColumns({"__middle": centre, "__named": F.regexp_extract("__tail", BRANCH, 1)})
    tail, legal, middle, named = F.col("__tail"), F.col("__legal") != "", F.col("__middle") != "", F.col("__named")
    plain = tail.rlike(f"^{HAN}{{2,18}}$") & ~tail.rlike("[章:：]") & (tail.rlike(BRANCH_ENDINGS) | ((purpose != "") & (F.length(tail) <= 6)))
    kind = F.when(legal, entity_type(F.col("__legal"), F.lit(False))).when(middle, entity_type(F.col("__middle"), F.lit(False))).when(clear, entity_type(rest, F.col("__is_store"))).otherwise("")
    company = F.when(legal, F.col("__legal")).when(middle, F.col("__middle")).when(clear & (kind != ""), rest).otherwise("")
    branch = F.when(legal, F.when(named != "", named).when(plain, tail).otherwise("")).when(middle, F.regexp_extract("__rest", split, 2)).otherwise("")
    unknown = F.when(legal, F.when(named != "", F.substring(tail, F.length(named) + 1, F.length(tail))).when(plain, "").otherwise(tail)).when(company == "", rest).otherwise("")
    out = out.withColumns({"__company": company, "__branch": branch, "__kind": kind, "__unknown": unknown})
    own, unknown = F.col("__company") != "", F.col("__unknown")
    some = (purpose != "") | (F.size("__fields") > 0) | (F.col("__number") != "")
    status = F.when(own & (unknown == ""), "parsed").when(own | some, "partial").otherwise("unparsed")
    name_ = F.concat("__company", "__branch")
    made = F.struct(
        F.col("__company").alias("company"), F.col("__branch").alias("branch"), name_.alias("name"), F.col("__kind").alias("entity_type"), purpose.alias("purpose"), F.col("__number").alias("number"), F.col("__fields").alias("identity_fields"),
        unknown.alias("unclassified"), status.alias("parse_status"), own.alias("supported"), (own & (unknown == "") & ~middle & (F.length(name_) >= 6)).alias("correction_supported"),
        (own & (unknown == "") & (F.size("__fields") == 0) & ~F.col("__company").rlike(f"^{GENERIC}$")).alias("groupable"),
    )
    return out.withColumn(name, made).select(*rows.columns, name)


# A service station's identity, and the contact that may follow it.
_HAN_ONLY = r"[一-鿿]"
_IDENTITY = f"({_HAN_ONLY}{{2,20}}?服务中心)(?:({_HAN_ONLY}{{3,12}}):?站代码:?|站代码:?({_HAN_ONLY}{{3,12}}):?)([0-9]{{6,12}})"
_PHONE_LABEL = "(?i)(TEL:?|电话:?)"
_CONTACT = rf"^(0[0-9]{{2,3}}-[0-9]{{7,8}})((?:地址:)?{_HAN_ONLY}{{2,12}}市[^\n]{{1,100}}(?:路|街|巷|大道)[0-9]{{1,6}}号[^\n]{{0,80}})?$"
_IDENTITY_WORDS = "(?i)公司|分部|中心|授权|代码|编号|站点|专用章|收货章|业务受理|TEL|电话"


def _station(text: Column) -> Column:
    """centre, name and code of a text that is a station's identity and nothing else; null otherwise."""
    part = lambda i: F.regexp_extract(text, f"^{_IDENTITY}$", i)
    return F.when(text.rlike(f"^{_IDENTITY}$"), F.struct(part(1).alias("centre"), F.when(part(2) != "", part(2)).otherwise(part(3)).alias("name"), part(4).alias("code")))


def compare_stations(expected: Column, actual: Column) -> Column:
    """Whether a reading has the station that is required, field by field (MCH-08); null if it hasn't.

    A struct of matched (names of equal fields), additional (contact fields
    that the requirement lacks) and the station's name as required and as
    read.  Centre and code must be equal.  A name may be one letter longer than
    required.  After one phone label only a phone number and an address without
    words of an identity may follow.
    """
    labels = F.size(F.regexp_extract_all(actual, F.lit(_PHONE_LABEL), F.lit(1)))
    pieces = F.split(actual, _PHONE_LABEL, 2)
    identity, contact = F.when(labels == 0, actual).otherwise(pieces[0]), F.when(labels > 0, F.get(pieces, F.lit(1)))
    address = F.regexp_extract(contact, _CONTACT, 2)
    sound = (labels == 0) | ((labels == 1) & contact.rlike(_CONTACT) & ~address.rlike(_IDENTITY_WORDS))
    need, read = _station(expected), _station(identity)
    same = need["name"] == read["name"]
    longer = read["name"].startswith(need["name"]) & (F.length(read["name"]) == F.length(need["name"]) + 1)
    extra = F.array_compact(F.array(F.when(labels == 1, "电话"), F.when(F.coalesce(address, F.lit("")) != "", "地址")))
    matched = F.when(same, F.array(F.lit("服务中心名称"), F.lit("站代码"), F.lit("站点名称"))).otherwise(F.array(F.lit("服务中心名称"), F.lit("站代码")))
    ok = F.coalesce(sound & need.isNotNull() & read.isNotNull() & (need["centre"] == read["centre"]) & (need["code"] == read["code"]) & (same | longer), F.lit(False))
    return F.when(ok, F.struct(matched.alias("matched"), extra.alias("additional"), need["name"].alias("required_name"), read["name"].alias("read_name")))
