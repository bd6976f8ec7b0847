"""Tables and room layouts stored as JSON pages, turned into sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx

TABLE_SCHEMA = "schema struct<fields:array<struct<name:string>>>, data array<array<string>>"
ROOM_SCHEMA = (
    "_type string, _file string, _i string, variant string, name string, type string, subtype string, "
    "shape string, width string, height string, difficulty string, weight string, "
    "doors array<struct<x:string,y:string,exists:boolean>>, "
    "spawns array<struct<x:string,y:string,entity:array<struct<type:string,variant:string,subtype:string>>>>"
)

# Labels, codes and sentinels of the structured sentences.
ITEM_CODES = {"c": ("item", "collectible"), "t": ("trinket", "trinket"), "k": ("card", "card"), "p": ("pill", "pill")}
ITEM_LABELS = {"item": "收藏品", "trinket": "饰品", "card": "卡牌或符文", "pill": "胶囊"}
ITEM_FIELDS = (
    ("desczh", "中文短描述"), ("descen", "英文短描述"), ("effect", "机制效果"), ("quality", "品质"),
    ("charge", "充能"), ("unlock", "解锁条件"), ("tag", "机制标签"), ("source", "游戏来源版本"), ("subtype", "子类型"),
)
ITEM_UNSET = ("-2147483648", "-1")
ENTITY_FIELDS = (
    ("page", "关联页面"), ("tag", "标签"), ("tips", "机制提示"), ("hp", "基础生命值"), ("stagehp", "关卡生命值"),
    ("shieldstrength", "护盾强度"), ("collisionDamage", "碰撞伤害"), ("source", "游戏来源版本"),
)
ENTITY_UNSET = ("-1",)
CONFLICT_NOTE = "源数据冲突：相同 type.variant.subtype 存在多个名称记录，均予保留"
NOT_FILLED = "未填写"
NONE_TEXT = "无"
ROOM_PREFIX = "Data:Rooms/"
ROOM_TYPE = "ROOM_STB"
# End of fixed values.


def explode_tabular(pages: DataFrame, content: str = "wikitext") -> DataFrame:
    """Rows of tabular pages: row_no, fields (map name to raw text) and ``arity_ok``.

    Nested values count as empty. A page that is not a table gives no row here;
    see ``bad_tables``.
    """
    table = F.from_json(content, TABLE_SCHEMA)
    names = F.transform("_t.schema.fields", lambda f: f["name"])
    rows = pages.select("*", F.explode_outer(F.array(table)).alias("_t")).select(
        *[c for c in pages.columns if c != content], names.alias("_names"), F.posexplode("_t.data").alias("_no", "_values")
    )
    fits = F.size("_values") == F.size("_names")
    values = F.transform("_values", lambda v: F.when(~v.rlike(r"^\s*[\[{]"), v))
    return rows.select(
        *[c for c in pages.columns if c != content],
        (F.col("_no") + 1).alias("row_no"),
        F.when(fits, F.map_from_arrays("_names", values)).alias("fields"),
        F.coalesce(fits, F.lit(False)).alias("arity_ok"),
    )


def bad_tables(pages: DataFrame, content: str = "wikitext") -> DataFrame:
    """Tabular pages without a usable schema or data."""
    t = F.from_json(content, TABLE_SCHEMA)
    names = F.transform(t["schema"]["fields"], lambda f: f["name"])
    fine = (F.size(names) > 0) & F.forall(names, lambda n: n.isNotNull() & (n != "")) & t["data"].isNotNull()
    return pages.where(~F.coalesce(fine, F.lit(False)))


def table_violations(pages: DataFrame, rows: DataFrame, content: str = "wikitext") -> DataFrame:
    """(title, row_no, rule) of pages that are no table, and of their rows with another number of values."""
    broken_pages = bad_tables(pages, content).select("title", F.lit(None).cast("int").alias("row_no"), F.lit("table").alias("rule"))
    return broken_pages.unionByName(rows.where("NOT arity_ok").select("title", "row_no", F.lit("arity").alias("rule")))


def identity_violations(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    """(title, row_no, rule) of rows without a usable identity."""
    number = F.col("row_no") if "row_no" in rows.columns else F.lit(None).cast("int")
    return rows.where(key.isNull()).select("title", number.alias("row_no"), F.lit(rule).alias("rule"))


def field(name: str) -> Column:
    return tx.clean_scalar(F.try_element_at("fields", F.lit(name)))


def _sentence(parts: list[Column]) -> Column:
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), "；"), F.lit("。"))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + "："), value)


def _filled(value: Column, other: Column | str) -> Column:
    return F.when(value != "", value).otherwise(F.lit(other) if isinstance(other, str) else other)


def item_identity(page_key: Column) -> tuple[Column, Column]:
    """Type and id of an item code such as ``C118``; null when the code is not valid."""
    folded = tx.fold(page_key)
    digits = F.regexp_extract(folded, "^[ctkp]([0-9]+)$", 1)
    number = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    kind, ident = F.lit(None).cast("string"), F.lit(None).cast("string")
    for letter, (entity_type, prefix) in ITEM_CODES.items():
        is_this = (digits != "") & F.startswith(folded, F.lit(letter))
        kind = F.when(is_this, F.lit(entity_type)).otherwise(kind)
        ident = F.when(is_this, F.concat(F.lit(prefix + ":"), number)).otherwise(ident)
    return kind, ident


def attach_keywords(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """Left join of item rows with their keyword row; of several the last wins."""
    last = keywords.groupBy(F.try_element_at("fields", F.lit("page")).alias("page_key")).agg(
        F.max_by("fields", "row_no").alias("keyword")
    )
    keyed = items.withColumn("page_key", F.trim(F.coalesce(F.try_element_at("fields", F.lit("page")), F.lit(""))))
    return keyed.join(last, "page_key", "left")


def render_items(rows: DataFrame) -> DataFrame:
    """Entity columns and sentence per item row (``fields``, ``page_key`` and optional ``keyword``)."""
    kind, ident = item_identity(F.col("page_key"))
    labels = F.create_map(*[F.lit(x) for pair in ITEM_LABELS.items() for x in pair])
    parts = [
        _labelled("名称", _filled(field("namezh"), F.col("entity_id"))),
        _labelled("英文名", _filled(field("nameen"), NOT_FILLED)),
        _labelled("实体类型", F.try_element_at(labels, F.col("entity_type"))),
        _labelled("稳定 ID", F.col("entity_id")),
    ]
    for name, label in ITEM_FIELDS:
        value = field(name)
        parts.append(F.when((value != "") & ~value.isin(*ITEM_UNSET), _labelled(label, value)))
    empty = F.array().cast("array<string>")

    def split(c: Column) -> Column:
        return F.coalesce(F.split(c, ";"), empty)

    lists = [split(F.try_element_at("fields", F.lit("namelist")))]
    if "keyword" in rows.columns:
        lists += [split(F.try_element_at("keyword", F.lit(n))) for n in ("name_alias", "PinyinIndex")]
    spelled = F.concat(F.array("page_key", field("namezh"), field("nameen")), *lists)
    zh = _filled(field("namezh"), F.col("page_key"))
    return rows.withColumn("entity_type", kind).withColumn("entity_id", ident).withColumn(
        "name_zh", zh
    ).withColumn("name_en", _filled(field("nameen"), F.col("name_zh"))).withColumn(
        "aliases", tx.unique_aliases(spelled)
    ).withColumn("text", tx.norm_plain(_sentence(parts)))


def entity_key() -> Column:
    """``type.variant.subtype``; null unless all three are whole numbers."""
    parts = [F.try_element_at("fields", F.lit(n)) for n in ("type", "variant", "subtype")]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.rlike("^-?[0-9]+$")
    return F.when(whole, F.concat_ws(".", *parts))


def render_entities(rows: DataFrame) -> DataFrame:
    """Entity columns and sentence per game-entity row; repeated identities are kept and marked."""
    from loreloom.operators.dedup import flag_conflicts

    keyed = flag_conflicts(rows.withColumn("identity", entity_key()).where("identity IS NOT NULL"), ["identity"])
    zh, en, identity = field("namezh"), field("nameen"), F.col("identity")
    fallback = _filled(zh, _filled(en, identity))
    parts = [
        _labelled("实体 ID", identity), _labelled("中文名", _filled(zh, NOT_FILLED)),
        _labelled("英文名", _filled(en, NOT_FILLED)),
    ]
    for name, label in ENTITY_FIELDS:
        value = field(name)
        parts.append(F.when((value != "") & ~value.isin(*ENTITY_UNSET), _labelled(label, value)))
    parts.append(F.when(F.col("source_conflict"), F.lit(CONFLICT_NOTE)))
    return keyed.withColumn("entity_type", F.lit("game_entity")).withColumn(
        "entity_id", F.concat(F.lit("game-entity:"), identity)
    ).withColumn("name_zh", _filled(zh, fallback)).withColumn("name_en", _filled(en, fallback)).withColumn(
        "aliases", tx.unique_aliases(F.array(identity, field("page"), zh, en))
    ).withColumn("text", tx.norm_plain(_sentence(parts))).withColumn(
        "conflict_key", F.when(F.col("source_conflict"), identity)
    )


def bad_rooms(pages: DataFrame, content: str = "wikitext") -> DataFrame:
    """(title, row_no, rule) of room pages that are not JSON objects."""
    named = pages.where(F.startswith("title", F.lit(ROOM_PREFIX)))
    parsed = F.schema_of_variant(F.try_parse_json(content))
    return named.where(~F.coalesce(F.startswith(parsed, F.lit("OBJECT")), F.lit(False))).select(
        "title", F.lit(None).cast("int").alias("row_no"), F.lit("room json").alias("rule")
    )


def read_rooms(pages: DataFrame, content: str = "wikitext") -> DataFrame:
    """Room-layout pages with the parsed record in ``room``."""
    named = pages.where(F.startswith("title", F.lit(ROOM_PREFIX)))
    parsed = named.select("*", F.explode_outer(F.array(F.from_json(content, ROOM_SCHEMA))).alias("room"))
    return parsed.where(F.col("room._type") == ROOM_TYPE)


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))


def room_key() -> Column:
    """Five-part identity of a room; null when a part is missing."""
    parts = [tx.clean_scalar(F.col(f"room.{n}")) for n in ("_file", "type", "variant", "subtype", "_i")]
    full = F.lit(True)
    for p in parts:
        full = full & (p != "")
    return F.when(full, F.concat_ws("/", *parts))


def render_rooms(rooms: DataFrame) -> DataFrame:
    """Entity columns and sentence per room layout: doors, spawn cells and spawn counts."""
    rows = rooms.withColumn("identity", room_key()).where("identity IS NOT NULL")
    r = lambda n: F.col(f"room.{n}")
    doors = F.transform(
        F.filter(F.coalesce(r("doors"), F.array().cast("array<struct<x:string,y:string,exists:boolean>>")), lambda d: d["exists"]),
        lambda d: F.concat(F.lit("("), _shown(d["x"]), F.lit(","), _shown(d["y"]), F.lit(")")),
    )
    zero = F.lit("0")
    keys = F.flatten(
        F.transform(
            F.filter("room.spawns", lambda s: s["entity"].isNotNull()),
            lambda s: F.transform(
                s["entity"],
                lambda e: F.concat_ws(
                    ".", F.coalesce(e["type"], zero), F.coalesce(e["variant"], zero), F.coalesce(e["subtype"], zero)
                ),
            ),
        )
    )
    lists = F.struct(F.coalesce(keys, F.array().cast("array<string>")).alias("_keys"), doors.alias("_doors"))
    rows = rows.select("*", F.inline(F.array(lists)))
    counts = F.transform(
        F.array_sort(F.array_distinct("_keys")),
        lambda k: F.concat(k, F.lit("×"), F.size(F.filter("_keys", lambda x: x == k)).cast("string")),
    )
    name = tx.clean_scalar(r("name"))
    cells = F.greatest(F.lit(0), F.size(F.coalesce(F.filter("room.spawns", lambda s: s.isNotNull()), F.array())))
    parts = [
        _labelled("房间布局 ID", F.col("identity")),
        F.when(name != "", _labelled("房间名称", name)),
        _labelled("STB 文件", _shown(r("_file"))),
        _labelled("房间类型", _shown(r("type"))),
        F.concat(F.lit("变体："), _shown(r("variant")), F.lit("，子类型："), _shown(r("subtype"))),
        F.concat(F.lit("形状："), _shown(r("shape")), F.lit("，尺寸："), _shown(r("width")), F.lit("×"), _shown(r("height"))),
        F.concat(F.lit("难度："), _shown(r("difficulty")), F.lit("，权重："), _shown(r("weight"))),
        _labelled("有效门", F.when(F.size("_doors") > 0, F.array_join("_doors", "、")).otherwise(NONE_TEXT)),
        _labelled("生成格数量", cells.cast("string")),
        _labelled("生成实体", F.when(F.size("_keys") > 0, F.array_join(counts, "、")).otherwise(NONE_TEXT)),
    ]
    display = _filled(name, F.concat(F.lit("房间布局 "), F.col("identity")))
    spelled = F.array(
        F.col("identity"), name, F.concat(tx.clean_scalar(r("_file")), F.lit(" "), _shown(r("_i"))),
        F.concat(F.lit("room-layout "), F.col("identity")),
    )
    return rows.withColumn("entity_type", F.lit("room_layout")).withColumn(
        "entity_id", F.concat(F.lit("room-layout:"), F.substring(F.sha2("identity", 256), 1, 20))
    ).withColumn("name_zh", display).withColumn("name_en", F.col("name_zh")).withColumn(
        "aliases", tx.unique_aliases(spelled)
    ).withColumn("text", tx.norm_plain(_sentence(parts))).drop("_keys", "_doors")
