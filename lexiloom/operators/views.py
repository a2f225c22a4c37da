"""Saved views: a filter, a multi-key sort, a grouping and a projection compiled to one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAGS = ("noun", "verb", "adjective", "adverb", "preposition", "other")
LANGUAGES = ("es", "he", "fr")
WEEK_MS = 7 * 24 * 3600 * 1000
_NEVER = 9007199254740991


@dataclass(frozen=True)
class Query:
    search: str = ""
    tags: tuple[str, ...] = ()
    pos: tuple[str, ...] = ()
    cefr: tuple[str, ...] = ()
    learned: str = "any"
    due: str = "any"
    status_match: str = "all"
    box_min: float | None = None
    box_max: float | None = None
    language: str | None = None

    @property
    def empty(self) -> bool:
        return self == Query()


@dataclass(frozen=True)
class View:
    query: Query = field(default_factory=Query)
    sorts: tuple[tuple[str, str], ...] = ()
    group_by: str | None = None
    visible: tuple[str, ...] = ("word", "translation", "pos")
    order: tuple[str, ...] = ()


def to_params(query: Query) -> str:
    """The query as URL parameters; defaults are left out."""
    q = query
    pairs = [("q", q.search), ("tags", ",".join(q.tags)), ("pos", ",".join(q.pos)), ("cefr", ",".join(q.cefr)), ("learned", q.learned if q.learned != "any" else ""), ("due", q.due if q.due != "any" else ""), ("status_match", q.status_match if q.status_match != "all" else "")]
    pairs += [(k, f"{v:g}") for k, v in (("box_min", q.box_min), ("box_max", q.box_max)) if v is not None]
    return urlencode([(k, v) for k, v in [*pairs, ("lang", q.language or "")] if v])


def from_params(params: str | None) -> Query:
    """The query of URL parameters; unknown values become defaults, numbers that aren't become none."""
    got = {k: v[0] for k, v in parse_qs(params or "").items()}
    some = lambda k: tuple(x.strip() for x in got.get(k, "").split(",") if x.strip())
    one = lambda k, allowed, other: got.get(k) if got.get(k) in allowed else other

    def number(k: str) -> float | None:
        try:
            value = float(got[k])
        except (KeyError, ValueError):
            return None
        return value if abs(value) != float("inf") and value == value else None

    return Query(
        got.get("q", ""), tuple(t for t in some("tags") if t in TAGS), some("pos"), some("cefr"), one("learned", ("learned", "not_learned"), "any"),
        one("due", ("due_now", "due_week", "not_due"), "any"), one("status_match", ("any",), "all"), number("box_min"), number("box_max"), one("lang", LANGUAGES, None),
    )


def _due(kind: str, now: Column) -> Column:
    due = F.col("mastery.next_due")
    if kind == "not_due":
        return due.isNull() | (due > now)
    return F.coalesce(due <= now + (WEEK_MS if kind == "due_week" else 0), F.lit(False))


def condition(query: Query, now: Column) -> Column:
    """The filter over vocabulary items; ``now`` is in milliseconds."""
    parts: list[Column] = []
    if text := query.search.strip().lower():
        hay = [F.coalesce(F.col(c), F.lit("")) for c in ("word", "translation", "lemma", "surface_form", "gloss_primary")]
        lists = [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") for c in ("glosses", "surface_forms")]
        parts.append(F.contains(F.lower(F.concat_ws(" ", *hay, *lists)), F.lit(text)))
    if query.tags:
        parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in query.tags])))
    parts += [F.col(c).isin(*own) for c, own in (("pos", query.pos), ("cefr", query.cefr)) if own]
    learned = None if query.learned == "any" else F.col("learned") == (query.learned == "learned")
    due = None if query.due == "any" else _due(query.due, now)
    if learned is not None and due is not None and query.status_match == "any":
        parts.append(learned | due)
    else:
        parts += [p for p in (learned, due) if p is not None]
    box = F.coalesce("mastery.box", F.lit(0))
    parts += [box >= query.box_min] if query.box_min is not None else []
    parts += [box <= query.box_max] if query.box_max is not None else []
    parts += [F.col("language") == query.language] if query.language else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def sort_value(name: str) -> Column:
    """What a property sorts by."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return {
        "lemma": text(F.coalesce("lemma", "word")),
        "translation": text(F.coalesce(F.nullif("gloss_primary", F.lit("")), "translation")),
        "pos": text(F.col("pos")),
        "cefr": F.coalesce("cefr", F.lit("")),
        "learned": F.col("learned").cast("int"),
        "box": F.coalesce("mastery.box", F.lit(0)),
        "nextDue": F.coalesce("mastery.next_due", F.lit(_NEVER)),
        "createdAt": F.col("created_at"),
        "gender": F.coalesce("gender", F.lit("")),
        "ipa": F.coalesce("ipa", F.lit("")),
    }.get(name, text(F.col("word")))


def ordering(sorts: tuple[tuple[str, str], ...]) -> list[Column]:
    """The sort keys, newest first by default, and the id for ties."""
    return [*[sort_value(f).asc() if d == "asc" else sort_value(f).desc() for f, d in sorts or (("createdAt", "desc"),)], F.col("id").asc()]


def group_key(name: str | None) -> Column:
    tag = F.coalesce(F.get("tags", F.lit(0)), F.lit(""))
    return {"learned": F.col("learned").cast("string"), "cefr": F.coalesce("cefr", F.lit("")), "pos": F.coalesce("pos", F.lit("")), "box": F.coalesce("mastery.box", F.lit(0)).cast("string"), "tags": tag}.get(name or "", F.lit(""))


def label(key: Column, name: str | None) -> Column:
    if name == "learned":
        return F.when(key == "true", "Learned").otherwise("Not learned")
    return F.when(key == "", "—").otherwise(key)


def columns(view: View, known: list[str]) -> list[str]:
    """Visible properties in their order: unknown ones dropped, missing ones added, the word first."""
    order = [c for c in dict.fromkeys([*view.order, *view.visible]) if c in known and c in view.visible]
    return ["word", *[c for c in order if c != "word"]]


def hidden(view: View, name: str) -> View:
    return replace(view, visible=tuple(c for c in view.visible if c != name or c == "word"))


def shown(view: View, name: str) -> View:
    return replace(view, visible=tuple(dict.fromkeys([*view.visible, name])))


def sorted_by(view: View, name: str | None, direction: str = "asc") -> View:
    """The view with this primary sort, or without one."""
    rest = tuple(s for s in view.sorts[1:] if s[0] != name)
    return replace(view, sorts=((name, direction), *rest) if name else rest)


def apply_view(items: DataFrame, view: View, now: Column) -> DataFrame:
    """Rows of the view with their group and their position in it."""
    key = group_key(view.group_by)
    kept = items.filter(condition(view.query, now)).withColumn("group_key", key)
    place = Window.partitionBy("group_key").orderBy(*ordering(view.sorts))
    own = columns(view, items.columns)
    return kept.select("id", "group_key", label(F.col("group_key"), view.group_by).alias("group_label"), F.row_number().over(place).alias("position"), *own)


# The columns of each layout, and the views that a new workspace starts with (name, icon, layout).
TABLE_PROPERTIES = ("word", "lemma", "translation", "pos", "cefr", "tags", "createdAt", "box", "nextDue")
GALLERY_PROPERTIES = ("word", "translation", "tags", "learned")
BOARD_PROPERTIES = ("word", "translation")
SEEDED = (("All words", "📋", "table"), ("Cards", "🖼️", "gallery"), ("Review queue", "📅", "table"))


def default_view(layout: str) -> View:
    """The view of a layout that has none yet: newest first, a board by learned."""
    shown_ = {"gallery": GALLERY_PROPERTIES, "board": BOARD_PROPERTIES}.get(layout, TABLE_PROPERTIES)
    return View(sorts=(("createdAt", "desc"),), group_by="learned" if layout == "board" else None, visible=shown_, order=shown_)


def review_queue() -> View:
    """What isn't learned or is due, what falls due first at the top."""
    own = ("word", "translation", "box", "nextDue", "learned")
    return View(query=Query(learned="not_learned", due="due_now", status_match="any"), sorts=(("nextDue", "asc"),), visible=own, order=own)


def seeded(workspaces: DataFrame, views: DataFrame) -> DataFrame:
    """The starting views, by position, of workspaces without any view."""
    rows = F.array(*[F.struct(F.lit(at).alias("position"), F.lit(n).alias("name"), F.lit(i).alias("icon"), F.lit(k).alias("layout")) for at, (n, i, k) in enumerate(SEEDED)])
    bare = workspaces.select("workspace_id").join(views.select("workspace_id"), "workspace_id", "left_anti")
    return bare.select("workspace_id", F.inline(rows))


# stored views ----------------------------------------------------------------------------------------------------------------
def rearranged(views: DataFrame, added: DataFrame, moved: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views, refused): the views of all workspaces after a set of changes, with positions 0, 1, 2 ... in each, and the deletes that were refused.

    views: (id, workspace_id, position, ...). added: the same columns, a null position for the end. moved: (id, position).
    deleted: (id, seq), each in the order of seq. A workspace keeps one view: if all that it would have are deleted, the last
    delete is refused. Of the others, views that are added or moved to a place stand before the view that has that place among
    the rest; a position below 0 is the first one, and ties go by id. Deletes of added views count; unknown ids change nothing.
    One pass: a join by id for the changes, a rank within each workspace for the rest.
    """
    changes = moved.groupBy("id").agg(F.min("position").alias("__to")).join(deleted.groupBy("id").agg(F.min("seq").alias("__seq")), "id", "full")
    old = views.select(*views.columns, F.lit(False).alias("__added"))
    rows = old.unionByName(added.select(*views.columns, F.lit(True).alias("__added"))).join(changes, "id", "left")
    own = Window.partitionBy("workspace_id")
    last = F.row_number().over(own.orderBy(F.desc_nulls_last("__seq"), F.desc("id")))
    rows = rows.withColumns({"__left": F.count(F.when(F.col("__seq").isNull(), 1)).over(own), "__last": last})
    kept = F.col("__seq").isNull() | ((F.col("__left") == 0) & (F.col("__last") == 1))
    rows = rows.withColumn("__kept", kept)
    refused = rows.filter(F.col("__kept") & F.col("__seq").isNotNull()).select("id", "workspace_id")
    wanted = F.coalesce("__to", F.when(F.col("__added"), F.col("position")))
    rest = F.row_number().over(Window.partitionBy("workspace_id", "__fixed").orderBy("__added", "position", "id")) - 1
    rows = rows.filter("__kept").withColumn("__wanted", wanted).withColumn("__fixed", F.col("__wanted").isNotNull())
    rows = rows.withColumn("__at", F.when(F.col("__fixed"), F.col("__wanted")).otherwise(rest))
    place = F.row_number().over(own.orderBy("__at", F.desc("__fixed"), "id")) - 1
    return rows.withColumn("position", place.cast(dict(views.dtypes)["position"])).select(*views.columns), refused


_CONFIG = "map<string, variant>"


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


def _names(config: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(config[key], "$", "array<string>"), F.array().cast("array<string>"))


def _with(config: Column, **values: Column) -> Column:
    """The configuration with these entries, the others as they are."""
    return F.map_concat(F.map_filter(config, lambda k, _: ~k.isin(*values)), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))


def _before_box(names: Column, name: str) -> Column:
    """The list with the name before ``box``, or at the end; as it is if it has the name."""
    at = F.coalesce(F.nullif(F.array_position(names, F.lit("box")), F.lit(0)), F.size(names) + 1).cast("int")
    return F.when(F.array_contains(names, name), names).otherwise(F.array_insert(names, at, F.lit(name)))


def _variant(names: Column) -> Column:
    return F.parse_json(F.to_json(names))


def migrated(views: DataFrame, config: str = "config") -> DataFrame:
    """views (name, layout, a JSON configuration, ...) brought up to date, with ``migrations``: what was done, in its order.

    cards: the default view Gallery of layout gallery is called Cards. review_queue: a review queue that asks for both not
    learned and due takes either. all_words: one that is sorted by word, or not sorted and without the date, shows the date
    before the box and is sorted by it, newest first. dedupe: lists of properties hold no name twice. Each looks at the shape
    that the ones before it left and does nothing to one that is up to date, so a second pass changes no row. Entries that a
    migration doesn't know stay. A null configuration, or one that isn't a JSON object, is empty.
    """
    rows = views.withColumn("__c", F.coalesce(F.from_json(config, _CONFIG), F.create_map().cast(_CONFIG)))
    c = F.col("__c")
    query = lambda key: F.try_variant_get(c["query"], f"$.{key}", "string")
    steps: list[tuple[str, Column, dict[str, Column]]] = []
    steps.append(("cards", (F.col("name") == "Gallery") & (F.col("layout") == "gallery"), {"name": F.lit("Cards")}))

    legacy = (F.col("name") == "Review queue") & (query("learned") == "not_learned") & (query("due") == "due_now") & (F.coalesce(query("statusMatch"), F.lit("all")) == "all")
    own_query = F.coalesce(F.from_json(F.to_json(c["query"]), _CONFIG), F.create_map().cast(_CONFIG))
    steps.append(("review_queue", legacy, {"__c": _with(c, query=F.parse_json(F.to_json(_with(own_query, statusMatch=_json('"any"')))))}))

    visible, order = _names(c, "visibleProperties"), _names(c, "propertyOrder")
    sorts = F.coalesce(F.from_json(F.to_json(c["sorts"]), "array<map<string, string>>"), F.array().cast("array<map<string, string>>"))
    first = F.get(sorts, F.lit(0))
    by_word = (F.size(sorts) == 1) & (F.size(first) == 2) & (first["field"] == "word") & (first["direction"] == "asc")
    bare = (F.size(sorts) == 0) & ~F.array_contains(visible, "createdAt")
    shown_ = F.when(F.size(visible) > 0, visible).otherwise(F.array(*[F.lit(p) for p in TABLE_PROPERTIES]))
    ordered = F.when(F.size(order) > 0, order).otherwise(shown_)
    dated = [_variant(F.array_distinct(_before_box(x, "createdAt"))) for x in (shown_, ordered)]
    newest = _json('[{"field": "createdAt", "direction": "desc"}]')
    steps.append(("all_words", (F.col("name") == "All words") & (by_word | bare), {"__c": _with(c, visibleProperties=dated[0], propertyOrder=dated[1], sorts=newest)}))

    twice = (F.size(F.array_distinct(visible)) < F.size(visible)) | (F.size(F.array_distinct(order)) < F.size(order))
    steps.append(("dedupe", twice, {"__c": _with(c, visibleProperties=_variant(F.array_distinct(visible)), propertyOrder=_variant(F.array_distinct(order)))}))

    rows = rows.withColumn("migrations", F.array().cast("array<string>"))
    for name, applies, new in steps:
        rows = rows.withColumn("__do", F.coalesce(applies, F.lit(False)))
        done = F.when(F.col("__do"), F.array_append("migrations", F.lit(name))).otherwise(F.col("migrations"))
        rows = rows.withColumns({k: F.when(F.col("__do"), v).otherwise(F.col(k)) for k, v in new.items()} | {"migrations": done})
    text = F.when(F.exists("migrations", lambda m: m != "cards"), F.to_json("__c")).otherwise(F.col(config))
    return rows.withColumn(config, text).select(*views.columns, "migrations")
