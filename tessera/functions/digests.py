"""Short transcripts of tool results: a projection for each tool, and a ladder of lengths for lists of orders.

The result never exceeds the budget, but for text that is no JSON object, which is cut at the budget and gets '...'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of details and of short fields, entries of lists, and the ladder of an order's summary.
DETAIL, SHORT, MOST_ORDERS, MOST_PRODUCTS, MOST_DOCS, LADDER = 60, 40, 10, 2, 5, (60, 30, 16, 8, 0)


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis if any are lost; nothing for 0."""
    return F.lit("") if limit <= 0 else F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule that uses a value in many places, with the value computed once a row."""
    return F.try_element_at(F.transform(F.array(value), rule), F.lit(1))


def _at(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    """The kind of a JSON value: STRING, BOOLEAN, VOID, OBJECT, ARRAY, BIGINT or another number; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def shown(value: Column) -> Column:
    """A JSON scalar as text: strings as they are, True, False and None, numbers with a fraction if they were written with one; nothing if there is none."""
    def one(v: Column) -> Column:
        kind, text = _kind(v), F.to_json(v)
        number = F.when((kind != "BIGINT") & ~text.rlike("[.eE]"), F.concat(text, F.lit(".0"))).otherwise(text)
        return F.when(v.isNull(), "").when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").otherwise(number)

    return _once(value, one)


def truthy(value: Column) -> Column:
    return _once(value, lambda v: v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}"))


def _short(value: Column, name: str, limit: int = SHORT) -> Column:
    return cut(shown(_at(value, name)), limit)


def _objects(payload: Column, name: str) -> Column:
    """The entries of a list; of none if it is missing or empty."""
    return F.coalesce(_at(payload, name, "array<variant>"), F.array().cast("array<variant>"))


def _malformed(payload: Column, name: str, kind: str) -> Column:
    value = _at(payload, name)
    return truthy(value) & (_kind(value) != kind)


def _order(payload: Column, budget: int) -> Column:
    order = _at(payload, "order")
    name = _at(F.try_element_at(_objects(order, "items"), F.lit(1)), "name")
    return F.concat(
        F.lit("order_id="), _short(order, "order_id"), F.lit(" status="), _short(order, "status"), F.lit(" total="), shown(_at(order, "total")), F.lit(" tracking_number="), _short(order, "tracking_number"),
        F.when(truthy(name), F.concat(F.lit(" 商品="), cut(shown(name), SHORT))).otherwise(""),
    )


def _product(payload: Column, budget: int) -> Column:
    every = _objects(payload, "products")
    one = lambda p: F.concat(F.lit("商品="), _short(p, "name"), *[x for n in ("price", "stock", "product_id") for x in (F.lit(f" {n}="), shown(_at(p, n)))])
    parts = F.transform(F.filter(F.slice(every, 1, MOST_PRODUCTS), lambda p: _kind(p) == "OBJECT"), one)
    more = F.size(every) - MOST_PRODUCTS
    return F.array_join(F.when(more > 0, F.array_append(parts, F.concat(F.lit("…另有"), more.cast("string"), F.lit("项")))).otherwise(parts), "; ")


def _logistics(payload: Column, budget: int) -> Column:
    held = _at(payload, "logistics")
    last = F.try_element_at(_objects(held, "events"), F.lit(-1))
    newest = F.concat(F.lit(" 最新="), _short(last, "time"), F.lit(" "), _short(last, "description"))
    return F.concat(F.lit("tracking_number="), _short(held, "tracking_number"), F.lit(" carrier="), _short(held, "carrier"), F.lit(" status="), _short(held, "status"), F.when(F.coalesce(_kind(last) == "OBJECT", F.lit(False)), newest).otherwise(""))


def _orders(payload: Column, budget: int) -> Column:
    """Every order keeps its id and status; summaries get the longest length of the ladder that fits."""
    every = _objects(payload, "orders")
    visible = F.filter(F.slice(every, 1, MOST_ORDERS), lambda o: _kind(o) == "OBJECT")
    count = _at(payload, "count")
    extra = F.when(truthy(count), _at(payload, "count", "int")).otherwise(F.size(every)) - F.size(visible)
    tail = F.when(extra > 0, F.concat(F.lit("…另有"), extra.cast("string"), F.lit("单"))).otherwise("")

    def one(o: Column) -> Column:
        about = F.when(truthy(_at(o, "items_summary")), shown(_at(o, "items_summary"))).otherwise("")
        return F.struct(F.btrim(F.concat(shown(_at(o, "order_id")), F.lit(" "), shown(_at(o, "status")))).alias("head"), about.alias("about"))

    def body(held: Column, limit: int, between: str) -> Column:
        entry = lambda e: F.when(e["about"] != "", F.concat(e["head"], F.lit(" "), cut(e["about"], limit))).otherwise(e["head"]) if limit else e["head"]
        parts = F.transform(held["entries"], entry)
        if between == "|":
            parts = F.transform(parts, lambda p: F.replace(p, F.lit("  "), F.lit(" ")))
        return F.concat(F.array_join(parts, between), F.when(held["tail"] != "", F.lit(" ")).otherwise(""), held["tail"])

    def ladder(held: Column) -> Column:
        fits = [_once(body(held, n, " | "), lambda t: F.when(F.length(t) <= budget, t)) for n in LADDER]
        return F.coalesce(*fits, body(held, 0, "|"))

    return _once(F.struct(F.transform(visible, one).alias("entries"), tail.alias("tail")), ladder)


def _knowledge(payload: Column, budget: int) -> Column:
    """Names of documents only, each once."""
    held = F.filter(_objects(payload, "results"), lambda r: _kind(r) == "OBJECT")
    names = F.array_distinct(F.filter(F.transform(held, lambda r: F.btrim(F.when(truthy(_at(r, "doc")), shown(_at(r, "doc"))).otherwise(""))), lambda d: d != ""))
    n = F.size(names)
    more = F.when(n > MOST_DOCS, F.concat(F.lit("…等"), n.cast("string"), F.lit("篇"))).otherwise("")
    return F.when(n == 0, "命中0篇").otherwise(F.concat(F.lit("命中"), n.cast("string"), F.lit("篇: "), F.array_join(F.slice(names, 1, MOST_DOCS), "、"), more))


def _refund(payload: Column, budget: int) -> Column:
    parts = [F.when(truthy(_at(payload, k)), F.concat(F.lit(f" {k}="), _short(payload, k, DETAIL))).otherwise("") for k in ("application_id", "status", "code", "message", "error")]
    return F.concat(F.lit("success="), shown(_at(payload, "success")), *parts)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _scalars(payload: Column, budget: int) -> Column:
    """The scalars of the top level as JSON with ordered keys; nested values go."""
    entries = F.map_entries(F.try_variant_get(payload, "$", "map<string,variant>"))
    kept = F.array_sort(F.transform(F.filter(entries, lambda e: ~F.coalesce(_kind(e["value"]), F.lit("VOID")).isin("VOID", "OBJECT", "ARRAY")), lambda e: F.struct(
        e["key"].alias("key"), F.when(_kind(e["value"]) == "STRING", _quoted(cut(shown(e["value"]), SHORT))).when(_kind(e["value"]) == "BOOLEAN", F.lower(shown(e["value"]))).otherwise(shown(e["value"])).alias("text"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), e["text"])), ", "), F.lit("}"))


def _skill(payload: Column, budget: int) -> Column:
    loaded = truthy(_at(payload, "success")) & truthy(_at(payload, "skill_name"))
    return F.when(loaded, F.concat(F.lit("已加载技能: "), shown(_at(payload, "skill_name")), F.lit("（指令略）"))).otherwise(_scalars(payload, budget))


#: Each tool's projection, and the value that must be of a kind for it.
PROJECTIONS: dict[str, tuple[Callable[[Column, int], Column], str | None, str]] = {
    "query_order": (_order, "order", "OBJECT"), "query_product": (_product, "products", "ARRAY"), "query_logistics": (_logistics, "logistics", "OBJECT"), "list_user_orders": (_orders, "orders", "ARRAY"),
    "search_knowledge": (_knowledge, "results", "ARRAY"), "submit_refund_application": (_refund, None, ""), "cancel_refund_application": (_refund, None, ""), "query_refund_application": (_refund, None, ""),
    "load_skill": (_skill, None, ""),
}


def tool_digest(tool: Column, content: Column, budget: int = 200) -> Column:
    """What a transcript keeps of a tool's JSON result.

    Known tools are projected, a recalled memory stays as it is, other tools keep the scalars of their top level; the result
    is cut to the budget. Text that is no JSON object, or lacks the shape its tool needs, is cut as it is; null gives null.
    """
    budget = max(int(budget), 1)
    prefix = F.when(F.length(content) <= budget, content).otherwise(F.concat(F.left(content, F.lit(budget)), F.lit("...")))

    def digest(payload: Column) -> Column:
        text, broken = F.when(tool == "recall_user_memory", content), F.lit(False)
        for name, (project, needs, kind) in PROJECTIONS.items():
            text = text.when(tool == name, project(payload, budget))
            if needs:
                broken |= (tool == name) & _malformed(payload, needs, kind)
        return F.when(F.coalesce(broken, F.lit(False)), prefix).otherwise(_once(text.otherwise(_scalars(payload, budget)), lambda t: cut(t, budget)))

    return _once(F.try_parse_json(content), lambda payload: F.when(F.coalesce(_kind(payload) == "OBJECT", F.lit(False)), digest(payload)).otherwise(prefix))
