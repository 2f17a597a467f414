"""Scalar functions over ids, names and statuses; all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a package path that name its layer, with the layer's level.
LAYERS = {
    ("api", 3): ("api", "routes", "views", "controllers", "web", "ui", "cli"),
    ("domain", 2): ("domain", "core", "services", "business", "usecases", "models"),
    ("infra", 1): ("infra", "infrastructure", "storage", "db", "database", "persistence", "adapters", "repositories"),
}
CALLABLES = ("function", "method")
DOCUMENTABLE = ("class", "interface", "enum", "function", "method")
API_KINDS = DOCUMENTABLE
INDEXED_KINDS = ("module", "class", "interface", "enum", "function", "method")
STATUSES = ("ok", "warn", "critical")


def qualname(node_id: Column) -> Column:
    """An id without its subproject."""
    return F.when(node_id.contains("/"), F.regexp_replace(node_id, "(?s)^[^/]*/", "")).otherwise(node_id)


def parent_id(node_id: Column) -> Column:
    """An id without its last dotted part; null where there is none."""
    return F.when(node_id.contains("."), F.regexp_extract(node_id, r"(?s)^(.*)\.[^.]*$", 1))


def package_of(name: Column) -> Column:
    """A module's package: its qualname without the last part, or itself."""
    return F.coalesce(parent_id(name), name)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def diagram_type(text: Column) -> Column:
    """A type as class diagrams can show it: without a default, brackets as tildes, bars as strokes."""
    return F.replace(F.translate(F.btrim(F.substring_index(text, "=", 1)), "[]", "~~"), F.lit("|"), F.lit(" / "))


def diagram_member(kind: Column, name: Column, signature: Column, visibility: Column) -> Column:
    """A member's line in a class diagram: an attribute with its type, or a method with its parameters' names and its result."""
    halves = F.split(F.coalesce(signature, F.lit("")), " -> ", 2)
    left, result = F.get(halves, F.lit(0)), F.nullif(F.get(halves, F.lit(1)), F.lit(""))
    given = F.transform(F.split(F.btrim(left, F.lit("()")), ","), lambda p: F.btrim(F.substring_index(p, ":", 1)))
    method = F.concat(F.lit("("), F.array_join(F.filter(given, lambda p: ~p.isin("", "*", "/")), ", "), F.lit(")"))
    shown = F.when(kind == "attribute", F.coalesce(F.concat(F.lit(": "), diagram_type(F.nullif(signature, F.lit("")))), F.lit("")))
    shown = shown.otherwise(F.concat(method, F.coalesce(F.concat(F.lit(" "), diagram_type(result)), F.lit(""))))
    return F.concat(F.lit("        "), F.when(visibility == "private", "-").otherwise("+"), name, shown)


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def python_visibility(name: Column) -> Column:
    return F.when(name.startswith("_") & ~is_dunder(name), "private").otherwise("public")


def package_id(module_id: Column) -> Column:
    """``pkg:<subproject>/<package>`` of a module id."""
    sub = F.when(module_id.contains("/"), F.substring_index(module_id, "/", 1)).otherwise("")
    return F.concat(F.lit("pkg:"), sub, F.lit("/"), package_of(qualname(module_id)))


def layer_of(package: Column) -> Column:
    """Struct (name, level) of the last part of a package that names a layer; null if none does."""
    table = F.create_map(
        *[x for (name, level), words in LAYERS.items() for w in words for x in (F.lit(w), F.struct(F.lit(name).alias("name"), F.lit(level).alias("level")))]
    )
    known = F.filter(F.split(package, r"\."), lambda w: F.map_contains_key(table, w))
    return F.when(F.size(known) > 0, F.element_at(table, F.element_at(known, -1)))


def complexity_status(value: Column, warn: int, critical: int) -> Column:
    return F.when(value > critical, "critical").when(value > warn, "warn").otherwise("ok")


def worst_status(*statuses: Column) -> Column:
    order = F.array(*[F.lit(s) for s in STATUSES])
    return F.element_at(order, F.greatest(*[F.array_position(order, s) for s in statuses]).cast("int"))


def is_documentable(name: Column, kind: Column, visibility: Column) -> Column:
    return ~is_dunder(name) & (visibility == "public") & kind.isin(*DOCUMENTABLE)


def rounded_percent(part: Column, whole: Column, empty: int = 100) -> Column:
    """100 * part / whole, half to even; ``empty`` where whole is 0."""
    return F.when(whole > 0, F.bround(100 * part / whole).cast("long")).otherwise(F.lit(empty).cast("long"))


def rounded_mean(value: Column) -> Column:
    """The mean of a group, half to even; 0 for none."""
    return F.coalesce(F.bround(F.avg(value)).cast("long"), F.lit(0).cast("long"))


def anchor(name: Column) -> Column:
    return F.lower(name)


def natural_key(label: Column) -> Column:
    """An array by which v10 comes after v2: runs of digits are padded."""
    parts = F.regexp_extract_all(label, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x))


def pair_text(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit(" → "), right)


def page_slug(node_id: Column, several: Column) -> Column:
    """Page name: the subproject stands before only if there are several."""
    return F.when(several, F.regexp_replace(node_id, "/", ".")).otherwise(qualname(node_id))


def display_name(node_id: Column, several: Column) -> Column:
    return F.when(several, node_id).otherwise(qualname(node_id))


def returned_class(signature: Column) -> Column:
    """The name after `` -> ``, without quotes, before ``[`` or a space; null if there is none."""
    tail = F.when(signature.contains(" -> "), F.regexp_replace(signature, "(?s)^.*? -> ", "")).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(F.trim(tail), '^"+|"+$', ""), "^'+|'+$", "")
    name = F.regexp_extract(bare, r"^([^\[ ]*)", 1)
    return F.when(name != "", name)


def search_rank(name: Column, full: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 part of the name, 3 part of the qualname; null if it does not match."""
    low, q = F.lower(name), query.lower()
    return (
        F.when(name == query, 0)
        .when(low.startswith(q), 1)
        .when(low.contains(q), 2)
        .when(F.lower(full).contains(q), 3)
    )
