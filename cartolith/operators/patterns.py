"""Design patterns by the structure of classes: at most one a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

#: Names that tell of a pattern's parts.
FACTORY = "^(create|build|make)(_|[A-Z]|$)"
SUBSCRIBE = ("subscribe", "attach", "register_observer", "add_listener", "add_observer")
NOTIFY = ("notify", "publish", "emit", "dispatch")
REGISTRIES = ("observers", "listeners", "subscribers", "handlers")
ACCESSORS = ("instance", "get_instance", "getinstance", "shared")
INSTANCES = ("_instance", "_INSTANCE")
#: The earlier one wins.
PRECEDENCE = ("singleton", "observer", "decorator", "adapter", "factory")


def _first(kind: str, names: tuple[str, ...]):
    """Name of the first member, by id, of a kind with one of some names (in lower case)."""
    hit = (F.col("kind") == kind) & F.lower("name").isin(*names)
    return F.min(F.when(hit, F.struct("id", "name")))["name"]


def _classes(graph: Graph) -> DataFrame:
    return graph.nodes_of("class").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))


def _members(graph: Graph) -> DataFrame:
    members = graph.nodes_of("method", "attribute").select(F.col("parent_id").alias("class_id"), "id", "kind", "name", "signature")
    return _classes(graph).join(members, "class_id")


def _row(pattern: str, confidence, *evidence):
    return ["class_id", F.lit(pattern).alias("pattern"), F.array(*evidence).alias("evidence"), confidence.alias("confidence")]



def singleton(graph: Graph) -> DataFrame:
    """An instance attribute and an accessor."""
    has = F.max((F.col("kind") == "attribute") & F.col("name").isin(*INSTANCES)).alias("has")
    found = _members(graph).groupBy("class_id").agg(has, _first("method", ACCESSORS).alias("accessor")).where("has and accessor is not null")
    return found.select(
        *_row("singleton", F.lit("high"), F.lit("attribut de classe `_instance`"), F.concat(F.lit("méthode d'accès `"), "accessor", F.lit("`")))
    )


def observer(graph: Graph) -> DataFrame:
    """A method to subscribe, one to notify, and a registry."""
    found = (
        _members(graph)
        .groupBy("class_id")
        .agg(_first("method", SUBSCRIBE).alias("s"), _first("method", NOTIFY).alias("n"), _first("attribute", REGISTRIES).alias("r"))
        .where("s is not null and n is not null and r is not null")
    )
    text = lambda head, c: F.concat(F.lit(head + " `"), c, F.lit("`"))
    return found.select(
        *_row("observer", F.lit("high"), text("méthode d'abonnement", "s"), text("méthode de diffusion", "n"), text("registre d'abonnés", "r"))
    )


def _links(graph: Graph, *kinds: str) -> DataFrame:
    return graph.edges_of(*kinds).select(F.col("source").alias("class_id"), "target").distinct()


def decorator(graph: Graph) -> DataFrame:
    """It inherits from what it holds."""
    both = _links(graph, "inherits", "implements").join(_links(graph, "composes", "aggregates"), ["class_id", "target"])
    found = both.join(_classes(graph), "class_id").groupBy("class_id").agg(F.min("target").alias("target"))
    name = N.last_part(F.col("target"))
    return found.select(
        *_row("decorator", F.lit("high"), F.concat(F.lit("hérite de `"), name, F.lit("`")), F.concat(F.lit("enveloppe une instance de `"), name, F.lit("`")))
    )


def adapter(graph: Graph) -> DataFrame:
    """It implements an interface and calls into a class that it holds and does not inherit from."""
    inherits = _links(graph, "inherits", "implements")
    interfaces = graph.nodes_of("interface").select(F.col("id").alias("target"))
    # edges come in order of target, then kind
    port = inherits.join(interfaces, "target", "left_semi").groupBy("class_id").agg(F.min("target").alias("port"))
    held = _links(graph, "composes", "aggregates").join(inherits, ["class_id", "target"], "left_anti")
    calls = graph.edges_of("calls").select(N.parent_id(F.col("source")).alias("class_id"), F.col("target").alias("callee"))
    # a call goes to a member of the held class, or to a member of its members
    up = calls.select("class_id", F.explode(_dotted_prefixes(F.col("callee"))).alias("target")).distinct()
    client = held.join(up, ["class_id", "target"], "left_semi").groupBy("class_id").agg(F.min("target").alias("client"))
    found = port.join(client, "class_id").join(_classes(graph), "class_id")
    return found.select(
        *_row("adapter", F.lit("high"), F.concat(F.lit("implémente l'interface `"), N.last_part(F.col("port")), F.lit("`")),
              F.concat(F.lit("délègue à `"), N.last_part(F.col("client")), F.lit("`")))
    )


def _dotted_prefixes(name):
    """All proper prefixes of a dotted name."""
    parts = F.split(name, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def factory(graph: Graph) -> DataFrame:
    """A method by a maker's name that returns a class of the graph."""
    known = graph.nodes_of("class", "interface").groupBy(F.col("name").alias("returned")).agg(F.min("id").alias("produced"))
    makers = _members(graph).where((F.col("kind") == "method") & F.col("name").rlike(FACTORY))
    made = makers.withColumn("returned", N.returned_class(F.col("signature"))).join(known, "returned")
    found = made.groupBy("class_id", "class_name").agg(F.min(F.struct("name", "produced")).alias("m"))
    evidence = F.concat(F.lit("méthode `"), F.col("m.name"), F.lit("` retourne `"), N.last_part(F.col("m.produced")), F.lit("`"))
    return found.select(*_row("factory", F.when(F.col("class_name").endswith("Factory"), "high").otherwise("medium"), evidence))


DETECTORS = {"singleton": singleton, "observer": observer, "decorator": decorator, "adapter": adapter, "factory": factory}


def patterns(graph: Graph) -> DataFrame:
    """(pattern, class_id, evidence, confidence): the pattern of each class that takes precedence."""
    out = None
    for k, name in enumerate(PRECEDENCE):
        found = DETECTORS[name](graph).withColumn("place", F.lit(k))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("class_id").agg(F.min(F.struct("place", "pattern", "evidence", "confidence")).alias("b"))
    return best.select("b.pattern", "class_id", "b.evidence", "b.confidence")
