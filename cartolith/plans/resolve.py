"""From raw facts to nodes and edges: names are resolved by joins within a subproject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import names as N

from .graph import first_edges
from .lineage import cut


def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact").isin(*kinds))


def _id(sub: Column | str, name: Column) -> Column:
    return F.concat(F.col(sub) if isinstance(sub, str) else sub, F.lit("/"), name)


def nodes_of(facts: DataFrame, visibility: Column) -> DataFrame:
    """Nodes of modules, classes, functions and attributes; the first of an id stays."""
    place = F.struct(F.col("path").alias("file"), F.col("line").alias("line")).alias("location")
    first_line = F.regexp_extract(F.col("doc"), r"(?s)^\s*([^\n\r]*)", 1)
    form = F.coalesce("doc_format", F.lit("docstring"))
    doc = F.when(F.coalesce("doc", F.lit("")) != "", F.struct(F.col("doc").alias("raw"), F.trim(first_line).alias("summary"), form.alias("format")))
    is_method = F.col("fact") == "function"
    kind = (
        F.when(F.col("fact") == "module", "module").when(F.col("fact") == "class", F.col("text"))
        .when(is_method & F.col("flag"), "method").when(is_method, "function").otherwise("attribute")
    )
    name = F.when(F.col("fact") == "module", F.col("module")).otherwise(F.concat("owner", F.lit("."), "name"))
    attribute = F.col("fact").isin("field", "self")
    rank = F.when(F.col("fact") == "field", 1).when(F.col("fact") == "self", 2).otherwise(0)
    rows = _of(facts, "module", "class", "function", "field", "self").where((F.col("fact") != "self") | F.col("flag") | F.col("text").isNull())
    made = rows.select(
        _id("sub", name).alias("id"), kind.alias("kind"), "name", F.col("sub").alias("subproject"), place,
        F.when(F.col("fact") == "module", "public").otherwise(visibility).alias("visibility"),
        F.when(is_method | attribute, F.coalesce("text", F.lit(""))).otherwise("").alias("signature"),
        F.when(~attribute, doc).alias("doc"), F.array_sort(F.coalesce("modifiers", F.array().cast("array<string>"))).alias("modifiers"),
        F.when(is_method, F.col("number")).alias("complexity"), F.coalesce("loc", F.lit(0)).alias("loc"), rank.alias("_rank"), "ord",
    )
    first = Window.partitionBy("id").orderBy("location.line", "_rank", "ord")
    return made.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank", "ord")


def _edge(rows: DataFrame, source: Column, target: Column, kind: Column | str, certainty: str = "certain", line: Column | str = "line") -> DataFrame:
    return rows.select(
        _id("sub", source).alias("source"), _id("sub", target).alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.lit(certainty).alias("certainty"), F.struct(F.col("path").alias("file"), (F.col(line) if isinstance(line, str) else line).cast("int").alias("line")).alias("location"),
    )


def skipped_of(facts: DataFrame) -> DataFrame:
    return _of(facts, "skip").select("path", F.col("text").alias("reason"))


class PythonResolver:
    """Resolution of Python facts. Registries are small columns of what the subproject defines."""

    def __init__(self, facts: DataFrame) -> None:
        self.facts = cut(facts)
        f = self.facts
        full = F.concat("owner", F.lit("."), "name")
        self.modules = _of(f, "module").select("sub", F.col("module").alias("q")).distinct()
        self.classes = _of(f, "class").select("sub", full.alias("q")).distinct()
        self.functions = _of(f, "function").select("sub", full.alias("q")).distinct()
        self.imports = self._imports()
        self.bindings = cut(
            self.imports.where("bound is not null").groupBy("sub", "module", "alias").agg(F.max_by("bound", "ord").alias("bound"))
        )
        self.tokens = cut(self._tokens())

    def _imports(self) -> DataFrame:
        rows = _of(self.facts, "import").select("sub", "module", "path", "line", "ord", F.col("token").alias("base"), "name", F.col("text").alias("alias"))
        rows = rows.withColumn("inner", F.concat("base", F.lit("."), "name"))
        known = self.modules.withColumn("k", F.lit(True))
        rows = rows.join(known.withColumnsRenamed({"q": "inner", "k": "inner_known"}), ["sub", "inner"], "left")
        rows = rows.join(known.withColumnsRenamed({"q": "base", "k": "base_known"}), ["sub", "base"], "left")
        target = F.when(F.col("inner_known"), F.col("inner")).when(F.col("base_known"), F.col("base"))
        bound = F.when(F.col("inner_known").isNull() & F.col("base_known") & F.col("name").isNotNull(), F.col("inner"))
        return rows.withColumns({"target": target, "bound": bound})

    def _tokens(self) -> DataFrame:
        """(sub, module, token, class) for each token that names a class of the subproject."""
        used = self.facts.select("sub", "module", "token").where("token like 'N:%' or token like 'A:%'")
        roots = _of(self.facts, "call").where("token like 'c:%'").select("sub", "module", F.substring("token", 3, 1 << 20).alias("token"))
        lists = self.facts.where("names is not null").select("sub", "module", F.explode("names").alias("token"))
        tokens = used.unionByName(roots).unionByName(lists).distinct().withColumn("t", F.substring("token", 3, 1 << 20))
        simple = F.col("token").startswith("N:")
        tokens = tokens.withColumn("here", F.when(simple, F.concat("module", F.lit("."), "t")).otherwise(F.col("t")))
        tokens = tokens.join(self.classes.select("sub", F.col("q").alias("here"), F.col("q").alias("own")), ["sub", "here"], "left")
        bound = self.bindings.withColumnRenamed("alias", "t").join(self.classes.withColumnRenamed("q", "bound"), ["sub", "bound"], "left_semi")
        tokens = tokens.join(bound, ["sub", "module", "t"], "left")
        found = F.coalesce("own", F.when(simple, F.col("bound")))
        return tokens.select("sub", "module", "token", found.alias("class")).where("class is not null")

    def classes_named(self, rows: DataFrame) -> DataFrame:
        """A row for each class that ``names`` names, with its place ``pos``."""
        return rows.select("*", F.posexplode("names").alias("pos", "_t")).drop("token").withColumnRenamed("_t", "token").join(self.tokens, ["sub", "module", "token"])

    def first_named(self, rows: DataFrame, *keys: str) -> DataFrame:
        return self.classes_named(rows).groupBy("sub", *keys).agg(F.min_by("class", "pos").alias("class"))

    def attribute_types(self) -> DataFrame:
        """(sub, owner, name, class): declared types of attributes; those set in the constructor come first."""
        f = self.facts
        fields = self.classes_named(_of(f, "field")).groupBy("sub", "owner", "name", "ord").agg(F.min_by("class", "pos").alias("class"))
        fields = fields.groupBy("sub", "owner", "name").agg(F.min_by("class", "ord").alias("class")).withColumn("level", F.lit(1))
        own = _of(f, "self")
        noted = self.first_named(own.where("names is not null"), "owner", "name", "ord").withColumn("how", F.lit(0))
        made = own.where("token is not null").join(self.tokens, ["sub", "module", "token"]).select("sub", "owner", "name", "ord", "class", F.lit(1).alias("how"))
        params = self.param_types().select("sub", F.col("scope").alias("doc"), F.col("name").alias("p"), "class")
        given = own.where("attrs is not null").withColumn("p", F.col("attrs")[0]).join(params, ["sub", "doc", "p"]).select("sub", "owner", "name", "ord", "class", F.lit(2).alias("how"))
        init = noted.unionByName(made).unionByName(given).groupBy("sub", "owner", "name").agg(F.min(F.struct("ord", "how", "class"))["class"].alias("class")).withColumn("level", F.lit(0))
        return init.unionByName(fields).groupBy("sub", "owner", "name").agg(F.min_by("class", "level").alias("class"))

    def param_types(self) -> DataFrame:
        rows = self.first_named(_of(self.facts, "param").withColumnRenamed("owner", "scope"), "scope", "name")
        return rows.select("sub", "scope", "name", "class")

    def variable_types(self) -> DataFrame:
        """(sub, scope, name, class): local variables before parameters."""
        local = self.classes_named(_of(self.facts, "local")).groupBy("sub", "owner", "name", "ord").agg(F.min_by("class", "pos").alias("class"))
        local = local.groupBy("sub", F.col("owner").alias("scope"), "name").agg(F.max_by("class", "ord").alias("class")).withColumn("level", F.lit(0))
        both = local.unionByName(self.param_types().withColumn("level", F.lit(1)))
        return both.groupBy("sub", "scope", "name").agg(F.min_by("class", "level").alias("class"))

    def module_variables(self) -> DataFrame:
        rows = self.classes_named(_of(self.facts, "modvar"))
        return rows.groupBy("sub", "module", "name").agg(F.max_by("class", "ord").alias("class"))

    def calls(self) -> DataFrame:
        calls = _of(self.facts, "call").select("sub", "module", "path", F.col("owner").alias("scope"), "line", "text", "name", "token", "attrs")
        calls = calls.withColumn("source", F.regexp_replace("scope", "@[0-9]+$", ""))
        known = self.functions.select("sub", F.col("q").alias("target"))
        named = calls.where("text = 'name'")
        bound = self.bindings.withColumnRenamed("alias", "name")
        made = self.tokens.withColumn("new", F.concat("class", F.lit(".__init__"))).select("sub", "module", "token", "new")
        # each name takes its own best target: a function here, an imported one, then a constructor
        per_name = named.join(bound, ["sub", "module", "name"], "left").join(made, ["sub", "module", "token"], "left").select(
            "sub", "path", "source", "line", "name", F.posexplode(F.array(F.concat("module", F.lit("."), "name"), F.col("bound"), F.col("new"))).alias("level", "target")
        ).where("target is not null").join(known, ["sub", "target"], "left_semi")
        best = per_name.groupBy("sub", "path", "source", "line", "name").agg(F.min(F.struct("level", "target"))["target"].alias("target"))
        by_name = best.select("sub", "path", "source", "line", "target", F.lit("certain").alias("certainty"))

        rest = calls.where("text <> 'name'").withColumn("root", F.substring("token", 3, 1 << 20))
        form = F.substring("token", 1, 2)
        variables = self.variable_types().select("sub", "scope", F.col("name").alias("root"), F.col("class").alias("v"))
        globals_ = self.module_variables().select("sub", "module", F.col("name").alias("root"), F.col("class").alias("g"))
        made_by = self.tokens.select("sub", "module", F.col("token").alias("root"), F.col("class").alias("c"))
        rest = rest.join(variables, ["sub", "scope", "root"], "left").join(globals_, ["sub", "module", "root"], "left").join(made_by, ["sub", "module", "root"], "left")
        owner = F.when(form == "t:", F.col("root")).when(form == "c:", F.col("c")).otherwise(F.coalesce("v", "g"))
        typed = rest.withColumns({"owner": owner, "attrs": F.coalesce("attrs", F.array().cast("array<string>"))}).where("owner is not null")
        hops = typed.agg(F.max(F.size("attrs")).alias("n")).first()["n"] or 0  # one number
        types = self.attribute_types().select("sub", "owner", F.col("name").alias("_attr"), F.col("class").alias("_next"))
        for k in range(hops):
            more = F.size("attrs") > k
            typed = typed.withColumn("_attr", F.when(more, F.get("attrs", F.lit(k)))).join(types, ["sub", "owner", "_attr"], "left")
            typed = typed.withColumn("owner", F.when(more, F.col("_next")).otherwise(F.col("owner"))).drop("_attr", "_next").where("owner is not null")
        members = typed.withColumn("target", F.concat("owner", F.lit("."), "name")).join(known, ["sub", "target"], "left_semi")
        by_type = members.select("sub", "path", "source", "line", "target", F.when(F.col("text") == "getattr", "inferred").otherwise("certain").alias("certainty"))
        return by_name.unionByName(by_type).distinct()

    def edges(self) -> DataFrame:
        f = self.facts
        full = F.col("owner")
        imports = _edge(self.imports.where("target is not null"), F.col("module"), F.col("target"), "imports")
        links = _of(f, "link").join(self.tokens, ["sub", "module", "token"])
        inherits = _edge(links, full, F.col("class"), F.col("text"))
        own = _of(f, "self").where("flag")
        noted = _edge(self.classes_named(_of(f, "field").unionByName(own.where("names is not null"))), full, F.col("class"), "associates")
        composed = _edge(own.where("token is not null").join(self.tokens, ["sub", "module", "token"]), full, F.col("class"), "composes")
        params = self.classes_named(_of(f, "param")).select("sub", F.col("owner").alias("doc"), F.col("name").alias("p"), "class").distinct()
        given = own.where("attrs is not null and token is null").withColumn("p", F.col("attrs")[0]).join(params, ["sub", "doc", "p"])
        aggregated = _edge(given, full, F.col("class"), "aggregates")
        calls = self.calls()
        called = calls.select(
            _id("sub", F.col("source")).alias("source"), _id("sub", F.col("target")).alias("target"), F.lit("calls").alias("kind"), "certainty",
            F.struct(F.col("path").alias("file"), "line").alias("location"),
        )
        out = imports
        for part in (inherits, noted, composed, aggregated, called):
            out = out.unionByName(part)
        return first_edges(out)

    def nodes(self) -> DataFrame:
        return nodes_of(self.facts, N.python_visibility(F.col("name")))


class ScriptResolver(PythonResolver):
    """JavaScript and TypeScript: relative imports by file stem; constructors, functions and ``this`` calls."""

    def _imports(self) -> DataFrame:
        rows = _of(self.facts, "import").select("sub", "module", "path", "line", "ord", F.col("token").alias("stem"), "name", F.col("text").alias("alias"))
        stems = _of(self.facts, "module").select("sub", F.col("text").alias("stem"), F.col("module").alias("target"))
        rows = rows.join(stems, ["sub", "stem"], "left")
        return rows.withColumn("bound", F.when(F.col("name").isNotNull(), F.concat("target", F.lit("."), "name"))).withColumn(
            "target", F.when(F.col("target") != F.col("module"), F.col("target"))
        )

    def calls(self) -> DataFrame:
        calls = _of(self.facts, "call").select("sub", "module", "path", F.regexp_replace("owner", "@[0-9]+$", "").alias("source"), "line", "text", "name", "token")
        known = self.functions.select("sub", F.col("q").alias("target"))
        bound = self.bindings.withColumnRenamed("alias", "name")
        rows = calls.join(bound, ["sub", "module", "name"], "left").join(self.tokens, ["sub", "module", "token"], "left")
        options = (
            F.when(F.col("text") == "new", F.array(F.concat("class", F.lit(".constructor"))))
            .when(F.col("text") == "this", F.array(F.concat(F.substring("token", 3, 1 << 20), F.lit("."), F.col("name"))))
            .otherwise(F.array(F.concat("module", F.lit("."), "name"), F.col("bound")))
        )
        found = rows.select("sub", "path", "source", "line", "text", "name", F.posexplode(options).alias("level", "target")).where("target is not null")
        best = found.join(known, ["sub", "target"], "left_semi").groupBy("sub", "path", "source", "line", "text", "name").agg(F.min_by("target", "level").alias("target"))
        return best.select("sub", "path", "source", "line", "target", F.lit("certain").alias("certainty")).distinct()

    def edges(self) -> DataFrame:
        imports = _edge(self.imports.where("target is not null"), F.col("module"), F.col("target"), "imports", line=F.lit(1))
        links = _of(self.facts, "link").join(self.tokens, ["sub", "module", "token"])
        calls = _edge(self.calls(), F.col("source"), F.col("target"), "calls")
        return first_edges(imports.unionByName(_edge(links, F.col("owner"), F.col("class"), F.col("text"))).unionByName(calls))

    def nodes(self) -> DataFrame:
        private = F.when(F.col("fact") == "function", F.col("ord") == 1).when(F.col("fact") == "field", F.col("flag")).otherwise(F.col("name").startswith("_"))
        return nodes_of(self.facts, F.when(private, "private").otherwise("public"))


class JavaResolver(PythonResolver):
    """Java: types by explicit import, then by package; methods up the superclasses."""

    #: Fixed value: superclasses searched for a method.
    HOPS = 8

    def __init__(self, facts: DataFrame) -> None:
        packages = _of(facts, "module").select("sub", "path", F.col("text").alias("package"))
        self.packages = packages
        self.types = _of(facts, "class").join(packages, ["sub", "path"]).select(
            "sub", "package", "name", F.concat("owner", F.lit("."), "name").alias("class"), F.col("owner").alias("in_module"), F.col("text").alias("type_kind")
        )
        super().__init__(facts)

    def _imports(self) -> DataFrame:
        rows = _of(self.facts, "import").select("sub", "module", "path", "line", "ord", "token", F.col("text").alias("alias"))
        named = self.types.select("sub", F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "name").alias("token"), F.col("class").alias("bound"), F.col("in_module").alias("target"))
        rows = rows.join(named, ["sub", "token"], "left")
        return rows.withColumn("target", F.when(F.col("target") != F.col("module"), F.col("target")))

    def _tokens(self) -> DataFrame:
        used = self.facts.where("token like 'N:%'").select("sub", "path", "module", "token")
        lists = self.facts.where("names is not null and fact not in ('class', 'import')").select("sub", "path", "module", F.explode("names").alias("token"))
        tokens = used.unionByName(lists).distinct().withColumn("name", F.substring("token", 3, 1 << 20)).join(self.packages, ["sub", "path"])
        bound = self.bindings.withColumnRenamed("alias", "name")
        same = self.types.select("sub", "package", "name", F.col("class").alias("own"))
        found = tokens.join(bound, ["sub", "module", "name"], "left").join(same, ["sub", "package", "name"], "left")
        return found.select("sub", "module", "token", F.coalesce("bound", "own").alias("class")).where("class is not null").distinct()

    def inherited(self) -> DataFrame:
        """(sub, class, method, owner): the class up the chain that declares a method."""
        methods = _of(self.facts, "function").select("sub", F.col("owner").alias("up"), F.col("name").alias("method")).distinct()
        ups = _of(self.facts, "link").where("text = 'inherits'").join(self.tokens, ["sub", "module", "token"])
        ups = cut(ups.groupBy("sub", F.col("owner").alias("up")).agg(F.min("class").alias("next")))
        reach = _of(self.facts, "class").select("sub", F.concat("owner", F.lit("."), "name").alias("class")).distinct().withColumns({"up": F.col("class"), "depth": F.lit(0)})
        found = None
        for k in range(self.HOPS + 1):
            level = reach.join(methods, ["sub", "up"]).select("sub", "class", "method", F.col("up").alias("owner"), "depth")
            found = level if found is None else found.unionByName(level)
            reach = reach.join(ups, ["sub", "up"]).select("sub", "class", F.col("next").alias("up"), F.lit(k + 1).alias("depth"))
            reach = cut(reach)
            if reach.isEmpty():
                break
        return found.groupBy("sub", "class", "method").agg(F.min_by("owner", "depth").alias("owner"))

    def calls(self) -> DataFrame:
        calls = _of(self.facts, "call").select(
            "sub", "module", "path", F.col("owner").alias("scope"), "line", "text", "name", "token", F.col("attrs")[0].alias("cls"), F.substring("token", 3, 1 << 20).alias("root")
        )
        variables = self.variable_types().select("sub", "scope", F.col("name").alias("root"), F.col("class").alias("v"))
        fields = self.classes_named(_of(self.facts, "field")).select("sub", F.col("owner").alias("cls"), F.col("name").alias("root"), F.col("class").alias("f")).distinct()
        supers = _of(self.facts, "link").where("text = 'inherits'").join(self.tokens, ["sub", "module", "token"]).groupBy("sub", F.col("owner").alias("cls")).agg(F.min("class").alias("s"))
        made = self.tokens.select("sub", "module", "token", F.col("class").alias("n"))
        rows = calls.join(variables, ["sub", "scope", "root"], "left").join(fields, ["sub", "cls", "root"], "left").join(supers, ["sub", "cls"], "left").join(made, ["sub", "module", "token"], "left")
        owner = (
            F.when(F.col("text") == "new", F.col("n")).when(F.col("text") == "this", F.col("cls")).when(F.col("text") == "super", F.col("s"))
            .when(F.col("text") == "field", F.col("f")).otherwise(F.coalesce("v", "f"))
        )
        rows = rows.withColumn("class", owner).withColumnRenamed("name", "method").where("class is not null")
        known = self.inherited()
        declared = rows.join(known, ["sub", "class", "method"])
        declared = declared.where((F.col("text") != "new") | (F.col("owner") == F.col("class")))
        source = F.regexp_replace("scope", "@[0-9]+$", "")
        return declared.select("sub", "path", source.alias("source"), "line", F.concat("owner", F.lit("."), "method").alias("target"), F.lit("certain").alias("certainty")).distinct()

    def edges(self) -> DataFrame:
        imports = _edge(self.imports.where("target is not null"), F.col("module"), F.col("target"), "imports", line=F.lit(1))
        kinds = self.types.select("sub", "class", "type_kind")
        own = self.types.select("sub", F.col("class").alias("owner"), F.col("type_kind").alias("own_kind"))
        links = _of(self.facts, "link").join(self.tokens, ["sub", "module", "token"]).join(kinds, ["sub", "class"]).join(own, ["sub", "owner"])
        kind = F.when((F.col("type_kind") == "interface") & (F.col("text") == "inherits"), "implements").otherwise(F.col("text"))
        calls = _edge(self.calls(), F.col("source"), F.col("target"), "calls")
        return first_edges(imports.unionByName(_edge(links, F.col("owner"), F.col("class"), kind)).unionByName(calls))

    def nodes(self) -> DataFrame:
        private = F.when(F.col("fact").isin("function", "class"), F.col("ord") == 1).when(F.col("fact") == "field", F.col("flag")).otherwise(F.lit(False))
        return nodes_of(self.facts, F.when(private, "private").otherwise("public"))
