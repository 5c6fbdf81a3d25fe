"""Calls through types: what a method call means, from the types of its receiver and the methods that they inherit.

Everything is joins over staging rows (see sources/extract.py). Type names become types by scope; supertypes are closed by pointer
doubling, so a hierarchy of depth d takes log2(d) rounds; the definer of a called method is a least priority over an equality join of
(type, ancestor) with (ancestor, method). Calls on results of other calls are resolved by their place in the chain: one round for each
place, each call in one round only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import scalars
from archgraph.sources.shared import dropped, written

#: A type's members may not be named by what stands in angle or square brackets.
BRACKETS = r"<.*|\[\]"
SCOPE = ("path", "package_name", "owner", "named")


def bare(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, BRACKETS, ""))


def types_of(rows: DataFrame) -> DataFrame:
    """(type_id, path, package_name, owner, name, form, extends_class, interfaces, annotations, place) of the type rows; of equal ids the first."""
    found = rows.filter("kind = 'type'").select(
        scalars.qualified("package_name", "name").alias("type_id"), F.struct("path", "ord").alias("place"), "path", "package_name", "owner", "name", F.col("declared").alias("form"), "extends_class", "interfaces", "annotations"
    )
    rest = [c for c in found.columns if c not in ("type_id", "place")]
    return found.groupBy("type_id").agg(F.min(F.struct("place", *rest)).alias("v")).select("type_id", "v.*")


def named_types(scopes: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """`scopes` (path, package_name, owner, named; each once) with the type that a name means there, where there is one.

    In this order: a type nested in one of those around, an import, the same package, an import of a whole package, the name as it
    stands, the first type of that simple name.
    """
    single = imports.filter("name <> '*'").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "declared"))).alias("single"))
    wide = imports.filter("name = '*'").groupBy("path").agg(F.sort_array(F.collect_set("declared")).alias("wide"))
    head, rest = F.substring_index("n", ".", 1), F.regexp_replace("n", r"^\w+", "")
    dotted = lambda package, name: F.when(F.coalesce(package, F.lit("")) == "", name).otherwise(F.concat(package, F.lit("."), name))
    around = F.filter(F.split(F.coalesce("owner", F.lit("")), r"\."), lambda x: x != "")
    chains = F.transform(F.when(F.size(around) > 0, F.sequence(F.size(around), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(around, F.lit(1), k), "."))
    keys = F.concat(
        F.transform(chains, lambda c: dotted(F.col("package_name"), F.concat(c, F.lit("."), F.col("n")))),
        F.array(F.concat(F.try_element_at("single", head), rest), dotted(F.col("package_name"), F.col("n"))),
        F.transform(F.coalesce("wide", F.array().cast("array<string>")), lambda p: F.concat(p, F.lit("."), F.col("n"))),
        F.array(F.col("n")),
    )
    asked = scopes.withColumn("n", bare(F.col("named"))).join(single, "path", "left").join(wide, "path", "left")
    tried = asked.select(*SCOPE, F.posexplode(keys).alias("priority", "type_id")).filter("type_id IS NOT NULL")
    direct = tried.join(types.select("type_id"), "type_id").select(*SCOPE, "priority", "type_id")
    first = types.groupBy(F.substring_index("name", ".", -1).alias("simple")).agg(F.min_by("type_id", "place").alias("type_id"))
    loose = scopes.withColumn("simple", F.substring_index(bare(F.col("named")), ".", -1)).join(first, "simple").select(*SCOPE, F.lit(1 << 20).alias("priority"), "type_id")
    return direct.unionByName(loose).groupBy(*SCOPE).agg(F.min(F.struct("priority", "type_id")).alias("v")).select(*SCOPE, "v.type_id")


def typed(rows: DataFrame, name: str, types: DataFrame, imports: DataFrame, output: str) -> DataFrame:
    """Rows with what the type name in a column means in their scope (path, package_name, owner), or null."""
    scopes = rows.filter(F.col(name).isNotNull()).select("path", "package_name", "owner", F.col(name).alias("named")).distinct()
    means = named_types(scopes, types, imports).select(*[F.col(c).alias(f"__{c}") for c in SCOPE], F.col("type_id").alias(output))
    # The path holds the package; an owner that is null is a scope like any other.
    same = (F.col("path") == F.col("__path")) & (F.col(name) == F.col("__named")) & F.col("owner").eqNullSafe(F.col("__owner")) & F.col("package_name").eqNullSafe(F.col("__package_name"))
    return rows.join(means, same, "left").select(*[F.col(c) for c in rows.columns], output)


def supertypes(types: DataFrame, imports: DataFrame) -> DataFrame:
    """(sub, super, rank): direct supertypes inside the project; the superclass before the interfaces, these in their order."""
    listed = F.concat(F.array(F.col("extends_class")), F.when(F.col("form") == "interface", F.array().cast("array<string>")).otherwise(F.coalesce("interfaces", F.array().cast("array<string>"))))
    several = F.when(F.col("form") == "interface", F.split(F.regexp_replace(F.coalesce("extends_class", F.lit("")), r"<[^<>]*(<[^<>]*>[^<>]*)*>", ""), ",")).otherwise(listed)
    named = types.select("type_id", "path", "package_name", "owner", F.posexplode(several).alias("rank", "parent")).filter("trim(parent) <> ''").withColumn("parent", F.trim("parent"))
    found = typed(named, "parent", types, imports, "super")
    return found.filter("super IS NOT NULL AND super <> type_id").groupBy(F.col("type_id").alias("sub"), "super").agg(F.min("rank").alias("rank"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(sub, super, distance, way): all supertypes of each type with the least distance, and of equal distances the least way by ranks.

    Pointer doubling: after round k all distances up to 2^k are exact; a round without a new pair is the last. Circles end like any others.
    """
    best = lambda df: df.groupBy("sub", "super").agg(F.min(F.struct("distance", "way")).alias("v")).select("sub", "super", "v.*")
    known = written(best(edges.select("sub", "super", F.lit(1).alias("distance"), F.array("rank").alias("way"))), "ancestors")
    many = known.count()
    while True:
        onward = known.select(F.col("sub").alias("super"), F.col("super").alias("next"), F.col("distance").alias("d"), F.col("way").alias("w"))
        further = known.join(onward, "super").filter("next <> sub").select("sub", F.col("next").alias("super"), (F.col("distance") + F.col("d")).alias("distance"), F.concat("way", "w").alias("way"))
        grown = written(best(known.unionByName(further)), "ancestors")
        now = grown.count()
        dropped(known)
        if now == many:
            return grown
        known, many = grown, now


def with_self(types: DataFrame, closed: DataFrame) -> DataFrame:
    return closed.unionByName(types.select(F.col("type_id").alias("sub"), F.col("type_id").alias("super"), F.lit(0).alias("distance"), F.array().cast("array<int>").alias("way")))


class Hierarchy:
    """The types, methods and fields of a project, ready for resolution."""

    def __init__(self, rows: DataFrame):
        self.types = written(types_of(rows), "types")
        self.imports = written(rows.filter("kind = 'import'").select("path", "name", "declared"), "imports")
        self.closed = with_self(self.types, ancestors(supertypes(self.types, self.imports)))
        owned = lambda kind: rows.filter(F.col("kind") == kind).withColumn("type_id", scalars.qualified("package_name", "owner"))
        bodies = owned("method").select(
            F.concat("path", F.lit("#"), F.col("method").cast("string")).alias("method_id"), "type_id", "name", "arity", F.struct("path", "ord").alias("place"), "path", "package_name", "owner", "declared", "annotations",
            F.coalesce(F.col("receiver") != "abstract", F.lit(True)).alias("has_body"),
        )
        self.methods = written(typed(bodies, "declared", self.types, self.imports, "result"), "methods")
        fields = owned("field").select("path", "package_name", "owner", "type_id", "name", "declared", "ord").groupBy("type_id", "name").agg(F.max_by(F.struct("path", "package_name", "owner", "declared"), F.struct("path", "ord")).alias("v")).select("type_id", "name", "v.*")
        self.fields = written(typed(fields, "declared", self.types, self.imports, "holds").select("type_id", "name", "declared", "holds"), "fields")
        marked = self.types.select(F.col("type_id").alias("sub"), "form", "place", F.exists("annotations", lambda a: a["annotation"].isin("Service", "Component", "Repository", "RestController", "Controller", "Configuration")).alias("managed"))
        concrete = self.closed.filter("distance > 0").join(marked, "sub").filter("form <> 'interface'")
        #: (type, implementation): the first class below a type, managed ones before others.
        self.implementation = written(concrete.groupBy(F.col("super").alias("type_id")).agg(F.min_by("sub", F.struct(~F.col("managed"), "place")).alias("implementation")), "implementation")

    def definers(self, asked: DataFrame) -> DataFrame:
        """(call_id, callee, result): of the methods of the called name that the call's types have or inherit, the first by: alternative, body or not, number of parameters, nearness.

        asked (call_id, alternative, type_id, member, arity, beyond): `beyond` is 1 where the type itself does not count.
        """
        above = self.closed.select(F.col("sub").alias("type_id"), F.col("super").alias("definer"), "distance", "way")
        has = self.methods.select(F.col("type_id").alias("definer"), F.col("name").alias("member"), F.col("arity").alias("takes"), "method_id", "place", "has_body", "result", F.col("declared").alias("result_name"))
        hit = asked.join(above, "type_id").filter("distance >= beyond").join(has, ["definer", "member"])
        order = F.struct("alternative", (F.col("takes") != F.col("arity")).alias("other"), "distance", "way", "place", "method_id", "result", "result_name")
        return hit.groupBy("call_id").agg(F.min(order).alias("v")).select("call_id", F.col("v.method_id").alias("callee"), "v.result", "v.result_name")

    def resolved(self, rows: DataFrame, names: bool = True) -> DataFrame:
        """(call_id, caller, member, argument, receiver_type name, chain, depth, callee) of all calls; the callee is null where nothing of the project is called.

        Without `names` the receivers' types are left out, which takes a join less.

        A field or variable means its declared type; a type without a body for the method, its first implementation below. What is known
        by no type at all (neither field, variable nor type) is the only method of its name in the project, if there is just one.
        """
        calls = written(
            rows.filter("kind = 'call'").select(
                F.concat_ws("#", "path", F.col("method").cast("string"), F.col("call").cast("string")).alias("call_id"), F.concat("path", F.lit("#"), F.col("method").cast("string")).alias("caller"), "path", "package_name", "owner",
                scalars.qualified("package_name", "owner").alias("own"), F.col("declared").alias("through"), "member", "argument", "receiver", "typed", "on", "chain", "depth", "arity",
            ),
            "calls",
        )
        roots = calls.filter("depth = 0")
        # Variables and constructors carry a type's name; a name without one is a field, its own or inherited or of a type around, else a type.
        around = F.filter(F.split("owner", r"\."), lambda x: x != "")
        chains = F.transform(F.sequence(F.size(around), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(around, F.lit(1), k), "."))
        scope = roots.filter("receiver IN ('name', 'self')").select("call_id", "through", "member", "arity", "receiver", "package_name", F.posexplode(chains).alias("outer", "at")).withColumn("type_id", scalars.qualified("package_name", "at"))
        above = self.closed.select(F.col("sub").alias("type_id"), F.col("super").alias("definer"), "distance", "way")
        held = self.fields.select(F.col("type_id").alias("definer"), F.col("name").alias("through"), F.col("declared").alias("field_name"), "holds")
        field = scope.filter("receiver = 'name'").join(above, "type_id").join(held, ["definer", "through"])
        field = field.groupBy("call_id").agg(F.min(F.struct("outer", "distance", "way", "holds", "field_name")).alias("f")).select("call_id", "f.holds", "f.field_name")
        direct = roots.join(field, "call_id", "left").withColumn("type_name", F.coalesce("typed", F.when(F.col("receiver") == "name", F.coalesce("field_name", "through"))))
        unheld = typed(direct.filter("holds IS NULL").drop("holds"), "type_name", self.types, self.imports, "holds")
        direct = written(direct.filter("holds IS NOT NULL").unionByName(unheld), "roots")
        named = direct.filter("receiver IN ('name', 'typed') AND holds IS NOT NULL").select("call_id", F.col("holds").alias("type_id"), "member", "arity", F.lit(0).alias("beyond"), F.lit(0).alias("outer"))
        own = scope.filter("receiver = 'self'").select("call_id", "type_id", "member", "arity", F.lit(0).alias("beyond"), "outer")
        upper = roots.filter("receiver = 'super'").select("call_id", F.col("own").alias("type_id"), "member", "arity", F.lit(1).alias("beyond"), F.lit(0).alias("outer"))
        found = self.of_types(named.unionByName(own).unionByName(upper))
        lost = direct.filter("receiver = 'name' AND holds IS NULL AND field_name IS NULL").filter(F.substring("through", 1, 1) == F.lower(F.substring("through", 1, 1))).select("call_id", F.col("member").alias("name"))
        only = self.methods.groupBy("name").agg(F.count("*").alias("many"), F.min(F.struct("method_id", "result", F.col("declared").alias("result_name"))).alias("v")).filter("many = 1")
        found = found.unionByName(lost.join(only, "name").select("call_id", F.col("v.method_id").alias("callee"), "v.result", "v.result_name"))
        made = direct.filter("receiver = 'new'").select("call_id", F.lit(None).cast("string").alias("callee"), F.col("holds").alias("result"), F.col("typed").alias("result_name"))
        steps = [written(found.unionByName(made), "resolved")]
        # A result's type is the receiver of what is called on it: one round for each place in a chain.
        longest = calls.agg(F.max("depth")).first()[0] or 0
        later = calls.filter("depth > 0").withColumn("call_id_on", F.concat(F.col("caller"), F.lit("#"), F.col("on").cast("string")))
        for depth in range(1, longest + 1):
            last = steps[-1].filter("result IS NOT NULL").select(F.col("call_id").alias("call_id_on"), F.col("result").alias("type_id"))
            asked = later.filter(F.col("depth") == depth).join(last, "call_id_on").select("call_id", "type_id", "member", "arity", F.lit(0).alias("beyond"), F.lit(0).alias("outer"))
            steps.append(written(self.of_types(asked), "resolved"))
        every = steps[0]
        for step in steps[1:]:
            every = every.unionByName(step)
        told = every.select("call_id", "callee", "result_name")
        known = calls.join(told.drop("result_name"), "call_id", "left")
        if not names:
            return known.select("call_id", "caller", "own", "through", "member", "argument", "receiver", "chain", "depth", "arity", "callee")
        called_on = direct.select("call_id", "type_name").unionByName(later.join(told.withColumnRenamed("call_id", "call_id_on"), "call_id_on").select("call_id", F.col("result_name").alias("type_name")))
        return known.join(called_on, "call_id", "left").select("call_id", "caller", "own", "through", "member", "argument", "receiver", F.col("type_name").alias("receiver_type"), "chain", "depth", "arity", "callee")

    def of_types(self, asked: DataFrame) -> DataFrame:
        """`definers` of calls on types (call_id, type_id, member, arity, beyond, outer): what the type has with a body, else what its implementation has, else what it declares."""
        managed = self.types.filter(F.exists("annotations", lambda a: a["annotation"].isin("Repository", "FeignClient")) | F.coalesce(F.col("extends_class").contains("Repository"), F.lit(False))).select("type_id", F.lit(True).alias("speaks"))
        rows = asked.join(self.types.select("type_id", "form"), "type_id").join(managed, "type_id", "left").join(self.implementation, "type_id", "left")
        # An interface that the framework implements (repositories, clients) stands for itself; any other for its first implementation.
        stands = (F.col("form") != "interface") | F.coalesce("speaks", F.lit(False)) | F.col("implementation").isNull() | (F.col("beyond") == 1)
        choices = F.when(stands, F.array(F.col("type_id"))).otherwise(F.array("implementation", "type_id"))
        # Both are read twice; as plans they would be made twice.
        asked = written(rows.select("call_id", "member", "arity", "beyond", "outer", F.posexplode(choices).alias("choice", "type_id")).withColumn("alternative", 2 * F.col("outer") + F.col("choice")), "asked")
        found = written(self.definers(asked), "found")
        # A method without a body of an abstract class means the first class below that has one.
        bodies = self.methods.select(F.col("method_id").alias("callee"), "has_body", F.col("type_id").alias("abstract"))
        told = found.join(bodies, "callee")
        form = self.types.filter("form <> 'interface'").select(F.col("type_id").alias("abstract"))
        open_ = told.filter("NOT has_body").join(form, "abstract", "left_semi").join(self.implementation.withColumnRenamed("type_id", "abstract"), "abstract")
        below = self.definers(open_.join(asked.select("call_id", "member", "arity").distinct(), "call_id").select("call_id", F.lit(0).alias("alternative"), F.col("implementation").alias("type_id"), "member", "arity", F.lit(0).alias("beyond")))
        better = below.join(bodies, "callee").filter("has_body").select("call_id", F.col("callee").alias("c"), F.col("result").alias("r"), F.col("result_name").alias("n"))
        joined = found.join(better, "call_id", "left")
        pick = lambda new, old: F.when(F.col("c").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
        return joined.select("call_id", pick("c", "callee"), pick("r", "result"), pick("n", "result_name"))
