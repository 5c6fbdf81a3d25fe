"""From extraction tables to the graph: classification, injection, call resolution, nodes and edges.

Staging tables are those of the schema module. Every "first match wins" is a least priority over an equality join, so no step
walks a call graph: all invocations are resolved at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import rules, scalars
from archgraph.operators import constants, typed
from archgraph.sources.shared import written

UNKNOWN_TOPIC = "<unknown>"


def applications(types: DataFrame) -> DataFrame:
    """One application for each class annotated SpringBootApplication: (app_key, base_package, main_class). types: (qualified_name, package_name, class_name, annotations)."""
    mains = types.filter(F.array_contains("annotations", "SpringBootApplication"))
    return mains.select(scalars.qualified("package_name", "class_name").alias("app_key"), F.col("package_name").alias("base_package"), F.col("class_name").alias("main_class")).distinct()


def scoped(types: DataFrame, apps: DataFrame) -> DataFrame:
    """Types with each application whose base package theirs begins with; an empty base takes all.

    Packages are exploded into their beginnings of those lengths that base packages have, and joined by equality. The join is a merge: an exploded
    side looks small to the planner, which would send it through the driver.
    """
    lengths = apps.agg(F.collect_set(F.length("base_package")).alias("__lengths"))
    package = F.coalesce("package_name", F.lit(""))
    long_enough = types.crossJoin(F.broadcast(lengths)).withColumn("__k", F.explode(F.filter("__lengths", lambda k: k <= F.length(package))))
    beginnings = long_enough.withColumn("base_package", F.substring(package, F.lit(1), F.col("__k"))).drop("__k", "__lengths")
    return beginnings.join(apps.select("app_key", "base_package").hint("merge"), "base_package").drop("base_package")


def classified(types: DataFrame) -> DataFrame:
    """Components: types of a known kind; of equal qualified names the first by file order. types also has extends, has_listener, ord."""
    kind = rules.component_kind(F.col("annotations"), F.coalesce(F.exists("interfaces", lambda i: i.endswith("Repository")), F.lit(False)), F.col("has_listener"))
    rest = [c for c in types.columns if c not in ("qualified_name", "ord")]
    found = types.withColumn("kind", kind).filter("kind IS NOT NULL")
    return found.groupBy("qualified_name").agg(F.min(F.struct("ord", "kind", *rest)).alias("v")).select("qualified_name", "v.*")


def endpoints(methods: DataFrame) -> DataFrame:
    """One row for each mapping annotation of a method: verb and full path. methods: (method_id, base_path, mappings array<struct<annotation, path>>, ...)."""
    rows = methods.withColumn("m", F.explode("mappings"))
    return rows.select("*", rules.http_method(F.col("m.annotation")).alias("http_method"), scalars.join_paths("base_path", F.col("m.path")).alias("full_path")).drop("m", "mappings")


def name_index(components: DataFrame) -> DataFrame:
    """(name, qualified_name): qualified and simple names; a simple name means the first component of it."""
    both = components.select(F.col("qualified_name").alias("name"), "qualified_name", "ord", F.lit(0).alias("p")).unionByName(components.select(scalars.simple_name("qualified_name").alias("name"), "qualified_name", "ord", F.lit(1).alias("p")))
    return both.groupBy("name").agg(F.min_by("qualified_name", F.struct("p", "ord", "qualified_name")).alias("qualified_name"))


def implementations(components: DataFrame) -> DataFrame:
    """(interface, implementation): the first implementation of each interface, under its qualified and simple names."""
    rows = components.select(F.explode("interfaces").alias("i"), "qualified_name", "ord")
    named = rows.select(F.explode(F.array_distinct(F.array(F.col("i"), scalars.simple_name("i")))).alias("interface"), "qualified_name", "ord")
    return named.groupBy("interface").agg(F.min_by("qualified_name", F.struct("ord", "qualified_name")).alias("implementation"))


def injected(injections: DataFrame, components: DataFrame) -> DataFrame:
    """Injections with what they mean: the component by qualified, then simple name, else the first implementation; of a field named twice the last source counts.

    injections: (component_id, field_name, declared, ord).
    """
    last = injections.groupBy("component_id", "field_name").agg(F.max_by("declared", "ord").alias("declared"))
    index, impl = name_index(components), implementations(components)
    named = last.join(index.withColumnRenamed("name", "declared").withColumnRenamed("qualified_name", "direct"), "declared", "left")
    simple = named.withColumn("s", scalars.simple_name("declared")).join(index.select(F.col("name").alias("s"), F.col("qualified_name").alias("by_simple")), "s", "left")
    full = simple.join(impl.select(F.col("interface").alias("declared"), F.col("implementation").alias("by_interface")), "declared", "left")
    return full.select("component_id", "field_name", "declared", F.coalesce("direct", "by_simple", "by_interface").alias("target"))


def method_index(methods: DataFrame) -> DataFrame:
    """(key, method_id): Simple#m, Qualified#m, the signature and the bare name; the first method of a key counts. methods: (method_id, component_id, method_name, signature, ord)."""
    m = F.col("method_name")
    keys = F.array(F.concat(scalars.simple_name("component_id"), F.lit("#"), m), F.concat(F.col("component_id"), F.lit("#"), m), F.col("signature"), m)
    return methods.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), "method_id", "ord").groupBy("key").agg(F.min_by("method_id", F.struct("ord", "method_id")).alias("method_id"))


def resolved_calls(invocations: DataFrame, methods: DataFrame, injections: DataFrame, components: DataFrame) -> DataFrame:
    """(caller, callee): each invocation's first candidate that the index holds, in this order: own class, injected class, declared class, its implementation, bare name.

    invocations: (invocation_id, method_id, component_id, target_field, declared, method_name, self_call).
    """
    fields = injected(injections, components).select("component_id", F.col("field_name").alias("target_field"), "target")
    impl = implementations(components).select(F.col("interface").alias("declared"), "implementation")
    rows = invocations.join(fields, ["component_id", "target_field"], "left").join(impl, "declared", "left")
    m = F.concat(F.lit("#"), F.col("method_name"))
    simple = lambda c: F.concat(scalars.simple_name(c), m)
    whole = lambda c: F.concat(F.col(c), m)
    own = lambda k: F.when(F.col("self_call"), k)
    keys = F.array(own(simple("component_id")), own(whole("component_id")), whole("target"), simple("target"), whole("declared"), simple("declared"), whole("implementation"), simple("implementation"), F.col("method_name"))
    tried = rows.select("invocation_id", F.col("method_id").alias("caller"), F.posexplode(keys).alias("priority", "key")).filter("key IS NOT NULL")
    hit = tried.join(method_index(methods).withColumnRenamed("method_id", "callee"), "key")
    return hit.groupBy("invocation_id", "caller").agg(F.min_by("callee", "priority").alias("callee")).select("caller", "callee").distinct()


def external_calls(invocations: DataFrame, feign: DataFrame) -> DataFrame:
    """Invocations that leave the application, with client and verb, once for each method, client, verb and URL. feign: (class_name)."""
    marked = invocations.join(feign.select(F.col("class_name").alias("declared"), F.lit(True).alias("is_feign")).distinct(), "declared", "left")
    client = rules.client_kind(F.col("declared"), F.col("method_name"), F.coalesce("is_feign", F.lit(False)))
    rows = marked.select("method_id", client.alias("client_type"), rules.call_verb(F.col("method_name"), F.col("argument")).alias("http_method"), F.coalesce("url", F.lit("<dynamic>")).alias("url"))
    return rows.filter("client_type NOT IN ('plain', 'Kafka')").distinct()


def repository_tables(repositories: DataFrame, entities: DataFrame) -> DataFrame:
    """Repositories with their tables: the named one, else the entity's name in snake case; only for known entities.

    repositories: (component_id, entity, extends_class, method_names); entities: (qualified_name, table_name).
    """
    known = entities.select(F.explode(F.array_distinct(F.array(F.col("qualified_name"), scalars.simple_name("qualified_name")))).alias("entity"), "qualified_name", "table_name")
    first = known.groupBy("entity").agg(F.min(F.struct("qualified_name", "table_name")).alias("e"))
    table = F.coalesce(F.nullif("e.table_name", F.lit("")), scalars.snake_case(scalars.simple_name("e.qualified_name")))
    ops = F.array_sort(F.array_distinct(F.flatten(F.transform("method_names", rules.operations_in_name))))
    every = F.array(*[F.lit(x) for x in ("DELETE", "READ", "WRITE")])
    return repositories.join(first, "entity").select("component_id", table.alias("table_name"), rules.repository_type(F.coalesce("extends_class", F.lit(""))).alias("repository_type"), F.when(F.size(ops) > 0, ops).otherwise(every).alias("operations"))


def topics(calls: DataFrame) -> DataFrame:
    """Distinct topics of calls; an empty name is `<unknown>`."""
    return calls.select(F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit(UNKNOWN_TOPIC)).alias("name")).distinct()


def nodes_of(components: DataFrame, methods: DataFrame) -> DataFrame:
    """nodes(id, type, label, owner, app_key, kind) of components and their methods, with canonical ids."""
    ident = F.when(F.col("kind") == "Controller", scalars.controller_id("package_name", "class_name")).when(F.col("kind") == "Repository", scalars.repository_id("package_name", "class_name")).otherwise(scalars.service_id("package_name", "class_name"))
    a = components.select(ident.alias("id"), F.col("kind").alias("type"), F.col("class_name").alias("label"), F.col("qualified_name").alias("owner"), "app_key", F.lit(None).cast("string").alias("kind"))
    b = methods.join(components.select(F.col("qualified_name").alias("component_id"), "package_name", "class_name", "app_key", F.col("kind").alias("owner_kind")), "component_id").select(
        scalars.method_id("package_name", "class_name", "method_name", "signature").alias("id"), F.lit("Method").alias("type"), F.col("method_name").alias("label"), F.col("component_id").alias("owner"), "app_key", rules.method_kind(F.col("owner_kind")).alias("kind")
    )
    return a.unionByName(b).dropDuplicates(["id"])


# The type of the edge from an application to a component of each kind.
CONTAINS = {"Controller": "CONTAINS_CONTROLLER", "Service": "CONTAINS_SERVICE", "Repository": "CONTAINS_REPOSITORY", "KafkaListener": "CONTAINS_KAFKA_LISTENER", "Configuration": "CONTAINS_CONFIGURATION"}


def edges_of(components: DataFrame, methods: DataFrame, calls: DataFrame, external: DataFrame, produced: DataFrame, consumed: DataFrame, tables: DataFrame) -> DataFrame:
    """edges(src, dst, type) of a parsed application, each once, between canonical ids.

    components (qualified_name, class_name, package_name, kind, app_key); methods (method_id, component_id, method_name, signature, http_method, full_path; verb and path
    are null for what is no endpoint); calls (caller, callee) and external (method_id, http_method, url), produced and consumed (method_id, topic) name methods by method_id;
    tables (component_id, table_name).
    """
    ident = F.when(F.col("kind") == "Controller", scalars.controller_id("package_name", "class_name")).when(F.col("kind") == "Repository", scalars.repository_id("package_name", "class_name")).otherwise(scalars.service_id("package_name", "class_name"))
    named = components.select(F.col("qualified_name").alias("component_id"), "package_name", "class_name", "kind", "app_key", ident.alias("component"))
    own = F.when(F.col("http_method").isNotNull(), scalars.endpoint_id("http_method", "full_path")).otherwise(scalars.method_id("package_name", "class_name", "method_name", "signature"))
    # A method that no endpoint, service, repository or listener has is no node.
    node = methods.join(named, "component_id").filter("http_method IS NOT NULL OR kind <> 'Controller'").select("method_id", own.alias("node"), "component", "kind", F.col("http_method").isNotNull().alias("is_endpoint"))
    edge = lambda rows, src, dst, kind: rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))
    contains = F.element_at(F.create_map(*[F.lit(x) for kv in CONTAINS.items() for x in kv]), F.col("kind"))
    member = F.when(F.col("is_endpoint"), "HAS_ENDPOINT").when(F.col("kind") == "KafkaListener", "HAS_LISTENER_METHOD").otherwise("HAS_METHOD")
    by = lambda rows, column: rows.join(node.select(F.col("method_id").alias(column), F.col("node").alias(f"{column}_node")), column)
    called = by(by(calls.select("caller", "callee").distinct(), "caller"), "callee")
    topic = lambda rows: by(rows.select("method_id", scalars.topic_id(F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit(UNKNOWN_TOPIC))).alias("topic")), "method_id")
    outside = by(external.select("method_id", scalars.external_id("http_method", "url", F.lit(False)).alias("call")), "method_id")
    parts = [
        edge(named.filter(contains.isNotNull() & F.col("app_key").isNotNull()), "app_key", "component", contains),
        edge(node, "component", "node", member),
        edge(called, "caller_node", "callee_node", "CALLS"),
        edge(outside, "method_id_node", "call", "MAKES_EXTERNAL_CALL"),
        edge(topic(produced), "method_id_node", "topic", "PRODUCES_TO"),
        edge(topic(consumed), "method_id_node", "topic", "CONSUMES_FROM"),
        edge(tables.join(named, "component_id").select("component", scalars.table_id("table_name").alias("table")), "component", "table", "ACCESSES"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def beans(methods: DataFrame) -> DataFrame:
    """(component_id, bean_name, method_name, return_type): methods of configurations that define a bean, by its given name or the method's. methods also has annotations."""
    given = F.try_element_at(F.filter("annotations", lambda a: a["annotation"] == "Bean"), F.lit(1))
    return methods.withColumn("bean", given).filter("bean IS NOT NULL").select("component_id", F.coalesce(F.nullif("bean.argument", F.lit("")), F.col("method_name")).alias("bean_name"), "method_name", "return_type")


def bean_edges(configurations: DataFrame, found: DataFrame) -> DataFrame:
    """DEFINES_BEAN edges of configurations. configurations (qualified_name)."""
    known = configurations.select(F.col("qualified_name").alias("component_id"))
    return found.join(known, "component_id", "left_semi").select(F.col("component_id").alias("src"), F.concat(F.lit("bean:"), F.col("component_id"), F.lit("."), F.col("bean_name")).alias("dst"), F.lit("DEFINES_BEAN").alias("type")).distinct()


def body_types(methods: DataFrame) -> DataFrame:
    """methods with request_type, the type of the parameter marked RequestBody, and response_type, what is returned unless it is void. methods: (parameters text, return_type)."""
    request = F.nullif(F.regexp_extract("parameters", r"@RequestBody(?:\([^)]*\))?\s+(?:final\s+|@\w+(?:\([^)]*\))?\s+)*([\w.]+(?:<[^>]*>+)?(?:\[\])?)\s+\w+", 1), F.lit(""))
    return methods.withColumn("request_type", request).withColumn("response_type", F.nullif("return_type", F.lit("void")))


def with_members(owners: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(owner_id, member_id): members of each owner by its links; of an owner without any, those that name its class in the same application.

    owners (id, class_name, app_key); links (src, dst); members (id, class_name, app_key).
    """
    linked = links.join(owners.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("owner_id"), F.col("dst").alias("member_id")).distinct()
    bare = owners.join(linked.select(F.col("owner_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("owner_id"), "class_name", "app_key")
    by_name = bare.join(members.select(F.col("id").alias("member_id"), "class_name", "app_key"), ["class_name", "app_key"]).select("owner_id", "member_id")
    return linked.unionByName(by_name.distinct())


def registry(details: DataFrame) -> DataFrame:
    """(topic, class_name, method_name, line): the entries of each topic's details `Class.method (line n)`, each once; one without a dot names a class only. details: (topic, detail array<string>)."""
    rows = details.select("topic", F.explode(F.array_distinct("detail")).alias("d")).withColumn("name", F.regexp_replace("d", r"\s*\(line \d+\)$", ""))
    split = F.col("name").contains(".")
    line = F.nullif(F.regexp_extract("d", r"\(line (\d+)\)$", 1), F.lit("")).cast("int")
    return rows.select("topic", F.when(split, F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).otherwise(F.col("name")).alias("class_name"), F.when(split, F.substring_index("name", ".", -1)).alias("method_name"), line.alias("line")).distinct()


MAPPING_ANNOTATIONS = rules.RULES["MAPPING_ANNOTATIONS"]


def path_text(text: Column) -> Column:
    """What a mapping annotation's argument says: the text between the quotes, without the element's name."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r'"?([^"=]*)"?\s*$', 1)


def tables_of(rows: DataFrame, app_key: Column) -> dict[str, DataFrame]:
    """Staging rows of a source reader as the tables that the other functions take: components, methods, injections, invocations, entities, feign.

    `app_key` is the application's key by the package_name of a type. Places in files stand for the order in which things were found.
    """
    place = F.concat(F.col("path"), F.lit("#"), F.lpad(F.col("ord").cast("string"), 9, "0"))
    qualified = lambda name: scalars.qualified("package_name", name)
    names = F.transform("annotations", lambda a: a["annotation"])
    argument = lambda *which: F.try_element_at(F.transform(F.filter("annotations", lambda a: a["annotation"].isin(*which)), lambda a: a["argument"]), F.lit(1))
    method_rows = rows.filter("kind = 'method'")
    listening = method_rows.filter(F.array_contains(names, "KafkaListener")).select(qualified("owner").alias("qualified_name"), F.lit(True).alias("has_listener")).distinct()
    types = rows.filter("kind = 'type'").select(
        qualified("name").alias("qualified_name"), F.col("name").alias("class_name"), "package_name", names.alias("annotations"), "interfaces", "extends_class", place.alias("ord"), F.col("declared").alias("form"),
        argument("RequestMapping").alias("base_path"), argument("Table").alias("table_name"), app_key.alias("app_key"),
    )
    types = types.join(listening, "qualified_name", "left").na.fill(False, ["has_listener"])
    components = classified(types)
    base = types.groupBy(F.col("qualified_name").alias("component_id")).agg(F.min_by("base_path", "ord").alias("base_path"))
    method = method_rows.select(
        F.concat("path", F.lit("#"), F.col("method").cast("string")).alias("method_id"), qualified("owner").alias("component_id"), F.col("name").alias("method_name"), F.col("argument").alias("signature"),
        F.col("declared").alias("return_type"), F.regexp_extract("argument", r"(?s)\((.*)\)$", 1).alias("parameters"), "annotations", place.alias("ord"),
    )
    of_controller = components.filter("kind = 'Controller'").select(F.col("qualified_name").alias("component_id"), F.lit(True).alias("routed"))
    mapped = F.filter("annotations", lambda a: a["annotation"].isin(*MAPPING_ANNOTATIONS))
    routed = method.join(base, "component_id", "left").join(of_controller, "component_id", "left").withColumn("m", F.explode_outer(F.when(F.col("routed"), mapped)))
    methods = routed.select(*method.columns, F.when(F.col("m").isNotNull(), rules.http_method(F.col("m.annotation"))).alias("http_method"), F.when(F.col("m").isNotNull(), scalars.join_paths(path_text(F.col("base_path")), path_text(F.col("m.argument")))).alias("full_path"))
    injections = rows.filter("kind = 'field'").select(qualified("owner").alias("component_id"), F.col("name").alias("field_name"), "declared", place.alias("ord"))
    fields = injections.groupBy("component_id", F.col("field_name").alias("target_field")).agg(F.max_by("declared", "ord").alias("declared"))
    invocations = rows.filter("kind = 'call' AND receiver <> 'new'").select(
        place.alias("invocation_id"), F.concat("path", F.lit("#"), F.col("method").cast("string")).alias("method_id"), qualified("owner").alias("component_id"),
        F.col("declared").alias("target_field"), F.col("member").alias("method_name"), (F.col("receiver") == "self").alias("self_call"), "argument", F.when(F.col("argument").contains("/"), F.col("argument")).alias("url"),
    ).join(fields, ["component_id", "target_field"], "left")
    entities = types.filter(F.array_contains("annotations", "Entity")).select("qualified_name", F.nullif(path_text(F.col("table_name")), F.lit("")).alias("table_name"))
    feign = types.filter(F.array_contains("annotations", "FeignClient")).select("class_name")
    return {"types": types, "components": components, "methods": methods, "injections": injections, "invocations": invocations, "entities": entities, "feign": feign}


def outgoing_calls(calls: DataFrame, texts: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method_id, client_type, http_method, url) of calls that leave the application, each once.

    Of a web client's chain the verb is its first call's and the URL what its `uri` was given; of a Feign client both come from the mapping of the
    method that is called (REQUEST and `<dynamic>` without one); of others from the method's name and its first argument.
    calls as of typed.Hierarchy.resolved; texts (text_id, text) by call_id; methods and types as of `tables_of`.
    """
    said = calls.join(texts.select(F.col("text_id").alias("call_id"), F.when(F.col("text").contains("/"), F.col("text")).alias("url")), "call_id", "left")
    clients = types.filter(F.array_contains("annotations", "FeignClient")).select(F.col("qualified_name").alias("component_id"), path_text(F.col("base_path")).alias("base"))
    mapped = F.try_element_at(F.filter("annotations", lambda a: a["annotation"].isin(*MAPPING_ANNOTATIONS)), F.lit(1))
    declared = methods.join(clients, "component_id").select(F.col("method_id").alias("callee"), mapped.alias("m"), "base").dropDuplicates(["callee"])
    verb, url = F.coalesce(rules.http_method(F.col("m.annotation")), F.lit("REQUEST")), F.when(F.col("m").isNotNull(), scalars.join_paths("base", path_text(F.col("m.argument"))))
    feign = calls.join(declared, "callee").select(F.col("caller").alias("method_id"), F.lit("Feign").alias("client_type"), verb.alias("http_method"), F.coalesce(url, F.lit("<dynamic>")).alias("url"))
    kind = rules.client_kind(F.col("receiver_type"), F.col("member"), F.lit(False))
    web = said.filter((F.col("depth") == 0) & (kind == "WebClient")).select("caller", "chain", rules.call_verb(F.col("member"), F.col("argument")).alias("http_method"))
    given = said.filter("member = 'uri' AND depth > 0").groupBy("caller", "chain").agg(F.min_by("url", "depth").alias("url"))
    chained = web.join(given, ["caller", "chain"], "left").select(F.col("caller").alias("method_id"), F.lit("WebClient").alias("client_type"), "http_method", F.coalesce("url", F.lit("<dynamic>")).alias("url"))
    direct = said.filter(kind.isin("RestTemplate", "HttpURLConnection")).select(F.col("caller").alias("method_id"), kind.alias("client_type"), rules.call_verb(F.col("member"), F.col("argument")).alias("http_method"), F.coalesce("url", F.lit("<dynamic>")).alias("url"))
    return feign.unionByName(chained).unionByName(direct).distinct()


def inherited_owners(calls: DataFrame, project: typed.Hierarchy, components: DataFrame, types: DataFrame) -> DataFrame:
    """Supertypes of components whose methods are called, and that are none themselves: rows like components, of kind `Inherited`."""
    named = components.select(F.col("qualified_name").alias("sub"))
    above = project.closed.filter("distance > 0").join(named, "sub", "left_semi").select(F.col("super").alias("qualified_name")).distinct()
    called = project.methods.join(calls.filter("callee IS NOT NULL").select(F.col("callee").alias("method_id")).distinct(), "method_id", "left_semi").select(F.col("type_id").alias("qualified_name")).distinct()
    own = above.join(called, "qualified_name", "left_semi").join(components.select("qualified_name"), "qualified_name", "left_anti")
    first = types.groupBy("qualified_name").agg(F.min(F.struct("ord", *[c for c in types.columns if c not in ("qualified_name", "ord")])).alias("v")).select("qualified_name", "v.*")
    return first.join(own, "qualified_name").withColumn("kind", F.lit("Inherited")).select(*components.columns)


def graph_of(rows: DataFrame, app_key: Column, properties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a source reader's staging rows: everything from classification to the edge table. properties (key, value)."""
    rows = written(rows, "staging")
    if properties is None:
        properties = rows.sparkSession.createDataFrame([], "key string, value string")
    t = tables_of(rows, app_key)
    methods, types = t["methods"], t["types"]
    project = typed.Hierarchy(rows)
    calls = written(project.resolved(rows), "calls")
    texts = written(constants.texts_of(rows, project, properties), "texts")
    components = t["components"].unionByName(inherited_owners(calls, project, t["components"], types))
    by_call = texts.select(F.col("text_id").alias("call_id"), F.col("text").alias("topic"))
    kafka = rules.client_kind(F.col("receiver_type"), F.col("member"), F.lit(False)) == "Kafka"
    produced = calls.filter(kafka).join(by_call, "call_id", "left").select(F.col("caller").alias("method_id"), F.coalesce("topic", F.lit("<dynamic>")).alias("topic"))
    consumed = texts.filter("text_id LIKE '%#topic%'").select(F.regexp_replace("text_id", r"#topic\d+$", "").alias("method_id"), F.col("text").alias("topic"))
    repositories = components.filter("kind = 'Repository'").select(F.col("qualified_name").alias("component_id"), F.nullif(F.regexp_extract("extends_class", r"<\s*([\w.]+)", 1), F.lit("")).alias("entity"), "extends_class")
    named = methods.groupBy("component_id").agg(F.collect_set("method_name").alias("method_names"))
    tables = repository_tables(repositories.join(named, "component_id", "left").withColumn("method_names", F.coalesce("method_names", F.array().cast("array<string>"))), t["entities"])
    edges = edges_of(components, methods, calls.filter("callee IS NOT NULL").select("caller", "callee"), outgoing_calls(calls, texts, methods, types), produced, consumed, tables)
    configured = components.filter("kind = 'Configuration'")
    return nodes_of(components, methods), edges.unionByName(bean_edges(configured, beans(methods)))


def status_code(return_type: Column, verb: Column) -> Column:
    return F.when(F.coalesce(return_type, F.lit("void")) == "void", 204).when(verb == "POST", 201).otherwise(200)
