"""Rule tables and the predicates and labels made from them. Every table is a default that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default rule tables.
RULES: dict[str, tuple[str, ...]] = {
    "MAPPING_ANNOTATIONS": ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping"),
    "REST_TEMPLATE_METHODS": ("getForObject", "getForEntity", "postForObject", "postForEntity", "put", "delete", "exchange"),
    "WEBCLIENT_HTTP_METHODS": ("get", "post", "put", "delete", "patch", "method"),
    "KAFKA_PRODUCER_METHODS": ("send", "sendDefault"),
    "KAFKA_PRODUCER_TYPES": ("KafkaTemplate", "ReactiveKafkaProducerTemplate"),
    "HTTP_URL_CONNECTION_METHODS": ("openConnection", "setRequestMethod", "getInputStream", "getOutputStream", "connect"),
    "REPOSITORY_WRITE_METHODS": ("save", "saveAll", "saveAndFlush", "saveAllAndFlush", "delete", "deleteAll", "deleteById", "deleteAllById", "deleteInBatch", "deleteAllInBatch", "insert", "update", "upsert"),
    "REPOSITORY_READ_METHODS": ("findById", "findAll", "findAllById", "existsById", "count", "getById", "getReferenceById", "getOne"),
    "ALLOWED_ANALYSIS_PACKAGES": ("org.springframework.web.client",),
}
# Verbs, colours, name prefixes and operations by name.
HTTP_METHODS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "REQUEST"}
NODE_COLOURS = {
    "Application": "#2196F3", "Controller": "#4CAF50", "Endpoint": "#8BC34A", "Service": "#FF9800", "Method": "#FFC107",
    "Repository": "#9C27B0", "DatabaseTable": "#673AB7", "KafkaTopic": "#E91E63", "KafkaListener": "#F44336", "Configuration": "#607D8B",
}
EDGE_COLOURS = {
    "CONTAINS_CONTROLLER": "#4CAF50", "HAS_ENDPOINT": "#8BC34A", "CONTAINS_SERVICE": "#FF9800", "HAS_METHOD": "#FFC107", "CALLS": "#2196F3",
    "MAKES_EXTERNAL_CALL": "#F44336", "PRODUCES_TO": "#E91E63", "CONSUMES_FROM": "#9C27B0", "ACCESSES": "#673AB7",
}
DEFAULT_COLOUR = "#9E9E9E"
STANDARD_PREFIXES = ("java.", "javax.", "jakarta.", "org.springframework.", "lombok.", "org.slf4j.", "org.apache.")
OPERATIONS_BY_PREFIX = (
    ("READ", ("find", "get", "read", "select", "query", "count")),
    ("WRITE", ("save", "insert", "create", "add", "persist")),
    ("UPDATE", ("update", "modify", "set")),
    ("DELETE", ("delete", "remove")),
)
OPERATIONS_BY_PART = (("READ", ("find", "get", "read", "query")), ("WRITE", ("save", "create", "insert", "persist")), ("UPDATE", ("update", "merge")), ("DELETE", ("delete", "remove")))


def rule_table(spark: SparkSession, overrides: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(config_type, value): the defaults with whole types replaced by `overrides`."""
    rules = {**RULES, **(overrides or {})}
    kinds = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]) if v else F.array().cast("array<string>"))])
    return spark.range(1).select(F.explode(kinds).alias("config_type", "values")).select("config_type", F.explode("values").alias("value"))


def looked_up(key: Column, options: dict[str, str], otherwise: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def node_colour(kind: Column) -> Column:
    return looked_up(kind, NODE_COLOURS, DEFAULT_COLOUR)


def edge_colour(kind: Column) -> Column:
    return looked_up(kind, EDGE_COLOURS, DEFAULT_COLOUR)


def http_method(annotation: Column) -> Column:
    return looked_up(annotation, HTTP_METHODS, "REQUEST")


def starts_with_any(x: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def is_standard_type(name: Column, allowed: tuple[str, ...] = RULES["ALLOWED_ANALYSIS_PACKAGES"]) -> Column:
    """Library types, unless a package is allowed; null counts as standard."""
    return F.coalesce(~starts_with_any(name, allowed) & starts_with_any(name, STANDARD_PREFIXES), F.lit(True))


def is_accessor(method: Column, fixed: tuple[str, ...] = ("equals", "hashCode", "toString", "canEqual", "builder", "build")) -> Column:
    return method.rlike("^(get|set)[A-Z]|^is[A-Z]") | method.isin(*fixed)


def infer_operation(method: Column) -> Column:
    """The first operation whose prefix the lower-case name has; else UNKNOWN."""
    name, out = F.lower(method), None
    for op, prefixes in OPERATIONS_BY_PREFIX:
        hit = starts_with_any(name, prefixes)
        out = F.when(hit, op) if out is None else out.when(hit, op)
    return out.otherwise("UNKNOWN")


def operations_in_name(method: Column) -> Column:
    """All operations of which the lower-case name holds a word, sorted."""
    name = F.lower(method)
    has = lambda words: name.rlike("|".join(words))
    return F.array_sort(F.array_compact(F.array(*[F.when(has(words), op) for op, words in OPERATIONS_BY_PART])))


def repository_label(method: Column) -> Column:
    name = F.lower(method)
    return (
        F.when(name.startswith("save"), "SAVE").when(name.startswith("delete") | name.startswith("remove"), "DELETE").when(name.startswith("insert"), "INSERT")
        .when(name.startswith("update"), "UPDATE").when(name.startswith("upsert"), "UPSERT").otherwise("READ")
    )


def repository_type(extends: Column) -> Column:
    return (
        F.when(extends.contains("ReactiveMongoRepository"), "ReactiveMongoRepository").when(extends.contains("ReactiveCrudRepository"), "ReactiveCrudRepository")
        .when(extends.contains("MongoRepository"), "MongoRepository").when(extends.contains("JpaRepository"), "JpaRepository").when(extends.contains("CrudRepository"), "CrudRepository").otherwise("Custom")
    )


def component_kind(annotations: Column, extends_repository: Column, has_listener: Column) -> Column:
    """First match of the stereotype annotations; then a repository super-interface; then listener methods; null for others."""
    has = lambda a: F.array_contains(annotations, a)
    return (
        F.when(has("RestController") | has("Controller"), "Controller").when(has("Service"), "Service").when(has("Repository"), "Repository").when(has("Configuration"), "Configuration")
        .when(has("Component"), F.when(has_listener, "KafkaListener").otherwise("Component")).when(extends_repository, "Repository").when(has_listener, "KafkaListener")
    )


def method_kind(component: Column) -> Column:
    return F.when(component == "Repository", "REPOSITORY_METHOD").when(component == "KafkaListener", "LISTENER_METHOD").otherwise("SERVICE_METHOD")


def client_kind(declared: Column, method: Column, is_feign: Column) -> Column:
    """How an invocation leaves the application; 'plain' if it doesn't."""
    return (
        F.when(declared.contains("RestTemplate") & method.isin(*RULES["REST_TEMPLATE_METHODS"]), "RestTemplate")
        .when(declared.contains("WebClient") & method.isin(*RULES["WEBCLIENT_HTTP_METHODS"]), "WebClient")
        .when(declared.contains("URLConnection") & method.isin(*RULES["HTTP_URL_CONNECTION_METHODS"]), "HttpURLConnection")
        .when(is_feign, "Feign")
        .when(F.exists(F.array(*[F.lit(t) for t in RULES["KAFKA_PRODUCER_TYPES"]]), lambda t: declared.contains(t)) & method.isin(*RULES["KAFKA_PRODUCER_METHODS"]), "Kafka")
        .otherwise("plain")
    )


def call_verb(method: Column, argument: Column) -> Column:
    """The HTTP verb of a client call: of `exchange` its argument, else the start of the method name; GET if neither tells."""
    name = F.lower(method)
    named = F.regexp_extract(name, "^(get|post|put|delete|patch)", 1)
    return F.upper(F.coalesce(F.when(name.isin("exchange", "method", "setrequestmethod"), F.nullif(F.regexp_replace(argument, r"^.*\.", ""), F.lit(""))), F.nullif(named, F.lit("")), F.lit("GET")))
