"""Scalar functions as Column expressions: canonical ids, paths and URLs, names, placeholders, verbs.

All stay in the JVM. A null input gives the value that each docstring states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- paths and URLs ----------------------------------------------------------------------------------------------------

#: What stands for a variable part of a path, and for a part that code computes.
VARIABLE, DYNAMIC = "{*}", "<dynamic>"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def normalize_path(path: Text) -> Column:
    """Path variables, numeric segments and UUIDs become `{*}`; one trailing slash goes; null gives ''.

    A match takes the slash after it, so of neighbouring numeric segments every second one stays.
    """
    p = F.regexp_replace(_c(path), r"\{[^}]+\}", VARIABLE)
    p = F.regexp_replace(p, r"/\d+(/|$)", "/" + VARIABLE + "$1")
    p = F.regexp_replace(p, f"/{UUID}(/|$)", "/" + VARIABLE + "$1")
    return F.coalesce(F.regexp_replace(p, r"^(.+)/$", "$1"), F.lit(""))


def url_path(url: Text) -> Column:
    """The path of a URL without its query; '/' for a host alone."""
    u = _c(url)
    is_web = u.rlike("^https?://")
    tail = F.regexp_replace(u, "^https?://[^/]*", "")
    return F.when(is_web & (tail == ""), "/").otherwise(F.regexp_replace(F.when(is_web, tail).otherwise(u), r"(?s)\?.*$", ""))


def normalize_external_url(url: Text) -> Column:
    """`url_path`, with computed parts as `{*}`, or else normalized as a path; null gives ''."""
    path = url_path(url)
    return F.coalesce(F.when(_c(url).contains(DYNAMIC), F.replace(path, F.lit(DYNAMIC), F.lit(VARIABLE))).otherwise(normalize_path(path)), F.lit(""))


def resolver_url(url: Text) -> Column:
    """The form in which calls are matched to endpoints: no host, query, fragment, computed parts or doubled slashes; '' if there is no path."""
    u = F.trim(_c(url))
    has_host = u.contains("://")
    tail = F.regexp_replace(u, r"^.*?://[^/]*", "")
    p = F.when(has_host, tail).otherwise(u)
    p = F.regexp_replace(p, r"(?s)(.)[?].*$", "$1")
    p = F.regexp_replace(p, r"(?s)(.)#.*$", "$1")
    p = F.regexp_replace(F.replace(p, F.lit(DYNAMIC), F.lit("")), "/{2,}", "/")
    p = F.regexp_replace(p, r"^(.+)/$", "$1")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.coalesce(F.when(has_host & (tail == ""), "").when(u == "", "").otherwise(p), F.lit(""))


def path_pattern(path: Text) -> Column:
    """A regular expression for a path template: a variable is one segment, a computed part any run without a slash."""
    quoted = F.regexp_replace(_c(path), r"([.+()\[\]^$|\\])", r"\\$1")
    return F.replace(F.regexp_replace(quoted, r"\{[^}]+\}", "[^/]+"), F.lit(DYNAMIC), F.lit("[^/]*"))


def template_regex(path: Text) -> Column:
    """A full-match expression for an endpoint template: `{x}` is one segment, `**` anything; other signs are literal."""
    quoted = F.regexp_replace(_c(path), r"([.+?()\[\]^$|\\])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(quoted, r"\*\*", "\u0001"), r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(starred, r"\{[^}]+\}", "[^/]+"), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def url_candidates(url: Text) -> Column:
    """A path, the path without its first segment, and without two: what a gateway may have put before it."""
    cleaned = F.when(_c(url).startswith("/"), _c(url)).otherwise(F.concat(F.lit("/"), _c(url)))
    segments = F.filter(F.split(cleaned, "/"), lambda s: F.trim(s) != "")
    rest = lambda k: F.when(F.size(segments) > k, F.concat(F.lit("/"), F.array_join(F.slice(segments, k + 1, F.greatest(F.size(segments) - k, F.lit(0))), "/")))
    return F.when(F.coalesce(_c(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(cleaned, rest(1), rest(2))))


def path_prefix(path: Text) -> Column:
    """Without a trailing slash and the last segment; a single segment stays whole."""
    bare = F.regexp_replace(_c(path), r"/$", "")
    return F.when(F.length(F.regexp_replace(bare, "/[^/]*$", "")) > 0, F.regexp_replace(bare, "/[^/]*$", "")).otherwise(bare)


def join_paths(base: Text, path: Text) -> Column:
    """A class mapping and a method mapping as one path, quotes, braces and doubled slashes removed; '/' if both are empty."""
    clean = lambda x: F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\"\[\]\s]", "")
    joined = F.regexp_replace(F.concat_ws("/", clean(base), clean(path)), "/{2,}", "/")
    joined = F.regexp_replace(joined, r"^(.+)/$", "$1")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def strip_dynamic(url: Text) -> Column:
    return F.regexp_replace(F.replace(_c(url), F.lit(DYNAMIC), F.lit("")), "(?<!:)/{2,}", "/")


# -- canonical ids -----------------------------------------------------------------------------------------------------

# The prefixes of ids here and below are fixed values.

def qualified(package: Text, name: Text) -> Column:
    return F.concat_ws(".", _c(package), _c(name))


def parameter_types(signature: Text) -> Column:
    """Types between the first `(` and the last `)`, comma-joined: each part loses its last word; '' if there are none."""
    inner = F.trim(F.regexp_extract(F.coalesce(_c(signature), F.lit("")), r"(?s)\((.*)\)", 1))
    types = F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\s+\S*$", "")))
    return F.when(inner == "", "").otherwise(F.array_join(types, ","))


def _id(known: Column, unknown: str, value: Column) -> Column:
    return F.when(known, value).otherwise(F.lit(unknown))


def controller_id(package: Text, name: Text) -> Column:
    return _id(_c(package).isNotNull() & _c(name).isNotNull(), "controller:unknown", F.concat(F.lit("controller:"), _c(package), F.lit("."), _c(name)))


def endpoint_id(verb: Text, path: Text) -> Column:
    return _id(_c(verb).isNotNull() & _c(path).isNotNull(), "endpoint:unknown", F.concat(F.lit("endpoint:"), F.upper(_c(verb)), F.lit(":"), normalize_path(path)))


def method_id(package: Text, name: Text, method: Text, signature: Text) -> Column:
    value = F.concat(F.lit("method:"), qualified(package, name), F.lit("."), _c(method), F.lit("("), parameter_types(signature), F.lit(")"))
    return _id(_c(name).isNotNull() & _c(method).isNotNull(), "method:unknown", value)


def external_id(verb: Text, url: Text, resolved: Text) -> Column:
    value = F.concat(F.lit("external:"), F.upper(_c(verb)), F.lit(":"), normalize_external_url(url), F.lit(":resolved="), _c(resolved).cast("string"))
    return _id(_c(verb).isNotNull() & _c(url).isNotNull(), "external:unknown", value)


def service_id(package: Text, name: Text) -> Column:
    return _id(_c(name).isNotNull(), "service:unknown", F.concat(F.lit("service:"), qualified(package, name)))


def repository_id(package: Text, name: Text) -> Column:
    return _id(_c(name).isNotNull(), "repository:unknown", F.concat(F.lit("repository:"), qualified(package, name)))


def application_id(app_key: Text) -> Column:
    return F.concat(F.lit("application:"), F.coalesce(_c(app_key), F.lit("unknown")))


def topic_id(name: Text) -> Column:
    return F.concat(F.lit("kafka_topic:"), F.coalesce(_c(name), F.lit("unknown")))


def table_id(name: Text) -> Column:
    return F.concat(F.lit("database_table:"), F.lower(F.coalesce(_c(name), F.lit("unknown"))))


def edge_id(kind: Text, source: Text, target: Text) -> Column:
    known = _c(kind).isNotNull() & _c(source).isNotNull() & _c(target).isNotNull()
    return _id(known, "edge:unknown", F.concat(F.lower(_c(kind)), F.lit(":"), _c(source), F.lit("->"), _c(target)))


def app_key(is_spring: Text, package: Text, main_class: Text, repo_url: Text) -> Column:
    return F.when(_c(is_spring), qualified(package, main_class)).otherwise(F.concat(_c(repo_url), F.lit("::NON_SPRING")))


def chunk_id(project: Text, level: Text, node: Text) -> Column:
    return F.concat_ws("::", _c(project), _c(level), _c(node))


def parse_chunk_id(chunk: Text) -> Column:
    """struct<project, level, node>: level and node are the last two parts, so a project may hold the separator itself."""
    parts = F.split(_c(chunk), "::")
    n = F.size(parts)
    return F.struct(F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), "::").alias("project"), F.try_element_at(parts, n - 1).alias("level"), F.try_element_at(parts, n).alias("node"))


# -- names -------------------------------------------------------------------------------------------------------------


def snake_case(name: Text) -> Column:
    return F.lower(F.regexp_replace(_c(name), "([a-z])([A-Z])", "$1_$2"))


def simple_name(name: Text) -> Column:
    return F.substring_index(_c(name), ".", -1)


def class_of_file(path: Text) -> Column:
    """The qualified class of a Java source file: what follows src/main/java/, dotted; null for other files."""
    p = _c(path)
    inner = F.regexp_replace(F.regexp_extract(p, r"src/main/java/(.*)\.java$", 1), "/", ".")
    return F.when(inner != "", inner)


def package_of_file(path: Text) -> Column:
    full = class_of_file(path)
    return F.when(F.instr(full, ".") > 0, F.regexp_replace(full, r"\.[^.]*$", ""))


def owner_repo(full_name: Text) -> Column:
    return F.struct(F.split_part(_c(full_name), F.lit("/"), F.lit(1)).alias("owner"), F.split_part(_c(full_name), F.lit("/"), F.lit(2)).alias("repo"))


def repo_name(url: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(url), r"/+$", ""), r"^.*/|\.git$", "")


def service_of_app(key: Text) -> Column:
    """The last but one dotted part of an application key, or the key."""
    return F.coalesce(F.try_element_at(F.split(_c(key), r"\."), F.lit(-2)), _c(key))


def service_of_url(url: Text) -> Column:
    """The first host label; null for local hosts, addresses and URLs without a host."""
    host = F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"^https?://([^/:?#]+)", 1)
    return F.when((host != "") & (host != "localhost") & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.substring_index(host, ".", 1))


def verb(name: Text) -> Column:
    return F.upper(F.coalesce(_c(name), F.lit("REQUEST")))


# -- placeholders ------------------------------------------------------------------------------------------------------

PLACEHOLDER = r"\$\{([^:}]+)(?::([^}]*))?\}"


def placeholder_keys(text: Text) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(PLACEHOLDER), F.lit(1))


def has_placeholder(text: Text) -> Column:
    return F.coalesce(_c(text).rlike(PLACEHOLDER), F.lit(False))


def resolve_placeholder(text: Text, value: Text) -> Column:
    """`${k}` or `${k:default}` as a whole text: the value, or the default if the value is null or empty, or the text itself."""
    t = _c(text)
    default = F.when(t.rlike(r"^\$\{[^:}]+:"), F.regexp_extract(t, PLACEHOLDER, 2))
    return F.when(t.rlike(f"^{PLACEHOLDER}$"), F.coalesce(F.nullif(_c(value), F.lit("")), default, t)).otherwise(t)


def resolve_all(text: Text, properties: Column) -> Column:
    """Every placeholder in a text, from a map column; those without value or default stay."""
    t = _c(text)
    whole = F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0))

    def one(done: Column, token: Column) -> Column:
        key = F.regexp_extract(token, PLACEHOLDER, 1)
        default = F.when(token.contains(":"), F.regexp_extract(token, PLACEHOLDER, 2))
        return F.replace(done, token, F.coalesce(F.nullif(F.try_element_at(properties, key), F.lit("")), default, token))

    return F.aggregate(whole, t, one)


def topic_state(topic: Text) -> Column:
    """How far a topic name is known: literal, placeholder, expression, variable or unknown."""
    t = _c(topic)
    return (
        F.when(t.isNull() | (F.trim(t) == ""), "unknown")
        .when(t.rlike(r"^\$\{"), "placeholder")
        .when(t.rlike(r"^#\{"), "expression")
        .when(t.startswith("<") | t.contains("$"), "variable")
        .otherwise("literal")
    )


# -- glob --------------------------------------------------------------------------------------------------------------


def glob_matches(path: Text, pattern: str) -> Column:
    """`*` is any run; the whole path has to match; other signs keep their meaning in a regular expression."""
    return _c(path).rlike("^(?:" + pattern.replace("*", ".*") + ")$")


def either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def field_value(fields: Column, name: Text) -> Column:
    """A constant from a map of qualified or plain field names: the name itself, else the least key that ends with `.name`."""
    suffix = F.concat(F.lit("."), _c(name))
    hits = F.array_sort(F.filter(F.map_keys(fields), lambda k: k.endswith(suffix)))
    return F.coalesce(F.try_element_at(fields, _c(name)), F.try_element_at(fields, F.try_element_at(hits, F.lit(1))))
