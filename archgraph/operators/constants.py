"""Texts that name constants and properties: a fixpoint of substitution over all files.

A text refers to a symbol as `${symbol}` or `${symbol:default}`, defaults may hold references again. Symbols are property keys, and
constants as `#type.FIELD`. A round puts the values of settled symbols into the texts that name them, innermost references first; a
symbol is settled when no reference is left in its value. What stays open when a round changes nothing lies on a circle or depends on one,
and keeps its references as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.scalars import DYNAMIC
from archgraph.operators.typed import SCOPE, Hierarchy, named_types
from archgraph.sources.shared import dropped, written

INNERMOST = r"\$\{([^${}:]+)(?::([^${}]*))?\}"
#: Stands for the sign of a reference that has neither value nor default, until all is done.
KEPT = "\x01{"


def is_open(text: Column) -> Column:
    return text.rlike(INNERMOST)


def substituted(texts: DataFrame, symbols: DataFrame, key: str, text: str) -> DataFrame:
    """Texts after one round. symbols (symbol, value): a value that is open is waited for; an empty one counts as none where there is a default."""
    token = texts.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(INNERMOST), F.lit(0)))).alias("token"))
    token = token.select("__key", "token", F.regexp_extract("token", INNERMOST, 1).alias("symbol"), F.when(F.regexp_extract("token", r"^[^:]*(:)", 1) == ":", F.regexp_extract("token", INNERMOST, 2)).alias("default"))
    hit = token.join(symbols.select("symbol", "value"), "symbol", "left")
    unset = F.col("value").isNull() | ((F.col("value") == "") & F.col("default").isNotNull())
    put = F.when(unset, F.coalesce("default", F.replace("token", F.lit("${"), F.lit(KEPT)))).when(is_open(F.col("value")), F.col("token")).otherwise(F.col("value"))
    parts = hit.select("__key", F.struct("token", put.alias("put")).alias("part")).groupBy(F.col("__key").alias(key)).agg(F.collect_list("part").alias("parts"))
    done = F.aggregate("parts", F.col(text), lambda s, p: F.replace(s, p["token"], p["put"]))
    return texts.join(parts, key, "left").withColumn(text, F.coalesce(done, F.col(text))).drop("parts")


def settled(symbols: DataFrame) -> DataFrame:
    """symbols (symbol, value; each once) with everything substituted that can be."""
    symbols = symbols.select("symbol", F.coalesce("value", F.lit("")).alias("value"))
    state = written(symbols, "symbols")
    while True:
        waiting = state.filter(is_open(F.col("value")))
        next_ = written(state.filter(~is_open(F.col("value"))).unionByName(substituted(waiting, state, "symbol", "value")), "symbols")
        changed = next_.join(waiting.withColumnRenamed("value", "old"), "symbol").filter("value <> old").limit(1).count()
        dropped(state)
        state = next_
        if not changed:
            return state.withColumn("value", F.replace("value", F.lit(KEPT), F.lit("${")))


def filled(texts: DataFrame, symbols: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Texts with the values of `settled` symbols in them; rounds are as many as references are nested."""
    state = written(texts, "texts")
    while True:
        waiting = state.filter(is_open(F.col(text)))
        next_ = written(state.filter(~F.coalesce(is_open(F.col(text)), F.lit(False))).unionByName(substituted(waiting, symbols, key, text)), "texts")
        changed = next_.select(key, text).join(waiting.select(key, F.col(text).alias("old")), key).filter(F.col(text) != F.col("old")).limit(1).count()
        dropped(state)
        state = next_
        if not changed:
            return state.withColumn(text, F.replace(text, F.lit(KEPT), F.lit("${")))


def qualified_names(texts: DataFrame, project: Hierarchy, key: str = "text_id", text: str = "text") -> DataFrame:
    """Texts (with path, package_name, owner) whose `${#name}` are `${#type.FIELD}`, by the scope they stand in; a name of no field becomes `<dynamic>`.

    A name with a type before it is looked up in that type, one without in the types around, each with what they inherit.
    """
    name = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{#([\w.]+)\}"), F.lit(1))))
    asked = texts.select(key, "path", "package_name", "owner", name.alias("name"))
    scopes = asked.select("path", "package_name", "owner", "name").distinct()
    split = scopes.withColumn("field", F.substring_index("name", ".", -1)).withColumn("named", F.nullif(F.regexp_replace("name", r"\.?\w+$", ""), F.lit("")))
    around = F.filter(F.split(F.coalesce("owner", F.lit("")), r"\."), lambda x: x != "")
    chains = F.transform(F.when(F.size(around) > 0, F.sequence(F.size(around), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(around, F.lit(1), k), "."))
    local = split.filter("named IS NULL").select("path", "package_name", "owner", "name", "field", F.posexplode(chains).alias("outer", "at"))
    local = local.withColumn("type_id", F.when(F.coalesce("package_name", F.lit("")) == "", F.col("at")).otherwise(F.concat("package_name", F.lit("."), "at"))).drop("at")
    distant = split.filter("named IS NOT NULL")
    means = named_types(distant.select(*SCOPE).distinct(), project.types, project.imports)
    distant = distant.join(means.select(*[F.col(c).alias(f"__{c}") for c in SCOPE], "type_id"), (F.col("path") == F.col("__path")) & (F.col("named") == F.col("__named")) & F.col("owner").eqNullSafe(F.col("__owner")) & F.col("package_name").eqNullSafe(F.col("__package_name")))
    tried = local.unionByName(distant.select("path", "package_name", "owner", "name", "field", F.lit(0).alias("outer"), "type_id"))
    above = project.closed.select(F.col("sub").alias("type_id"), F.col("super").alias("definer"), "distance", "way")
    held = project.fields.select(F.col("type_id").alias("definer"), F.col("name").alias("field"))
    hit = tried.join(above, "type_id").join(held, ["definer", "field"]).groupBy("path", "owner", "name").agg(F.min(F.struct("outer", "distance", "way", "definer", "field")).alias("v"))
    hit = hit.select(F.col("path").alias("__path"), F.col("owner").alias("__owner"), F.col("name").alias("__name"), F.concat(F.lit("${#"), F.col("v.definer"), F.lit("."), F.col("v.field"), F.lit("}")).alias("put"))
    each = asked.join(hit, (F.col("path") == F.col("__path")) & (F.col("name") == F.col("__name")) & F.col("owner").eqNullSafe(F.col("__owner")), "left")
    part = F.struct(F.concat(F.lit("${#"), "name", F.lit("}")).alias("token"), F.coalesce("put", F.lit(DYNAMIC)).alias("put"))
    parts = each.select(key, part.alias("part")).groupBy(key).agg(F.collect_list("part").alias("parts"))
    # Longer names first would not help: a token ends with its bracket, so none is a part of another; marks keep what was put in from being read again.
    done = F.replace(F.aggregate("parts", F.col(text), lambda s, p: F.replace(s, p["token"], F.replace(p["put"], F.lit("${#"), F.lit("\x02")))), F.lit("\x02"), F.lit("${#"))
    return texts.join(parts, key, "left").withColumn(text, F.coalesce(done, F.col(text))).drop("parts")


def symbols_of(rows: DataFrame, project: Hierarchy, properties: DataFrame) -> DataFrame:
    """Settled symbols of a project: properties (key, value), and fields with a text, as initialised or as injected by a Value annotation."""
    fields = rows.filter("kind = 'field' AND argument IS NOT NULL").select(
        F.concat(F.lit("#"), F.when(F.coalesce("package_name", F.lit("")) == "", F.col("owner")).otherwise(F.concat("package_name", F.lit("."), "owner")), F.lit("."), "name").alias("text_id"),
        "path", "package_name", "owner", F.col("argument").alias("text"), "ord",
    )
    last = fields.groupBy("text_id").agg(F.max_by(F.struct("path", "package_name", "owner", "text"), F.struct("path", "ord")).alias("v")).select("text_id", "v.*")
    named = qualified_names(last, project).select(F.col("text_id").alias("symbol"), F.col("text").alias("value"))
    return settled(named.unionByName(properties.select(F.col("key").alias("symbol"), "value")))


def texts_of(rows: DataFrame, project: Hierarchy, properties: DataFrame) -> DataFrame:
    """(text_id, text): first arguments of calls by call_id, and topics of listeners by method_id and number, with constants and properties put in."""
    call = F.concat_ws("#", "path", F.col("method").cast("string"), F.col("call").cast("string"))
    arguments = rows.filter("kind = 'call' AND argument IS NOT NULL").select(call.alias("text_id"), "path", "package_name", "owner", F.col("argument").alias("text"))
    topics = rows.filter("kind = 'method' AND size(values) > 0").select("path", "package_name", "owner", "method", F.posexplode("values").alias("n", "text"))
    topics = topics.select(F.concat_ws("#", "path", F.col("method").cast("string"), F.concat(F.lit("topic"), F.col("n"))).alias("text_id"), "path", "package_name", "owner", "text")
    # What refers to nothing is left out of the joins.
    every = arguments.unionByName(topics)
    plain = every.filter("NOT contains(text, '${')").select("text_id", "text")
    open_ = filled(qualified_names(every.filter("contains(text, '${')"), project), symbols_of(rows, project, properties)).select("text_id", "text")
    return plain.unionByName(open_)
