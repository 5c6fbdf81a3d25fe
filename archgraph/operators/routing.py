"""URLs routed through tries of path segments, level by level.

Two tries are descended at once. The one from the beginning has literal, variable and pattern branches; where it ends with the URL, the
template matches (8). The one from the end has literal and variable branches by their text; where a URL leaves it, the segments agreed
so far are the score of all endpoints behind the branches not taken. A node keeps the least endpoint behind its first few branches, so no
URL meets an endpoint that does not win. Equal paths (10) and ends of paths (7, 5) are equality joins on the texts of paths and their ends.

Endpoints are known by verb class: every one under `any`, and under its verb, or `*` if it serves all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions import scalars
from archgraph.sources.shared import dropped, written

ANY, OPEN = "any", "*"
VARIABLE = r"^\{[^}]+\}$"


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_variable(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def least(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("endpoint_id").alias("endpoint_id"))


def ends_of(parts: Column, from_: int) -> Column:
    """The ends of a path as texts, from the one without its first `from_` segments on; the root has none."""
    n = F.size(parts)
    ks = F.when(n > from_, F.sequence(F.lit(from_), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ks, lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k + 1, n - k), "/")))


class Registry:
    """Endpoints (endpoint_id, path, class) as tables that URLs are led through. `path` is in the form of URLs."""

    def __init__(self, endpoints: DataFrame):
        ends = endpoints.withColumn("parts", parts_of(F.col("path")))
        shape = lambda s: F.regexp_replace(s, r"\{[^}]+\}", "{}")
        spread = F.array_position(F.transform("parts", lambda s: s.contains("**")), True)
        odd = F.exists("parts", lambda s: (s.contains("{") & ~s.rlike(VARIABLE)) | s.contains("*") | (s.contains("}") & ~s.rlike(VARIABLE)))
        ends = ends.withColumn("wide", spread.cast("int")).withColumn("odd", odd)
        #: Whole paths and their proper ends.
        self.whole = least(ends, "path", "class")
        self.tails = least(ends.select("class", "endpoint_id", F.explode(ends_of(F.col("parts"), 1)).alias("candidate")), "candidate", "class")

        # From the beginning, as far as each segment stands for one segment.
        upto = F.when(F.col("wide") > 0, F.col("wide") - 1).otherwise(F.size("parts"))
        led = ends.withColumn("led", F.slice("parts", F.lit(1), upto))
        node = lambda k: F.concat_ws("/", F.lit(""), F.transform(F.slice("led", F.lit(1), k), shape))
        step = led.select("led", F.explode(F.when(F.size("led") > 0, F.sequence(F.lit(1), F.size("led"))).otherwise(F.array().cast("array<int>"))).alias("k")).withColumn("s", F.element_at("led", F.col("k")))
        plain = ~F.col("s").contains("{") & ~F.col("s").contains("*") & ~F.col("s").contains("}")
        key = F.when(plain, F.concat(F.lit("l:"), "s")).when(F.col("s").rlike(VARIABLE), "v").otherwise("p")
        ahead = step.select(F.lit("f").alias("dir"), node(F.col("k") - 1).alias("node"), key.alias("key"), node(F.col("k")).alias("child"), F.when(key == "p", scalars.template_regex(shape_free(F.col("s")))).alias("pattern"), F.lit(None).cast("string").alias("text"))
        self.templates = least(led.filter("wide = 0").select(node(F.size("led")).alias("node"), "class", "endpoint_id"), "node", "class")
        rest = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.col("wide"), F.size("parts")), "/"))
        last = F.element_at("parts", F.lit(-1))
        fixed = F.when(~last.rlike(r"[{*}]"), last)
        self.spreads = least(led.filter("wide > 0").select(node(F.size("led")).alias("node"), fixed.alias("last"), scalars.template_regex(shape_free(rest)).alias("pattern"), "class", "endpoint_id"), "node", "last", "pattern", "class")

        # From the end, regular endpoints only; the place before the first slash is a part too, the empty one.
        back = ends.filter("NOT odd").select("class", "endpoint_id", F.concat(F.reverse("parts"), F.array(F.lit(""))).alias("back"))
        walk = back.select("class", "endpoint_id", "back", F.explode(F.sequence(F.lit(1), F.size("back"))).alias("k")).withColumn("s", F.element_at("back", F.col("k")))
        text = lambda k: F.array_join(F.slice("back", F.lit(1), k), "/")
        walk = walk.select("class", "endpoint_id", "s", text(F.col("k") - 1).alias("node"), text(F.col("k")).alias("child"), is_variable(F.col("s")).alias("varies"))
        behind = walk.filter("s <> ''").select(F.lit("b").alias("dir"), "node", F.when(F.col("varies"), "v").otherwise(F.concat(F.lit("l:"), "s")).alias("key"), "child", F.lit(None).cast("string").alias("pattern"), F.col("s").alias("text"))
        self.edges = ahead.unionByName(behind).distinct()
        branch = walk.groupBy("node", "class", "s", "varies").agg(F.min("endpoint_id").alias("endpoint_id"))
        # At most two literal branches of a node are not counted (the one taken, the end of the path): the least of three suffice.
        self.branches = first_branches(branch).join(branch.filter("varies").groupBy("node", "class").agg(F.min("endpoint_id").alias("varied")), ["node", "class"], "full")
        # Endpoints with patterns inside segments are few: they meet the URLs of their last two parts.
        pair = F.slice(F.concat(F.reverse("parts"), F.array(F.lit(""))), 1, 2)
        self.irregular = least(ends.filter("odd").filter(F.size("parts") > 0).select(F.array_join(F.transform(pair, lambda s: F.when(is_variable(s), "{}").otherwise(s)), "/").alias("pair"), "path", "class", "endpoint_id"), "pair", "path", "class")


def shape_free(text: Column) -> Column:
    """Variables under one name, so that equal shapes are equal texts."""
    return F.regexp_replace(text, r"\{[^}]+\}", "{x}")


def first_branches(branch: DataFrame) -> DataFrame:
    """(node, class, fixed): the three literal branches of each node with the least endpoints behind them, ranked before they are collected."""
    ranked = branch.filter("NOT varies").withColumn("n", F.row_number().over(Window.partitionBy("node", "class").orderBy("endpoint_id", "s"))).filter("n <= 3")
    return ranked.groupBy("node", "class").agg(F.array_sort(F.collect_list(F.struct("endpoint_id", "s"))).alias("fixed"))


def descended(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, parts, dir, d, node, same): every node that a URL comes through in either trie. A level is a join on (node, branch)."""
    parts = parts_of(F.col("candidate"))
    first = urls.select("candidate", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("dir"), parts.alias("forth"))
    first = first.select("candidate", "dir", F.when(F.col("dir") == "f", F.when(F.size("forth") > 0, F.col("forth")).otherwise(F.array(F.lit("")))).otherwise(F.concat(F.reverse("forth"), F.array(F.lit("")))).alias("parts"), F.lit(0).alias("d"), F.lit("").alias("node"), F.lit(True).alias("same"))
    levels = [written(first, "level")]
    while True:
        on = levels[-1].filter(F.col("d") < F.size("parts")).withColumn("s", F.element_at("parts", F.col("d") + 1))
        asked = on.withColumn("key", F.explode(F.array(F.concat(F.lit("l:"), "s"), F.lit("v"), F.lit("p"))))
        # The root's one segment is empty: a pattern may stand for it, a variable may not.
        hit = asked.join(edges, ["dir", "node", "key"]).filter((F.col("key") != "p") | F.rlike("s", "pattern")).filter((F.col("key") != "v") | (F.col("s") != "") | (F.col("dir") == "b"))
        # What stands for the place before the first slash is no text of the path.
        same = F.col("same") & ((F.col("s") == "") | (F.col("s") == F.coalesce("text", F.lit("\x01"))))
        level = written(hit.select("candidate", "dir", "parts", (F.col("d") + 1).alias("d"), F.col("child").alias("node"), same.alias("same")).distinct(), "level")
        if level.isEmpty():
            dropped(level)
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def routed(urls: DataFrame, registry: Registry, score_of) -> DataFrame:
    """(candidate, class, endpoint_id, score): for each URL (candidate; each once) and verb class what may win. `score_of(candidate, path)` judges irregular endpoints."""
    at = written(descended(urls, written(registry.edges, "edges")), "descended")

    def row(df: DataFrame, score: int | Column) -> DataFrame:
        """The best of one way of matching, before the ways meet."""
        best = F.min(F.struct((-(F.lit(score) if isinstance(score, int) else score)).cast("int").alias("s"), "endpoint_id"))
        return df.groupBy("candidate", "class").agg(best.alias("b")).select("candidate", "class", "b.endpoint_id", (-F.col("b.s")).alias("score"))

    out = [row(urls.join(registry.whole.withColumnRenamed("path", "candidate"), "candidate"), 10)]
    shorter = urls.select("candidate", F.explode(ends_of(parts_of(F.col("candidate")), 1)).alias("path"))
    out.append(row(shorter.join(registry.whole, "path"), 7))
    out.append(row(urls.join(registry.tails, "candidate"), 5))
    out.append(row(at.filter("dir = 'f' AND d = size(parts)").join(registry.templates, "node"), 8))
    rest = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.col("d") + 1, F.size("parts")), "/"))
    open_ = at.filter("dir = 'f' AND d < size(parts)").withColumn("rest", rest).withColumn("end", F.element_at("parts", F.lit(-1))).withColumn("last", F.explode(F.array(F.col("end"), F.lit(""))))
    spread = registry.spreads.withColumn("last", F.coalesce("last", F.lit("")))
    out.append(row(open_.join(spread, ["node", "last"]).filter(F.rlike("rest", "pattern")), 8))
    # Where a URL leaves the trie from the end. The last part is the empty one: what ends with the URL as a text scores by that.
    left = at.filter("dir = 'b' AND d < size(parts)").withColumn("s", F.element_at("parts", F.col("d") + 1)).filter("NOT (same AND s = '')")
    met = left.join(registry.branches, "node")
    other = F.filter("fixed", lambda b: (b["s"] != F.col("s")) & ~((b["s"] == "") & F.col("same")))
    out.append(row(met.filter("d >= 2").withColumn("endpoint_id", F.try_element_at(other, F.lit(1))["endpoint_id"]).filter("endpoint_id IS NOT NULL"), F.col("d") + 1))
    # A variable stands for the place before the first slash as well.
    out.append(row(met.filter("s = '' AND d >= 1 AND varied IS NOT NULL").withColumn("endpoint_id", F.col("varied")), F.col("d") + 2))
    two = F.slice(F.concat(F.reverse(parts_of(F.col("candidate"))), F.array(F.lit(""))), 1, 2)
    a, b = F.try_element_at(two, F.lit(1)), F.try_element_at(two, F.lit(2))
    keys = F.array_distinct(F.array(*[F.concat(x, F.lit("/"), y) for x in (a, F.lit("{}")) for y in (b, F.lit("{}"))]))
    met = urls.withColumn("pair", F.explode(keys)).join(registry.irregular, "pair").withColumn("score", score_of(F.col("candidate"), F.col("path")))
    out.append(row(met, F.col("score")))
    return reduce(DataFrame.unionByName, out)
