"""Reports as text columns and as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions import scalars
from archgraph.operators import impact

# Signs and texts of the report's format.
ICONS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
TYPE_ICONS = {"Controller": "🎮", "Service": "⚙️", "Repository": "🗄️", "KafkaListener": "📨"}
OTHER_ICON = "📄"
STATUS_BADGES = {"added": "🆕 added", "removed": "❌ removed", "modified": "✏️ modified", "renamed": "➡️ renamed"}
TITLE = "## 🏗️ Architecture Impact Report"
RISK = "## 🎯 Risk Assessment\n\n**Overall Risk: {level}** {icon}  \n**Risk Score: {total}/100**"
SCORES = (
    ("- 🔴 Breaking Changes: {n}/40", "breaking", 20, " (High impact)"),
    ("- 🟡 Downstream Impact: {n}/30", "downstream", 15, " (Significant)"),
    ("- 🟢 Service Criticality: {n}/20", "criticality", 12, " (Critical services)"),
    ("- 🟢 Change Complexity: {n}/10", "complexity", 7, " (Complex)"),
)
COUNTS = (
    ("| Architecture components changed | {n} |", "components"), ("| Endpoints affected (in this service) | {n} |", "endpoints"),
    ("| Request flows affected | {n} |", "flows"), ("| New circular dependencies | {n} |", "cycles"),
)
URL_COUNTS = (("| ⚠️ **API URL changes** | **{n}** |", "url_changes"), ("| ⚠️ **Downstream consumers affected** | **{n}** |", "consumers"))
URL_WARNING = (
    "### 🚨 CRITICAL: API URL Changes Detected\n\n> **WARNING:** Service-to-service API endpoint URLs have been changed. This **WILL BREAK** communication between services unless coordinated across all consumers.\n\n{lines}\n\n"
    "**Required Actions:**\n1. ✋ **STOP** - Do not merge without coordination\n2. Review consumer list below\n3. Update consumers OR revert these URL changes\n4. Deploy changes in coordinated manner"
)
URL_DETAIL = "#### {name}\n\n**WHAT Changed:**\n- Old URL: `{old}`\n- New URL: `{new}`\n- Change Type: {kind}\n- Breaking Score: {points}/40 points\n\n**WHO is Affected:**\n"
CONSUMED = "⚠️ **{n} downstream consumer(s) detected:**\n\n**HOW to Fix:**\n- **Option 1 (Recommended):** Revert this URL change to `{old}`\n- **Option 2:** Update all consumer services listed above to use `{new}`\n- **Option 3:** Support both URLs temporarily (add endpoint alias at target service)"
UNCONSUMED = (
    "⚠️ **No consumers detected** - This may indicate:\n- Dead code (endpoint never called)\n- External service call (not in current graph)\n- Graph analysis limitation\n\n"
    "**HOW to Fix:**\n- Verify this endpoint is actually used (may be dead code)\n- Check logs for calls to `{old}`\n- If unused, safe to change; if used externally, coordinate with external teams"
)
COMPONENT_ROWS = "### Changed Components\n\n| Type | Class | Status | +/- |\n|------|-------|--------|-----|\n{lines}"
ENDPOINT_ROWS = "### Affected Endpoints\n\n| Method | Path | Reason |\n|--------|------|--------|\n{lines}"
FLOW_ROWS = "### Affected Request Flows\n\n{lines}"
CYCLE_ROWS = "### :warning: New Circular Dependencies\n\n{lines}"
DIFF_ROWS = "### Graph Diff Summary\n\n| Change Type | Count |\n|-------------|-------|\n{lines}"
NOTE_ROWS = "### Notes\n\n{lines}"
FAILED = "> **Analysis failed** for branch `{branch}`\n\n**Error:** {error}\n\nThe shadow graph analysis could not be completed. This may be due to compilation issues in the branch or infrastructure problems.\n\n---"
RUNNING = "> **Analyzing** branch `{branch}` ...\n\nShadow graph analysis is in progress. This comment will be updated with results.\n\n---"


def put(text: str, **values: Column) -> Column:
    """A text with its {name} marks replaced; null values show as nothing."""
    out = F.lit(text)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def looked_up(values: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), other)


def risk_section(factors: Column) -> Column:
    """Score, factors by severity, actions, deployment and merge status. factors: array<struct<severity, description>>."""
    c = F.col
    head = put(RISK, level=c("level"), icon=looked_up(ICONS, c("level"), F.lit("")), total=c("total"))
    scores = F.concat_ws("\n", F.lit("### Score Breakdown"), *[F.concat(put(text, n=c(name)), F.when(c(name) >= least, mark).otherwise("")) for text, name, least, mark in SCORES])
    of = lambda severity: F.transform(F.filter(factors, lambda f: f["severity"] == severity), lambda f: F.concat(F.lit("- "), f["description"]))
    block = lambda severity: F.when(F.size(of(severity)) > 0, F.concat(F.lit(f"**{severity} SEVERITY**\n"), F.array_join(of(severity), "\n")))
    named = F.when(F.size(factors) > 0, F.concat_ws("\n\n", F.lit("### ⚠️ Key Risk Factors"), *[block(x) for x in ("HIGH", "MEDIUM", "LOW")], F.lit("---")))
    steps = F.when(F.size(impact.actions()) > 0, F.concat(F.lit("### ✅ Recommended Actions\n\n**Before Merging:**\n- [ ] "), F.array_join(impact.actions(), "\n- [ ] ")))
    plan = impact.deployment()
    flag = F.when(plan["feature_flag"], "- Feature flag: **Required**").otherwise("- Feature flag: Not required")
    deploy = F.concat_ws("\n", F.lit("**Deployment Strategy:**"), F.concat(F.lit("- "), plan["recommendation"]), flag, F.concat(F.lit("- Reasoning: "), plan["reasoning"]))
    return F.concat_ws("\n\n", head, scores, F.lit("---"), named, steps, deploy, F.concat(F.lit("**Merge Status:** "), impact.merge_status()), F.lit("---"))


def summary_section() -> Column:
    c = F.col
    value = lambda name: c("error_cycles") + c("warning_cycles") if name == "cycles" else c(name)
    rows = [put(text, n=value(name)) for text, name in COUNTS] + [F.when(c("url_changes") > 0, put(text, n=c(name))) for text, name in URL_COUNTS]
    return F.concat_ws("\n", F.lit("### Summary\n\n| Metric | Count |\n|--------|-------|"), *rows)


def gathered_lines(rows: DataFrame, key: str, line: Column, order: list[str], name: str, template: str, join: str = "\n") -> DataFrame:
    """(key, name): a section of each change from its rows' lines in order."""
    made = rows.select(key, F.struct(*order, line.alias("line")).alias("l")).groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return made.select(key, put(template, lines=F.array_join("ls.line", join)).alias(name))


def sections(key: str, urls: DataFrame | None = None, components: DataFrame | None = None, endpoints: DataFrame | None = None, flows: DataFrame | None = None, cycles: DataFrame | None = None, diff: DataFrame | None = None, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sections of the tables that are given, in the report's order, each (key, name).

    urls (old_url, new_url, kind, points, consumers, filename); components (type, class_name, status, added, removed); endpoints (verb, path, reason);
    flows (endpoint, chain array<string>, affected_at); cycles (signature, severity); diff (part, change, n); notes (note).
    """
    c = F.col
    out = {}
    if urls is not None:
        out["url_warning"] = gathered_lines(urls, key, F.concat(F.lit("- "), c("old_url"), F.lit(" → "), c("new_url")), ["old_url", "new_url"], "url_warning", URL_WARNING)
        name = F.coalesce(scalars.simple_name(scalars.class_of_file("filename")), c("filename"))
        detail = F.concat(put(URL_DETAIL, name=name, old=c("old_url"), new=c("new_url"), kind=c("kind"), points=c("points")), F.when(c("consumers") > 0, put(CONSUMED, n=c("consumers"), old=c("old_url"), new=c("new_url"))).otherwise(put(UNCONSUMED, old=c("old_url"))))
        out["url_details"] = gathered_lines(urls, key, detail, ["old_url", "new_url"], "url_details", "### 📋 API URL Change Impact Analysis\n\n{lines}", "\n\n")
    if components is not None:
        line = F.concat(F.lit("| "), looked_up(TYPE_ICONS, c("type"), F.lit(OTHER_ICON)), F.lit(" "), c("type"), F.lit(" | `"), c("class_name"), F.lit("` | "), looked_up(STATUS_BADGES, c("status"), c("status")), F.lit(" | +"), c("added").cast("string"), F.lit(" -"), c("removed").cast("string"), F.lit(" |"))
        out["components_section"] = gathered_lines(components.filter("type <> 'Other'"), key, line, ["type", "class_name"], "components_section", COMPONENT_ROWS)
    if endpoints is not None:
        line = F.concat(F.lit("| `"), c("verb"), F.lit("` | `"), c("path"), F.lit("` | "), F.coalesce("reason", F.lit("Affected")), F.lit(" |"))
        out["endpoints_section"] = gathered_lines(endpoints, key, line, ["path", "verb"], "endpoints_section", ENDPOINT_ROWS)
    if flows is not None:
        steps = F.transform("chain", lambda x: F.concat(F.when(x == c("affected_at"), " >> ").otherwise("    "), x))
        line = F.concat(F.lit("**"), c("endpoint"), F.lit("**\n```\n"), F.array_join(steps, "\n    |\n"), F.lit("\n```"))
        out["flows_section"] = gathered_lines(flows, key, line, ["endpoint"], "flows_section", FLOW_ROWS, "\n\n")
    if cycles is not None:
        line = F.concat(F.when(c("severity") == "ERROR", ":x:").otherwise(":warning:"), F.lit(" **Circular dependency**\n```\n"), F.replace("signature", F.lit(">"), F.lit(" -> ")), F.lit("\n```"))
        out["cycles_section"] = gathered_lines(cycles, key, line, ["severity", "signature"], "cycles_section", CYCLE_ROWS, "\n\n")
    if diff is not None:
        word = F.when(c("part") == "node", "Nodes").otherwise("Relationships")
        line = F.concat(F.lit("| "), word, F.lit(" "), F.lower("change"), F.lit(" | "), c("n").cast("string"), F.lit(" |"))
        out["diff_section"] = gathered_lines(diff.groupBy(key, "part", "change").agg(F.sum("n").alias("n")), key, line, ["part", "change"], "diff_section", DIFF_ROWS)
    if notes is not None:
        out["notes_section"] = gathered_lines(notes, key, F.concat(F.lit("- "), c("note")), ["note"], "notes_section", NOTE_ROWS)
    return out


def impact_report(scored: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """(key, body): a report for each scored change: risk, summary, and a section for each table of sections() that is given and has rows of it."""
    factors = impact.risk_factors(scored, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "severity", "description"))).alias("__factors"))
    rows = scored.join(factors, key, "left").withColumn("__factors", F.coalesce("__factors", F.array().cast(factors.schema["__factors"].dataType)))
    made = sections(key, **tables)
    for part in made.values():
        rows = rows.join(part, key, "left")
    return rows.select(key, F.concat_ws("\n\n", F.lit(TITLE), risk_section(F.col("__factors")), summary_section(), *made, F.lit("---")).alias("body"))


def comment(state: Column, branch: Column, error: Column) -> Column:
    """The comment of a change whose analysis failed or still runs; null for others."""
    body = F.when(state == "FAILED", put(FAILED, branch=branch, error=error)).when(state.isin("PENDING", "ANALYZING"), put(RUNNING, branch=branch))
    return F.concat(F.lit(TITLE + "\n\n"), body)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template's {{KEY}} marks replaced; null gives '', marks without a value stay."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def application_report(applications: DataFrame, nodes: DataFrame) -> DataFrame:
    """Applications with their services, and for each service its numbers: nested rows. Sizes are counts, lists are of services only."""
    inner = nodes.filter("owner IS NOT NULL").groupBy("app_key", "owner").agg(F.count(F.when(F.col("type") == "Endpoint", 1)).alias("endpoints"), F.count(F.when(F.col("type") == "Method", 1)).alias("methods"), F.count(F.when(F.col("type") == "Repository", 1)).alias("repositories"))
    listed = inner.groupBy("app_key").agg(F.array_sort(F.collect_list(F.struct("owner", "endpoints", "methods", "repositories"))).alias("services"))
    return applications.select("app_key", "label").join(listed, "app_key", "left")


def detail_report(subjects: DataFrame, nodes: DataFrame, edges: DataFrame, sections: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, section, position, item, label): the items of each section of each subject, flat and in order of label.

    A section is a type of edge and its direction, 'out' or 'in': an application's are its components, topics and tables, a controller's its endpoints,
    an endpoint's its calls and topics, a service's its methods and callers, a repository's its tables.
    """
    kinds = F.create_map(*[F.lit(x) for name, (kind, way) in sections.items() for x in (f"{way} {kind}", name)])
    own = subjects.select("id").distinct()
    named = nodes.select(F.col("id").alias("item"), "label")
    one = lambda a, b, way: edges.select(F.col(a).alias("id"), F.col(b).alias("item"), F.concat(F.lit(f"{way} "), F.col("type")).alias("k")).join(own, "id", "left_semi")
    rows = one("src", "dst", "out").unionByName(one("dst", "src", "in")).withColumn("section", F.try_element_at(kinds, F.col("k"))).filter("section IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("id", "section").orderBy("label", "item"))
    return rows.select("id", "section", "item").distinct().join(named, "item", "left").select("id", "section", place.alias("position"), "item", "label")


def external_graph(calls: DataFrame, resolved: bool | None = None) -> DataFrame:
    """(src, dst, label, colour, resolved): outgoing calls drawn at what makes them: all, or only the resolved or the open ones. calls (node_id, call_id, verb, url, resolved)."""
    rows = calls if resolved is None else calls.filter(F.coalesce("resolved", F.lit(False)) == resolved)
    known = F.coalesce("resolved", F.lit(False))
    label = F.concat(F.coalesce("verb", F.lit("UNKNOWN")), F.lit(" "), F.coalesce("url", F.lit("")))
    return rows.select(F.col("node_id").alias("src"), F.col("call_id").alias("dst"), label.alias("label"), F.when(known, "#4CAF50").otherwise("#F44336").alias("colour"), known.alias("resolved")).distinct()


def topic_graph(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Edges between topics and their two sides: (src, dst, type). producers (id, topic), consumers (id, topic)."""
    a = producers.select(F.col("id").alias("src"), F.concat(F.lit("topic:"), F.col("topic")).alias("dst"), F.lit("PRODUCES_TO").alias("type"))
    b = consumers.select(F.concat(F.lit("topic:"), F.col("topic")).alias("src"), F.col("id").alias("dst"), F.lit("CONSUMED_BY").alias("type"))
    return a.union(b).distinct()


def access_graph(repositories: DataFrame, accesses: DataFrame, first_only: bool = False) -> DataFrame:
    """(repository, table): every repository, with each of its tables or the least one; null without any."""
    found = accesses.select(F.col("src").alias("repository"), F.col("dst").alias("table")).distinct()
    if first_only:
        found = found.groupBy("repository").agg(F.min("table").alias("table"))
    return repositories.select(F.col("id").alias("repository")).join(found, "repository", "left")


def numbered_context(hits: DataFrame, text: str = "text") -> DataFrame:
    """One row with the hits' texts as numbered blocks that keep their rank, or an answer that nothing was found."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    blocks = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["t"])), "\n\n")
    return hits.agg(F.count("*").alias("n"), blocks.alias("context")).select("n", F.when(F.col("n") == 0, "Nothing relevant was found.").otherwise(F.col("context")).alias("context"))


def prompt(question: Column, context: Column) -> Column:
    """The text for a language model; calling one is left to the caller."""
    return F.concat(F.lit("Answer from the context only.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)
