"""What is done with findings: keys, order, counts, gates, statuses, masks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import TASK_PAIRS, first_come
from ..functions.ordering import GROUP_ROWS, positions_within
from ..functions.values import ancestors, finding_key, scope, severity, severity_rank, visual_of_path

#: The total order of findings; nulls count as empty.
ORDER = ("path", "category", "change", "message", "old", "new")

#: Findings or keys that one row of a list holds; longer lists go on in further parts.
PART = 10_000


def order_columns(columns=ORDER) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")) for c in columns]


def completed(findings: DataFrame) -> DataFrame:
    """Adds scope, severity and the base key."""
    out = findings.withColumns({"scope": scope(F.col("category")), "severity": severity(F.col("category"), F.col("change"))})
    return out.withColumn("base_key", finding_key(F.col("scope"), F.col("category"), F.col("change"), F.col("path")))


def numbered(findings: DataFrame, by: list[str], most: int = GROUP_ROWS) -> DataFrame:
    """Stable keys: repeats of a key in a run get #2, #3, ... in sort order, findings that are equal in it by their other columns, so that other findings never change a key. A key of more than `most` findings is numbered in many tasks."""
    own = [c for c in ORDER if c in findings.columns]
    rest = [c for c in findings.columns if c not in own]
    n = F.col("_number")
    placed = positions_within(findings, [*by, "base_key"], order_columns([*own]) + [F.col(c).cast("string") for c in rest], "_number", most)
    return placed.withColumn("key", F.when(n > 1, F.concat(F.col("base_key"), F.lit("#"), n)).otherwise(F.col("base_key"))).drop("_number")


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold)))


def not_fully_validated(findings: DataFrame) -> DataFrame:
    return findings.where((F.col("category") == "data") & (F.col("change") == "error"))


def most_severe(findings: DataFrame, most: int = 50, threshold: str = "info") -> DataFrame:
    """The first findings by severity, then in their order; those of the helper are left out."""
    return at_least(findings.where("category <> 'ai'"), threshold).orderBy(severity_rank(F.col("severity")).desc(), *order_columns([c for c in ORDER if c in findings.columns])).limit(most)


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Per run and in total (by is null there): findings of each severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")]
    return findings.rollup(*by).agg(*counts)


def category_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by, "category").agg(F.count("*").alias("n"))


def status_overview(summaries: DataFrame) -> DataFrame:
    return summaries.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "different", "not_validated")])


def gate(findings: DataFrame, by: list[str], threshold: str = "critical", on_unvalidated: bool = True) -> DataFrame:
    """(by.., severe, unvalidated, failed): helper findings never fail a run."""
    own = F.col("category") != "ai"
    severe = F.count_if(own & (severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold))))
    open_ = F.count_if((F.col("category") == "data") & (F.col("change") == "error"))
    out = findings.groupBy(*by).agg(severe.alias("severe"), open_.alias("unvalidated"))
    return out.withColumn("failed", (F.col("severe") > 0) | (F.lit(on_unvalidated) & (F.col("unvalidated") > 0)))


def run_gate(runs: DataFrame) -> DataFrame:
    """The severity of projects that have no findings of their own: removed ones are critical, added ones information."""
    return runs.withColumn("severity", F.when(F.col("status") == "removed", "critical").when(F.col("status") == "added", "info").when(F.col("status") == "error", "critical"))


def item_status(items: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """Status of items(by.., path, side): added or removed where only one side has it and a finding says so, else modified if a page-scoped finding is at or under the path, else unchanged.

    Containment is made an equality: every finding stands at its path and at all folders above.
    """
    placed = findings.where("scope = 'page'").select(*by, F.explode(ancestors(F.col("path"))).alias("path"), (F.col("change")).alias("_c"), F.col("path").alias("_at"))
    own = placed.groupBy(*by, "path").agg(F.count("*").alias("_n"), F.max(F.when((F.col("_at") == F.col("path")) & F.col("_c").isin("added", "removed"), F.col("_c"))).alias("_said"))
    out = items.join(own, [*by, "path"], "left")
    one = F.when(F.col("side") == "new", "added").when(F.col("side") == "old", "removed")
    status = F.when(one.isNotNull() & (F.col("_said") == one), one).when((F.coalesce("_n", F.lit(0)) > 0) | one.isNotNull(), "modified").otherwise("unchanged")
    return out.withColumn("status", status).drop("_n", "_said")


def in_parts(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Adds `part`, from 0: the group's rows in order, `most` to a part."""
    return positions_within(rows, by, order, "_position").withColumn("part", F.expr(f"(_position - 1) div {int(most)}")).drop("_position")


def by_visual(findings: DataFrame, visuals: DataFrame, by: list[str], most: int = PART) -> DataFrame:
    """(by.., visual, part, n, keys): findings on known visuals, by their own visual_path or the first two segments of a page-scoped path; keys in order, at most `most` in a part."""
    key = F.coalesce(F.col("visual_path"), F.when(F.col("scope") == "page", visual_of_path(F.col("path"))))
    placed = findings.withColumn("visual", key).join(visuals.select(*by, "visual").distinct(), [*by, "visual"], "left_semi")
    dealt = in_parts(placed.select(*by, "visual", "key"), [*by, "visual"], [F.col("key")], most)
    return dealt.groupBy(*by, "visual", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))


def masked_findings(findings: DataFrame, allow_data: bool = False) -> DataFrame:
    """What may leave: no keys, no locations, and of data findings no row path, message or values."""
    hide = (F.col("category") == "data") & F.lit(not allow_data)
    path = F.when(hide, F.concat(visual_of_path(F.col("path")), F.lit("/data"))).otherwise(F.col("path"))
    return findings.select("category", "change", "severity", path.alias("path"), *[F.when(~hide, F.col(c)).alias(c) for c in ("message", "old", "new")])


def masked_summaries(summaries: DataFrame, allow_data: bool = False) -> DataFrame:
    return summaries if allow_data else summaries.withColumns({"max_abs_delta": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pairable_categories(findings: DataFrame) -> DataFrame:
    """Categories that have both removed and added findings, of pages, visuals and measures."""
    one = lambda change: findings.where((F.col("change") == change) & F.col("category").isin("page", "visual", "measure")).select("category")
    return one("removed").intersect(one("added"))


def vetted(proposals: DataFrame, removed: DataFrame, added: DataFrame, by: list[str], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Proposed renames(by.., position, category, old, new, confidence) whose ends are known, of one category, each path used once in the order of proposals (by their ends where positions repeat); confidence within 0 and 1."""
    known = proposals.join(removed.select(*by, "category", F.col("path").alias("old")).distinct(), [*by, "category", "old"]).join(added.select(*by, "category", F.col("path").alias("new")).distinct(), [*by, "category", "new"])
    known = known.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return first_come(known, [*by, "category"], [F.col("position"), F.col("old"), F.col("new")], task_pairs)


def with_explanations(findings: DataFrame, texts: DataFrame, most: int = 600) -> DataFrame:
    """Attaches texts(id, position, text): the first per id that is not blank, cut to `most` characters."""
    clean = texts.withColumn("text", F.trim("text")).where("text <> ''")
    first = clean.groupBy("id").agg(F.min_by("text", "position").alias("_t"))
    return findings.join(first, "id", "left").withColumn("explanation", F.substring("_t", 1, most)).drop("_t")


def markdown(findings: DataFrame, by: list[str], limit: int = 65_536 - 1_000) -> DataFrame:
    """(by.., text, shown, more): findings by category and order, under category headings, up to the size limit; the first block that would exceed it ends the text. Nulls count as empty.

    No block is shorter than its marks, so only so many first findings can fit. The first of each
    task's findings hold the first of all: no task sorts more of a run than that.
    """
    by_order = ["category", *[c for c in ORDER if c in findings.columns]]
    most = limit // len("- :  \n") + 1
    filled = findings.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in dict.fromkeys([*by_order, "severity"])])
    first = lambda rows, within: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*by_order))).where(F.col("_n") <= most)
    near = first(first(filled.withColumn("_task", F.spark_partition_id()), [*by, "_task"]), by)
    w = Window.partitionBy(*by).orderBy("_n")
    head = F.when(F.lag("category").over(w).eqNullSafe(F.col("category")), F.lit("")).otherwise(F.concat(F.lit("\n## "), F.col("category"), F.lit("\n\n")))
    block = F.concat(head, F.lit("- "), F.col("severity"), F.lit(": "), F.col("path"), F.lit(" "), F.col("change"), F.lit("\n"))
    sized = near.withColumn("_b", block).withColumn("_sum", F.sum(F.length("_b")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = sized.where(F.col("_sum") <= limit).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "_b"))).alias("_l"))
    texts = kept.select(*by, F.array_join(F.transform("_l", lambda x: x["_b"]), "").alias("text"), F.size("_l").cast("bigint").alias("shown"), F.lit(0).cast("bigint").alias("_all"))
    counts = filled.groupBy(*by).agg(F.count("*").alias("_all")).select(*by, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("shown"), "_all")
    each = texts.unionByName(counts).groupBy(*by).agg(F.max("text").alias("text"), F.sum("shown").alias("shown"), F.sum("_all").alias("_all"))
    return each.select(*by, "text", "shown", (F.col("_all") - F.col("shown")).alias("more"))


def documents(findings: DataFrame, by: list[str], most: int = PART) -> DataFrame:
    """(by.., part, document): a JSON document for each run, findings in their order; a run of more than `most` findings goes on in further documents. Nulls count as empty."""
    cols = [c for c in (*ORDER, *[c for c in findings.columns if c not in ORDER]) if c in findings.columns and c not in by]
    texts = findings.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    ordered = F.array_sort(F.collect_list(F.struct(*cols)))
    return in_parts(texts, by, [F.col(c) for c in cols], most).groupBy(*by, "part").agg(F.to_json(F.struct(F.lit("1").alias("version"), ordered.alias("findings"))).alias("document"))


def over_projects(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(position, path, status, critical, warning, info, document): the result over many projects, runs(path, status) in the order of paths; the row at 0, without a path, holds the totals.

    Findings(path of the project as `project`, severity) count for changed projects only: added,
    removed, skipped and failed ones were not compared. Each row has its JSON form.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")]
    found = findings.groupBy(F.col("project").alias("path")).agg(*counts)
    shown = [F.when(F.col("status") == "changed", F.coalesce(s, F.lit(0))).otherwise(0).cast("bigint").alias(s) for s in ("critical", "warning", "info")]
    each = positions_within(runs.select("path", "status").join(found, "path", "left").select("path", "status", *shown), [], [F.col("path")]).withColumn("position", F.col("position").cast("bigint"))
    total = each.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("critical", "warning", "info")]).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("status"), "critical", "warning", "info", F.lit(0).cast("bigint").alias("position"))
    document = F.to_json(F.struct("path", "status", F.struct("critical", "warning", "info").alias("severity_counts")))
    return each.unionByName(total).select("position", "path", "status", "critical", "warning", "info", document.alias("document"))


def in_view_order(items: DataFrame, by: list[str], ordinal: str | None = None) -> DataFrame:
    """Adds the place of items(by.., name, status) in a view: pages by their ordinal, removed ones after others of the same, then by name; without an ordinal, as visuals are, by name."""
    order = [F.col("name")] if ordinal is None else [F.col(ordinal), F.col("status") == "removed", F.col("name")]
    return positions_within(items, by, order).withColumn("position", F.col("position").cast("bigint"))


def write_findings(findings: DataFrame, path: str, by: list[str]) -> None:
    findings.write.partitionBy(*by).mode("overwrite").parquet(path)
