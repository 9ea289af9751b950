"""Composed stages of record keeping: canonical facts, signals, context selection, cohort gate, review and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.functions import scalars as S
from vintara.operators import contexts, gates, periods, pit, scoring, timeseries
from vintara.plans import stages
from vintara.sources import landing


def canonical_facts(candidates: DataFrame, inline: DataFrame, targets: DataFrame, mapping: DataFrame, url: str) -> DataFrame:
    """Every candidate with its decision: CANONICAL, or the first thing that keeps it out.

    ``candidates`` has issuer, form, report_period, url and the keys of ``contexts.MATCH``; it must
    agree with its target (by accession) in issuer, form and report period, and its url with the
    template ``url`` (printf form, of the accession). Then it needs one context without dimensions,
    a mapped concept, and the best priority of its issuer, concept, period and filing. Targets with
    one accession twice fail the job.
    """
    want = gates.require_unique(targets, ("accession",)).select("accession", *[F.col(c).alias(f"_t_{c}") for c in ("issuer", "form", "report_period")])
    rows = contexts.match_contexts(candidates, inline).join(want, "accession", "left")
    agrees = F.col("_t_issuer").isNotNull() & F.col("issuer").eqNullSafe(F.col("_t_issuer")) & F.col("form").eqNullSafe(F.col("_t_form")) & F.col("report_period").eqNullSafe(F.col("_t_report_period"))
    own = mapping.select(F.col("taxonomy_concept").alias("local_concept"), "canonical_concept", "priority")
    rows = rows.join(F.broadcast(own), "local_concept", "left")  # the list of concepts
    early = S.first_reason((F.col("_t_issuer").isNull(), "NO_TARGET"), (~agrees, "TARGET_MISMATCH"), (F.col("url") != F.format_string(url, "accession"), "URL_MISMATCH"), (F.col("match") != "EXACT", "CONTEXT"), (F.col("canonical_concept").isNull(), "UNMAPPED_CONCEPT"))
    rows = rows.withColumn("_early", F.when(early == "CONTEXT", F.col("match")).otherwise(early)).drop("_t_issuer", "_t_form", "_t_report_period")
    keys = ("issuer", "canonical_concept", "start", "end", "accession")
    # what is kept out early has no say, and stays in its place
    rows = rows.withColumns({f"_{c}": F.when(F.col("_early").isNull(), F.col(c)) for c in ("priority", "value")})
    decision = F.coalesce("_early", F.when(F.col("choice") == "SELECTED", "CANONICAL").otherwise(F.col("choice")))
    chosen = pit.choose_by_priority(rows, keys, "_priority", "_value").withColumn("decision", decision)
    return chosen.withColumn("duration", S.duration_class(F.col("start"), F.col("end"))).drop("_early", "_priority", "_value", "choice")


def signals(facts: DataFrame) -> DataFrame:
    """Signals of reported facts: validated standalone quarters, then all observations on them."""
    quarters = periods.standalone_quarters(facts).where(F.col("status").startswith("PASS_") & F.col("value").isNotNull())
    cells = quarters.select("issuer", "concept", "q_start", "q_end", F.quarter("q_start").alias("fiscal_quarter"), "value")
    rows = timeseries.year_over_year(timeseries.trailing(timeseries.mark_runs(cells)))
    for name in ("q_yoy", "ttm_yoy"):
        rows = timeseries.acceleration(rows, name)
    return timeseries.roll_forward(rows)


def verified_signals(documents: DataFrame, candidates: DataFrame, targets: DataFrame, mapping: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, signals): candidate facts proved by the contexts of the filings' own documents, and the signals of those that are canonical.

    ``documents`` has accession and html. Tagged facts are taken from them, joined with their contexts and
    read as numbers; every candidate must find exactly one context without dimensions that reports its concept, dates and value
    (``canonical_facts``). Only canonical facts go on to quarters and observations, under their canonical concept; a fact that
    the documents do not prove is a hole, to be filled from year-to-date facts where these are proved.
    """
    tagged = landing.tagged_facts(landing.html_elements(documents, "accession", "html"), "accession").where("match = 'FOUND'")
    kind = candidates.schema["value"].dataType
    inline = tagged.select("accession", S.local_name(F.col("name")).alias("local_concept"), "start", "end", S.accounting_number(F.col("text")).cast(kind).alias("value"), "context_id", "dimensions")
    decisions = canonical_facts(candidates, inline, targets, mapping, url)
    proved = decisions.where("decision = 'CANONICAL'").drop("concept").withColumnRenamed("canonical_concept", "concept")
    return decisions, signals(proved)


def select_batch(companyfacts: DataFrame, inline: DataFrame, keys: tuple[str, ...], context: str, value: str, needed: int) -> DataFrame:
    """Per key: the value and sorted contexts from the first source, or from the second where the first has none, and whether enough components are there."""

    def of(rows: DataFrame, source: str) -> DataFrame:
        one = rows.groupBy(*keys).agg(F.sum(value).alias(value), F.array_join(F.array_sort(F.collect_set(context)), "|").alias("contexts"), F.count_distinct(context).alias("components"))
        return one.withColumn("source", F.lit(source))

    both = gates.fallback_union(of(companyfacts, "COMPANYFACTS"), of(inline, "INLINE"), keys)
    return both.withColumn("selection", F.when(F.col("components") >= needed, "COMPLETE").otherwise("INCOMPLETE"))


def combine_cohort(waves: list[DataFrame], roster: DataFrame, before: DataFrame, key: str, status: str) -> DataFrame:
    """(gate, detail, n) of several waves taken as one cohort: repeated and missing and unexpected members, cells changed since ``before``, and counts by status."""
    rows = waves[0]
    for wave in waves[1:]:
        rows = rows.unionByName(wave, allowMissingColumns=True)
    sides = gates.set_difference(rows, roster, (key,))
    count = lambda frame, gate: frame.agg(F.lit(gate).alias("gate"), F.lit("").alias("detail"), F.count(F.lit(1)).alias("n"))
    out = count(gates.duplicates(rows, (key,)), "REPEATED_MEMBER")
    out = out.unionByName(count(sides.where("side = 'RIGHT_ONLY'"), "MISSING_MEMBER")).unionByName(count(sides.where("side = 'LEFT_ONLY'"), "UNEXPECTED_MEMBER"))
    changed = gates.cell_differences(before, rows.select(*before.columns), (key,)).groupBy(F.lit("CHANGED_CELL").alias("gate"), F.col("field").alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(changed).unionByName(rows.groupBy(F.lit("STATUS").alias("gate"), F.col(status).alias("detail")).agg(F.count(F.lit(1)).alias("n")))


def independent_review(previous: DataFrame, reviewed: DataFrame, composite: DataFrame, weight: float) -> DataFrame:
    """Model date and issuer: family findings, breadth anew, and the composite with it.

    ``previous`` and ``reviewed`` are family classes; the composite moves by ``weight`` times the
    change of breadth, and is null where breadth is.
    """
    keys = list(stages.KEYS)
    long = lambda rows: rows.select(*keys, *stages.FAMILIES).unpivot(keys, list(stages.FAMILIES), "family", "class")
    findings = long(previous).withColumnRenamed("class", "_old").join(long(reviewed), [*keys, "family"]).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("_old") != F.col("class"), F.concat_ws(":", "family", "_old", "class")))), "|").alias("findings"))
    breadth = lambda rows, name: scoring.breadth(long(rows), 0.25, stages.KEYS).select(*keys, F.col("breadth_score").alias(name))
    rows = findings.join(breadth(previous, "old_breadth"), keys).join(breadth(reviewed, "new_breadth"), keys).join(composite.select(*keys, "composite"), keys, "left")
    return rows.withColumn("reviewed_composite", F.col("composite") + weight * (F.col("new_breadth") - F.col("old_breadth")))


def prepare(requests: DataFrame, symbols: DataFrame, filings: DataFrame, model_date: str, last: int = 12) -> DataFrame:
    """Requested symbols to their entity, its target filings and whether its history suffices; what cannot be used has its exception."""
    who = contexts.resolve_identity(requests, symbols)
    targets = pit.last_periods(pit.latest_vintage(pit.eligible(filings, model_date)), last)
    audit = pit.history_audit(targets).join(targets.groupBy("issuer").agg(F.count(F.lit(1)).alias("targets"), F.max("report_period").alias("latest_period")), "issuer")
    rows = who.join(audit.select(F.col("issuer").alias("entity"), "targets", "latest_period", "history"), "entity", "left")
    exception = F.when(F.col("resolution") != "RESOLVED", F.col("resolution")).when(F.col("targets").isNull(), "NO_ELIGIBLE_FILINGS").when(F.col("history") != "PASS_TARGET_HISTORY", F.col("history"))
    return rows.withColumn("exception", exception).select("symbol", "entity", F.coalesce("targets", F.lit(0)).alias("targets"), "latest_period", "exception")


def mapping_continuity(facts: DataFrame, rules: DataFrame, eligible: DataFrame, unit: str = "USD") -> tuple[DataFrame, DataFrame]:
    """(evidence, summary) of rules that add several reported components up to one concept.

    ``facts`` has issuer, taxonomy_concept, unit, accession, start, end, value; ``rules`` issuer, rule_id, canonical_concept, component, a row a
    component; ``eligible`` the filings (issuer, accession) known on the model date. Evidence is a row for each rule, filing and
    period that has any component: the total where all are there, else what is missing. Of a component reported twice in one filing and period
    the greatest value counts. A rule is APPROVED when it has rows and all are complete, else REVIEW_REQUIRED; rules without rows have a summary too.
    """
    needed = rules.groupBy("issuer", "rule_id", "canonical_concept").agg(F.array_sort(F.collect_set("component")).alias("components"))
    usable = facts.where(F.col("unit") == unit).join(eligible.select("issuer", "accession").distinct(), ["issuer", "accession"], "left_semi")
    met = usable.join(rules.select("issuer", "rule_id", F.col("component").alias("taxonomy_concept")).distinct(), ["issuer", "taxonomy_concept"])
    one = met.groupBy("issuer", "rule_id", "accession", "start", "end", "taxonomy_concept").agg(F.max("value").alias("value"))
    found = one.groupBy("issuer", "rule_id", "accession", "start", "end").agg(F.sum("value").alias("_total"), F.collect_set("taxonomy_concept").alias("_found"))
    judged = found.join(needed, ["issuer", "rule_id"])
    missing = F.array_except("components", "_found")
    evidence = judged.select("issuer", "rule_id", "canonical_concept", "accession", "start", "end", F.size("components").alias("required"), F.size("_found").alias("present"), F.array_join(missing, "|").alias("missing"), F.when(F.size(missing) == 0, F.col("_total")).alias("canonical_value"))
    done = F.col("missing") == ""
    counts = evidence.groupBy("issuer", "rule_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("complete_rows"), F.count_distinct(F.when(done, F.struct("start", "end"))).alias("complete_periods"), F.min(F.when(done, F.col("end"))).alias("earliest_end"), F.max(F.when(done, F.col("end"))).alias("latest_end")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole = (F.col("rows") > 0) & (F.col("rows") == F.col("complete_rows"))
    summary = needed.join(counts, ["issuer", "rule_id"], "left").select("issuer", "rule_id", "canonical_concept", F.array_join("components", "+").alias("components"), n("rows"), n("complete_rows"), n("complete_periods"), "earliest_end", "latest_end", F.when(whole, "APPROVED").otherwise("REVIEW_REQUIRED").alias("mapping_status"))
    return evidence, summary
