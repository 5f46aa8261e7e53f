"""Evaluation: verdicts against labels, rates by set and type, and the coverage score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the detection rates and the levels' least accuracies.
TYPE_WEIGHTS = {"false_attr": 0.3, "contradiction": 0.3, "fabrication": 0.25, "true_fact": 0.15}
LEVELS = [("EXCELLENT", 0.9), ("GOOD", 0.7), ("MODERATE", 0.5), ("WEAK", 0.3)]
# What each adapter takes for true and for false; anything else is unverifiable.
ADAPTERS = {
    "kb_probe": (["PASS", "SOFT_PASS"], ["CONTRADICT", "FAIL"]),
    "memory": (["verified"], ["refuted"]),
    "external": (["verified"], ["refuted"]),
    "judge": (["PASS"], ["FAIL"]),
    "self_consistency": (["PASS"], ["FAIL"]),
    "ground_store": ([], []),
}
# Algorithms that need a server, or whose model is a stand-in, and what calls for which work.
UNAVAILABLE, MOCKED = ("ground_store",), ("judge", "self_consistency")
TASKS = {
    "false_attr": ("HIGH", "Fix false attribution", "1-2 hours", "Match with regard to the subject"),
    "contradiction": ("HIGH", "Fix contradiction detection", "1-2 hours", "Add facts: birth places, locations, capitals"),
    "no ground_store": ("MEDIUM", "Deploy the ground-truth store", "4-8 hours", "Set up its server"),
    "no judge": ("LOW", "Enable a real model", "30 mins", "Provide a key for it"),
}


def as_bool(verdict: Column, adapter: str) -> Column:
    """What a verdict says of the claim; null where it is unverifiable, as anything of an unavailable algorithm is."""
    true, false = ADAPTERS[adapter]
    return F.when(verdict.isin(true), True).when(verdict.isin(false), False)


def judged_cases(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """cases joined with predictions (algo, case_id, verdict, actual, latency_ms): adds passed."""
    j = cases.join(predictions, "case_id")
    return j.withColumn("passed", F.coalesce(F.col("actual") == F.col("is_true"), F.lit(False)))


def metrics(results: DataFrame) -> DataFrame:
    """One pass of grouping sets: by (algo, set), (algo, type) and algo. tested, passed, rate, latency_ms; level_of says
    which grouping a row belongs to."""
    g = results.groupingSets([["algo", "set_key"], ["algo", "h_type"], ["algo"]], "algo", "set_key", "h_type")
    out = g.agg(F.count("*").alias("tested"), F.sum(F.col("passed").cast("long")).alias("passed"), F.avg("latency_ms").alias("latency_ms"), F.grouping("set_key").alias("__s"), F.grouping("h_type").alias("__t"))
    level = F.when(F.col("__s") == 0, "set").when(F.col("__t") == 0, "type").otherwise("all")
    return out.select("algo", "set_key", "h_type", "tested", "passed", "latency_ms", level.alias("level_of"), (F.col("passed") / F.col("tested")).alias("rate"))


def coverage(m: DataFrame) -> DataFrame:
    """algo, accuracy, score (40 accuracy + 40 weighted detection + 20 mean set accuracy), level and flags."""
    weights = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    of = lambda kind, c: F.when(F.col("level_of") == kind, c)
    detect = lambda t: F.coalesce(F.max(F.when((F.col("level_of") == "type") & (F.col("h_type") == t), F.col("rate"))) >= 0.5, F.lit(False))
    g = m.groupBy("algo").agg(
        F.max(of("all", F.col("rate"))).alias("accuracy"),
        F.coalesce(F.sum(of("type", F.col("rate") * F.try_element_at(weights, F.col("h_type")))), F.lit(0.0)).alias("capability"),
        F.coalesce(F.avg(of("set", F.col("rate"))), F.lit(0.0)).alias("domain"),
        *[detect(t).alias(f"detects_{t}") for t in TYPE_WEIGHTS],
    )
    level = F
    for name, least in LEVELS:
        level = level.when(F.col("accuracy") >= least, name)
    score = F.col("accuracy") * 40 + F.col("capability") * 40 + F.col("domain") * 20
    return g.select("algo", F.round("accuracy", 6).alias("accuracy"), F.round(score, 4).alias("score"), level.otherwise("MINIMAL").alias("level"), *[f"detects_{t}" for t in TYPE_WEIGHTS])


def failures(results: DataFrame) -> DataFrame:
    """algo, h_type, failed, types (all failed types of the algo) and the first three claims."""
    f = results.filter(~F.col("passed"))
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "text"))), lambda x: x["text"]), 1, 3)
    by = f.groupBy("algo", "h_type").agg(F.count("*").alias("failed"), F.array_join(first, " | ").alias("examples"))
    types = f.groupBy("algo").agg(F.array_join(F.array_sort(F.collect_set("h_type")), ",").alias("types"))
    return by.join(types, "algo")


def statuses(spark, unavailable: tuple = UNAVAILABLE, mocked: tuple = MOCKED) -> DataFrame:
    """algo and availability of all algorithms; one that is unavailable has no results and counts as MINIMAL."""
    kinds = {a: "available" for a in ADAPTERS} | {a: "mock_only" for a in mocked} | {a: "unavailable" for a in unavailable}
    return spark.createDataFrame(sorted(kinds.items()), "algo string, availability string")


def priorities(results: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """priority, task, failures, time, action: for the types whose failures, over all algorithms, call for work, and for
    the algorithms (algo, availability) that need setting up."""
    known = F.create_map(*[F.lit(x) for kind, item in TASKS.items() for x in (kind, F.struct(*[F.lit(v).alias(n) for n, v in zip(("priority", "task", "time", "action"), item, strict=True)]))])
    f = results.filter(~F.col("passed")).groupBy(F.col("h_type").alias("k")).agg(F.count("*").alias("failures"))
    if available is not None:
        f = f.unionByName(available.filter("availability = 'unavailable'").select(F.concat(F.lit("no "), "algo").alias("k"), F.lit(0).cast("long").alias("failures")))
    items = f.withColumn("t", F.try_element_at(known, F.col("k"))).filter("t IS NOT NULL")
    return items.select("t.priority", "t.task", "failures", "t.time", "t.action")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(str, r)) + " |" for r in rows], ""]


def markdown(coverage_rows: DataFrame, metric_rows: DataFrame | None = None, available: DataFrame | None = None, todo: DataFrame | None = None) -> str:
    """The report as Markdown: comparison, legend, capabilities, sets and what to do. Its tables have a row per algorithm,
    set or task, whatever the number of cases."""
    rows = {r.algo: r for r in coverage_rows.collect()}
    m = metric_rows.collect() if metric_rows is not None else []
    latency = {r.algo: r.latency_ms for r in m if r.level_of == "all"}
    state = {r.algo: r.availability for r in available.collect()} if available is not None else {a: "available" for a in rows}
    out = ["## Evaluation", "", "### Comparison", ""]
    order = sorted(set(rows) | {a for a, s in state.items() if s == "unavailable"}, key=lambda a: (-rows[a].score if a in rows else 1.0, a))
    shown = lambda a: [a, state.get(a, "available"), *([f"{rows[a].accuracy:.0%}", rows[a].level, f"{rows[a].score:.0f}/100"] if a in rows else ["N/A", "MINIMAL", "0/100"]), f"{latency[a]:.1f} ms" if a in latency else "N/A"]
    out += _table(["Algorithm", "Status", "Accuracy", "Coverage", "Score", "Latency"], [shown(a) for a in order])
    bounds = [least for _, least in LEVELS]
    out += ["### Coverage levels", "", *_table(["Level", "Accuracy"], [[name, f"{least:.0%} and more"] for name, least in LEVELS] + [["MINIMAL", f"less than {bounds[-1]:.0%}"]])]
    out += ["### Detects", "", *_table(["Algorithm", *TYPE_WEIGHTS], [[a, *["yes" if rows[a][f"detects_{t}"] else "no" for t in TYPE_WEIGHTS]] for a in order if a in rows])]
    for a in order:
        own = sorted((r for r in m if r.algo == a and r.level_of == "set"), key=lambda r: r.set_key)
        if own:
            out += [f"### Sets: {a}", "", *_table(["Set", "Passed", "Total", "Accuracy", "Latency"], [[r.set_key, r.passed, r.tested, f"{r.rate:.0%}", f"{r.latency_ms:.1f} ms"] for r in own])]
    if todo is not None:
        out += ["### What to do", "", *_table(["Priority", "Task", "Failures", "Time", "Action"], [[r.priority, r.task, r.failures or "", r.time, r.action] for r in sorted(todo.collect(), key=lambda r: (["HIGH", "MEDIUM", "LOW"].index(r.priority), r.task))])]
    return "\n".join(out)
