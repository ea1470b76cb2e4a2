"""The generation run: topics to sub-topics, personas, dialogues, summaries,
judge scores and metrics, with a stage table after every step.

Each step reads the table before it, and model answers come from a written
store, so no model call hides in a plan that Spark may evaluate twice. A row
that fails goes to the error table; the others continue. The manifest of the
folder says which table was made from which, and a later stage starts from the
newest one that stems from the present dialogues.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import prompts
from parlance.functions.parsing import extract_sections, judge_score, parse_list
from parlance.operators import model
from parlance.operators.lists import check_count, drop_repeated, explode_pairs, truncate
from parlance.operators.model import ClientFactory
from parlance.operators.sampling import sample_few
from parlance.plans.quality import Family, attach_metrics, families, metric_errors, metric_rows, metric_tables
from parlance.session import lookup_join
from parlance.sources.manifest import Manifest

# Stages, and the steps each of them runs.
STAGES = {
    "scratch": ("dialogues", "summary", "judge", "metrics"),
    "summary": ("summary", "judge", "metrics"),
    "llm_judge": ("judge", "metrics"),
    "metrics": ("metrics",),
}
# Tables that a later stage may start from.
STARTS = {
    "summary": ["dialogues"],
    "llm_judge": ["summaries", "dialogues"],
    "metrics": ["judged", "summaries", "dialogues"],
}
# The table at which the lineage of the later stages ends.
ROOT = "dialogues"
# Fixed value: worked examples drawn from the seed dialogues.
EXAMPLES = 4

DIALOGUE_KEY = ["topic_pos", "base_topic", "sub_topic", "pos_1", "pos_2", "persona_1", "persona_2"]


@dataclass
class Run:
    """Settings of a run. ``attempt`` asks the model anew for equal requests.

    ``head`` is the version of the table that the next one is made from.
    """

    spark: SparkSession
    out: str
    client: ClientFactory
    n_sub_topics: int | None = None
    n_personas: int | None = None
    stage: str = "scratch"
    disable_judge: bool = False
    disable_metrics: bool = False
    drop_scope: str = "row"
    seed: int = 0
    attempt: int = 0
    partitions: int | None = None
    yes_id: int | None = None
    templates: prompts.Templates = prompts.DEFAULT
    registry: dict[str, Family] | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    head: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    step_errors: dict[str, str] = field(default_factory=dict)
    metric_errors: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.stage not in STAGES:
            raise ValueError(f"invalid stage: {self.stage}")
        if self.drop_scope not in ("row", "base_topic"):
            raise ValueError(f"invalid drop_scope: {self.drop_scope}")

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, self.out, ROOT)

    def path(self, table: str) -> str:
        return f"{self.out}/{table}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save(self, name: str, df: DataFrame, next_head: bool = False) -> DataFrame:
        """Write a stage table made from the head; with ``next_head`` later tables are made from it."""
        table, self.counts[name], version = self.manifest.save(name, df, self.run_id, self.head)
        if next_head:
            self.head = version
        return table

    def ask(self, df: DataFrame, stage: str, key: list[str], messages: Column, params) -> DataFrame:
        params = replace(params, extra={"attempt": self.attempt})
        return model.generate(
            df, stage, key, messages, self.client, params, self.path(f"responses/{stage}"), self.partitions
        )

    def quarantine(self, stage: str, rows: DataFrame, error: Column) -> None:
        """Rows with an error, kept with the response that caused it."""
        bad = rows.where(error.isNotNull()).select(
            "topic_pos", "base_topic", "response", error.alias("error")
        )
        self.save(f"errors/{stage}", bad)


def few_shot(seeds: DataFrame, seed: int, k: int = EXAMPLES) -> DataFrame:
    """One row, examples: ``k`` seed dialogues in a fixed order.

    Attach it with ``.scalar()``: Spark evaluates it once and treats the
    result as a constant, so there is no join with the large side.
    """
    drawn = sample_few(seeds.select("id", "dialogue", "summary"), ["id"], k, seed)
    ordered = F.array_sort(F.collect_list(F.struct("id", "dialogue", "summary")))
    return drawn.agg(
        F.when(F.count("*") == k, F.transform(ordered, lambda e: F.struct(
            e["dialogue"].alias("dialogue"), e["summary"].alias("summary")
        ))).otherwise(F.raise_error(F.lit(f"fewer than {k} seed dialogues"))).alias("examples")
    )


def list_step(run: Run, rows: DataFrame, stage: str, key: list[str], messages: Column, params, n: int) -> DataFrame:
    """``rows`` with ``items``: the parsed, truncated and filtered answer list."""
    answered = run.ask(rows, stage, key, messages, params)
    read = answered.withColumn("_list", parse_list(F.col("response")))
    error = F.coalesce(F.col("error"), F.col("_list.error"))
    run.quarantine(stage, read, error)
    good = read.where(error.isNull())
    return good.select(*rows.columns, drop_repeated(truncate(F.col("_list.items"), n)).alias("items"))


def sub_topic_step(run: Run, topics: DataFrame) -> DataFrame:
    n = check_count(run.n_sub_topics, "n_sub_topics")
    request = prompts.sub_topic_request(F.col("base_topic"), n, run.templates)
    lists = list_step(run, topics, "sub_topics", topics.columns, request, prompts.SUB_TOPIC_PARAMS, n)
    rows = lists.select("topic_pos", "base_topic", F.posexplode("items").alias("sub_pos", "sub_topic"))
    return run.save("sub_topics", rows, True)


def persona_step(run: Run, sub_topics: DataFrame) -> DataFrame:
    """topic_pos, base_topic, sub_topic, personas; lists of equal sub-topics are merged."""
    n = check_count(run.n_personas, "n_personas")
    request = prompts.persona_request(F.col("sub_topic"), n, run.templates)
    lists = list_step(run, sub_topics, "personas", sub_topics.columns, request, prompts.PERSONA_PARAMS, n)
    # At most 20 sub-topics of 20 personas meet in one row.
    merged = lists.groupBy("topic_pos", "base_topic", "sub_topic").agg(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("sub_pos", "items"))), lambda e: e["items"]
        )).alias("personas")
    )
    return run.save("personas", merged, True)


def failed_topics(run: Run, stages: list[str]) -> DataFrame:
    failed = None
    for stage in stages:
        rows = run.table(f"errors/{stage}").select("topic_pos", "base_topic")
        failed = rows if failed is None else failed.unionByName(rows)
    return failed.distinct()


def dialogue_step(run: Run, personas: DataFrame, seeds: DataFrame) -> DataFrame:
    pairs = explode_pairs(personas, "personas").withColumn(
        "dialogue_id", F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in DIALOGUE_KEY]))
    )
    with_examples = pairs.withColumn("_examples", few_shot(seeds, run.seed).scalar())
    request = prompts.dialogue_request(
        F.col("_examples"), F.col("persona_1"), F.col("persona_2"), F.col("sub_topic"), True, run.templates
    )
    answered = run.ask(with_examples, "dialogues", ["dialogue_id"], request, prompts.DIALOGUE_PARAMS)
    run.quarantine("dialogues", answered, F.col("error"))
    good = answered.where(F.col("error").isNull()).withColumn("_s", extract_sections(F.col("response")))
    rows = good.select("dialogue_id", *DIALOGUE_KEY, "_s.dialogue", "_s.cot", "_s.extraction_path")
    if run.drop_scope == "base_topic":
        failed = failed_topics(run, ["sub_topics", "personas", "dialogues"])
        rows = lookup_join(rows, failed, ["topic_pos", "base_topic"], "left_anti", F.col("dialogue_id"))
    # Large topics are written by many tasks, so no topic is one file or one task.
    return run.save("dialogues", rows, True)


def summary_step(run: Run, dialogues: DataFrame, seeds: DataFrame) -> DataFrame:
    with_examples = dialogues.withColumn("_examples", few_shot(seeds, run.seed).scalar())
    request = prompts.summary_request(F.col("_examples"), F.col("dialogue"), run.templates)
    answered = run.ask(with_examples, "summary", ["dialogue_id"], request, prompts.SUMMARY_PARAMS)
    run.quarantine("summary", answered, F.col("error"))
    rows = answered.select(*dialogues.columns, F.col("response").alias("summary"))
    return run.save("summaries", rows, True)


def judge_step(run: Run, dialogues: DataFrame) -> DataFrame:
    request = prompts.judge_request(
        F.col("sub_topic"), F.col("persona_1"), F.col("persona_2"), F.col("dialogue"), run.templates
    )
    answered = run.ask(dialogues, "judge", ["dialogue_id"], request, prompts.JUDGE_PARAMS)
    scored = answered.withColumn("llm_judge_score", judge_score(F.col("response")))
    missing = F.when(F.col("llm_judge_score").isNull(), F.lit("no score"))
    run.quarantine("judge", scored, F.coalesce(F.col("error"), missing))
    rows = scored.select(*dialogues.columns, "llm_judge_score", F.col("response").alias("judge_raw"))
    return run.save("judged", rows, True)


def metric_step(run: Run, dialogues: DataFrame) -> DataFrame:
    registry = run.registry or families(run.client, run.yes_id, run.path("scores"))
    tables, run.metric_errors = metric_tables(dialogues, registry)
    run.save("metric_rows", metric_rows(dialogues, tables))
    run.save("errors/metrics", metric_errors(dialogues, tables))
    return run.save("metrics", attach_metrics(dialogues, tables, list(registry)), True)


def latest(run: Run, names: list[str]) -> DataFrame:
    """The newest of the named tables that was made, step by step, from the present dialogues."""
    record = run.manifest.current(names)
    if record is None:
        raise FileNotFoundError(f"no stage table of {names} in {run.out}")
    run.head = record.version
    return run.table(record.name)


def isolated(run: Run, name: str, current: DataFrame, step: Callable[[], DataFrame]) -> DataFrame:
    try:
        return step()
    except Exception as exc:  # noqa: BLE001 - reported in the run
        run.step_errors[name] = f"{type(exc).__name__}: {exc}"
        return current


def execute(
    run: Run, topics: DataFrame | None = None, seeds: DataFrame | None = None, dialogues: DataFrame | None = None
) -> DataFrame:
    """Run the steps of the stage and return the last table.

    ``topics``: topic_pos, base_topic. ``dialogues`` replaces the stored table
    when a later stage starts from elsewhere. A failing summary or judge step
    as a whole leaves its columns out, and the next step goes on.
    """
    steps = STAGES[run.stage]
    if "dialogues" in steps:
        if topics is None or seeds is None:
            raise ValueError("topics and seeds are required")
        check_count(run.n_sub_topics, "n_sub_topics")
        check_count(run.n_personas, "n_personas")
        sub_topics = sub_topic_step(run, topics)
        current = dialogue_step(run, persona_step(run, sub_topics), seeds)
    elif dialogues is not None:
        current = run.save("dialogues", dialogues, True)
    else:
        current = latest(run, STARTS[run.stage])
    if "summary" in steps:
        if seeds is None:
            raise ValueError("seeds are required")
        source = current
        current = isolated(run, "summary", source, lambda: summary_step(run, source, seeds))
    if "judge" in steps and not run.disable_judge:
        scored = current
        current = isolated(run, "judge", scored, lambda: judge_step(run, scored))
    if "metrics" in steps and not run.disable_metrics:
        current = metric_step(run, current)
    return current
