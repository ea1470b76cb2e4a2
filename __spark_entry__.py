"""

Every query reads whole tables and whole texts. Where a limit appears it is
the operator itself (first k rows of a file, list truncation, sampling).
Queries with model answers use the stand-in of ``parlance.scripted``, so they
check the data work and not a model.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from parlance.functions import parsing, prompts, rouge, text, tokens, vectors  # noqa: E402
from parlance.operators import dedup, diversity, lists, model, reports, sampling  # noqa: E402
from parlance.plans import corpus, datasets, generation, quality, scoring  # noqa: E402
from parlance.scripted import EchoAll, EchoFirst, FirstWord, ScriptedClient, SecondRun  # noqa: E402
from parlance.session import materialize, scratch_path, ship_package  # noqa: E402
from parlance.sources import files, folders, ledger, tables  # noqa: E402
from parlance.schemas import TEST_CSV  # noqa: E402

SEED = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- shared inputs


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """dialogue_id, dialogue: a conversation's turns as '#role#: text' lines, one dialogue however long."""
    turns = table(spark, sf, "conversations")
    return (
        turns.groupBy(F.col("conv_id").cast("string").alias("dialogue_id"))
        .agg(text.render_turns(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("dialogue"))
    )


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, a, b: each turn and the next one. The join key is unique per row."""
    turns = table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return turns.select("conv_id", "turn", F.col("text").alias("a")).join(following, ["conv_id", "turn"])


def part_lists(spark: SparkSession, sf: str) -> DataFrame:
    """l_orderkey, names: the part names of an order, as a response would list them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return lists.gather_lists(named, ["l_orderkey"], ["l_linenumber", "p_partkey"], "p_name", "names")


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """id, dialogue, summary, predicted_summary: the text, its last and its first line."""
    lines = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("dialogue"),
        F.element_at(lines, -1).alias("summary"), F.element_at(lines, 1).alias("predicted_summary"),
    )


# ------------------------------------------------------------ sources and sinks


def topic_source(spark, sf):
    path = scratch_path(spark, "topics")
    names = table(spark, sf, "supplier").select(F.concat(F.lit(" \t"), "s_name", F.lit("  ")).alias("value"))
    names.write.text(path)
    return files.read_topics(spark, path).select("base_topic")


def seed_source(spark, sf):
    path = scratch_path(spark, "seeds")
    rows = document_rows(spark, sf).select("dialogue", "summary")
    rows.write.json(path)
    return files.read_seed_dialogues(spark, path)


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.export_csv(document_rows(spark, sf).select("id", "dialogue", "summary"), path)
    return files.read_csv(spark, path, TEST_CSV).select("id", "dialogue", "summary")


def _mixed_folder(spark, sf) -> str:
    """Exports of the documents by language: columns in other orders, one more, and two that lack one."""
    folder, rows = scratch_path(spark, "folder"), document_rows(spark, sf)
    lang = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    rows = rows.join(lang, "id")
    layouts = {"en": ["id", "dialogue", "summary"], "de": ["summary", "lang", "id", "dialogue"], "fr": ["dialogue", "summary"], "es": ["id", "summary"]}
    for code, names in layouts.items():
        tables.export_csv(rows.where(F.col("lang") == code).select(*names), f"{folder}/{code}.csv")
    return folder


def folder_scan(spark, sf):
    """Rows read by column name from the files of a folder that can be read."""
    found = folders.scan(spark, _mixed_folder(spark, sf), TEST_CSV, ["dialogue"])
    return found.rows.select("file_name", "id", "dialogue", "summary")


def folder_errors(spark, sf):
    """Files set aside because they lack the id, with the reason; parts of an export are one file."""
    found = folders.scan(spark, _mixed_folder(spark, sf), TEST_CSV, ["id", "dialogue"])
    return found.files.groupBy("file_name").agg(
        F.sum("records").alias("records"), F.max("error").alias("error")
    )


def corpus_split(spark, sf):
    path = scratch_path(spark, "split")
    document_rows(spark, sf).write.parquet(path)
    return files.read_corpus_split(spark, path)


def stage_save(spark, sf):
    """Two saves of a partitioned stage table; the second replaces one language."""
    path = scratch_path(spark, "stage")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    tables.save_stage(docs, path, ["lang"])
    longer = docs.where(F.col("lang") == "fr").withColumn("n_chars", F.col("n_chars") + 1)
    return tables.save_stage(longer, path, ["lang"]).groupBy("lang").agg(
        F.count("*").alias("rows"), F.sum("n_chars").alias("n_chars")
    )


def metric_report(spark, sf):
    """Mean label per source, reported by two runs into one table."""
    path = scratch_path(spark, "report")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    wide = table(spark, sf, "labels").join(docs, "doc_id")
    rows = reports.report(reports.long_metrics(wide, ["source", "doc_id"], ["quality", "toxic"]), ["source"])
    for run in ("one", "two"):
        tables.append_report(rows.withColumn("run_id", F.lit(run)), path)
    return spark.read.parquet(path).select("run_id", "source", "metric", r6(F.col("mean")).alias("mean"))


def question_store(spark, sf):
    """English documents were answered before, so only the others are asked again."""
    path = scratch_path(spark, "store")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    ask = dict(stage="questions", key=["doc_id"], messages=prompts.question_request(F.col("text")),
               params=prompts.QUESTION_PARAMS, store=path)
    model.generate(docs.where(F.col("lang") == "en"), client=FirstWord, **ask)
    return model.generate(docs, client=SecondRun, **ask).select("doc_id", "lang", "response")


def file_labels(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", files.base_name(url).alias("base"), files.run_label("some-org/model-x", url).alias("label")
    )


# --------------------------------------------- filters, samples, set operations


def first_k_per_file(spark, sf):
    """Labelled documents, first 200 per language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    both = docs.join(table(spark, sf, "labels"), "doc_id", "left").na.drop(subset=["quality"])
    return sampling.first_k(both, ["lang"], ["doc_id"], diversity.FILE_ROWS).select("lang", "doc_id", "pos")


def truncate_lists(spark, sf):
    return part_lists(spark, sf).select("l_orderkey", joined(lists.truncate(F.col("names"), 3)).alias("names"))


def seed_sample(spark, sf):
    return sampling.sample_few(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 4, SEED)


def size_matched_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.size_matched(docs, ["doc_id"], table(spark, sf, "labels"), SEED)


def append_results(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), "text")
    turns = table(spark, sf, "conversations").select("text", F.lit("turn").alias("kind"))
    return docs.unionByName(turns).groupBy("kind").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters")
    )


def train_test_pairs(spark, sf):
    named = lambda name, key: table(spark, sf, name).select(
        F.col(key).cast("string").alias("id"), F.col("text").alias("dialogue")
    )
    synthetic = dialogues(spark, sf).select(F.col("dialogue_id").alias("id"), "dialogue")
    return datasets.training_sets(synthetic, named("documents", "doc_id"), named("benchmark", "item_id")).select(
        "dataset", "split", "id", F.md5("context").alias("context"), "response"
    )


# ------------------------------------------------------------------------ joins


def few_shot_attach(spark, sf):
    """Every turn with the same four examples in its summary request."""
    seeds = document_rows(spark, sf)
    turns = table(spark, sf, "conversations").withColumn("examples", generation.few_shot(seeds, SEED).scalar())
    request = prompts.summary_request(F.col("examples"), F.col("text"))
    return turns.select(
        "conv_id", "turn", F.md5(F.element_at(request, 1)["content"]).alias("system"),
        F.element_at(request, 2)["content"].alias("user"),
    )


def persona_pairs(spark, sf):
    return lists.explode_pairs(part_lists(spark, sf), "names")


def criteria_grid(spark, sf):
    rows = dialogues(spark, sf).select("dialogue_id")
    return quality.with_criteria(rows, quality.followup_criteria())


def qa_alignment(spark, sf):
    """Lines of a document against lines of the next one, for labelled documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("left_lines"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("left_lines").alias("right_lines"))
    asked = docs.join(following, "doc_id", "left").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return lists.zip_answers(asked, "left_lines", "right_lines", ["doc_id"])


# ----------------------------------------------------------------- aggregation


def diversity_rouge_names(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return diversity.diversity_rouge(parts, "p_brand", ["p_partkey"], "p_name").select(
        "p_brand", "rows", r6(F.col("diversity_rouge")).alias("diversity_rouge")
    )


def diversity_rouge_documents(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return diversity.diversity_rouge(docs, "source", ["doc_id"], "text").select(
        "source", "rows", r6(F.col("diversity_rouge")).alias("diversity_rouge")
    )


def diversity_cosine(spark, sf):
    return diversity.diversity_cosine(table(spark, sf, "embeddings"), "label", ["vec_id"], "embedding").select(
        "label", r6(F.col("diversity_cosine")).alias("diversity_cosine")
    )


def corpus_diversity(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return corpus.corpus_diversity(docs, "source", ["doc_id"], "text", ScriptedClient).select(
        "source", "rows", r6(F.col("rouge")).alias("rouge"), r6(F.col("cosine")).alias("cosine")
    )


def chunked_mean(spark, sf):
    return sampling.chunked_mean(table(spark, sf, "events"), "event_id", "value", 3).select(
        "chunk", r6(F.col("mean")).alias("mean")
    )


def mean_by_document(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "value")
    return reports.mean_by_document(rows, "user_id", "value").select("user_id", r6(F.col("mean")).alias("mean"))


# ----------------------------------------------------------------- near copies


def greedy_filter_lists(spark, sf):
    return part_lists(spark, sf).select("l_orderkey", joined(lists.drop_repeated(F.col("names"))).alias("names"))


def greedy_filter_names(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return dedup.greedy_filter(parts, "p_brand", "p_partkey", "p_name")


def greedy_filter_rounds(spark, sf):
    """The same by rounds over the index of rare tokens, however small a group is."""
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return dedup.greedy_filter(parts, "p_brand", "p_partkey", "p_name", window=8, local_items=0)


def greedy_filter_documents(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return dedup.greedy_filter(docs, "source", "doc_id", "text").select("source", "doc_id")


# ------------------------------------------------------------------------ text


def rouge_l_pairs(spark, sf):
    score = rouge.rouge_l(F.col("a"), F.col("b"))
    return turn_pairs(spark, sf).select("conv_id", "turn", r6(score).alias("rouge_l"))


def rouge_l_stem_pairs(spark, sf):
    score = rouge.rouge_l(F.col("a"), F.col("b"), stem=True)
    return turn_pairs(spark, sf).select("conv_id", "turn", r6(score).alias("rouge_l"))


def token_stems(spark, sf):
    """The stem of every distinct word of documents and turns."""
    texts = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "conversations").select("text"))
    return tokens.dictionary(texts, "text").select("token", "stem")


def answer_normalize(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.normalize_answer(body).alias("normal"), F.size(text.answer_tokens(body)).alias("tokens")
    )


def token_f1(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", r6(text.token_f1(F.col("a"), F.col("b"))).alias("f1"))


def parse_lists(spark, sf):
    kind, name = F.col("p_partkey") % 6, F.col("p_name")
    response = (
        F.when(kind == 0, F.concat(F.lit('Sure: ["'), name, F.lit('", "'), "p_brand", F.lit('"] done')))
        .when(kind == 1, F.concat(F.lit("['"), name, F.lit("', \""), "p_brand", F.lit('"]')))
        .when(kind == 2, F.concat(F.lit('["'), name, F.lit('", "'), "p_brand", F.lit('",]')))
        .when(kind == 3, F.concat(F.lit('["'), name, F.lit('", "open')))
        .when(kind == 4, F.concat(F.lit('["'), name, F.lit('", 5]')))
        .otherwise(F.concat(F.lit('["'), name, F.lit('" "!"]')))
    )
    parsed = parsing.parse_list(response)
    return table(spark, sf, "part").select(
        "p_partkey", joined(parsed["items"]).alias("items"), parsed["error"].alias("error")
    )


def extract_sections(spark, sf):
    a, b, kind = F.col("a"), F.col("b"), (F.col("conv_id") + F.col("turn")) % 5
    open_c, close_c, open_d, close_d = (F.lit(t) for t in ("<cot>", "</cot>", "<dialogue>", "</dialogue>"))
    response = (
        F.when(kind == 0, F.concat(open_d, b, close_d, a))
        .when(kind == 1, F.concat(a, b))
        .when(kind == 2, F.concat(open_d, b, close_d, open_c, a, close_c))
        .when(kind == 3, F.concat(open_c, F.lit("x &amp; <i>y</i>"), a, close_c, open_d, b, close_d))
        .otherwise(F.concat(F.lit("So: "), open_c, a, close_c, open_d, b, close_d))
    )
    rows = turn_pairs(spark, sf).withColumn("r", response)
    return rows.select("conv_id", "turn", parsing.extract_sections(F.col("r")).alias("s")).select(
        "conv_id", "turn", "s.cot", "s.dialogue", "s.extraction_path"
    )


def judge_scores(spark, sf):
    n = F.col("turn") + F.col("conv_id") % 14
    response = F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(
        F.concat("text", F.lit("\nScore: "), n.cast("string"))
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", parsing.judge_score(response).cast("double").alias("score")
    )


def speakers(spark, sf):
    said = text.speakers(F.col("dialogue"))
    return dialogues(spark, sf).select(
        "dialogue_id", joined(said).alias("speakers"), joined(F.array_distinct(said)).alias("names")
    )


def followup_turn(spark, sf):
    told = text.append_followup(F.col("dialogue"), F.lit("Tell me more."))
    return dialogues(spark, sf).select("dialogue_id", told.alias("dialogue"))


def dialogue_text(spark, sf):
    return dialogues(spark, sf)


def context_response(spark, sf):
    return datasets.response_pairs(document_rows(spark, sf))


# --------------------------------------------------------------------- prompts


def _request(rows: DataFrame, keys: list[str], messages: Column, second: str = "user") -> DataFrame:
    return rows.withColumn("_m", messages).select(
        *keys, F.md5(F.element_at("_m", 1)["content"]).alias("system"), F.element_at("_m", 2)["content"].alias(second)
    )


def sub_topic_prompts(spark, sf):
    rows = table(spark, sf, "supplier").select("s_name")
    return _request(rows, ["s_name"], prompts.sub_topic_request(F.col("s_name"), 6))


def persona_prompts(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return _request(rows, ["p_partkey"], prompts.persona_request(F.col("p_name"), 5))


def _dialogue_prompts(spark, sf, reasoning):
    seeds = document_rows(spark, sf)
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).withColumn("examples", generation.few_shot(seeds, SEED).scalar())
    request = prompts.dialogue_request(
        F.col("examples"), F.col("s_name"), F.col("n_name"), F.concat_ws(" and ", "n_name", "s_name"), reasoning
    )
    return _request(rows, ["s_suppkey"], request)


def dialogue_prompts(spark, sf):
    return _dialogue_prompts(spark, sf, True)


def dialogue_prompts_plain(spark, sf):
    return _dialogue_prompts(spark, sf, False)


def judge_prompts(spark, sf):
    rows = table(spark, sf, "conversations")
    request = prompts.judge_request(
        F.col("role"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")
    )
    return _request(rows, ["conv_id", "turn"], request)


def question_prompts(spark, sf):
    return _request(dialogues(spark, sf), ["dialogue_id"], prompts.question_request(F.col("dialogue"), 4))


def answer_prompts(spark, sf):
    request = prompts.answer_request(F.col("a"), F.split("b", "\n", -1))
    return _request(turn_pairs(spark, sf), ["conv_id", "turn"], request)


def probe_prompts(spark, sf):
    rows = quality.with_criteria(
        dialogues(spark, sf), quality.criteria(["metric", "question"], list(prompts.PROBED_ASPECTS.items()))
    )
    return _request(
        rows, ["dialogue_id", "metric"], prompts.probe_request(F.col("question"), F.col("dialogue")), "assistant"
    )


def rubric_prompts(spark, sf):
    rows = quality.with_criteria(
        dialogues(spark, sf), quality.criteria(["metric", "aspect"], list(prompts.RATED_ASPECTS.items()))
    )
    request = prompts.rubric_request(F.col("aspect"), F.col("dialogue"))
    return _request(rows, ["dialogue_id", "metric"], request)


# --------------------------------------------------------- vectors and metrics


def cosine_pairs(spark, sf):
    vecs = table(spark, sf, "embeddings")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vecs.join(following, "vec_id").select(
        "vec_id", r6(vectors.cosine(F.col("embedding"), F.col("other"))).alias("cosine")
    )


def embedding_match_f1(spark, sf):
    """Every eight vectors are the tokens of a sentence, compared with the next sentence."""
    vecs = table(spark, sf, "embeddings").select(F.expr("vec_id div 8").alias("sentence"), "vec_id", "embedding")
    sentences = lists.gather_lists(vecs, ["sentence"], ["vec_id"], "embedding", "tokens")
    following = sentences.select((F.col("sentence") - 1).alias("sentence"), F.col("tokens").alias("other"))
    match = vectors.embedding_match(F.col("tokens"), F.col("other"))
    return sentences.join(following, "sentence").select("sentence", match.alias("m")).select(
        "sentence", *[r6(F.col(f"m.{c}")).alias(c) for c in ("precision", "recall", "f1")]
    )


def yes_probability(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(vectors.softmax_at(F.col("embedding"), F.col("label"))).alias("probability")
    )


def last_yes_position(spark, sf):
    sizes = F.transform(F.split("text", " "), lambda w: F.length(w) % 7)
    return table(spark, sf, "documents").select("doc_id", vectors.last_before(sizes, F.lit(3)).cast("double").alias("position"))


def expected_rating(spark, sf):
    third = lambda k: F.filter("embedding", lambda x, i: i % 3 == k)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double"))
    logits = F.array(*[total(third(k)) for k in range(3)])
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(vectors.expected_rating(logits)).alias("rating")
    )


def _column(metric: str) -> str:
    return metric.replace(" ", "_")


def fed_score(spark, sf):
    """FED of every dialogue, its map of metrics laid out as columns."""
    maps = quality.score(dialogues(spark, sf), quality.fed_scale(), ScriptedClient)
    return maps.select("dialogue_id", *[r6(F.col("metrics")[m]).alias(_column(m)) for m in prompts.FOLLOWUPS])


def gpt_score(spark, sf):
    rows = quality.gpt_score(dialogues(spark, sf), ScriptedClient, yes_id=7)
    return rows.select("dialogue_id", "metric", r6(F.col("value")).alias("value"))


def g_eval(spark, sf):
    rows = quality.g_eval(dialogues(spark, sf), ScriptedClient)
    return rows.select("dialogue_id", "metric", r6(F.col("value")).alias("value"))


def quality_metrics(spark, sf):
    """Mean of every metric of every family, through the registry."""
    rows, _ = quality.calculate_metrics(dialogues(spark, sf), quality.families(ScriptedClient, 7))
    return reports.report(rows, ["family"]).select("family", "metric", F.round("mean", 5).alias("mean"))


class Moody(ScriptedClient):
    """Fails on every dialogue whose length is a multiple of seven."""

    def rating_logits(self, batch):
        if any(len(m[-1]["content"]) % 7 == 0 for m in batch):
            raise RuntimeError("overloaded")
        return super().rating_logits(batch)


class Even(ScriptedClient):
    """Rates all alike, so what it was asked can be told from what was stored."""

    def rating_logits(self, batch):
        return [[0.0, 0.0, 0.0] for _ in batch]


def score_ledger(spark, sf):
    """G-Eval in three runs over one ledger: some dialogues fail, another client scores those, a third finds nothing to do."""
    path, rows = scratch_path(spark, "ledger"), materialize(dialogues(spark, sf), "dialogues")
    out = None
    for run, client in (("first", Moody), ("second", Even), ("third", Moody)):
        part = materialize(quality.score(rows, quality.rubric_scale(), client, path), "scores")
        part = part.select(F.lit(run).alias("run"), "dialogue_id", r6(F.col("metrics")["coherence"]).alias("coherence"), "error")
        out = part if out is None else out.unionByName(part)
    return out


def score_counts(spark, sf):
    """Scored and missing dialogues by metric after a run with failures, and the ledger's rows after three."""
    path, rows = scratch_path(spark, "ledger"), materialize(dialogues(spark, sf), "dialogues")
    first = None
    for client in (Moody, Even, Moody):
        scores = materialize(quality.score(rows, quality.rubric_scale(), client, path), "scores")
        first = scores if first is None else first
    counts = reports.report(quality.long_rows(first).withColumn("run", F.lit("first")), ["run"])
    stored = ledger.Ledger(spark, path, "array<double>").load().agg(
        F.lit("all").alias("run"), F.lit("rows").alias("metric"), F.count(F.when(F.col("error").isNull(), 1)).alias("scored"),
        F.count("error").alias("missing"),
    )
    return counts.select("run", "metric", "scored", "missing").unionByName(stored)


def vector_ledger(spark, sf):
    """Vectors of all turns, of which the user's were stored before."""
    path, turns = scratch_path(spark, "vectors"), table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    key = ["conv_id", "turn"]
    model.embeddings(turns.where("role = 'user'"), key, F.col("text"), ScriptedClient, path)
    rows = model.embeddings(turns, key, F.col("text"), Doubled, path)
    return rows.select(*key, r6(F.get("value", F.lit(0)).cast("double")).alias("e"), F.size("value").alias("size"))


class Doubled(ScriptedClient):
    """Vectors of twice the length."""

    def embed(self, texts):
        return [[2 * x for x in v] for v in super().embed(texts)]


def _qas(spark, sf):
    rows = document_rows(spark, sf)
    return materialize(scoring.qa_rows(rows, ScriptedClient), "qas")


def qags(spark, sf):
    return scoring.qags(_qas(spark, sf), ScriptedClient).select("id", r6(F.col("mean")).alias("qags"))


def qags_chunked(spark, sf):
    qas = _qas(spark, sf).withColumn("at", F.col("id").cast("long"))
    return scoring.qags_chunked(qas, "at", ScriptedClient).select("chunk", r6(F.col("mean")).alias("mean"))


def turn_rows(spark, sf):
    """id, dialogue, summary, predicted_summary: a whole conversation, a turn's next turn, and the turn."""
    pairs = turn_pairs(spark, sf).select(
        F.col("conv_id").cast("string").alias("dialogue_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("b").alias("summary"), F.col("a").alias("predicted_summary"),
    )
    return pairs.join(dialogues(spark, sf), "dialogue_id").select("id", "dialogue", "summary", "predicted_summary")


def summary_scores(spark, sf):
    rows = scoring.score_summaries(turn_rows(spark, sf), ScriptedClient)
    return rows.select("id", "metric", r6(F.col("value")).alias("value"))


def summary_predictions(spark, sf):
    """Summaries of whole dialogues that two runs predict."""
    rows = dialogues(spark, sf).withColumnRenamed("dialogue_id", "id")
    out = None
    for run, client in (("first", EchoFirst), ("last", ScriptedClient)):
        part = scoring.predict(rows, "dialogue", client, prompts.PREDICT_SUMMARY_PARAMS, run, "predicted_summary")
        out = part if out is None else out.unionByName(part)
    return out.select("run_id", "id", "predicted_summary")


def summary_run_scores(spark, sf):
    """The two runs' summaries against the dialogue's second turn, by metric."""
    references = dialogues(spark, sf).withColumnRenamed("dialogue_id", "id").withColumn(
        "summary", F.element_at(F.split("dialogue", "\n", -1), 2)
    )
    runs = scoring.compare_summaries(materialize(summary_predictions(spark, sf), "predictions"), references, ScriptedClient)
    return runs.select("run_id", "metric", F.round("mean", 5).alias("mean"), "scored", "missing")


def prediction_file_scores(spark, sf):
    """Scores of predictions read back from a CSV file."""
    path = scratch_path(spark, "predictions")
    tables.export_csv(turn_rows(spark, sf).select("id", "predicted_summary", "summary"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "predicted_summary", "summary")])
    rows = files.read_csv(spark, path, schema)
    return scoring.score_prediction_file(rows, ScriptedClient).select("metric", F.round("mean", 5).alias("mean"))


def response_predictions(spark, sf):
    """Two runs' predictions of the last line from the lines before it."""
    pairs = datasets.response_pairs(document_rows(spark, sf))
    out = None
    for run, client in (("first_line", EchoFirst), ("whole", EchoAll)):
        part = scoring.predict(pairs, "context", client, prompts.PREDICT_RESPONSE_PARAMS, run, "predicted_response")
        out = part if out is None else out.unionByName(part)
    return out.select("run_id", "id", F.md5("predicted_response").alias("predicted_response"))


def run_compare(spark, sf):
    pairs = datasets.response_pairs(document_rows(spark, sf))
    predictions = None
    for run, client in (("base", EchoFirst), ("synthetic", ScriptedClient), ("in_domain", EchoAll)):
        part = scoring.predict(pairs, "context", client, prompts.PREDICT_RESPONSE_PARAMS, run, "predicted_response")
        predictions = part if predictions is None else predictions.unionByName(part)
    return scoring.compare_runs(predictions, pairs, ScriptedClient).select(
        "run_id", "metric", F.round("mean", 5).alias("mean")
    )


def _topics(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("topic_pos"), F.col("s_name").alias("base_topic"))


def generation_run(spark, sf):
    """Topics to judged dialogues, one topic per supplier."""
    run = generation.Run(spark, scratch_path(spark, "run"), ScriptedClient, n_sub_topics=6, n_personas=6,
                         disable_metrics=True)
    out = generation.execute(run, _topics(spark, sf), document_rows(spark, sf))
    return out.select("base_topic", "sub_topic", "persona_1", "persona_2", "dialogue", "cot", "summary",
                      F.col("llm_judge_score").cast("double").alias("llm_judge_score"))


def _two_runs(spark, sf):
    """A folder with a whole run over all suppliers, then one without judge over the even ones."""
    folder, seeds, topics = scratch_path(spark, "run"), document_rows(spark, sf), _topics(spark, sf)
    make = lambda run_id, **options: generation.Run(
        spark, folder, ScriptedClient, n_sub_topics=1, n_personas=3, run_id=run_id, **options)
    generation.execute(make("one", disable_metrics=True), topics, seeds)
    generation.execute(make("two", disable_judge=True, disable_metrics=True), topics.where("topic_pos % 2 = 0"), seeds)
    return make


def stage_manifest(spark, sf):
    """Tables of two runs with their rows and parents, and the one that each later stage would start from."""
    manifest = _two_runs(spark, sf)("look").manifest
    starts = {stage: manifest.current(names) for stage, names in generation.STARTS.items()}
    made = manifest.table().where("state = 'committed' and name not like 'errors/%'")
    parents = made.select(F.col("version").alias("parent"), F.col("name").alias("made_from"))
    rows = made.join(parents, "parent", "left").select("run_id", "name", "made_from", "rows", "version")
    begins = F.array(*[F.when(F.col("version") == r.version, F.lit(stage)) for stage, r in starts.items()])
    return rows.withColumn("starts", F.array_join(begins, ",")).drop("version")


def stage_summary(spark, sf):
    """Summaries written anew, then judged, from the dialogues of the second run."""
    out = generation.execute(_two_runs(spark, sf)("three", stage="summary", disable_metrics=True), seeds=document_rows(spark, sf))
    return out.select("sub_topic", "persona_1", "persona_2", "summary", F.col("llm_judge_score").cast("double").alias("llm_judge_score"))


def stage_judge(spark, sf):
    """Judge scores added to the second run's summaries."""
    out = generation.execute(_two_runs(spark, sf)("three", stage="llm_judge", disable_metrics=True))
    return out.select("sub_topic", "persona_1", "persona_2", "summary", F.col("llm_judge_score").cast("double").alias("llm_judge_score"))


def stage_metrics(spark, sf):
    """Metrics of the second run's dialogues. The first run's judged table is not read."""
    run = _two_runs(spark, sf)("three", stage="metrics", registry={
        "g_eval": lambda d: quality.score(d, quality.rubric_scale(), ScriptedClient)})
    out = generation.execute(run)
    return out.select("sub_topic", "persona_2", r6(F.col("g_eval")["coherence"]).alias("coherence"),
                      F.lit("llm_judge_score" in out.columns).alias("judged"))


class OddPersonas(ScriptedClient):
    """Gives no list of personas for sub-topics that end in an odd digit, and no dialogue with a night clerk."""

    identity = "odd personas"

    def reply(self, system, user):
        told = user.removesuffix(".")
        if system.startswith(prompts.DEFAULT.personas[:8]) and told[-1] in "13579":
            return "I would rather not"
        if "<dialogue>" in system and "Second person: The clerk" in system and told[-1] == "2":
            raise RuntimeError("too late at night")
        return super().reply(system, user)


def _odd_run(spark, sf, **options):
    run = generation.Run(spark, scratch_path(spark, "run"), OddPersonas, n_sub_topics=3, n_personas=4, disable_judge=True,
                         disable_metrics=True, **options)
    generation.execute(run, _topics(spark, sf), document_rows(spark, sf))
    return run


def drop_scope(spark, sf):
    """Dialogues per topic when any failure drops the whole topic."""
    return _odd_run(spark, sf, drop_scope="base_topic").table("dialogues").groupBy("base_topic").agg(F.count("*").alias("dialogues"))


def progress_counts(spark, sf):
    """Rows of each table of a run, as the writes counted them."""
    return _odd_run(spark, sf).manifest.table().where("state = 'committed'").select("name", "rows")


def persona_groups(spark, sf):
    """Personas by sub-topic; suppliers are topics of one name per nation, so equal sub-topics meet."""
    topics = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = topics.select(F.lit(0).alias("topic_pos"), F.lit("ports").alias("base_topic"), F.col("s_suppkey").cast("int").alias("sub_pos"),
                         F.concat("n_name", F.lit(" port "), (F.col("s_suppkey") % 40).cast("string")).alias("sub_topic"))
    run = generation.Run(spark, scratch_path(spark, "run"), ScriptedClient, n_personas=4)
    return generation.persona_step(run, rows).select("sub_topic", joined(F.col("personas")).alias("personas"))


# The registered queries, by name.
QUERIES = [
    topic_source, seed_source, csv_roundtrip, folder_scan, folder_errors, corpus_split, stage_save, metric_report, question_store, file_labels,
    first_k_per_file, truncate_lists, seed_sample, size_matched_sample, append_results, train_test_pairs,
    few_shot_attach, persona_pairs, criteria_grid, qa_alignment,
    diversity_rouge_names, diversity_rouge_documents, diversity_cosine, corpus_diversity, chunked_mean,
    mean_by_document, greedy_filter_lists, greedy_filter_names, greedy_filter_rounds, greedy_filter_documents,
    rouge_l_pairs, rouge_l_stem_pairs, token_stems, answer_normalize, token_f1, parse_lists, extract_sections, judge_scores,
    speakers, followup_turn, dialogue_text, context_response,
    sub_topic_prompts, persona_prompts, dialogue_prompts, dialogue_prompts_plain, judge_prompts, question_prompts,
    answer_prompts, probe_prompts, rubric_prompts,
    cosine_pairs, embedding_match_f1, yes_probability, last_yes_position, expected_rating,
    fed_score, gpt_score, g_eval, quality_metrics, score_ledger, score_counts, vector_ledger, qags, qags_chunked, summary_scores, summary_predictions, summary_run_scores, prediction_file_scores,
    response_predictions, run_compare, generation_run, stage_manifest, stage_summary, stage_judge, stage_metrics,
    drop_scope, progress_counts, persona_groups,
]


try:  # the training-data operators are optional
    from parlance.llm.queries import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES
    import corpus_pipeline
except ImportError:
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}


def entry(spark: SparkSession) -> DataFrame:
    """Corpus diversity: the mean best score of each source's documents."""
    return corpus_diversity(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{q.__name__: q for q in QUERIES}, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES

    return {**ORACLES, **LLM_ORACLES}
