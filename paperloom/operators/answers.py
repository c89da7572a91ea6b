"""Evidence for answers: excerpts, prompts, lenses, citations. Models stand behind a small interface."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scholarly import validate_citations
from paperloom.functions.text import coerce_json, estimate_tokens, sentences, truncate
from paperloom.runtime import Scratch

# Sizes of excerpts and of the memory, weights of queries, and the lenses with how many excerpts they take.
EXCERPT, TURNS, TURN, IMAGES = 1600, 6, 700, 4
QUESTION, LENS, COMPARISON = 1.0, 0.75, 0.8
LENSES = {"tldr": 10, "structured_abstract": 16, "methodology": 16, "data": 16, "results": 16, "limitations": 16, "credibility": 18, "reproducibility": 16, "related": 14, "glossary": 14, "explain": 14, "figures": 16}
COMPARISONS = {"compare": 8, "compare_results": 10, "compare_methods": 10}
_ASKS = {
    "tldr": (["main contribution", "key result"], ["abstract", "conclusion"]),
    "structured_abstract": (["problem and aim", "approach", "main results"], ["abstract", "introduction", "results", "conclusion"]),
    "methodology": (["how the method works", "model and training"], ["methods", "experiments"]),
    "data": (["datasets used", "how data was collected"], ["data", "experiments"]),
    "results": (["reported results", "comparison with baselines"], ["results", "discussion"]),
    "limitations": (["limitations", "threats to validity"], ["limitations", "discussion"]),
    "credibility": (["sample size", "statistical tests", "limitations"], ["methods", "data", "limitations"]),
    "reproducibility": (["hyperparameters", "code and data availability"], ["experiments", "methods", "appendix"]),
    "related": (["related work", "differences from prior work"], ["related_work", "introduction"]),
    "glossary": (["definitions of terms", "notation"], ["background", "methods"]),
    "explain": (["intuition of the idea", "why it works"], ["introduction", "methods"]),
    "figures": (["what the figures show", "what the tables show"], ["results", "experiments"]),
    "compare": (["main claim", "main results"], ["abstract", "results"]),
    "compare_results": (["reported numbers", "metrics"], ["results"]),
    "compare_methods": (["method", "training"], ["methods", "experiments"]),
}


def lenses(spark) -> DataFrame:
    """The lens table: id, comparison, top_k, queries, sections."""
    rows = [(k, k in COMPARISONS, n, *_ASKS[k]) for k, n in {**LENSES, **COMPARISONS}.items()]
    return spark.createDataFrame(rows, "id string, comparison boolean, top_k int, queries array<string>, sections array<string>")


def lens_queries(lens_table: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(topic_id, query_no, text, weight): each lens's queries, and before them the question (topic_id, text) if there is one."""
    w = F.when(F.col("comparison"), COMPARISON).otherwise(LENS)
    own = lens_table.select(F.col("id").alias("topic_id"), w.alias("weight"), F.posexplode("queries").alias("query_no", "text")).select("topic_id", (F.col("query_no") + 1).cast("long").alias("query_no"), "text", "weight")
    return own if questions is None else own.unionByName(questions.select("topic_id", F.lit(0).cast("long").alias("query_no"), "text", F.lit(QUESTION).alias("weight")))


def excerpt(n: Column, kind: Column, title: Column, page: Column, section: Column, path: Column, body: Column, inferred: Column) -> Column:
    """A numbered excerpt: a line that tells where it stands, and its body, with a warning if a table's structure was inferred."""
    head = F.concat_ws(", ", kind, F.when(title != "", truncate(title, 70)), F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))), F.when(section != "unknown", section), F.when(F.size(path) > 0, truncate(F.array_join(path, " > "), 80)))
    note = F.when(inferred, F.lit("\n(The columns of this table were inferred from its layout.)")).otherwise(F.lit(""))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), head, F.lit("\n"), truncate(body, EXCERPT), note)


def build_context(hits: DataFrame) -> DataFrame:
    """(query_id, context, citations) from ranked hits (query_id, rank, chunk_id, kind, title, page, section, section_path, label, display_text, inferred): excerpts numbered from 1."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = hits.withColumn("n", n).withColumn("_x", excerpt(F.col("n"), F.col("kind"), F.col("title"), F.col("page"), F.col("section"), F.col("section_path"), F.col("display_text"), F.col("inferred")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "_x"))).alias("_e"), F.array_sort(F.collect_list(F.struct("n", "chunk_id", "page", "label"))).alias("citations"))
    return lists.select("query_id", F.array_join(F.transform("_e", lambda x: x["_x"]), "\n\n").alias("context"), "citations")


def prompts(contexts: DataFrame, questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): the last six turns (query_id, pos, role, content) of 700 characters each, the excerpts and the question."""
    rows = contexts.join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    memory = F.lit("")
    if turns is not None:
        last = turns.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pos")))).where(F.col("_rn") <= TURNS)
        said = last.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("role", F.lit(": "), truncate(F.col("content"), TURN)).alias("s")))), lambda x: x["s"]), "\n").alias("_m"))
        rows = rows.join(said, "query_id", "left")
        memory = F.coalesce("_m", F.lit(""))
    return rows.select("query_id", F.concat_ws("\n\n", F.when(memory != "", memory), F.concat(F.lit("Excerpts:\n\n"), "context"), F.concat(F.lit("Question: "), "_q")).alias("prompt"))


class Generator(Protocol):
    """A model: from (query_id, prompt, context) rows to (query_id, answer) rows."""

    name: str

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Extractive:
    """The offline default: the first sentence of each excerpt, with its number."""

    name = "extractive"

    def __call__(self, rows: DataFrame) -> DataFrame:
        parts = F.regexp_extract_all("context", F.lit(r"(?s)(?:^|\n\n)(\[\d+\] .*?)(?=\n\n\[\d+\] |\z)"), F.lit(1))
        line = lambda p: F.concat(F.coalesce(F.get(sentences(F.regexp_replace(p, r"^\[\d+\] [^\n]*\n", "")), F.lit(0)), F.lit("")), F.lit(" "), F.regexp_extract(p, r"^(\[\d+\])", 1))
        return rows.select("query_id", F.array_join(F.transform(parts, line), " ").alias("answer"))


def ask(contexts: DataFrame, questions: DataFrame, generator: Callable | None = None, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, text, used, citations, evidence_only, note): answers whose citations are all of supplied excerpts; without a generator the evidence alone. Questions without excerpts say so."""
    base = questions.select("query_id").join(contexts, "query_id", "left")
    if generator is None:
        return base.select("query_id", F.lit("").alias("text"), F.expr("cast(array() as array<int>)").alias("used"), "citations", F.lit(True).alias("evidence_only"), F.when(F.col("context").isNull(), "nothing was found").otherwise("no model was asked").alias("note"))
    answers = generator(prompts(contexts, questions, turns).join(contexts.select("query_id", "context"), "query_id"))
    rows = base.join(answers, "query_id", "left")
    checked = validate_citations(F.coalesce("answer", F.lit("")), F.coalesce(F.transform("citations", lambda c: c["n"]), F.expr("cast(array() as array<int>)")))
    return rows.withColumn("_c", checked).select("query_id", F.col("_c.text").alias("text"), F.col("_c.used").alias("used"), F.filter("citations", lambda c: F.array_contains(F.col("_c.used"), c["n"])).alias("citations"), F.col("answer").isNull().alias("evidence_only"), F.when(F.col("context").isNull(), "nothing was found").otherwise("").alias("note"))


def images_to_show(citations: DataFrame, most: int = IMAGES) -> DataFrame:
    """The first images (query_id, n, digest) of cited excerpts, ``most`` a query, each digest once."""
    rows = citations.where("digest is not null and digest != ''").groupBy("query_id", "digest").agg(F.min("n").alias("n"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("n")).cast("long")).where(F.col("pos") <= most)


def missing_analyses(papers: DataFrame, lens_ids: DataFrame, analyses: DataFrame, refresh: bool = False) -> DataFrame:
    """The (paper_id, lens) pairs of papers and a handful of lenses that aren't cached, or all to refresh. Lenses are exploded beside each paper; nothing is cross-joined."""
    ids = F.array(*(F.lit(r["id"]) for r in lens_ids.select("id").collect()))
    pairs = papers.select("paper_id", F.explode(ids).alias("lens"))
    return pairs if refresh else pairs.join(analyses.select("paper_id", "lens").distinct(), ["paper_id", "lens"], "left_anti")


def batch_progress(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(paper_id, lens, status): the events of a batch as rows: cached, result, failed or waiting. ``done`` has (paper_id, lens, error)."""
    rows = wanted.join(done, ["paper_id", "lens"], "left")
    return rows.select("paper_id", "lens", F.when(F.col("error").isNotNull() & (F.col("error") != ""), "failed").when(F.col("error").isNotNull(), "result").otherwise("waiting").alias("status"))


class Available(Protocol):
    """A generator among others: its name, and whether it can be used here."""

    name: str
    ready: bool

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def choose(generators: list, wanted: str | None = None):
    """The generator of a name, which must be there and ready; without a name the first that is ready, or None."""
    ready = {g.name: g for g in generators if getattr(g, "ready", True)}
    if wanted is None:
        return next(iter(ready.values()), None)
    if wanted not in ready:
        raise ValueError(f"{wanted} isn't there; there are {', '.join(sorted(ready)) or 'none'}")
    return ready[wanted]


# How often JSON is asked for.
ATTEMPTS = 3
AGAIN = "\n\nYour last answer was no JSON. Give the JSON value alone, without any other words."


def ask_json(rows: DataFrame, generator: Callable, attempts: int = ATTEMPTS) -> DataFrame:
    """(query_id, json, attempt): answers to rows (query_id, prompt, context) that hold JSON, as a variant; rows whose answer holds none are asked again, with a word on that, ``attempts`` times at most.

    What failed throughout has a null value and attempt. Each round's answers are a table in the shared folder, so a generator is asked once for each row and round.
    """
    found, left = None, rows
    for k in range(attempts):
        asked = left if k == 0 else left.withColumn("prompt", F.concat("prompt", F.lit(AGAIN)))
        got = Scratch(generator(asked).select("query_id", F.to_json(coerce_json(F.col("answer"))).alias("_json")), "json-answers").df
        good = got.where("_json is not null").select("query_id", F.parse_json("_json").alias("json"), F.lit(k + 1).alias("attempt"))
        found = good if found is None else found.unionByName(good)
        left = left.join(got.where("_json is not null").select("query_id"), "query_id", "left_anti")
    return rows.select("query_id").join(found, "query_id", "left")


def used_tokens(prompts: DataFrame, answered: DataFrame) -> DataFrame:
    """(query_id, input_tokens, output_tokens): a quarter of the characters of prompts (query_id, prompt) and answers (query_id, answer), at least one each, where a service tells no figures."""
    rows = prompts.select("query_id", estimate_tokens(F.col("prompt")).alias("input_tokens"))
    return rows.join(answered.select("query_id", estimate_tokens(F.col("answer")).alias("output_tokens")), "query_id")


def answer_events(answered: DataFrame, citations: DataFrame, piece: int = 40) -> DataFrame:
    """(query_id, pos, event, body): the events of streamed answers in order: retrieving, the evidence (``citations``: query_id, citations), and for those with evidence writing, the answer's pieces (``answered``: query_id, answer) and the end.

    An answer comes in pieces of about ``piece`` characters, cut behind a blank; an empty one has no pieces.
    """
    rows = citations.select("query_id", F.to_json("citations").alias("_evidence")).join(answered.select("query_id", "answer"), "query_id", "left")
    event = lambda name, body: F.struct(F.lit(name).alias("event"), body.alias("body"))
    pieces = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(rf"(?s).{{1,{piece}}}\S*\s?"), F.lit(0))
    told = F.concat(F.array(event("status", F.lit("retrieving")), event("evidence", F.coalesce("_evidence", F.lit("[]")))), F.when(F.col("answer").isNull(), F.array()).otherwise(F.concat(F.array(event("status", F.lit("writing"))), F.transform(pieces, lambda p: event("delta", p)))), F.array(event("done", F.coalesce("answer", F.lit("")))))
    return rows.select("query_id", F.posexplode(told).alias("pos", "_e")).select("query_id", F.col("pos").cast("long").alias("pos"), "_e.event", "_e.body")


def assembled(events: DataFrame) -> DataFrame:
    """(query_id, answer): the pieces of streamed answers put together in order; an answer without pieces is empty."""
    pieces = F.filter(F.array_sort(F.collect_list(F.struct("pos", "event", "body"))), lambda e: e["event"] == "delta")
    return events.groupBy("query_id").agg(F.array_join(F.transform(pieces, lambda e: e["body"]), "").alias("answer"))
