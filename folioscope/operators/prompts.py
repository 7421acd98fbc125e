"""Prompt alignment: principles from feedback, their application to prompts, and metrics of a prompt's evolution."""

from __future__ import annotations

import re

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import let

LEAST_LENGTH, MOST_LENGTH, MOST_PRINCIPLES = 10, 200, 10
SUGGESTION_IMPORTANCE, ISSUE_IMPORTANCE = 0.8, 0.9
STORED_FACTOR, IMPORT_IMPORTANCE = 0.9, 0.8

# Parts of words that make a suggestion actionable.
ACTIONABLE = ("should", "must", "ensure", "add", "remove", "include", "specify", "clarify", "provide", "always", "never", "require")
# Hedge words.
HEDGES = ("maybe", "perhaps", "might", "could", "possibly", "somewhat", "likely", "probably", "seems", "appears")
# Words that may be repeated.
REPEATABLE = ("the", "a", "an", "and", "or", "but", "to", "of", "in")
# Question words.
QUESTIONS = ("what", "how", "why", "when", "where", "who")
# What an issue says, and the principle that answers it.
ISSUE_PRINCIPLES = (
    ("unclear", "Ensure clarity and specificity in requirements"),
    ("ambiguous", "Provide specific, unambiguous instructions"),
    ("too vague", "Make requirements specific and concrete"),
    ("too long", "Keep prompts concise while maintaining clarity"),
    ("too complex", "Break down complex requirements into simpler parts"),
    ("no context", "Provide sufficient context for understanding"),
    ("no examples", "Include relevant examples to clarify expectations"),
)
# The texts with which the rules change a prompt.
INCLUDE, ENSURE = "should include", "Ensure: "
DETAILS, DETAILS_ASKED = " with specific details and examples?", " (provide specific, detailed response)"
ADDRESS = "Please address the following:\n"
MAIN_REQUEST, CONTEXT_AFTER = "Main request: ", "\n\nContext: "
MAIN_POINT, DETAILS_AFTER = "Main point: ", "\n\nDetails: "
NOTHING_TO_ADD = "Additional information: [Specify what to add]"
REQUIREMENTS_AFTER = "\n\nSpecific requirements: [Add specific details here]"
SPECIFICALLY_AFTER = "\n\nSpecifically: [Add concrete details]"
BACKGROUND_BEFORE = "Context: [Provide relevant background]\n\n"
DOMAIN_BEFORE = "Given the context of [specify domain/situation]:\n"
PRINCIPLE_BEFORE, INSTRUCTION_BEFORE = "Principle: ", "Clear instruction: "
EXAMPLE_AFTER = "\n\nExample: [Add relevant example]"


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def is_actionable(text: Column) -> Column:
    return _any_of(F.lower(text), ACTIONABLE)


def issue_principle(issue: Column) -> Column:
    """The positive principle that answers an issue: the first rule that fits."""
    low = F.lower(issue)
    swap = lambda word: F.replace(issue, F.lit(word), F.lit(INCLUDE))
    out = F.when(low.contains("lacks"), swap("lacks"))
    out = out.when(low.contains("missing"), F.when(issue.contains("Missing"), swap("Missing")).otherwise(swap("missing")))
    for said, answer in ISSUE_PRINCIPLES:
        out = out.when(low.contains(said), answer)
    bare = F.replace(F.replace(issue, F.lit("not"), F.lit("")), F.lit("no"), F.lit(""))
    return out.otherwise(F.concat(F.lit(ENSURE), F.trim(bare)))


def extract_principles(feedback: DataFrame) -> DataFrame:
    """feedback(feedback_id, principles array<struct<principle, importance>>, suggestions, issues array<string>) ->
    (feedback_id, place, principle, importance): explicit ones of fitting length, actionable suggestions, answers to
    issues; the first ten of each of the latter two are looked at, and ten in all are kept."""
    given = F.filter("principles", lambda p: F.length(p["principle"]).between(LEAST_LENGTH, MOST_LENGTH))
    given = F.transform(given, lambda p: F.struct(p["principle"].alias("principle"), p["importance"].cast("double").alias("importance")))

    def weighed(texts: Column, importance: float) -> Column:
        return F.transform(texts, lambda t: F.struct(t.alias("principle"), F.lit(importance).alias("importance")))

    told = weighed(F.filter(F.slice("suggestions", 1, MOST_PRINCIPLES), is_actionable), SUGGESTION_IMPORTANCE)
    answers = F.filter(F.transform(F.slice("issues", 1, MOST_PRINCIPLES), issue_principle), lambda t: t != "")
    whole = F.slice(F.concat(given, told, weighed(answers, ISSUE_IMPORTANCE)), 1, MOST_PRINCIPLES)
    return feedback.select("feedback_id", F.posexplode(whole).alias("place", "p")).select("feedback_id", "place", "p.principle", "p.importance")


def clarify(prompt: Column) -> Column:
    """A prompt without hedge words, with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(prompt, rf"(?i)\b(?:{'|'.join(HEDGES)})\b", ""), r"\s+", " "))


def make_specific(prompt: Column) -> Column:
    asked = F.replace(prompt, F.lit("?"), F.lit(DETAILS))
    return F.when(prompt.contains("?"), asked).otherwise(F.concat(prompt, F.lit(DETAILS_ASKED)))


def simplify(prompt: Column) -> Column:
    """A prompt without repeated words, but for those that may be."""
    words = F.filter(F.split(prompt, r"\s+"), lambda w: w != "")

    def fresh(ws: Column) -> Column:
        low = F.transform(ws, lambda w: F.lower(w))
        return F.filter(ws, lambda w, i: F.lower(w).isin(*REPEATABLE) | (F.array_position(low, F.lower(w)) == i + 1))

    return F.array_join(let(words, fresh), " ")


def break_down(prompt: Column) -> Column:
    """Parts between commas, semicolons and the word `and` as a numbered list (numbers count blank parts too)."""
    parts = F.split(prompt, r"[;,]|\band\b", -1)
    numbered = F.filter(F.transform(parts, lambda p, i: F.when(F.trim(p) != "", F.concat((i + 1).cast("string"), F.lit(". "), F.trim(p)))), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 1, F.concat(F.lit(ADDRESS), F.array_join(numbered, "\n"))).otherwise(prompt)


def _sentences(prompt: Column) -> Column:
    return F.filter(F.transform(F.split(prompt, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def restructure(prompt: Column) -> Column:
    """Questions first, then the rest; without questions the shortest sentence first, then the others by length."""

    def ordered(s: Column) -> Column:
        questions = F.filter(s, lambda x: _any_of(F.lower(x), QUESTIONS))
        others = F.filter(s, lambda x: ~F.array_contains(questions, x))
        by_size = F.transform(F.array_sort(F.transform(s, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))), lambda x: x["x"])
        asked = F.concat(F.lit(MAIN_REQUEST), F.array_join(questions, ". "), F.lit(CONTEXT_AFTER), F.array_join(others, ". "))
        told = F.concat(F.lit(MAIN_POINT), by_size[0], F.lit(DETAILS_AFTER), F.array_join(F.slice(by_size, F.lit(2), F.size(s)), ". "))
        return F.when(F.size(s) <= 1, F.lit(None)).when(F.size(questions) > 0, asked).otherwise(told)

    return F.coalesce(let(_sentences(prompt), ordered), prompt)


def capitalise_sentences(prompt: Column) -> Column:
    """What follows a run of end marks, and the first character, in upper case (blanks count as characters)."""
    parts = F.split(prompt, r"(?<=[.!?])(?![.!?])", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def core_request(prompt: Column) -> Column:
    question = F.regexp_extract(prompt, r"([^.]*\?)", 1)
    return F.when(question != "", F.trim(question)).otherwise(F.trim(F.split(prompt, r"[.!?]+", -1)[0]))


def addition(principle: Column) -> Column:
    found = F.trim(F.regexp_extract(principle, r"(?i)(?:add|include)\s+(.+)", 1))
    return F.when(found != "", found).otherwise(NOTHING_TO_ADD)


def apply_principle(prompt: Column, principle: Column, preserve_context: bool = True) -> Column:
    """A prompt changed as the first rule says that a principle's words call for."""
    low = F.lower(principle)
    has = lambda *parts: _any_of(low, parts)
    gap = F.lit("\n\n")
    if preserve_context:
        clear = F.concat(prompt, F.lit(REQUIREMENTS_AFTER))
        specific = F.concat(prompt, F.lit(SPECIFICALLY_AFTER))
        context = F.concat(F.lit(BACKGROUND_BEFORE), prompt)
        added, general = F.concat(prompt, gap, addition(principle)), F.concat(F.lit(PRINCIPLE_BEFORE), principle, gap, prompt)
    else:
        clear, specific = F.concat(F.lit(INSTRUCTION_BEFORE), clarify(prompt)), make_specific(prompt)
        context = F.concat(F.lit(DOMAIN_BEFORE), prompt)
        added, general = F.concat(addition(principle), gap, prompt), F.concat(principle, gap, core_request(prompt))
    return (
        F.when(has("clarity", "clear"), clear)
        .when(has("specific", "concrete"), specific)
        .when(has("concise", "shorten"), simplify(prompt))
        .when(has("simple", "break down"), break_down(prompt))
        .when(has("context"), context)
        .when(has("add", "include"), added)
        .when(has("structure"), restructure(prompt))
        .when(has("example"), F.concat(prompt, F.lit(EXAMPLE_AFTER)))
        .when(has("format"), capitalise_sentences(prompt))
        .otherwise(general)
    )


def apply_principles(prompt: Column, principles: Column, preserve_context: bool = True) -> Column:
    """A prompt after all principles (array<struct<principle, importance>>), the most important first (ties: as given)."""
    ranked = F.transform(principles, lambda p, i: F.struct((-p["importance"]).alias("o"), i.alias("i"), p["principle"].alias("p")))
    return F.aggregate(F.array_sort(ranked), prompt, lambda text, p: apply_principle(text, p["p"], preserve_context))


def combine_principles(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Both (principle, importance): new ones as they are, stored ones a tenth less important."""
    return new.select("principle", "importance").unionByName(stored.select("principle", (F.col("importance") * STORED_FACTOR).alias("importance")))


def add_principles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored(seq, principle, importance) and those of new whose text it lacks, each text once (the first stays)."""
    fresh = new.join(stored, "principle", "left_anti")
    first = fresh.groupBy("principle").agg(F.min(F.struct("seq", "importance")).alias("f")).select("f.seq", "principle", "f.importance")
    return stored.select("seq", "principle", "importance").unionByName(first)


def boost(importance: Column, factor: float) -> Column:
    """Importance times a factor (1.2 for an ideal's principles, 1.1 for a critique's), at most 1."""
    return F.least(importance * factor, F.lit(1.0))


def alignment_metrics(evolution: DataFrame, final: DataFrame) -> DataFrame:
    """evolution(prompt_id, iteration, score), final(prompt_id, final_score) -> (prompt_id, n_iterations,
    mean_change, convergence_rate, stability): the mean change of score, the whole gain per iteration, and
    1 / (1 + variance of the changes), which is 1 for fewer than two."""
    order = Window.partitionBy("prompt_id").orderBy("iteration")
    steps = evolution.withColumn("change", F.col("score") - F.lag("score").over(order))
    sums = steps.groupBy("prompt_id").agg(F.count("*").alias("n"), F.min_by("score", "iteration").alias("first"), F.avg("change").alias("mean"), F.var_pop("change").alias("var"), F.count("change").alias("changes"))
    return sums.join(final, "prompt_id").select(
        "prompt_id", F.col("n").alias("n_iterations"),
        F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("mean_change"),
        F.round((F.col("final_score") - F.col("first")) / F.col("n"), 9).alias("convergence_rate"),
        F.round(F.when(F.col("changes") > 1, 1 / (1 + F.col("var"))).otherwise(1.0), 9).alias("stability"),
    )


def checked_prompt(prompt: Column) -> Column:
    """A prompt of 10 to 10,000 characters; others are an error."""
    return F.when(F.length(prompt).between(10, 10_000), prompt).otherwise(F.raise_error(F.lit("a prompt must have 10 to 10000 characters")))


def align(prompts: DataFrame, evaluate: Callable[[DataFrame], DataFrame], feedback: Callable[[DataFrame], DataFrame], threshold: float = 0.85, max_iterations: int = 5, preserve_context: bool = True, save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """prompts(prompt_id, prompt) changed until their score reaches the threshold -> (final prompts, evolution).

    evaluate: adds score; feedback: from (prompt_id, prompt, score) to (feedback_id, principles, suggestions,
    issues). All prompts below the threshold go through a round together; save cuts lineage between rounds.
    """
    now = prompts.select("prompt_id", checked_prompt(F.col("prompt")).alias("prompt"))
    history = None
    for i in range(max_iterations):
        scored = save(evaluate(now).withColumn("iteration", F.lit(i)), f"align{i}")
        open_ = scored.where(F.col("score") < threshold)
        step = scored.select("prompt_id", "iteration", "prompt", "score")
        history = step if history is None else history.unionByName(step)
        if open_.isEmpty():
            break
        lists = extract_principles(feedback(open_)).groupBy("feedback_id").agg(F.sort_array(F.collect_list(F.struct("place", "principle", "importance"))).alias("ps"))
        joined = scored.join(lists, scored["prompt_id"] == lists["feedback_id"], "left")
        changed = apply_principles(F.col("prompt"), F.transform("ps", lambda p: F.struct(p["principle"].alias("principle"), p["importance"].alias("importance"))), preserve_context)
        now = joined.select("prompt_id", F.when((F.col("score") < threshold) & F.col("ps").isNotNull(), changed).otherwise(F.col("prompt")).alias("prompt"))
    return evaluate(now), history


# --- prompt builders ------------------------------------------------------------------------------------------------


def fill_prompt(template: str, given: dict[str, Column]) -> Column:
    """A template with {name} places, filled with columns (null: empty). A place without a column is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = sorted({n for n in parts[1::2] if n not in given})
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return F.concat(*(F.coalesce(given[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def chunking_prompt(text: Column, most: int = 5000) -> Column:
    """What a model that cuts pages into chunks is asked; at most that many characters of the page are shown."""
    return fill_prompt("Cut this page into passages that can be understood alone. Keep its words and their order.\n\n{page}", {"page": F.substring(text, 1, most)})


def meaning_prompt(term: Column, contexts: Column, most: int = 3000) -> Column:
    """What a model that judges a term is asked: the term and where it was found, at most that many characters of it."""
    shown = F.substring(F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("- "), c)), "\n"), 1, most)
    return fill_prompt("Say whether {term} is a term of these documents, and what it means in them.\n\n{shown}", {"term": term, "shown": shown})


def refinement_prompt(query: Column, own: Column, peers: Column, round_: Column) -> Column:
    """What a model is asked after a round: its own answer and its peers', numbered."""
    numbered = F.array_join(F.transform(peers, lambda p, i: F.concat(F.lit("Answer "), (i + 1).cast("string"), F.lit(": "), p)), "\n")
    return fill_prompt("{query}\n\nRound {round}. You answered: {own}\n\nOthers answered:\n{peers}\n\nAnswer again; keep your answer where theirs don't convince you.", {"query": query, "round": round_, "own": own, "peers": numbered})


def judge_prompt(first: Column, second: Column, n_votes: Column) -> Column:
    """What a judge is asked about the two answers of a tie."""
    return fill_prompt("{n} votes end in a tie of two answers.\n\nFirst: {first}\n\nSecond: {second}\n\nGive the better one, or one that is better than both, in the same form.", {"n": n_votes, "first": first, "second": second})
