"""Rewards as arithmetic on columns; the weights are data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milestones and their weights.
PRODUCTION = {
    "question_present": 0.15,
    "code_present": 0.15,
    "json_valid": 0.15,
    "schema_fraction": 0.20,
    "valid_operation_fraction": 0.20,
    "valid_prefix_fraction": 0.15,
}
GROUNDING = {
    "seed_coverage": 0.12,
    "relation_valid_fraction": 0.08,
    "handle_valid_fraction": 0.08,
    "type_valid_fraction": 0.08,
    "executable_prefix_fraction": 0.16,
    "program_executable": 0.14,
    "answer_nonempty": 0.09,
    "cardinality_valid": 0.05,
    "question_program_alignment": 0.10,
    "no_answer_leak": 0.05,
    "certified": 0.05,
}
SOLVER_SYNTAX = {
    "output_present": 0.10,
    "json_valid": 0.25,
    "schema_fraction": 0.25,
    "valid_operation_fraction": 0.20,
    "valid_prefix_fraction": 0.20,
}
SOLVER_TOOL = {
    "tool_call_attempted": 0.10,
    "valid_tool_call_fraction": 0.25,
    "successful_tool_call_fraction": 0.25,
    "evidence_progress": 0.15,
    "execution_progress": 0.15,
    "budget_compliance": 0.10,
}
SOLVER_SOLVE = {
    "answer_present": 0.10,
    "answer_parse_valid": 0.15,
    "answer_f1": 0.55,
    "exact_match": 0.20,
}
# What each rejection is worth.
REJECTION = {
    "NON_JSON": -1.0,
    "EXTRA_TEXT": -0.9,
    "EXTRA_FIELD": -0.75,
    "UNSUPPORTED_VERSION": -0.75,
    "UNKNOWN_OP": -0.75,
    "INVALID_SCHEMA": -0.6,
    "RELATION_NOT_ALLOWED": -0.6,
    "EMPTY_RESULT": -0.4,
    "NON_UNIQUE_RESULT": -0.4,
    "BUDGET_EXCEEDED": -0.4,
}
#: An incomplete script earns at most this part of what a parsed one would.
TRUNCATED = 0.4


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(values[name].cast("double"), F.lit(0.0)) * w
    return out


def frontier(rate: Column, target: float = 0.5, sigma: float = 0.2) -> Column:
    """Most where the pass rate is at the target."""
    return F.exp(-(rate - target) * (rate - target) / (2 * sigma * sigma))


def smoothed(rate: Column, n: Column) -> Column:
    return (rate * n + 1) / (n + 2)


def efficiency(cost: Column) -> Column:
    return F.exp(-0.05 * cost)


def quality(rate: Column, necessity: Column, novelty: Column, cost: Column) -> Column:
    return 0.2 + 0.8 * (0.35 * frontier(rate) + 0.25 * necessity + 0.25 * novelty + 0.15 * efficiency(cost))


def gated_quality(rate: Column, n: Column, necessity: Column, novelty: Column, alignment: Column, cost: Column) -> Column:
    q = 0.35 * necessity + 0.25 * novelty + 0.20 * alignment + 0.20 * efficiency(cost)
    return 0.05 + 0.95 * frontier(smoothed(rate, n)) * (0.5 + 0.5 * q)


def curriculum(production: Column, grounding: Column, frontier_value: Column, parsed: Column, executed: Column, stage: str) -> Column:
    """The reward of a stage: production alone, with grounding, or with the frontier, whose weight grows with how often
    scripts parse and run."""
    if stage == "production":
        return production
    if stage == "grounding":
        return 0.4 * production + 0.6 * grounding
    weight = 0.35 * parsed * executed
    return (1 - weight) * (0.3 * production + 0.7 * grounding) + weight * frontier_value


def rejection(code: Column) -> Column:
    out = F.lit(-0.6)
    for name, value in REJECTION.items():
        out = F.when(code == name, value).otherwise(out)
    return out


def solver_outcome(f1: Column, em: Column) -> Column:
    return 0.1 + 0.7 * f1 + 0.2 * em


def tool_penalty(searches: Column, invalid: Column) -> Column:
    return -0.02 * F.greatest(searches - 3, F.lit(0)) - 0.1 * invalid


def alignment(question: Column, anchors: Column) -> Column:
    """Half token F1 of the question's words with the anchor words, half the anchors' recall."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9]+"), F.lit(0)))
    both, n, m = F.size(F.array_intersect(q, anchors)), F.size(q), F.size(anchors)
    return F.when((n == 0) | (m == 0), 0.0).otherwise(0.5 * (2 * both / (n + m)) + 0.5 * both / m)


def solver_curriculum(syntax: Column, tool: Column, solve: Column, stage: str) -> Column:
    """The solver's reward of a stage from its three scores (``weighted`` over the milestones above): syntax alone, with tools, or
    with answers."""
    if stage == "syntax":
        return syntax
    if stage == "tool":
        return 0.4 * syntax + 0.6 * tool
    return 0.2 * syntax + 0.3 * tool + 0.5 * solve


def verification_failure(reasons: Column, executable: Column, nonempty: Column, cardinality: Column, efficiency_: Column) -> Column:
    """What a task that failed verification is worth: the worst failure decides, and the nearer to a valid task the more."""
    said = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    return (
        F.when(said("ANSWER_LEAK", "SHORTCUT_FOUND"), -0.3).when(~executable | said("EXECUTION_ERROR"), -0.35).when(~nonempty | ~cardinality, -0.2).when(said("SHORTCUT_UNKNOWN"), -0.15)
        .otherwise(-0.1 - 0.02 * (1.0 - efficiency_))
    )


def _prefix(flags: Column) -> Column:
    bad = F.array_position(flags, F.lit(False))
    return F.when(bad == 0, F.size(flags)).otherwise(bad - 1)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def whole_json(text: Column) -> Column:
    """Whether a text is JSON without anything after it, which a parser by itself passes over."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()


def script_shape(text: Column, version: str, allowed: list[str]) -> Column:
    """code_present, schema_fraction, valid_operation_fraction, valid_prefix_fraction of a script's text.  A text that is whole
    JSON is read; of a cut-off one only explicit keys and operator names are, for ``TRUNCATED`` of the credit."""
    whole = whole_json(text)
    ops = F.from_json(text, "struct<version: string, ops: array<struct<op: string>>>")
    names_whole = F.transform(F.coalesce(ops["ops"], F.array().cast("array<struct<op:string>>")), lambda o: F.coalesce(o["op"], F.lit("")))
    names_cut = F.regexp_extract_all(text, F.lit(r'"op"\s*:\s*"([^"\\]*)"'), F.lit(1))
    slots = F.greatest(F.regexp_count(text, F.lit(r'"op"\s*:')), F.size(names_cut))
    version_there, ops_there, program_there = (text.rlike(p) for p in (rf'"version"\s*:\s*"{version}"', r'"ops"\s*:\s*\[', r'"program"\s*:\s*\{'))

    def shape(names: Column, total: Column, code: Column, version_: Column, ops_: Column, scale: float) -> Column:
        flags = F.transform(names, lambda n: n.isin(allowed))
        share = _share(F.size(F.filter(flags, lambda f: f)), total)
        return F.struct(
            code.cast("double").alias("code_present"), (scale * (version_.cast("double") + ops_.cast("double") + share) / 3.0).alias("schema_fraction"),
            (scale * share).alias("valid_operation_fraction"), (scale * _share(_prefix(flags), total)).alias("valid_prefix_fraction"),
        )

    read = shape(names_whole, F.size(names_whole), F.lit(True), F.coalesce(ops["version"] == version, F.lit(False)), F.size(names_whole) > 0, 1.0)
    return F.when(whole, read).otherwise(shape(names_cut, slots, version_there | ops_there | program_there, version_there, ops_there, TRUNCATED))


def question_present(text: Column) -> Column:
    """1 where a question is written as a JSON field, whole text or not."""
    return F.coalesce(text.rlike(r'"question"\s*:\s*"(?:[^"\\]|\\.)+"').cast("double"), F.lit(0.0))


def relation_share(named: Column, allowed: Column) -> Column:
    """The share of the relations named that are allowed, with repeats; 1 where none is named."""
    return F.when(F.size(named) == 0, 1.0).otherwise(_share(F.size(F.filter(named, lambda n: F.array_contains(allowed, n))), F.size(named)))


def parsed_answers(text: Column, kind: Column) -> Column:
    """The answers in a text's answer tag, an ARRAY<STRING>: a JSON list, or one value as a list of one.  NULL where there is no
    tag, no JSON, or where a count is not exactly one whole number."""
    from graphweft.functions.text import between_tags

    inside = between_tags(text, "answer")
    value = F.try_parse_json(inside)
    many = F.from_json(inside, "array<string>")
    one = F.when(F.schema_of_variant(value) != "VOID", F.array(F.try_variant_get(value, "$", "string")))
    answers = F.when(F.ltrim(inside).startswith("["), many).otherwise(one)
    whole = answers[0].try_cast("double").cast("bigint").cast("string")
    return F.when(value.isNull(), None).when(kind == "count", F.when((F.size(answers) == 1) & whole.isNotNull(), F.array(whole))).otherwise(answers)


def structure_alignment(target: Column, roots: Column, terminal: Column, nodes: Column, ops: Column, answers: Column) -> Column:
    """How close a program's structure is to a target written ``roots=..|terminal=..|nodes=..|ops=a,b|answers=..``: the mean of four
    matches and the Jaccard similarity of operators (1 where neither has any)."""
    want = F.str_to_map(target, F.lit("[|]"), F.lit("="))
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    a, b = split(want["ops"]), split(ops)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    match = lambda name, c: F.coalesce((want[name] == c).cast("double"), F.lit(0.0))
    return (match("roots", roots) + match("terminal", terminal) + match("nodes", nodes) + match("answers", answers) + F.when(either == 0, 1.0).otherwise(both / either)) / 5.0
