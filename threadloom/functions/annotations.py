"""Prompts for annotators, and checks of what they answer. Native Column expressions over VARIANT for JSON types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let

# Fixed values.
LABELS = ("Information Providing", "Information Seeking", "Epistemic/Factual", "Experiential", "Opinion/Belief", "AOT")
LABEL_COLUMNS = ("information_providing", "information_seeking", "epistemic", "experiential", "opinion", "aot")
REQUIRED_FIELDS = ("label", "evidence_span", "confidence", "rationale")
MIN_RATIONALE = 10
MAX_PROMPT_TOKENS, CHARS_PER_TOKEN = 4000, 4

SYSTEM_MESSAGE = "You annotate short texts with the perspectives they express and answer with valid JSON only."
# The template is a parameter; this one asks for the same answer in our own words.
TEMPLATE = """Annotate a short text with the perspectives that it expresses. Labels: Information Providing, Information Seeking,
Epistemic/Factual, Experiential, Opinion/Belief, AOT (actively open-minded thinking). Give each label that applies an object of
its own with the fields "label", "evidence_span" (copied verbatim from the text, as short as can be), "confidence" (0 to 1)
and "rationale" (one or two sentences). Answer with one JSON object that maps the text's id to the list of these objects.

Tweet ID: {tweet_id}
Tweet Text: "{tweet_text}"

Provide your annotation in valid JSON format only.
"""
MARKER = "Provide your annotation"


def build_prompt(tweet_id: Column, text: Column, template: str = TEMPLATE) -> Column:
    """The template with id and text put in; the text's own braces stay as they are."""
    head, _, tail = template.partition("{tweet_text}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{tweet_id}"), tweet_id)
    return F.concat(fill(head), text, fill(tail))


def augment_prompt(prompt: Column, title: Column, summary: Column) -> Column:
    """The prompt with what a link leads to before the closing request; missing parts read N/A."""
    said = F.concat(
        F.lit("Linked content:\nTitle: "), F.coalesce(title, F.lit("N/A")), F.lit("\nSummary: "), F.coalesce(summary, F.lit("N/A")), F.lit(f"\n\n{MARKER}")
    )
    return F.replace(prompt, F.lit(MARKER), said)


def prompt_fits(prompt: Column, max_tokens: int = MAX_PROMPT_TOKENS) -> Column:
    return F.length(prompt) / CHARS_PER_TOKEN <= max_tokens


def extract_json(response: Column) -> Column:
    """The longest brace-balanced part (two levels) outside of code fences, the first of equals; else the stripped text."""

    def longest(bare: Column) -> Column:
        found = F.regexp_extract_all(bare, F.lit(r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"), F.lit(0))
        best = F.reduce(found, F.lit(None).cast("string"), lambda best, x: F.when(F.length(x) <= F.length(best), best).otherwise(x))
        return F.coalesce(best, F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))

    return let(F.regexp_replace(F.regexp_replace(response, r"(?U)```json\s*", ""), r"(?U)```\s*$", ""), longest)


def _one_list(text: Column, use) -> Column:
    """``use(error, list)`` of an answer: why it isn't one object with one key and a list, or null, and the list as a VARIANT."""

    def of_object(fields: Column, kind: Column) -> Column:
        def of_value(inner: Column) -> Column:
            error = (
                F.when(F.coalesce(text, F.lit("")) == "", "no_json")
                .when(kind.isNull(), "parse_error")
                .when(fields.isNull(), "not_a_dictionary")
                .when(F.size(fields) != 1, "not_one_key")
                .when(~F.startswith(F.schema_of_variant(inner), F.lit("ARRAY")), "not_a_list")
            )
            return let(error, lambda e: use(e, inner))

        return let(F.get(F.map_values(fields), F.lit(0)), of_value)

    def of_json(value: Column) -> Column:
        return let(F.schema_of_variant(value), lambda kind: let(F.when(F.startswith(kind, F.lit("OBJECT")), value.cast("map<string,variant>")), lambda fields: of_object(fields, kind)))

    return let(F.try_parse_json(text), of_json)


def structure_error(text: Column) -> Column:
    """Why the text is not one object with one key and a list; null if it is."""
    return let(text, lambda t: _one_list(t, lambda error, _: error))


def evidence_ok(span: Column, text: Column, fuzzy: bool = True) -> Column:
    """Whether the span is in the text, exactly or with white space joined on both sides."""
    joined = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    found = F.contains(text, span)
    if fuzzy:
        found = found | F.contains(joined(text), joined(span))
    return F.coalesce((span != "") & (text != "") & found, F.lit(False))


def confidence_ok(value: Column) -> Column:
    """Whether a JSON value is a number, or true or false as 1 and 0, from 0 to 1."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce((F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "BOOLEAN")) & number.between(0.0, 1.0), F.lit(False))


def label_ok(label: Column) -> Column:
    return F.coalesce(label.isin(*LABELS), F.lit(False))


def item_errors(item: Column, text: Column) -> Column:
    """The codes of what is wrong with one annotation; none if it is valid. Missing fields hide the other checks."""
    of = lambda field, kind="string": F.try_variant_get(item, f"$.{field}", kind)
    missing = [F.when(of(f, "variant").isNull(), f"missing_{f}") for f in REQUIRED_FIELDS]
    lacks = F.array_compact(F.array(*missing))
    wrong = F.array_compact(
        F.array(
            F.when(~label_ok(of("label")), "label"),
            F.when(~evidence_ok(of("evidence_span"), text), "evidence"),
            F.when(~confidence_ok(of("confidence", "variant")), "confidence"),
            F.when(F.coalesce(F.length(F.regexp_replace(of("rationale"), r"(?U)^\s+|\s+$", "")), F.lit(0)) < MIN_RATIONALE, "rationale"),
        )
    )
    return F.when(F.size(lacks) > 0, lacks).otherwise(wrong)


def validate_response(response: Column, text: Column, strict: bool = False) -> Column:
    """Struct of is_valid, error (of the structure), errors (by item) and annotations (the valid ones)."""

    def outcome(problem: Column, checked: Column) -> Column:
        good = F.transform(
            F.filter(checked, lambda c: F.size(c["errors"]) == 0),
            lambda c: F.struct(
                F.try_variant_get(c["item"], "$.label", "string").alias("label"),
                F.try_variant_get(c["item"], "$.evidence_span", "string").alias("evidence_span"),
                F.try_variant_get(c["item"], "$.confidence", "double").alias("confidence"),
                F.try_variant_get(c["item"], "$.rationale", "string").alias("rationale"),
            ),
        )
        good = F.coalesce(good, F.array().cast("array<struct<label:string,evidence_span:string,confidence:double,rationale:string>>"))
        errors = F.coalesce(F.transform(checked, lambda c: c["errors"]), F.array().cast("array<array<string>>"))

        def result(annotations: Column) -> Column:
            valid = problem.isNull() & (F.lit(not strict) | (F.size(annotations) > 0))
            return F.struct(valid.alias("is_valid"), problem.alias("error"), errors.alias("errors"), annotations.alias("annotations"))

        return let(good, result)

    def items(problem: Column, inner: Column) -> Column:
        listed = F.when(problem.isNull(), inner.cast("array<variant>"))
        return let(F.transform(listed, lambda x: F.struct(x.alias("item"), item_errors(x, text).alias("errors"))), lambda checked: outcome(problem, checked))

    return let(extract_json(response), lambda body: _one_list(body, items))
