"""Expressions used when reading run logs: metric choice, prompt extraction, prompt selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.constants import JUDGE_MARKERS


def choice_score(choice: Column) -> Column:
    """Letter grade -> score: A = 1.0 ... E = 0.0; '__invalid__' and NULL give NULL."""
    return F.when(choice.isNull() | (choice == "__invalid__"), F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - (F.ascii(choice) - F.lit(65)).cast("double") / F.lit(4.0))


def metric_value(accuracy: Column, score: Column, choice: Column, sacrebleu: Column) -> Column:
    """The graded value of a metrics record: accuracy, else score, else sacrebleu / 100,
    else the choice letter's score; a record with none of them fails the job."""
    known = accuracy.isNotNull() | score.isNotNull() | sacrebleu.isNotNull() | choice.isNotNull()
    return F.when(known, F.coalesce(accuracy, score, sacrebleu / F.lit(100.0), choice_score(choice))).otherwise(
        F.raise_error(F.lit("metrics record without accuracy, score, sacrebleu or choice")).cast("double"))


def chat_contents(messages: Column) -> Column:
    """Non-empty ``content`` fields of a list of chat messages, in order."""
    return F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c.isNotNull() & (c != ""))


def completion_prompt(parts: Column) -> Column:
    """A completion-style prompt: concatenated text without its final character (a newline)."""
    s = F.concat_ws("", parts)
    return F.array(F.substr(s, F.lit(1), F.length(s) - 1))


def drop_last_response(sampled: Column) -> Column:
    """Keep all responses but the final one when there is more than one."""
    return F.when(F.size(sampled) > 1, F.slice(sampled, F.lit(1), F.size(sampled) - 1)).otherwise(sampled)


def select_prompts(prompts: Column) -> Column:
    """Prompt selection: distinct (first occurrence order); one -> it; four -> 1st and 3rd;
    otherwise drop judge prompts recognised by their marker text."""
    d = F.array_distinct(prompts)
    keep = F.filter(d, lambda p: ~(p.contains(JUDGE_MARKERS[0]) | p.contains(JUDGE_MARKERS[1])
                                   | p.contains(JUDGE_MARKERS[2])))
    return (F.when(F.size(d) == 1, d)
            .when(F.size(d) == 4, F.array(F.element_at(d, 1), F.element_at(d, 3)))
            .otherwise(keep))


def parse_list_literal(text: Column) -> Column:
    """A list stored as its printed form (``['a', "b's"]``) -> ``array<string>``.

    Parsed by the JSON reader with single quotes, any backslash escape and raw
    control characters allowed; a value that is not a list gives NULL.
    """
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true",
                                               "allowBackslashEscapingAnyCharacter": "true",
                                               "allowUnquotedControlChars": "true"})
