"""Prompt and request columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill import constants as K


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template.

    Values are joined between the literal pieces, so braces inside a text are
    never read as places.
    """
    parts = []
    for at, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if at % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def numbered(examples: Column) -> Column:
    """Lines ``1. "first"`` and so on."""
    return F.transform(
        examples, lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x, F.lit('"'))
    )


def examples_section(examples: Column, max_examples: int) -> Column:
    """Heading and numbered examples; empty when there are none."""
    shown = F.slice(examples, 1, max_examples)
    lines = F.concat(F.lit("Representative Examples:\n"), F.array_join(numbered(shown), "\n"), F.lit("\n\n"))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, lines).otherwise(F.lit(""))


def binary_prompt(text, label, description, examples, max_examples: int) -> Column:
    return fill(
        K.BINARY_TEMPLATE,
        text=text,
        label=label,
        description=description,
        examples_section=examples_section(examples, max_examples),
    )


def reasoning_prompt(text, label, description, examples, max_examples: int) -> Column:
    return fill(
        K.REASONING_TEMPLATE,
        text=text,
        label=label,
        description=description,
        examples_section=examples_section(examples, max_examples),
    )


def class_list(labels: Column, descriptions: Column) -> Column:
    """Lines ``- label: description``."""
    lines = F.zip_with(labels, descriptions, lambda a, b: F.concat(F.lit("- "), a, F.lit(": "), b))
    return F.array_join(lines, "\n")


def multiclass_prompt(text, predicted, class_descriptions, examples, max_examples: int) -> Column:
    return fill(
        K.MULTICLASS_TEMPLATE,
        text=text,
        predicted_class=predicted,
        class_descriptions=class_descriptions,
        examples_section=examples_section(examples, max_examples),
    )


def uncertainty_prompt(text, predicted, confidence, available) -> Column:
    return fill(
        K.UNCERTAINTY_TEMPLATE,
        text=text,
        predicted_class=predicted,
        confidence=confidence,
        available_classes=available,
    )


def describe_prompt(label: Column, examples: Column, total: Column, shown: int = 10) -> Column:
    """Ask for a label description from its first examples; ``total`` were drawn."""
    listed = F.array_join(numbered(F.slice(examples, 1, shown)), "\n")
    more = F.concat(F.lit("\n... and "), (total - shown).cast("string"), F.lit(" more examples"))
    return fill(
        K.DESCRIBE_TEMPLATE,
        label=label,
        examples=F.concat(listed, F.when(total > shown, more).otherwise(F.lit(""))),
    )


def default_description(label: Column) -> Column:
    """Description used when none was written."""
    return F.when(label == K.NOISE_LABEL, F.lit(K.NOISE_DESCRIPTION)).otherwise(
        fill(K.DEFAULT_DESCRIPTION, label=label)
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(F.struct(content.alias("text"))).alias("parts"))


def chat_request(system: str, user: Column, style: str = "messages", pairs=K.FEW_SHOT_PAIRS) -> Column:
    """One request as JSON.

    ``messages`` has a system message and alternating turns, ``single`` puts
    everything into one user message, ``contents`` uses parts and an acknowledged
    system turn.
    """
    if style == "messages":
        parts = [_message("system", F.lit(system))] if system else []
        for question, answer in pairs:
            parts += [_message("user", F.lit(question)), _message("assistant", F.lit(answer))]
        return F.to_json(F.struct(F.array(*parts, _message("user", user)).alias("messages")))
    if style == "single":
        parts = [F.lit(f"System: {system}")] if system else []
        for question, answer in pairs:
            parts += [F.lit(f"Human: {question}"), F.lit(f"Assistant: {answer}")]
        content = F.concat_ws("\n\n", *parts, F.concat(F.lit("Human: "), user))
        return F.to_json(F.struct(F.array(_message("user", content)).alias("messages")))
    if style == "contents":
        parts = [_turn("user", F.lit(system)), _turn("model", F.lit(K.ACKNOWLEDGEMENT))] if system else []
        for question, answer in pairs:
            parts += [_turn("user", F.lit(question)), _turn("model", F.lit(answer))]
        return F.to_json(F.struct(F.array(*parts, _turn("user", user)).alias("contents")))
    raise ValueError(f"unknown request style {style!r}")
