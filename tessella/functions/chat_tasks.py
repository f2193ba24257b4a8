"""Samples of ten tasks as chat messages: an instruction, sections, the target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tasks and their instructions; {target}, {level} and {mask} are filled in.
TASKS = (
    "measure_epr", "phrase_epr", "abcx2pm", "sm2pm", "measure_score_lang_continuation", "measure_score_lang_mask",
    "phrase_score_lang_continuation", "phrase_score_lang_mask", "measure_perf_lang_continuation", "measure_perf_lang_mask",
)
RENDER_TARGET = "Render target {level} {target} from aligned ABCX score into expressive compact MIDI-TSV performance. Use the previous performance context if provided. Output only the target {level}."
RENDER_SPAN = "Render the provided {kind} into expressive performance midi. Output only the target span."
RENDER_REST = "Using the provided first performance measure as a style reference, render the rest of the {kind} into expressive performance midi. Output only the target span."
CONTINUE_SCORE = "Continue the aligned ABCX score from the given {level}. Output only the next {level}."
RESTORE_SCORE = "Restore the {mask}-masked aligned ABCX score {level}. Output only the restored {level}."
CONTINUE_PERFORMANCE = "Continue the compact MIDI-TSV performance from the given measure. Output only the next measure."
RESTORE_PERFORMANCE = "Restore the {mask}-masked compact MIDI-TSV performance measure. Output only the restored measure."


def _filled(template: str, **values: Column) -> Column:
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def section(title: str, content: Column) -> Column:
    """A titled section without blanks at its end; null (left out) if there is nothing."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+$", "")
    return F.when(body != "", F.concat(F.lit(f"{title}:\n"), body))


def user_message(task: Column, kind: Column, target: Column, context: Column, score: Column, performance: Column, mask: Column) -> Column:
    """The user's message of a sample; null for an unknown task.

    ``kind`` is the place of the sample (coldstart, main, ending), ``context``
    the performance before it, ``score`` and ``performance`` its input.
    """
    level = F.when(F.startswith(task, F.lit("phrase_")), "phrase").otherwise("measure")
    told = F.when(kind != "", F.concat(F.lit("Task type: "), kind))
    cold = (kind == "coldstart") | (F.coalesce(context, F.lit("")) == "")

    def joined(*parts: Column) -> Column:
        return F.concat_ws("\n", *parts)

    def span(name: str, given: Column) -> Column:
        asked = F.when(cold, _filled(RENDER_SPAN, kind=F.lit(name))).otherwise(_filled(RENDER_REST, kind=F.lit(name)))
        return joined(asked, told, given, section("first performance measure", context))

    return (
        F.when(F.endswith(task, F.lit("_epr")), joined(_filled(RENDER_TARGET, level=level, target=target), told, section("Score", score), section("Previous performance", context)))
        .when(task == "abcx2pm", span("abcx score", section("abcx", score)))
        .when(task == "sm2pm", span("score midi", section("score midi", score)))
        .when(F.endswith(task, F.lit("_score_lang_continuation")), joined(_filled(CONTINUE_SCORE, level=level), section("Score", score)))
        .when(F.endswith(task, F.lit("_score_lang_mask")), joined(_filled(RESTORE_SCORE, mask=mask, level=level), section("Score", score)))
        .when(task == "measure_perf_lang_continuation", joined(F.lit(CONTINUE_PERFORMANCE), section("Performance", performance)))
        .when(task == "measure_perf_lang_mask", joined(_filled(RESTORE_PERFORMANCE, mask=mask), section("Performance", performance)))
    )


def messages(user: Column, answer: Column) -> Column:
    """Roles and contents of a sample's messages; null without a user message."""
    return F.when(user.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce(answer, F.lit("")).alias("content"))))


def inferred_task(user: Column) -> Column:
    """Task that a user message begins with, of the six language tasks; else unknown."""
    level = F.when(F.contains(user, F.lit("ABCX score phrase")) | F.contains(user, F.lit("from the given phrase")), "phrase").otherwise("measure")
    restored = F.startswith(user, F.lit("Restore the"))
    return (
        F.when(F.startswith(user, F.lit("Continue the aligned ABCX score from the given")), F.concat(level, F.lit("_score_lang_continuation")))
        .when(restored & F.contains(user, F.lit("ABCX score ")), F.concat(level, F.lit("_score_lang_mask")))
        .when(F.startswith(user, F.lit("Continue the compact MIDI-TSV performance")), "measure_perf_lang_continuation")
        .when(restored & F.contains(user, F.lit("compact MIDI-TSV performance measure")), "measure_perf_lang_mask")
        .otherwise("unknown")
    )
