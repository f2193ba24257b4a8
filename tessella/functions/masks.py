"""Masked texts of score and performance tasks: mask signs and instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask tokens of performances, and what each kind of mask hides.
PERFORMANCE_MASKS = ("[MASK_VEL]", "[MASK_DUR]", "[MASK_TIMING]")
HIDDEN = {
    "score": {"acc": "accidentals (sharps/flats)", "treble": "treble clef (right hand)", "bass": "bass clef (left hand)", "label": "expression marks"},
    "performance": {"timing": "note timing", "velocity": "note velocities", "duration": "note durations", "pedal": "pedal events"},
}


def performance_masks(text: Column) -> Column:
    """Every mask token of a performance as one X."""
    for token in PERFORMANCE_MASKS:
        text = F.replace(text, F.lit(token), F.lit("X"))
    return text


def score_masks(text: Column) -> Column:
    """Masks of a score as X: z with octave commas, each z of a run, and z before a length; a single z is a rest and stays."""
    marked = F.regexp_replace(text, "z,+", "X")
    runs = F.transform(F.regexp_extract_all(marked, F.lit("z+|[^z]+"), F.lit(0)), lambda r: F.when(F.startswith(r, F.lit("zz")), F.repeat(F.lit("X"), F.length(r))).otherwise(r))
    return F.regexp_replace(F.array_join(runs, ""), "z([0-9]+)", "X$1")


def instruction(task: Column, mask: Column) -> Column:
    """Instruction of a task ``<unit>_<score or perf>_lang_<continuation or mask>`` and its mask; empty for others."""
    parts = F.regexp_extract(task, "^(measure|phrase)_(score|perf)_lang_(continuation|mask)$", 1)
    side = F.when(F.contains(task, F.lit("_score_")), "score").otherwise("performance")
    hides = F.coalesce(*[F.when(side == s, F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[mask]) for s, kinds in HIDDEN.items()], mask)
    asked = F.when(F.endswith(task, F.lit("_continuation")), F.concat(F.lit("Continue the "), side, F.lit(" to the next "), parts))
    return F.when(parts == "", "").otherwise(F.coalesce(asked, F.concat(F.lit("Reconstruct the masked "), hides, F.lit(" in the "), side)))
