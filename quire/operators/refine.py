"""Refining readings with a language model that the caller brings: prompts, attempts and the fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null
from quire.operators.ensemble import ENGINES, fallback_text, hint

ATTEMPTS = 3
WAIT_S = 2.0
FALLBACK_MODEL = "fallback-no-llm"


#: Templates of prompts; callers bring their own with the rules of their script. {a}, {b}, {c} are the readings, {hint} what
#: they agree on, {engine} and {text} the one reading's.
THREE = "Three readings of one line follow.\nReading A: {a}\nReading B: {b}\nReading C: {c}{hint}Answer with the corrected line only."
ONE = "A reading by {engine} follows.\n{text}\nAnswer with the corrected line only."
EMPTY = "(empty)"


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns; {{ and }} are braces. A name without a column is an error."""
    parts = []
    for plain, name, _, _ in Formatter().parse(template):
        parts += [F.lit(plain)] * bool(plain) + ([values[name]] if name is not None else [])
    return F.concat(*parts) if parts else F.lit("")


def three_reading_prompt(majority: Column, suspect: Column, template: str = THREE) -> Column:
    """A prompt with all three readings, (empty) for missing ones, and the hints that apply."""
    shown = {letter: F.coalesce(F.nullif(F.col(f"{e}.text"), F.lit("")), F.lit(EMPTY)) for letter, e in zip("abc", ENGINES, strict=True)}
    return filled(template, **shown, hint=hint(majority, suspect))


def one_reading_prompt(engine: str, template: str = ONE) -> Column:
    """A prompt with one reading; null for a blank one, which is never sent."""
    text = F.col(f"{engine}.text")
    return F.when(blank_to_null(text).isNotNull(), filled(template, engine=F.lit(engine), text=text))


def refined(flagged: DataFrame, call: Callable[[str], str], model: str, attempts: int = ATTEMPTS, wait: float = WAIT_S, template: str = THREE) -> DataFrame:
    """flagged readings with refined_text, refined_model and refine_failed. call(prompt) is tried a few times per row; after
    that the fallback text stands and the last error is kept, so one bad row doesn't end the job."""
    majority, suspect = F.coalesce("majority_agreement", F.lit(False)), F.coalesce("surya_suspect", F.lit(False))
    return _asked(flagged, three_reading_prompt(majority, suspect, template), fallback_text(majority), call, model, attempts, wait)


def refined_one(readings: DataFrame, engine: str, call: Callable[[str], str], model: str, attempts: int = ATTEMPTS, wait: float = WAIT_S, template: str = ONE) -> DataFrame:
    """readings with refined_text, refined_model and refine_failed of one engine's reading. A blank reading is kept as it is (null
    as an empty one) and never sent; its model is null. After failed attempts the reading itself stands."""
    return _asked(readings, one_reading_prompt(engine, template), F.coalesce(F.col(f"{engine}.text"), F.lit("")), call, model, attempts, wait)


def _asked(readings: DataFrame, prompt: Column, plain: Column, call: Callable[[str], str], model: str, attempts: int, wait: float) -> DataFrame:
    """readings with call's answer to each prompt, plain where there is no prompt or no answer."""
    rows = readings.drop("refined_text", "refined_model", "refine_failed").withColumns({"_prompt": prompt, "_plain": plain})
    kept = [f for f in rows.schema.fields if not f.name.startswith("_")]
    key = F.struct(*[f.name for f in kept])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, models, errors = [], [], []
            for prompt, plain in zip(pdf["_prompt"], pdf["_plain"], strict=True):
                text, error = None, None
                for n in range(attempts if prompt is not None else 0):
                    try:
                        text = call(prompt)
                        break
                    except Exception as e:  # kept per row
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < attempts:
                            time.sleep(wait)
                texts.append(plain if text is None else text)
                models.append(model if text is not None else None if prompt is None else FALLBACK_MODEL)
                errors.append(error if text is None else None)
            yield pd.DataFrame({"r": pdf["r"], "refined_text": texts, "refined_model": models, "refine_failed": errors})

    packed = rows.select(key.alias("r"), "_prompt", "_plain")
    out = packed.mapInPandas(work, f"r {packed.schema['r'].dataType.simpleString()}, refined_text string, refined_model string, refine_failed string")
    return out.select("r.*", "refined_text", "refined_model", "refine_failed")
