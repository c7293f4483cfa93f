"""Validators over items: what each says of an item, whether it ran, and how results replace older ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run(items: DataFrame, id: str, text: str, validators: dict[str, Callable[[str], bool | None]], executing: frozenset[str] = frozenset()) -> DataFrame:
    """(id, validator, outcome) per item and validator: passed, failed, skipped (it returns None, or would execute what it
    checks, which is never done here) or error (it raises; the job goes on)."""
    kind = items.schema[id].dataType.simpleString()

    def outcome(name: str, check: Callable[[str], bool | None], value: str) -> str:
        if name in executing:
            return "skipped"
        try:
            said = check(value)
        except Exception:  # noqa: BLE001 - a validator is foreign code
            return "error"
        return "skipped" if said is None else "passed" if said else "failed"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, name, outcome(name, check, t or "")) for i, t in zip(batch["id"], batch["text"]) for name, check in validators.items()]
            yield pd.DataFrame(rows, columns=["id", "validator", "outcome"])

    return items.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(each, f"id {kind}, validator string, outcome string").withColumnRenamed("id", id)


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Results with the new ones in place of older ones of the same validator on the same item; errors replace nothing."""
    good = new.filter("outcome <> 'error'")
    return old.join(good.select(*key), key, "left_anti").unionByName(good.select(*old.columns))


def validated(results: DataFrame, id: str) -> DataFrame:
    """(id, origin): items all of whose validators that ran have passed."""
    ran = results.filter("outcome IN ('passed', 'failed')").groupBy(id).agg(F.bool_and(F.col("outcome") == "passed").alias("_ok"))
    return ran.filter("_ok").select(id, F.lit("EXPERIMENTALLY_VALIDATED").alias("origin"))


def extended(files: dict[str, DataFrame], *extensions: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """An export's files with those that extensions make from its records, under ext/; a name may be used once."""
    out = dict(files)
    for extension in extensions:
        for name, rows in extension(files).items():
            place = f"ext/{name}"
            if place in out:
                raise ValueError(f"{place} is there already")
            out[place] = rows
    return out
