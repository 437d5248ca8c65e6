"""Slots for models and chemistry.

A backend is a function over iterators of pandas frames, or a table that
already holds the results.  Nothing here needs a model: with a table in a slot
the plan is a join.  What fails for a row stays a row, with ``error`` set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: slot: (input columns, output schema)
SLOTS: dict[str, tuple[list[str], str]] = {
    "render": (["path", "page"], "path string, page int, width_px int, height_px int, gray binary, error string"),
    "ocr_words": (["file", "page", "gray", "width_px", "height_px"], "file string, page int, seq int, text string, x int, y int, w int, h int, conf int, error string"),
    "layout": (["file", "page", "gray", "width_px", "height_px"], "file string, page int, label string, conf double, l double, t double, r double, b double, error string"),
    "predict": (["file", "page", "structure_index", "gray", "width_px", "height_px"], "file string, page int, structure_index int, smiles string, error string"),
    "chem_props": (["smiles"], "smiles string, is_valid boolean, canonical string, exact_mass double, formula string, clogp double, tpsa double, rot_bonds int, stereo int, fingerprint array<bigint>, molblock string, error string"),
    "classify": (["file", "page", "answer", "n"], "file string, page int, box_no int, type string, id string, error string"),
    "formulas": (["file", "page"], "file string, page int, answer string, error string"),
}
_REGISTERED: dict[str, Backend | DataFrame] = {}


def register(slot: str, backend: Backend | DataFrame) -> None:
    """Puts a function or a table into a slot; KeyError for an unknown slot."""
    if slot not in SLOTS:
        raise KeyError(slot)
    _REGISTERED[slot] = backend


def available(slot: str) -> tuple[bool, str]:
    """Whether a slot is filled, and a message."""
    backend = _REGISTERED.get(slot)
    if backend is None:
        return False, f"nothing registered for {slot}"
    return True, f"{slot}: {'a table' if isinstance(backend, DataFrame) else 'a function'}"


def apply(slot: str, df: DataFrame) -> DataFrame:
    """The slot's output for the rows of ``df``.  A table is semi-joined to the
    keys asked for; a function runs once per distinct input row."""
    columns, schema = SLOTS[slot]
    backend = _REGISTERED.get(slot)
    if backend is None:
        raise LookupError(f"nothing registered for {slot}")
    if isinstance(backend, DataFrame):
        keys = [c for c in columns if c in backend.columns and c in df.columns]
        return backend.join(df.select(*keys).distinct(), keys, "left_semi")
    return df.select(*columns).mapInPandas(backend, schema)


def guarded(one: Callable[[dict], list[dict]], slot: str) -> Backend:
    """A backend from a function of one row; what it raises becomes the row's
    ``error`` beside the keys it was asked for."""
    names = [c.split()[0] for c in SLOTS[slot][1].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.to_dict("records"):
                try:
                    out += [{**row, **made} for made in one(row)]
                except Exception as e:  # noqa: BLE001 - one row's failure is its own
                    out.append({**row, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    return run


def first_answer(df: DataFrame, key: list[str], answer: str, attempts: list[Backend], schema: str) -> DataFrame:
    """Runs backends one after another, each only on the rows none before has
    answered, cheap ones first; the rows left keep a null."""
    done, todo = None, df
    for attempt in attempts:
        made = todo.mapInPandas(attempt, schema)
        good = made.where(f"{answer} is not null")
        done = good if done is None else done.unionByName(good)
        todo = todo.join(good.select(*key), key, "left_anti")
    return done
