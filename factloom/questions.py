"""A question, as a planner reads it: names, conditions and a period, checked before use."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

TYPES = ("Material", "Process", "Equipment", "Property", "Condition", "NumericParameter", "Laboratory", "Experiment", "Effect", "Facility", "Region", "Expert", "Publication")


@dataclass(frozen=True)
class Condition:
    parameter: str
    value_min: float | None = None
    value_max: float | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Question:
    text: str
    material: str | None = None
    process: str | None = None
    property: str | None = None
    equipment: str | None = None
    region: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    conditions: tuple[Condition, ...] = ()
    target: Condition | None = None
    entities: tuple[tuple[str, str], ...] = field(default=())


def number(value) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(str(value))
    except ValueError:
        return None


def parse(text: str, plan: dict, now: int) -> Question:
    """A planner's reply with what is not usable left out: names must be texts, years between 1900 and now, entity types known, conditions named."""
    name = lambda k: (plan.get(k) or "").strip() or None if isinstance(plan.get(k), str) else None

    def year(k):
        v = number(plan.get(k))
        return int(v) if v is not None and 1900 <= v <= now else None

    def condition(item) -> Condition | None:
        if not isinstance(item, dict) or not isinstance(item.get("parameter"), str) or not item["parameter"].strip():
            return None
        unit = item.get("unit")
        return Condition(item["parameter"].strip(), number(item.get("value_min")), number(item.get("value_max")), unit if isinstance(unit, str) and unit.strip() else None)

    many = lambda k: plan.get(k) if isinstance(plan.get(k), list) else []
    entities = tuple((e["type"], e["name"].strip()) for e in many("entities") if isinstance(e, dict) and e.get("type") in TYPES and isinstance(e.get("name"), str) and e["name"].strip())
    conditions = tuple(c for c in map(condition, many("conditions")) if c)
    return Question(text, *(name(k) for k in ("material", "process", "property", "equipment", "region")), year("year_min"), year("year_max"), conditions, condition(plan.get("target")), entities)


# -- an answer as server-sent events -------------------------------------------------------------------------------


def events(evidence: dict, deltas: Iterable[str], final) -> Iterator[str]:
    """evidence, then each delta, then final: always the last, whatever happens between."""
    send = lambda kind, data: f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    yield send("evidence", evidence)
    error = None
    try:
        for delta in deltas:
            yield send("delta", {"text": delta})
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    yield send("final", final(error))


def read_events(chunks: Iterable[str]) -> Iterator[tuple[str, dict]]:
    """(kind, data) of events that come in any pieces; an event ends with a blank line."""
    held = ""
    for chunk in chunks:
        held = (held + chunk).replace("\r\n", "\n")
        *whole, held = held.split("\n\n")
        for block in whole:
            lines = [line.partition(":") for line in block.split("\n")]
            data = "\n".join(v.removeprefix(" ") for k, _, v in lines if k == "data")
            if data:
                yield next((v.strip() for k, _, v in lines if k == "event"), "message"), json.loads(data)


def hold_back(text: str, most: int = 200) -> tuple[str, str]:
    """What of a growing text can be shown, and its tail: from the last open bracket on, unless that is over `most` characters back."""
    at = text.rfind("[")
    if at < 0 or "]" in text[at:] or len(text) - at > most:
        return text, ""
    return text[:at], text[at:]
