"""What is put together from settings; a part that can't be leaves the others running."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


@dataclass
class Wiring:
    """The parts that could be made, by name, and what was wrong with the others."""

    parts: dict[str, object] = field(default_factory=dict)
    problems: dict[str, str] = field(default_factory=dict)


def wire(settings: Mapping[str, str], makers: Mapping[str, Callable[[Mapping[str, str]], object]], needed: tuple[str, ...] = ("search",)) -> Wiring:
    """Each part from the settings. What is needed fails as a whole; any other part that fails is logged and left out."""
    made = Wiring()
    for name, make in makers.items():
        try:
            made.parts[name] = make(settings)
        except Exception as e:
            if name in needed:
                raise
            made.problems[name] = str(e) or type(e).__name__
            logging.getLogger("quillet").warning("%s is left out: %s", name, made.problems[name])
    return made


def number(settings: Mapping[str, str], name: str, default: int) -> int:
    """A positive whole number of the settings, or the default where it is not given; anything else is an error."""
    raw = settings.get(name, "").strip()
    if raw and not (raw.isdigit() and int(raw) > 0):
        raise ValueError(f"{name} must be a whole number over 0")
    return int(raw) if raw else default
