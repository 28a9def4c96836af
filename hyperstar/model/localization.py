"""Labels in other languages."""

from __future__ import annotations

import copy
from typing import Any

from .cube import Cube

_TEXTS = ("label", "description", "category")


def translated(cube: Cube, translation: dict[str, Any] | None, locale: str | None) -> Cube:
    """A copy of the cube for a locale. ``translation`` has label, description and category of the cube, and under dimensions, levels, hierarchies, attributes, measures, aggregates and details those of its parts; a part may be a plain label."""
    out = copy.deepcopy(cube)
    out.locale = locale or cube.locale
    t = translation or {}
    _apply(out, t)
    for kind in ("measures", "aggregates", "details"):
        for x in getattr(out, kind):
            _apply(x, t.get(kind, {}).get(x.name))
    for d in out.dimensions.values():
        own = t.get("dimensions", {}).get(d.name)
        _apply(d, own)
        if isinstance(own, dict):
            for h in d.hierarchies.values():
                _apply(h, own.get("hierarchies", {}).get(h.name))
            for level in d.levels:
                of_level = own.get("levels", {}).get(level.name)
                _apply(level, of_level)
                for a in level.attributes:
                    _apply(a, own.get("attributes", {}).get(a.name))
                    if isinstance(of_level, dict):
                        _apply(a, of_level.get("attributes", {}).get(a.name))
    return out


def _apply(thing, texts) -> None:
    if isinstance(texts, str):
        texts = {"label": texts}
    for k in _TEXTS:
        if texts and texts.get(k) and hasattr(thing, k):
            setattr(thing, k, texts[k])
