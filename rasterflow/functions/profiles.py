"""Colour profiles by name: transfer function, primaries and luma weights, for one name or a column of names."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterflow.functions.colour import LUMA

# Parts of lower-case names that tell the primaries, the first that fits; and the names to write back.
PARTS = (
    ("Rec2020", ("rec. 2020", "rec.2020", "rec2020", "bt.2020")),
    ("DisplayP3", ("display p3", "display-p3")),
    ("sRGB", ("srgb",)),
    ("AdobeRGB", ("adobe rgb", "adobergb")),
    ("ProPhoto", ("prophoto",)),
)
STANDARD = {"DisplayP3": "Display P3", "AdobeRGB": "Adobe RGB (1998)", "ProPhoto": "ProPhoto RGB", "Rec2020": "Rec. 2020", "sRGB": "sRGB IEC61966-2.1"}
SUFFIX = r"(?i)\s*\((?:linear\s+rgb\s+profile|linear\s+profile)\)\s*$"
# Parts that a name on offer has to have, to stand for the primaries.
OFFERED = {"Rec2020": r"(?=.*(rec|bt)).*2020", "DisplayP3": r"(?=.*display).*p3", "AdobeRGB": r"adobe rgb", "ProPhoto": r"prophoto", "sRGB": r"srgb"}


class Profile(NamedTuple):
    transfer: str
    base: str
    #: Nothing in the name tells the primaries.
    assumed: bool


def base_of(name: str | None) -> str | None:
    s = (name or "").lower()
    if s == "p3":
        return "DisplayP3"
    return next((key for key, parts in PARTS if any(p in s for p in parts)), None)


def resolve(name: str | None, *others: str | None, depth: int = 16) -> Profile:
    """The profile of a name; of samples of 32 bits, which are linear, primaries may come from the other names."""
    if depth == 32:
        base = next((b for n in (name, *others) if (b := base_of(n))), None)
        return Profile("linear", base or "sRGB", base is None)
    base = base_of(name)
    return Profile("linear" if "linear" in (name or "").lower() else base or "sRGB", base or "sRGB", base is None)


def base_column(name: Column) -> Column:
    """base_of over a column; null where nothing fits."""
    s = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for key, parts in PARTS:
        hit = s == "p3" if key == "DisplayP3" else F.lit(False)
        for p in parts:
            hit = hit | s.contains(p)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def resolve_column(name: Column) -> dict[str, Column]:
    """transfer, base and assumed of a column of names."""
    base = F.coalesce(base_column(name), F.lit("sRGB"))
    return {"transfer": F.when(F.lower(F.coalesce(name, F.lit(""))).contains("linear"), "linear").otherwise(base), "base": base, "assumed": base_column(name).isNull()}


def written_name(name: Column) -> Column:
    """The name without the suffix that linear samples get."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), SUFFIX, ""))


def match(offered: list[str], base: str) -> str | None:
    """Of the names on offer the standard one, else the first that fits and isn't linear, else the first that fits."""
    if STANDARD[base] in offered:
        return STANDARD[base]
    fit = [n for n in offered if re.match(OFFERED[base] if OFFERED[base].startswith("(?=") else f".*{OFFERED[base]}", n.lower())]
    return next((n for n in fit if "linear" not in n.lower()), fit[0] if fit else None)


def luma_weights(base: str) -> tuple[float, float, float]:
    return LUMA.get(base, LUMA["sRGB"])
