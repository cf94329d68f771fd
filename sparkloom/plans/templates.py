"""Prompt templates: text with parts in braces, each a JSON object."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(template: str) -> list[dict]:
    """Parts in order: {"hard": text}, or what a brace holds. An open or unreadable brace is an error."""
    parts, at = [], 0
    decoder = json.JSONDecoder()
    while at < len(template):
        brace = template.find("{", at)
        if brace < 0:
            parts.append({"hard": template[at:]})
            break
        if brace > at:
            parts.append({"hard": template[at:brace]})
        try:
            part, at = decoder.raw_decode(template, brace)
        except json.JSONDecodeError as e:
            raise ValueError(f"the template can't be read at {brace}: {template[brace : brace + 30]!r}") from e
        parts.append(part)
    return parts


def render(template: str, mask: str = "[MASK]") -> Column:
    """The template over a row's columns: {"text": column, "length": n}, {"mask": true}."""
    out = []
    for p in parse(template):
        if "hard" in p:
            out.append(F.lit(p["hard"]))
        elif "text" in p:
            c = F.col(p["text"]).cast("string")
            out.append(F.left(c, F.lit(p["length"])) if "length" in p else c)
        elif p.get("mask"):
            out.append(F.lit(mask))
        else:
            raise ValueError(f"a part is neither text nor mask: {p}")
    return F.concat(*out)
