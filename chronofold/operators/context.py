"""Packing of an agent's context under a character budget; runs on the driver for one run."""

from __future__ import annotations

import json


def pack_context(sections: list[tuple[str, object]], budget: int = 24_000, reserve: int = 160) -> dict:
    """Sections in order of importance, as (name, value). Each first gets a preview
    of an equal share; previews are dropped from the end until all fits; then
    sections are made complete in order while they fit. budget: 1,000..100,000."""
    budget = max(1_000, min(100_000, budget))
    texts = [(n, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for n, v in sections]
    share = max(0, budget // max(1, len(texts)) - reserve)
    shown = {n: t if len(t) <= share else t[:share] for n, t in texts}
    full = {n: len(t) <= share for n, t in texts}
    used = lambda: sum(len(s) + reserve for s in shown.values())
    for n, _ in reversed(texts):
        if used() <= budget:
            break
        shown.pop(n), full.pop(n)
    for n, t in texts:
        if n in shown and not full[n] and used() - len(shown[n]) + len(t) <= budget:
            shown[n], full[n] = t, True
    return {"sections": [{"name": n, "complete": full[n], "characters": len(t), "text": shown[n]} for n, t in texts if n in shown], "omitted": [n for n, _ in texts if n not in shown], "used": used()}
