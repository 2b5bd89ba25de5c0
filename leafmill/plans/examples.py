"""Stand-ins for models: what queries and tests ask instead of one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd

FALLBACK = "second-model"


def moody_answer(page_id: int, headline: str, asks: int, content_limit: int, model: str | None) -> tuple[str | None, str | None, int | None]:
    """(text, error_type, status_code) of a model that fails by page: it never gives JSON, gives it
    for shorter content only, is down unless the fallback answers, is silent at first, or fails in
    two ways one after the other."""
    good = json.dumps([{"headline": headline, "author": "A. Writer", "url": f"/{page_id}"}])
    short, fallback = content_limit <= 25_000, model == FALLBACK
    down = None, "LLMProviderError", 503
    match page_id % 7:
        case 0:
            return "not json", None, None
        case 1 if not short:
            return "{", None, None
        case 2 if not fallback:
            return down
        case 3 if asks == 1:
            return " ", None, None
        case 4 if not short:
            return "[1", None, None
        case 4 if not fallback:
            return down
    return good, None, None


def moody_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = [t.split("\n")[0] for t in batch["user_content"]]
        said = [moody_answer(*x) for x in zip(batch["page_id"], lines, batch["asks"], batch["content_limit"], batch["model"])]
        text, error, status = (pd.Series(x, index=batch.index, dtype=object) for x in zip(*said)) if said else ([], [], [])
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"], "raw_output": text, "input_tokens": 5, "output_tokens": 2, "latency_ms": 1.0,
                "model": batch["model"], "error_type": error, "status_code": status,
            }
        )


def headline_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A first try that finds little: one field of six, by page also most of them."""
    for batch in batches:
        lines = [t.split("\n") for t in batch["user_content"]]
        poor = [[{"headline": "x"}] if i % 6 else [{"headline": x[0], "author": "A. Writer", "published_date": "2024-01-15", "summary": x[-1]}] for i, x in zip(batch["page_id"], lines)]
        yield pd.DataFrame({"page_id": batch["page_id"], "raw_output": list(map(json.dumps, poor)), "input_tokens": 5, "output_tokens": 1, "latency_ms": 1.0, "model": "first"})


def hint_writer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Writes instructions; by page too short ones, blanks, or nothing because it is down."""
    for batch in batches:
        said = {0: "  Look for the author below the headline. ", 1: "Look closer.", 2: "   ", 3: None}
        kind = [i % 5 for i in batch["page_id"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"], "raw_output": pd.Series([said.get(k, said[0]) for k in kind], index=batch.index, dtype=object),
                "input_tokens": 20, "output_tokens": 2, "latency_ms": 4.0, "model": "writer",
                "error_type": pd.Series(["LLMProviderError" if k == 3 else None for k in kind], index=batch.index, dtype=object),
            }
        )


def hinted_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A second try: two fields more for pages that were given a hint, the same as before for others."""
    for batch in batches:
        hinted = batch["system_prompt"].str.contains("below the headline")
        good = {"headline": "Mill stops", "author": "A. Writer", "url": "/a"}
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"], "raw_output": [json.dumps([good if h else {"headline": "x"}]) for h in hinted],
                "input_tokens": 7, "output_tokens": 3, "latency_ms": 2.0, "model": "second",
            }
        )
