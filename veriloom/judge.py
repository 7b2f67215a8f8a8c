"""The seam for judges: a small protocol, an offline stand-in, and its wiring into a plan (2.I, B54).

The stand-in is a pure function of claim and passages, so that runs repeat. It is there to exercise
the pipeline and makes no claim of judging quality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "key long, sample int, verdict string, gap string, quotes array<struct<pid:string,quote:string>>, calls int"


class Judge(Protocol):
    """Anything that judges one claim against its passages, each sample on its own."""

    name: str

    def judge(self, claim: str, passages: list[tuple[str, str]], sample: int) -> dict:
        """A dict with verdict, gap and quotes, each quote a dict of pid and quote."""
        ...


class OverlapJudge:
    """Judges by the share of a claim's longer words that its best sentence has."""

    name = "overlap"

    def judge(self, claim: str, passages: list[tuple[str, str]], sample: int) -> dict:
        """Faithful from 0.8, partial from 0.5, overstated from 0.3 of the words, else absent."""
        want = {w for w in re.findall(r"[a-z0-9]+", claim.lower()) if len(w) > 3}
        best = (0.0, "", "")
        for pid, text in passages:
            for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
                share = len(want & set(re.findall(r"[a-z0-9]+", sentence.lower()))) / max(1, len(want))
                if share > best[0]:
                    best = (share, pid, sentence)
        verdict = "faithful" if best[0] >= 0.8 else "partial" if best[0] >= 0.5 else "overstated" if best[0] >= 0.3 else "absent"
        return {"verdict": verdict, "gap": "none" if verdict == "faithful" else "scope", "quotes": [{"pid": best[1], "quote": best[2]}] if verdict != "absent" else []}


def judged(claims: DataFrame, passages: DataFrame, judge: Judge, samples: int = 1) -> DataFrame:
    """Claims (key, claim) judged against passages (key, pos, pid, text): one row per sample.

    The passages of a claim are within a budget, so they fit one row; an answer that is no verdict is
    asked for once more, then counts as an error (I9).
    """
    held = passages.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "pid", "text"))).alias("ps"))
    rows = claims.join(held, "key", "left").select("key", "claim", "ps", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, claim, ps, sample in zip(b["key"], b["claim"], b["ps"], b["sample"]):
                given = [(p["pid"], p["text"]) for p in (ps if ps is not None else [])]
                got, calls = {}, 0
                while calls < 2 and not got.get("verdict"):
                    calls += 1
                    try:
                        got = judge.judge(claim or "", given, int(sample)) or {}
                    except (ValueError, KeyError):
                        got = {}
                out.append((key, sample, got.get("verdict") or "error", got.get("gap") or "", got.get("quotes") or [], calls))
            yield pd.DataFrame(out, columns=["key", "sample", "verdict", "gap", "quotes", "calls"])

    return rows.mapInPandas(run, RESULT)


def passages_block(passages: DataFrame) -> DataFrame:
    """(key, block): the passages of each claim in order, each under its id, as a judge reads them."""
    head = F.concat(F.lit("["), "pid", F.lit("] "), "text")
    return passages.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", head.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))
