"""Prompts for a language model, and calls of one through a protocol; the default client is offline and always answers alike."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def complete(self, prompt: str, max_tokens: int, temperature: float) -> str: ...


class Unavailable(Exception):
    """The service asks to come again after ``wait`` seconds."""

    def __init__(self, wait: float | None = None) -> None:
        super().__init__(f"try again after {wait} s")
        self.wait = wait


class Denied(Exception):
    """The service will not answer, however often it is asked."""


def failure(status: int, retry_after: str | None = None) -> Exception:
    """What a client raises for an HTTP status: a wait where the service is busy (60 s if it names none), else a refusal that says why."""
    if status == 429:
        return Unavailable(float(retry_after) if retry_after and retry_after.strip().isdigit() else 60.0)
    if status >= 500:
        return Unavailable(None)
    why = {401: "the key is missing, wrong or expired", 402: "the account has no credit"}
    return Denied(f"status {status}: {why.get(status, 'the request was refused')}")


class OfflineClient:
    """Answers from the prompt's hash: yes or no, as JSON."""

    def complete(self, prompt: str, max_tokens: int, temperature: float) -> str:
        even = hashlib.md5(prompt.encode()).digest()[0] % 2 == 0
        return json.dumps({"answer": "yes" if even else "no", "explanation": "offline"})


def call_all(prompts: DataFrame, key: str, prompt: str, client: Callable[[], Client] = OfflineClient, *, gap: float = 0.0, tries: int = 3, patience: float = 1.0, max_tokens: int = 1000, temperature: float = 0.0) -> DataFrame:
    """(key, reply, error): one call for each row, at most one every ``gap`` seconds in each partition.

    A call is tried ``tries`` times, later each time (10, 20, 30 s after a lost connection, 5, 10, 15 s after other errors, times
    ``patience``), or when the service says, and not again where it refuses; a failed row comes out with a null reply and its error. Rows with a null prompt are not called. The client is made in the worker and
    takes its credentials from its environment.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, last = client(), 0.0
        for pdf in batches:
            out = []
            for k, p in zip(pdf["key"], pdf["prompt"]):
                reply, error = None, None
                for attempt in range(tries if p is not None else 0):
                    time.sleep(max(0.0, last + gap - time.monotonic()))
                    last = time.monotonic()
                    try:
                        reply, error = service.complete(p, max_tokens, temperature), None
                        break
                    except Denied as e:
                        error = str(e)
                        break
                    except Unavailable as e:
                        error, wait = str(e), e.wait if e.wait is not None else min(10.0 * (attempt + 1), 30.0) * patience
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is the row's error
                        error, wait = f"{type(e).__name__}: {e}", 5.0 * (attempt + 1) * patience
                    if attempt + 1 < tries:
                        time.sleep(wait)
                out.append((k, reply, error))
            yield pd.DataFrame(out, columns=["key", "reply", "error"])

    source = prompts.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    return source.mapInPandas(run, f"key {kind}, reply string, error string").withColumnRenamed("key", key)


def relevance_prompt(text: Column, keywords: Column, summary: Column) -> Column:
    """Asks whether a text, of any length, is about a topic."""
    return F.concat(F.lit("Topic: "), F.coalesce(summary, F.lit("")), F.lit("\nKeywords: "), F.coalesce(keywords, F.lit("")), F.lit("\nText: "), F.coalesce(text, F.lit("")), F.lit('\nIs the text about the topic? Answer as {"answer": "yes"} or {"answer": "no"}.'))


def topics_prompt(lines: Column, topics: Column) -> Column:
    """Asks for so many topics of the given articles, as a JSON list."""
    form = '[{"Topic 1": {"Summary": "...", "Keywords": ["..."], "Source Titles": ["..."]}}]'
    return F.concat(F.lit("Find "), topics.cast("string"), F.lit(f" topics, each with 5 to 12 keywords, in these articles. Answer only with JSON like {form}\n"), lines)


def rubric_prompt(keywords: Column, summary: Column) -> Column:
    form = '{"evaluation": {"coherence": {"score": 1}, "conciseness": {"score": 1}, "informativity": {"score": 1}}, "overall_score": 1}'
    return F.concat(F.lit("Rate this topic from 1 to 5 for coherence, conciseness and informativity.\nKeywords: "), keywords, F.lit("\nSummary: "), summary, F.lit(f"\nAnswer as {form}"))


def capacity_prompt(lines: Column) -> Column:
    return F.concat(F.lit('Find as many different topics as there are in these articles, and state {"estimated_topics": n}.\n'), lines)


def hierarchy_prompt(title: Column, topic: Column, keywords: Column, text: Column, most: int | None = None) -> Column:
    """Asks for secondary and tertiary topics of an article, whole or by a preview of ``most`` characters."""
    text = text if most is None else F.substring(text, 1, most)
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Topic: "), topic), F.concat(F.lit("Keywords: "), keywords), F.concat(F.lit("Text: "), text))
    return F.concat(head, F.lit('\nName narrower topics as {"secondary_topics": ["..."], "tertiary_topics": ["..."]}.'))


def diversity_prompt(summaries: Column) -> Column:
    return F.concat(F.lit("Which of these topics say the same, and which overlap?\n"), F.array_join(summaries, "\n"), F.lit('\nAnswer as {"redundant_pairs": [], "partial_overlap_pairs": [], "unique_topics_count": 0, "diversity_score": 0.0}.'))
