"""Model inference as hooks: columns in, columns out, with deterministic defaults."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.metrics import token_judge
from lodestrata.functions.text import is_blank, tokens, truncate_text
from lodestrata.functions.vectors import hashed_embedding
from lodestrata.operators.context import NOT_FOUND

#: The result of a query: its answer, what the process said, how it ended.
RESULT = "answer string, raw_stdout string, raw_stderr string, returncode int, elapsed_seconds double, error string"
# How a process ends that runs out of time, or does not start.
TIMED_OUT, NOT_STARTED = 124, 1
# Colours and other controls that a terminal takes.
_ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"


def extract_answer(question: Column, context: Column) -> Column:
    """The start of the evidence, or the sentence for none."""
    return F.when(is_blank(context), F.lit(NOT_FOUND)).otherwise(truncate_text(context, 400))


def word_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that a text has, from 0 to 100."""
    asked = F.array_distinct(tokens(question))
    met = F.size(F.array_intersect(asked, tokens(text)))
    return F.when(F.size(asked) > 0, F.round(100 * met / F.size(asked), 2)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Hooks:
    """Models as columns.

    ``embed`` text -> array<float>; ``generate`` (question, context) -> text; ``judge``
    (answer, gold) -> struct(label, score); ``rate`` (question, report) -> 0 to 100;
    ``synthesise`` (question, answers) -> text; ``query`` (question, root, method) ->
    ``RESULT``, which, where given, answers in place of the engine's own retrieval.
    """

    embed: Callable[[Column], Column] = lambda c: hashed_embedding(tokens(c))
    generate: Callable[[Column, Column], Column] = extract_answer
    judge: Callable[[Column, Column], Column] = token_judge
    rate: Callable[[Column, Column], Column] = word_overlap
    synthesise: Callable[[Column, Column], Column] = lambda question, answers: answers
    query: Callable[[Column, Column, str], Column] | None = None


def external_query(command: Callable[[str, str, str], list[str]], timeout: float = 600.0) -> Callable[[Column, Column, str], Column]:
    """A ``query`` hook that runs ``command(question, root, method)`` once a row, in the task of the row.

    A process beyond ``timeout`` seconds is ended and has code 124, one that can't be
    started code 1; only a process with code 0 has an answer. Colours are taken off.
    """

    def hook(question: Column, root: Column, method: str) -> Column:
        @F.pandas_udf(RESULT)
        def run(questions: pd.Series, roots: pd.Series) -> pd.DataFrame:
            import re

            def plain(raw: bytes | str | None) -> str:
                text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw or ""
                return re.sub(_ANSI, "", text).strip()

            rows = []
            for q, r in zip(questions, roots):
                began = time.perf_counter()
                try:
                    done = subprocess.run(command(q or "", r or "", method), capture_output=True, timeout=timeout, check=False)
                    out, err, code = plain(done.stdout), plain(done.stderr), done.returncode
                    rows.append((out if code == 0 else "", out, err, code, round(time.perf_counter() - began, 3), None if code == 0 else err or out))
                except subprocess.TimeoutExpired as e:
                    rows.append(("", plain(e.stdout), plain(e.stderr), TIMED_OUT, round(time.perf_counter() - began, 3), f"timed out after {timeout} seconds"))
                except (OSError, ValueError) as e:
                    rows.append(("", "", "", NOT_STARTED, round(time.perf_counter() - began, 3), str(e)))
            return pd.DataFrame(rows, columns=["answer", "raw_stdout", "raw_stderr", "returncode", "elapsed_seconds", "error"])

        return run(question, root)

    return hook


def chat_completion(url: str, model: str, timeout: float = 180.0, max_tokens: int = 512, key: str = "") -> Callable[[Column], Column]:
    """A model behind a completion service of the common form: prompt -> reply at temperature 0, null where the service fails."""

    def hook(prompt: Column) -> Column:
        @F.pandas_udf("string")
        def run(prompts: pd.Series) -> pd.Series:
            def ask(p: str | None) -> str | None:
                body = json.dumps({"model": model, "temperature": 0, "max_tokens": max_tokens, "messages": [{"role": "user", "content": p or ""}]}).encode()
                request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as reply:
                        return json.loads(reply.read())["choices"][0]["message"]["content"]
                except (OSError, ValueError, KeyError, IndexError):
                    return None

            return prompts.map(ask)

        return run(prompt)

    return hook
