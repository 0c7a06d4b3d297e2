"""What talks to model providers and code hosts, behind small interfaces with offline stand-ins."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tessera import fixed


class ProviderError(Exception):
    """A failed call: status 0 for none. `reducible` errors may pass with a smaller request, `passing` ones later."""

    def __init__(self, status: int, body: str):
        super().__init__(f"{status}: {body[:500]}")
        self.status, self.body = status, body
        self.rate_limited = status == 429
        self.pressure = not self.rate_limited and (status in fixed.PRESSURE_STATUSES or any(p in body.lower() for p in fixed.PRESSURE_PHRASES))
        self.reducible = self.rate_limited or self.pressure
        self.passing = self.reducible or not status or status >= 500


class ChatModel(Protocol):
    def complete(self, system: str, user: str, max_tokens: int | None = None) -> str: ...


@dataclass
class HttpChat:
    """A chat endpoint of the common JSON form, at temperature zero; retries with growing pauses unless told to surface."""

    endpoint: str
    model: str
    key: str
    retries: int = 5
    timeout: float = 300
    surface_reducible: bool = False
    sleep: Callable[[float], None] = time.sleep

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.endpoint, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise ProviderError(e.code, e.read().decode("utf-8", "replace")) from e
        except OSError as e:
            raise ProviderError(0, str(e)) from e

    def complete(self, system: str, user: str, max_tokens: int | None = None) -> str:
        body = {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        body |= {"max_tokens": max_tokens} if max_tokens else {}
        def once() -> str:
            message = self._post(body)["choices"][0]["message"]
            return message.get("content") or message.get("reasoning_content") or ""

        return with_retries(once, self.retries, self.sleep, lambda e: self.surface_reducible and e.reducible)


def with_retries(call: Callable[[], str], retries: int, sleep: Callable[[float], None], surface: Callable[[ProviderError], bool] = lambda e: False) -> str:
    """The call's value; after a rate limit, pressure or no answer it is tried again after 1, 2, 4 ... seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except ProviderError as e:
            if not e.passing or attempt == retries or surface(e):
                raise
            sleep(2.0**attempt)
    raise AssertionError


@dataclass
class ScriptedChat:
    """A stand-in for tests: answers by what the prompt holds. It is no model."""

    answers: dict[str, str]
    default: str = '{"summary": "", "findings": []}'

    def complete(self, system: str, user: str, max_tokens: int | None = None) -> str:
        return next((a for k, a in self.answers.items() if k in user), self.default)


def complete_column(prompts: DataFrame, model: ChatModel, concurrency: int, max_tokens: int | None = None) -> DataFrame:
    """(id, response, error, reducible, rate_limited) of (id, system, user): at most `concurrency` tasks call the provider at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, system, user in pdf[["id", "system", "user"]].itertuples(index=False):
                try:
                    out.append((i, model.complete(system, user, max_tokens), None, False, False))
                except ProviderError as e:
                    out.append((i, None, str(e), e.reducible, e.rate_limited))
            yield pd.DataFrame(out, columns=["id", "response", "error", "reducible", "rate_limited"])

    return prompts.select("id", "system", "user").repartition(concurrency).mapInPandas(run, "id long, response string, error string, reducible boolean, rate_limited boolean")


class CodeHost(Protocol):
    """A merge request of a code host."""

    def fetch_diff(self) -> str: ...
    def fetch_changed_paths(self) -> list[str]: ...
    def fetch_metadata(self) -> dict: ...
    def post_findings(self, findings: list[dict]) -> None: ...
    def post_summary(self, summary: str) -> None: ...
    def prior_fingerprints(self) -> list[dict]: ...
    def resolve_stale(self, stale: list[dict]) -> None: ...


@dataclass
class MemoryHost:
    """An offline code host: one change given at the start, comments kept in a list."""

    diff: str = ""
    metadata: dict = field(default_factory=dict)
    comments: list[dict] = field(default_factory=list)
    summaries: list[str] = field(default_factory=list)

    def fetch_diff(self) -> str:
        return self.diff

    def fetch_changed_paths(self) -> list[str]:
        return sorted({line[6:] for line in self.diff.split("\n") if line.startswith("+++ b/")})

    def fetch_metadata(self) -> dict:
        return self.metadata

    def post_findings(self, findings: list[dict]) -> None:
        self.comments += [dict(f, resolved=False) for f in findings]

    def post_summary(self, summary: str) -> None:
        self.summaries.append(summary)

    def prior_fingerprints(self) -> list[dict]:
        return [{"fp_id": c.get("fp_id"), "line_id": c.get("line_id")} for c in self.comments if not c["resolved"]]

    def resolve_stale(self, stale: list[dict]) -> None:
        """Matches the content id only."""
        ids = {s["fp_id"] for s in stale if s.get("fp_id")}
        for c in self.comments:
            c["resolved"] = c["resolved"] or c.get("fp_id") in ids


def http_pages(get: Callable[[int], tuple[list[dict], int | None]], most: int = 10) -> list[dict]:
    """All rows of a paged listing: get(page) gives rows and the next page; at most `most` pages, as the host's API allows."""
    out: list[dict] = []
    page: int | None = 1
    for _ in range(most):
        if page is None:
            break
        rows, page = get(page)
        out += rows
    return out


def detect_platform(explicit: str | None, configured: str | None, env: dict[str, str]) -> str:
    """An explicit choice, then the configured one, then what the CI's variables show."""
    if explicit or configured:
        return explicit or configured or ""
    return "gitlab" if env.get("GITLAB_CI") else "github"


def git_state(repo: str) -> tuple[str, str]:
    """Branch and commit of a checkout, `unknown` where git can't say."""

    def ask(*args: str) -> str:
        try:
            done = subprocess.run(["git", "-C", repo, "rev-parse", *args], capture_output=True, text=True)
        except OSError:
            return "unknown"
        return done.stdout.strip() or "unknown" if done.returncode == 0 else "unknown"

    return ask("--abbrev-ref", "HEAD"), ask("HEAD")


def local_change(path: str) -> tuple[str, list[str]]:
    """A change from a diff file: its text and the paths that it changes; it has no other metadata."""
    with open(path, encoding="utf-8") as f:
        diff = f.read()
    return diff, MemoryHost(diff).fetch_changed_paths()


def detect_runner(env: dict[str, str]) -> str:
    return "github-actions" if env.get("GITHUB_ACTIONS") else "gitlab-ci" if env.get("GITLAB_CI") else "ci" if env.get("CI") else "local"
