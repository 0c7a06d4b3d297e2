"""Code hosts over HTTP. Requests go through one injected function, so that all of it runs offline in tests."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from tessera.sources.connectors import ProviderError, http_pages

#: method, url, headers, body -> status, headers (lower-case names), text
Request = Callable[[str, str, dict[str, str], bytes | None], tuple[int, dict[str, str], str]]
ID_MARK, LINE_MARK, MARK_END = "<!-- tessera-id:", "<!-- tessera-line:", "-->"


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, dict[str, str], str]:
    request = urllib.request.Request(url, body, headers, method=method)
    with urllib.request.urlopen(request, timeout=60) as answer:
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read().decode("utf-8", "replace")


def marker(body: str, mark: str) -> str | None:
    at = body.find(mark)
    end = body.find(MARK_END, at + len(mark)) if at >= 0 else -1
    return (body[at + len(mark) : end].strip() or None) if end >= 0 else None


def prints_of(bodies: list[str]) -> list[dict]:
    """Ids of earlier comments that carry any."""
    rows = [{"fp_id": marker(b, ID_MARK), "line_id": marker(b, LINE_MARK)} for b in bodies]
    return [r for r in rows if r["fp_id"] or r["line_id"]]


@dataclass
class Host:
    token: str
    request: Request = http

    def call(self, method: str, url: str, body: dict | None = None, accept: str = "application/json"):
        headers = {"Accept": accept, "Content-Type": "application/json", "User-Agent": "tessera", **self.auth()}
        status, head, text = self.request(method, url, headers, None if body is None else json.dumps(body).encode())
        if status >= 400:
            raise ProviderError(status, text)
        return head, text

    def auth(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.token}"}


@dataclass
class GitHubHost(Host):
    """A pull request: owner/repo and number."""

    repo: str = ""
    number: int = 0
    base: str = "https://api.github.com"

    @property
    def pull(self) -> str:
        return f"{self.base}/repos/{self.repo}/pulls/{self.number}"

    def fetch_diff(self) -> str:
        return self.call("GET", self.pull, accept="application/vnd.github.v3.diff")[1]

    def fetch_changed_paths(self) -> list[str]:
        return [f["filename"] for f in json.loads(self.call("GET", f"{self.pull}/files")[1])]

    def fetch_metadata(self) -> dict:
        pull, commits = (json.loads(self.call("GET", u)[1]) for u in (self.pull, f"{self.pull}/commits"))
        return {
            "title": pull["title"], "description": pull.get("body") or "", "author": pull["user"]["login"], "base": pull["base"]["ref"],
            "labels": [x["name"] for x in pull.get("labels", [])], "commits": [c["commit"]["message"].split("\n")[0] for c in commits],
        }

    def post_findings(self, findings: list[dict]) -> None:
        sha = json.loads(self.call("GET", self.pull)[1])["head"]["sha"]
        for f in findings:
            self.call("POST", f"{self.pull}/comments", {"body": f["body"], "commit_id": sha, "path": f["file"], "line": f["start_line"], "side": "RIGHT"})

    def post_summary(self, summary: str) -> None:
        self.call("POST", f"{self.base}/repos/{self.repo}/issues/{self.number}/comments", {"body": summary})

    def _comments(self) -> list[dict]:
        return json.loads(self.call("GET", f"{self.pull}/comments")[1])

    def prior_fingerprints(self) -> list[dict]:
        return prints_of([c["body"] for c in self._comments()])

    def resolve_stale(self, stale: list[dict], text: str = "**Resolved**") -> None:
        """By content id only."""
        ids = {s["fp_id"] for s in stale if s.get("fp_id")}
        for c in self._comments():
            if marker(c["body"], ID_MARK) in ids:
                self.call("PATCH", f"{self.base}/repos/{self.repo}/pulls/comments/{c['id']}", {"body": text})


@dataclass
class GitLabHost(Host):
    """A merge request: project path and number."""

    project: str = ""
    number: int = 0
    base: str = "https://gitlab.com/api/v4"

    def auth(self) -> dict[str, str]:
        return {"PRIVATE-TOKEN": self.token}

    @property
    def merge(self) -> str:
        return f"{self.base}/projects/{urllib.parse.quote(self.project, safe='')}/merge_requests/{self.number}"

    def _changes(self) -> list[dict]:
        return json.loads(self.call("GET", f"{self.merge}/changes")[1])["changes"]

    def fetch_diff(self) -> str:
        return "".join(f"--- a/{c['old_path']}\n+++ b/{c['new_path']}\n{c['diff']}\n" for c in self._changes())

    def fetch_changed_paths(self) -> list[str]:
        return [c["new_path"] for c in self._changes()]

    def fetch_metadata(self) -> dict:
        merge, commits = (json.loads(self.call("GET", u)[1]) for u in (self.merge, f"{self.merge}/commits"))
        return {
            "title": merge["title"], "description": merge.get("description") or "", "author": merge["author"]["username"], "base": merge["target_branch"],
            "labels": merge.get("labels", []), "commits": [c["title"] for c in commits],
        }

    def notes(self) -> list[dict]:
        """All notes, by the next page that the host's headers name, ten pages of a hundred at most."""

        def page(n: int) -> tuple[list[dict], int | None]:
            head, text = self.call("GET", f"{self.merge}/notes?per_page=100&page={n}")
            return json.loads(text), int(head["x-next-page"]) if head.get("x-next-page") else None

        return http_pages(page)

    def post_findings(self, findings: list[dict]) -> None:
        """As a discussion at the line; where the host refuses that place, as a plain note."""
        refs = json.loads(self.call("GET", self.merge)[1])["diff_refs"]
        for f in findings:
            position = {"position_type": "text", "new_path": f["file"], "old_path": f["file"], "new_line": f["start_line"], **refs}
            try:
                self.call("POST", f"{self.merge}/discussions", {"body": f["body"], "position": position})
            except ProviderError:
                self.call("POST", f"{self.merge}/notes", {"body": f"`{f['file']}:{f['start_line']}`\n\n{f['body']}"})

    def post_summary(self, summary: str) -> None:
        self.call("POST", f"{self.merge}/notes", {"body": summary})

    def prior_fingerprints(self) -> list[dict]:
        return prints_of([n["body"] for n in self.notes()])

    def resolve_stale(self, stale: list[dict], text: str = "**Resolved**") -> None:
        ids = {s["fp_id"] for s in stale if s.get("fp_id")}
        for n in self.notes():
            if marker(n["body"], ID_MARK) in ids:
                self.call("PUT", f"{self.merge}/notes/{n['id']}", {"body": text})
