"""A small corpus of its own for the unit tests: ten tickets, four profiles."""

from __future__ import annotations

import json
from pathlib import Path

PEOPLE = {n: {"id": n[:2].lower(), "displayName": n, "email": f"{n[:2].lower()}@example.com"} for n in ("Ada Moss", "Ben Hale", "Cy Ito")}


def issue(key, summary, status, priority, kind, assignee, labels, components, created, comments=()):
    return {
        "key": key, "summary": summary, "description": f"About {summary.lower()}", "status": status, "priority": priority, "type": kind, "labels": list(labels), "components": list(components),
        "assignee": PEOPLE.get(assignee), "reporter": PEOPLE["Ben Hale"], "created": created, "updated": created, "comments": [{"author": "Cy Ito", "body": c, "created": created} for c in comments],
        "project": key.split("-")[0], "sprint": None, "storyPoints": 3,
    }


ISSUES = [
    issue("OPS-1", "Database backup fails", "To Do", "High", "Bug", "Ada Moss", ["backup", "urgent"], ["Storage"], "2025-01-05T10:00:00Z", ["disk full again"]),
    issue("OPS-2", "Rotate keys", "Done", "Critical", "Task", "Ben Hale", ["security"], ["Auth", "Storage"], "2025-01-10T10:00:00Z"),
    issue("OPS-3", "Slow login page", "In Progress", "Medium", "Bug", None, ["performance"], ["Auth"], "2025-01-15T10:00:00Z", ["login takes a minute"]),
    issue("OPS-4", "Write runbook", "In Review", "Low", "Story", "Cy Ito", [], [], "2025-02-01T10:00:00Z"),
    issue("OPS-5", "Upgrade database", "Blocked", "High", "Story", "Ada Moss", ["database"], ["Storage"], "2025-02-10T10:00:00Z"),
    issue("OPS-10", "Archive logs", "To Do", "Strange", "Task", "Ada Moss", ["urgent"], ["Logs"], "2025-02-12T10:00:00Z"),
    issue("WEB-1", "Login button misplaced", "Done", "Medium", "Bug", "Ben Hale", ["frontend"], ["Portal"], "2025-02-15T00:00:00Z"),
    issue("WEB-2", "Dark mode", "To Do", "Low", "Epic", None, ["frontend", "Security"], ["Portal"], "2025-02-16T10:00:00Z"),
    issue("WEB-3", "Audit trail", "In Progress", "Critical", "Spike", "Ada Moss", ["security", "audit"], ["Portal", "Auth"], "2025-03-01T10:00:00Z"),
    issue("WEB-4", "Session timeout too short", "To Do", "High", "Bug", "Cy Ito", ["performance"], ["Auth"], "2025-03-02T10:00:00Z", ["login login login"]),
]
CORPUS = {
    "issues": ISSUES, "users": [], "projects": [{"key": "OPS", "name": "Ops", "lead": "Ada Moss"}, {"key": "WEB", "name": "Web", "lead": "Ben Hale"}],
    "statuses": ["To Do", "In Progress", "In Review", "Done", "Blocked"], "priorities": ["Critical", "High", "Medium", "Low"], "issue_types": ["Bug", "Story", "Task", "Spike", "Epic"],
}
PROFILES = {
    "permissions": {
        "boss": {"projects": ["OPS", "WEB"], "can_view_all_issues": True},
        "ops": {"projects": ["OPS"], "can_view_all_issues": True, "restricted_labels": ["security"]},
        "portal": {"projects": ["WEB"], "can_view_all_issues": False, "viewable_components": ["Portal"], "can_view_comments": False, "restricted_labels": ["audit"]},
        "guest": {"projects": ["OPS"], "can_view_all_issues": True, "can_view_comments": False, "restricted_labels": ["*"]},
    }
}


def write(folder: Path) -> tuple[str, str]:
    a, b = folder / "corpus.json", folder / "profiles.json"
    a.write_text(json.dumps(CORPUS, indent=1))
    b.write_text(json.dumps(PROFILES, indent=1))
    return str(a), str(b)
