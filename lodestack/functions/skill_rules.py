"""Fixed values of the rules over skills and manifests."""
from __future__ import annotations

from lodestack.functions.rules import WORKFLOW  # noqa: F401

# Names and descriptions.
NAME = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
NAMESPACED, BARE_NAME = r"^[a-z0-9-]+/[a-z0-9-]+$", r"^[a-z0-9-]+$"
RESERVED = ("anthropic", "claude")
TAG = r"<[a-zA-Z][^>]*>"
FIRST_PERSON = r"(?i)\b(I can|I will|I help|I am|I'm|I process|I analyze|I generate|I create|I extract|I manage)\b"
SECOND_PERSON = r"(?i)\b(You can|You will|You should|You may)\b"
GENERIC_WORDS = ("helper", "helpers", "util", "utils", "tools", "tool", "lib", "common", "misc", "stuff", "doc", "docs", "data", "files")
GENERIC_FILE = r"(?i)^(?:doc|notes|file|tmp|test|untitled)\d*\.(?:md|py|js|ts|sh)$"
CODE_SUFFIXES = (".py", ".js", ".ts", ".go", ".rb", ".java", ".rs")
# Bodies.
WINDOWS_PATH = r"(?:^|\s|[(])[A-Za-z0-9_./-]*\\[A-Za-z0-9_./\\-]+"
BARE_TOOL = r"`mcp__[a-z0-9_-]+`"
TEMPLATE_MARKERS = (
    "insert instructions below", "todo: write the skill", "<your skill goes here>", "describe what this skill does", "your-skill-name", "skill name (replace this)",
)
TOOL_ENTRY = r"^(?:[A-Z][\w-]*(?:\([^)]+\))?|mcp__[a-z0-9_-]+__[a-z0-9_-]+)$"
# A table of contents, and the lines from which a reference needs one.
CONTENTS = r"(?im)(?:table of contents|^#+\s*(?:contents|toc)\b)"
LONG_REFERENCE, HEAD_LINES = 100, 50
# Numbers in code.
ASSIGNED_NUMBER = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[-+]?(\d+)(?:\.\d+)?\s*(?:#(.*))?$"
_WORDS = "MAX|MIN|DEFAULT|LIMIT|TIMEOUT|SIZE|LENGTH|COUNT|THRESHOLD|MAGIC|VERSION|RETRIES|DEPTH|PORT|EXIT"
EXPLAINING_NAME = rf"(?i)(?:(?:^|_)(?:{_WORDS})_|_(?:{_WORDS})(?:_|$))"
EXPLAINING_WORDS = ("why", "because", "reason", "so", "to avoid", "chosen", "required", "empirical", "empirically", "measured", "tuned", "spec", "rfc", "limit", "fits")
# Risks of tools.
SHELLS = ("Bash", "Bash(*)", "Bash(**)", "Shell", "Terminal")
TOOL_RISKS = {
    "Bash": "high", "Bash(*)": "high", "Shell": "high", "Terminal": "high", "Execute": "high", "Write": "medium", "Edit": "medium", "MultiEdit": "medium",
    "FileWrite": "medium", "Read": "low", "ReadFile": "low", "Search": "low", "Grep": "low", "Glob": "low", "List": "low", "ListDir": "low",
    "WebSearch": "medium", "WebFetch": "medium", "HttpRequest": "high", "Task": "medium", "TodoRead": "low", "TodoWrite": "low",
}
# Manifests.
CAPABILITIES = ("read_file", "read_code", "write_file", "network_access", "exec")
SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?"
    r"(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?$"
)
PARAM_TYPES = ("string", "number", "boolean", "enum")
CATEGORIES = (
    "code-review", "deployment", "documentation", "dev-tools", "frameworks", "security", "testing", "data", "design", "infrastructure", "observability", "general",
)
CAPABILITY_HINTS = {
    "write_file": (r"(?i)\bwrite_file\b", r"(?i)\bcreate_file\b", r"(?i)\bsave\s+file\b", r"(?i)\bwrite\s+to\s+file\b", r"(?i)\boverwrite\b"),
    "network_access": (r"(?i)https?://", r"(?i)\bfetch\b", r"(?i)\bcurl\b", r"(?i)\bhttp\s+request\b", r"(?i)\bapi\s+call\b"),
}
# Payloads in code.
DECODERS = (r"base64\.b64decode\s*\(", r"base64\.decodebytes\s*\(", r"(?:^|\W)atob\s*\(")
LONG_BASE64 = r"""['"]([A-Za-z0-9+/=]{100,})['"]"""
EVAL = r"(?i)(?:eval|exec)\s*\("
