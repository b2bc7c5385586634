"""Vocabularies that fix the meaning of intents, expansions and stop words. Plain data: change them by passing others."""

from __future__ import annotations

# All names in this file, but for EXAMPLE_RULES, are lists that results depend on word by word.

#: Phrases that ask for an overview.
OVERVIEW = (
    "what is the repo about",
    "what is this repo about",
    "what does the repo do",
    "what does this repo do",
    "what is the repository about",
    "what does the repository do",
    "what is this project about",
    "what does this project do",
    "repo summary",
    "repository summary",
    "project summary",
    "summarize the repo",
    "summarize this repo",
    "repo overview",
    "repository overview",
    "project overview",
)

#: Parts of a question on documentation.
DOCS = (
    "readme", "docs", "documentation", "setup", "install", "installation", "usage", "overview",
    "what is this repo", "what is the repository about", "what is the repo about", "what does the repo do", "what does this repo do",
    "repo summary", "repository summary", "project summary", "feature", "features", "architecture",
)

#: In order of precedence, after the overview phrases and before the documentation ones.
INTENTS = (
    ("tests", ("test", "tests", "pytest", "spec")),
    ("error_handling", ("error", "invalid", "conflict", "raises", "guard against")),
    ("api", ("api", "api v1", "api v2", "endpoint", "frontend", "backend", "openapi", "public api", "route", "router", "trpc")),
    ("setup", (
        "build", "configure", "configured", "configuration", "create", "database", "env", "environment", "install", "local development",
        "metadata", "orchestration", "self-host", "self hosting", "setup", "table", "workspace",
    )),
    ("cross_file", ("flow", "across", "across files", "connect", "code path")),
    ("implementation", (
        "behavior", "class", "function", "implementation", "implemented", "job", "jobs", "lifecycle", "lives", "method", "represented",
        "signing", "webhook", "webhooks", "what is special", "where does", "where is", "where should", "where would",
    )),
)
#: Intents that are searched deeply, that put code first, and under which documents lose points.
DEEP = ("api", "implementation", "cross_file", "error_handling", "setup", "tests")
CODE_FIRST = ("api", "implementation", "cross_file", "error_handling", "setup")
DOC_PENALTY = ("api", "implementation", "cross_file", "error_handling", "tests")

#: (triggers, all of them needed?, hints): substrings of the question and what they add.
EXPANSIONS = (
    (("export", "expose", "import"), False, ("package exports", "__init__.py", "index", "public api", "re-export")),
    (("public api", "exposed", "exported"), False, ("public api", "__init__.py", "index")),
    (("session", "exec"), True, ("session exec", "session.py", "execute", "scalars")),
    (("async",), False, ("async", "await", "asyncio")),
    (("relationship", "field", "function", "method", "class"), False, ("class", "function", "method", "metadata")),
    (("under the hood", "implementation", "code path", "conversion"), False, ("implementation", "source", "call path", "class", "function")),
    (("error", "invalid", "conflict", "raise", "raises", "guard"), False, ("raise", "raises", "exception", "validation", "guard")),
    (("test", "tests", "pytest", "spec"), False, ("test", "tests", "pytest", "spec")),
    (("create", "setup", "install", "configuration", "metadata", "table"), False, ("create", "setup", "configure", "initialize", "schema", "README.md", "docs")),
    (("__init__", "exports"), False, ("__init__.py", "package exports", "public api")),
)
OVERVIEW_SUFFIX = "repository overview purpose main workflow architecture README features stack"
WANTS_CODE = ("code", "snippet", "implementation", "function", "class", "import")
FOLLOW_UP_STARTS = ("give", "show", "where", "which", "how", "what")
FOLLOW_UP_WORDS = ("code", "snippet", "implementation")
GREETINGS = ("hey, what question do you have for me today?", "ask a question")

CODE_STOP = (
    "about", "against", "also", "and", "are", "between", "code", "does", "file", "for", "from", "happen", "happens", "how", "into", "main",
    "me", "model", "models", "path", "project", "that", "the", "this", "through", "under", "using", "what", "when", "where", "which", "with",
)
EVAL_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "its", "of", "on", "or", "that",
    "the", "their", "this", "to", "what", "when", "where", "which", "with",
)

#: Parts of paths and sources that count for an intent.
API_STEMS = ("index", "public", "api")
API_PATHS = ("api", "route", "router", "controller")
ERROR_WORDS = ("raise", "except", "error", "invalid", "exception")
SETUP_FILES = ("readme.md", "package.json", "pyproject.toml", "requirements.txt", "dockerfile", "docker-compose.yml", "compose.yml")
SETUP_PATHS = ("config", "settings", "setup")
SETUP_WORDS = ("create", "configure", "initialize", "metadata", "schema")

#: Files that are read, and those that are not.
SUFFIXES = (
    ".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".java", ".go", ".rs", ".md", ".mdx", ".json", ".yml", ".yaml",
    ".toml", ".sh", ".css", ".html", ".prisma",
)
FILE_NAMES = (".env.example", "Dockerfile")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb")
SKIPPED_DIRS = (
    ".agents", ".cache", ".git", ".mypy_cache", ".next", ".opencode", ".parcel-cache", ".pytest_cache", ".ruff_cache", ".turbo", ".vite",
    "dist", "build", "coverage", "logs", "node_modules", "tmp", "vendor", ".venv", "venv", "__pycache__",
)
MAX_BYTES = 250_000
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust",
}
#: Words that begin a definition where no parser knows the language.
DEFINITION_WORDS = ("def", "class", "function", "const", "export", "interface", "type")

#: Reasons for which an answer may end, and words that none ends with.
FINISHED = ("stop", "stopsequence", "finish_reason_unspecified")
TAIL_WORDS = ("a", "an", "the", "to", "for", "with", "of", "in", "on", "from", "about")

#: An example of a path-hint table: (terms, paths). Users bring their own.
EXAMPLE_RULES = ((("mail", "smtp", "inbox"), ("services/mail", "lib/mailer.py")), (("queue", "worker", "/cron"), ("services/worker", "lib/queue")), (("login", "auth"), ("lib/auth", "services/login/")))
