"""Word lists, patterns, weights and limits that results depend on."""

from __future__ import annotations

EXTENSIONS = {
    "advanced": ["js", "ts", "jsx", "tsx", "py", "java", "cpp", "c", "h", "hpp", "cs", "rb", "php", "go", "rs", "swift", "kt", "scala", "clj"],
    "base": ["js", "ts", "jsx", "tsx", "py", "java", "cpp", "c"],
}
IGNORED = {
    "advanced": ["node_modules", ".git", "dist", "build", "__pycache__", "venv", "target"],
    "base": ["node_modules", ".git", "dist", "build"],
    "security": ["node_modules", ".git", "dist", "build", "__pycache__", ".venv"],
}
MAX_FILES = {"advanced": 10_000, "base": 1_000, "security": 2_000}
MAX_BYTES = {"advanced": 10 << 20, "base": 1 << 20, "security": 10 << 20}
ENTRY_NAMES = ["index", "main", "app", "__init__"]
ARCHIVE_LIMITS = {"entries": 1_000, "entry_bytes": 10 << 20, "total_bytes": 100 << 20}
UPLOAD_BYTES = {"analyze": 25 << 20, "refactor": 5 << 20}
RESOLVE_EXTENSIONS = {"advanced": ["js", "ts", "jsx", "tsx", "py", "java", "cpp"], "base": ["js", "ts", "jsx", "tsx", "py"]}

#: Words that a branch starts with, by language.
KEYWORDS = {
    "javascript": ["if", "else", "while", "for", "switch", "case", "catch", "finally"],
    "java": ["if", "else", "while", "for", "switch", "case", "catch", "finally"],
    "python": ["if", "elif", "else", "while", "for", "except", "finally", "with"],
    "cpp": ["if", "else", "while", "for", "switch", "case", "catch"],
    "generic": ["if", "else", "while", "for", "switch", "case"],
}
LOGICAL = ["&&", "||", "??", "and", "or"]
BASE_PYTHON_KEYWORDS = ["if", "elif", "while", "for", "except", "and", "or"]
#: A trimmed line that matches opens a block.
OPENERS = {
    "javascript": r"\{\s*$|if\s*\(|while\s*\(|for\s*\(|function\s*\w*\s*\(",
    "java": r"\{\s*$|if\s*\(|while\s*\(|for\s*\(",
    "cpp": r"\{\s*$|if\s*\(|while\s*\(|for\s*\(",
    "python": r":\s*$|if\s+|while\s+|for\s+|def\s+|class\s+",
    "generic": r"\{\s*$|if\s*\(",
}
OPERATORS = {
    "javascript": ["+", "-", "*", "/", "%", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "!", "?", ":", ";", ",", ".", "[", "]", "(", ")", "{", "}"],
    "python": ["+", "-", "*", "/", "//", "%", "**", "=", "==", "!=", "<", ">", "<=", ">=", "and", "or", "not", "is", "in", ":", ",", ".", "[", "]", "(", ")"],
    "java": ["+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "?", ":", ";", ",", ".", "[", "]", "(", ")", "{", "}"],
    "cpp": ["+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "?", ":", ";", ",", ".", "[", "]", "(", ")", "{", "}", "->", "::"],
    "generic": ["+", "-", "*", "/", "=", "==", "!=", "<", ">", "(", ")", "{", "}"],
}
COMMENTS = {
    "javascript": r"^\s*(//|/\*|\*)",
    "java": r"^\s*(//|/\*|\*)",
    "cpp": r"^\s*(//|/\*|\*)",
    "python": "^\\s*(#|\"\"\"|''')",
    "generic": r"^\s*(//|#)",
}
WEIGHTS = {"cyclomatic": 0.25, "cognitive": 0.30, "halstead": 0.20, "maintainability": 0.15, "coupling": 0.10}

#: File types in the order in which they are tried; the predicates are in paths.file_type.
FILE_TYPES = ["test", "api", "component", "page", "hook", "utility", "service", "config", "type", "style", "generic"]
CLUSTER_LABELS = {
    "component": "UI Components", "page": "Pages & Views", "api": "API Layer", "service": "Services", "utility": "Utilities", "hook": "React Hooks",
    "test": "Test Suite", "config": "Configuration", "type": "Type Definitions", "style": "Styling", "generic": "Core Modules",
}
PURPOSES = {
    "component": "User interface components and layouts", "page": "Application pages and route handlers", "api": "API endpoints and request handlers",
    "service": "Business logic and external integrations", "utility": "Helper functions and common utilities", "hook": "React hooks for state and side effects",
    "test": "Test cases and testing utilities", "config": "Application configuration and constants", "type": "TypeScript type definitions and interfaces",
    "style": "CSS styles and theme definitions", "generic": "Core application logic and modules",
}
CONTEXTS = [
    ("Admin", ["admin", "dashboard"]), ("Authentication", ["auth", "login", "signin"]), ("User Management", ["user", "profile", "account"]),
    ("Payment", ["payment", "billing", "checkout"]), ("Communication", ["chat", "message", "notification"]), ("Search & Filter", ["search", "filter", "sort"]),
    ("File Management", ["upload", "file", "media"]), ("Analytics", ["report", "analytics", "stats"]), ("Security", ["security", "encrypt", "hash"]),
    ("Data Layer", ["database", "model", "schema"]),
]
#: (purpose, keywords, directory slug), in order.
REFACTOR_PURPOSES = [
    ("testing", ["test", "spec"], "tests"), ("api", ["api", "endpoint", "route"], "api"), ("ui components", ["component", "ui", "view"], "components"),
    ("utilities", ["util", "helper", "lib"], "utils"), ("data models", ["model", "entity", "schema"], "models"), ("services", ["service", "client", "adapter"], "services"),
    ("configuration", ["config", "setting", "env"], "config"), ("core application", ["main", "index", "app"], "core"),
]
UI_NAMES = [
    ("Testing Suite", ["test", "spec", "__test__"]), ("API Layer", ["api", "endpoint", "route"]), ("User Interface", ["component", "ui", "view", ".tsx", ".jsx"]),
    ("Utilities", ["util", "helper", "lib"]), ("Data Models", ["model", "entity", "schema"]), ("Services", ["service", "client", "adapter"]),
    ("Configuration", ["config", "setting", "env"]), ("Core Engine", ["core", "engine", "analyzer"]), ("Security", ["security", "auth", "guard"]),
    ("Styling", ["style", "css", "theme"]), ("Pages", ["page", "route", "index"]), ("React Hooks", ["hook", "context"]), ("Type Definitions", ["type", "interface", ".d.ts"]),
]
#: (rule, pattern, case matters, severity, message)
SECURITY_RULES = [
    (1, r"eval\s*\(", False, "critical", "Code injection risk: eval()"),
    (2, r"exec\s*\(", False, "critical", "Command injection risk: exec()"),
    (3, r"innerHTML\s*=", False, "high", "XSS risk: innerHTML assignment"),
    (4, r"document\.write\s*\(", False, "high", "XSS risk: document.write()"),
    (5, r"\$\{[^}]*\}", True, "medium", "Template injection risk"),
    (6, r"password\s*=\s*[\"'][^\"']+[\"']", False, "high", "Hardcoded password"),
    (7, r"api_key\s*=\s*[\"'][^\"']+[\"']", False, "high", "Hardcoded API key"),
    (8, r"token\s*=\s*[\"'][^\"']+[\"']", False, "medium", "Hardcoded token"),
    (9, r"os\.system\s*\(", False, "critical", "Command injection risk: os.system()"),
    (10, r"subprocess\.(?:call|run|Popen)", False, "high", "Command execution risk"),
    (11, r"rm\s+-rf\s+/", False, "critical", "Dangerous file deletion"),
    (12, r"\bsudo\b", False, "medium", "Privilege escalation"),
]
BLOCKED = ["exe", "dll", "so", "bin", "sh", "bat", "msi", "app", "deb", "rpm"]
TEXT_EXTENSIONS = ["js", "ts", "jsx", "tsx", "py", "java", "cpp", "c", "h", "css", "scss", "less", "html", "xml", "json", "yaml", "yml", "md", "txt", "sql", "php", "rb", "go", "rs", "swift", "kt"]
#: tier: repositories, analyses a month, days of history
QUOTAS = {"free": (3, 10, 30), "pro": (50, 200, 365), "team": (200, 1000, 730)}
