"""Word lists, names, patterns and orders that results depend on. They are stated as they must be."""

# Words that never associate texts.
STOP_WORDS = (
    "acceptance", "artifact", "behavior", "change", "changes", "compact", "current", "debug", "each", "existing", "exports", "from", "implementation",
    "into", "makes", "normal", "possible", "report", "requirement", "reused", "summary", "that", "this", "through", "true", "without", "with",
)

# Names and suffixes of file profiles.
DOCUMENT_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".pdf", ".doc", ".docx")
WORKFLOW_FOLDERS = (".github/workflows/", ".circleci/")
CONFIGURATION_NAMES = ("pyproject.toml", "setup.cfg", "tox.ini", "package.json", "tsconfig.json", "dockerfile")
CONFIGURATION_SUFFIXES = (".ini", ".toml", ".yaml", ".yml", ".json")
DEPENDENCY_NAMES = ("requirements.txt", "poetry.lock", "uv.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "go.sum")
TEST_ENDINGS = ("_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
GENERATED_FOLDERS = ("vendor", "generated", "dist")

# Architectural layers, the first that has a segment wins.
LAYERS = (
    ("verification", ("test", "tests", "spec", "specs")),
    ("documentation", ("doc", "docs", "documentation")),
    ("automation", (".github", "ci", "workflows")),
    ("entry", ("cli", "entrypoint", "entrypoints")),
    ("presentation", ("presentation", "ui", "views", "web")),
    ("application", ("application", "orchestration", "pipeline", "service", "services")),
    ("domain", ("domain", "model", "semantics", "assessment")),
    ("infrastructure", ("provider", "providers", "adapter", "adapters", "client", "clients")),
    ("persistence", ("storage", "database", "db", "persistence", "repository", "repositories")),
)
SOURCE_ROOTS = ("src", "lib", "app", "packages")
OWN_DOMAINS = ("test", "tests", "spec", "specs", "docs", ".github")

# Requirement profiles by tokens, in order, and the fact profiles each admits.
REMOVAL_TERMS = (
    "remove", "removed", "removal", "delete", "deleted", "deprecate", "deprecated", "cleanup", "clean", "exclude", "prevent", "avoid", "mustn",
)
PROFILE_TERMS = (
    ("ui", ("render", "renderer", "html", "component", "display")),
    ("workflow_configuration", ("workflow", "configuration", "config", "action", "actions", "pipeline")),
    ("schema_migration", ("schema", "migration", "database")),
    ("api_contract", ("api", "contract", "interface", "schema", "versioned")),
    ("behavior", ("runtime", "behavior", "execute", "execution", "call")),
)
DOCUMENTATION_INTENT = (
    r"^(?:document\b|(?:documentation|docs|readme)\s+(?:covers?|describes?|documents?|explains?|includes?|is|matches?|must|reflects?|should)\b"
    r"|(?:add|publish|update|write)\s+(?:the\s+)?(?:documentation|docs|readme)\b)"
)
TEST_INTENT = (
    r"^(?:(?:test|validate|verify)\b|(?:tests|testing|validation|verification)\s+(?:covers?|is|must|pass|passes|should|verify|verifies|validate|validates)\b"
    r"|(?:add|extend|run)\s+(?:the\s+)?(?:regression|tests?|testing)\b)"
)
ADMITTED = {
    "documentation": ("document",),
    "workflow_configuration": ("workflow", "configuration", "dependency", "production", "test"),
    "schema_migration": ("schema", "production", "test", "configuration"),
    "test_verification": ("test", "workflow", "production"),
    "api_contract": ("production", "test", "schema"),
    "ui": ("production", "test", "document"),
    "behavior": ("production", "test", "configuration"),
    "guardrail": ("production", "test", "document", "workflow", "configuration", "dependency", "schema"),
    "generic": ("production", "test", "document", "workflow", "configuration", "dependency", "schema", "unknown"),
}

# Kinds of symbols that code graphs hold, and suffixes of the files they cover.
SYMBOL_KINDS = ("file", "function", "method", "class", "route", "variable", "constant")
STRUCTURAL_SUFFIXES = (
    ".astro", ".c", ".cc", ".cbl", ".cob", ".cobol", ".cfc", ".cfm", ".cfs", ".cpp", ".cpy", ".cs", ".cshtml", ".cjs", ".cts", ".cu", ".cuh", ".cxx",
    ".dart", ".dfm", ".dpk", ".dpr", ".erl", ".escript", ".ets", ".fmx", ".go", ".h", ".hpp", ".hrl", ".hxx", ".inc", ".install", ".java", ".js",
    ".jsx", ".kt", ".kts", ".liquid", ".lpr", ".lua", ".luau", ".m", ".metal", ".mjs", ".mm", ".module", ".mts", ".nix", ".pas", ".php",
    ".properties", ".py", ".pyw", ".r", ".rake", ".razor", ".rb", ".rs", ".scala", ".sc", ".sol", ".svelte", ".swift", ".tf", ".tfvars", ".theme",
    ".tofu", ".ts", ".tsx", ".vb", ".vue", ".xsjs", ".xsjslib", ".xml",
)
STRUCTURAL_ENDS = (".routes", ".app", ".app.src", ".routing.yml", ".routing.yaml")
