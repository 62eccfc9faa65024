"""Fixed values.

Word lists, patterns and limits that decide results. They are stated here in full because the
results depend on every entry; nothing in this module is logic.
"""

# --- fixed values: whitespace as understood by the text rules (Java / RE2 class bodies) ---
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same as plain characters.
WS_CHARS = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# --- fixed values: budgets and limits ---
CHARS_PER_TOKEN = 3.5
MAX_FILE_BYTES = 1024 * 1024
CODE_CHUNK_LINES = 20
CODE_CHUNK_OVERLAP = 5
COMMENT_DISTANCE_LIMIT = 0.4
CONTEXT_RADIUS = 40
MAX_FULL_FILE_TOKENS = 12000
MAX_TOTAL_FULL_TOKENS = 60000
MAX_SINGLE_FILE_SHARE = 0.5
CHUNK_TOKENS = 35000
FULL_CONTENT_RATIO = 0.25
CONTEXT_OVERHEAD_TOKENS = 25000
MAX_SINGLE_REVIEW_TOKENS = 100000
MAX_SINGLE_REVIEW_FILES = 30
EMBEDDING_TRUNCATE_LINES = 1000
CODE_TRUNCATE_LINES = 300
GUIDELINE_TRUNCATE_LINES = 400
QUERY_CONTEXT_CHARS = 1500
SYNC_BUFFER_DAYS = 7
PARAGRAPH_CHUNK_MAX = 1000
PARAGRAPH_CHUNK_MIN = 100
SPLIT_MARKER = "... (diff split for PR review token budget; continued from another part) ..."

# --- fixed values: extension -> language ---
EXTENSION_LANGUAGE = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".d.ts": "typescript",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".svg": "svg",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
    ".md": "markdown", ".mdx": "markdown", ".markdown": "markdown", ".rst": "restructuredtext",
    ".adoc": "asciidoc", ".txt": "text",
    ".py": "python", ".pyi": "python", ".ipynb": "jupyter",
    ".rb": "ruby", ".erb": "ruby", ".rake": "ruby",
    ".php": "php", ".phtml": "php",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".groovy": "groovy", ".scala": "scala",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".c++": "cpp", ".h++": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".swift": "swift",
    ".sh": "bash", ".bash": "bash", ".zsh": "zsh", ".fish": "fish",
    ".pl": "perl", ".pm": "perl", ".lua": "lua", ".r": "r", ".dart": "dart",
    ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang",
    ".clj": "clojure", ".cljs": "clojure", ".hs": "haskell", ".lhs": "haskell",
    ".graphql": "graphql", ".gql": "graphql",
    ".vue": "vue", ".svelte": "svelte", ".astro": "astro", ".prisma": "prisma",
}
DOCUMENT_LANGUAGES = ("markdown", "restructuredtext", "asciidoc", "text")
DOCUMENT_EXTENSIONS = tuple(e for e, lang in EXTENSION_LANGUAGE.items() if lang in DOCUMENT_LANGUAGES)
CODE_EXTENSIONS = tuple(e for e, lang in EXTENSION_LANGUAGE.items() if lang not in DOCUMENT_LANGUAGES)

# --- fixed values: file admission ---
BINARY_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".webp", ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls",
    ".xlsx", ".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".ttf", ".otf", ".woff",
    ".woff2", ".mp3", ".mp4", ".avi", ".mov", ".wav",
)
SKIP_DIRECTORIES = ("node_modules", "dist", "build", ".git", "coverage", "vendor")
SKIP_FILENAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock",
    "package.json", "composer.json", "Gemfile", "Cargo.toml", "go.mod", "go.sum", "requirements.txt",
    "pyproject.toml", "pom.xml", "build.gradle",
    "tsconfig.json", "jsconfig.json", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".prettierrc",
    ".prettierrc.json", "prettier.config.js", ".babelrc", "babel.config.js", "jest.config.js", "jest.config.ts",
    "vitest.config.ts", "vitest.config.js", "webpack.config.js", "vite.config.js", "vite.config.ts",
    "rollup.config.js", ".dockerignore", ".gitignore", ".gitattributes", ".editorconfig", ".env.example",
    ".nvmrc", ".node-version",
)
SKIP_PATH_PATTERNS = (
    r"\.min\.(js|css)$", r"\.bundle\.(js|css)$", r"\.generated\.", r"\.d\.ts$", r"\.snap$",
    r"\.config\.(js|ts|mjs|cjs)$",
)
SKIP_NAME_PATTERNS = (r"^\..*rc$", r"^\..*rc\.json$")
DEFAULT_INCLUDES = tuple(
    f"**/*.{ext}" for ext in (
        "js", "jsx", "ts", "tsx", "py", "rb", "java", "go", "php", "cs", "c", "cpp", "h", "hpp", "html", "css",
        "scss", "json", "md", "yml", "yaml", "kt", "sh", "gradle",
    )
)
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.*/**", "**/*.min.*", "**/vendor/**", "**/tmp/**",
    "**/coverage/**", "**/__pycache__/**", "**/*.log", "**/*.lock", "**/*.bak", "**/package-lock.json",
    "**/yarn.lock", "**/assets/**", "**/images/**", "**/fonts/**",
)

# --- fixed values: documentation and test names ---
TEST_PATH_PATTERN = r"(/__tests__/|/tests?/|/specs?/|_test\.|_spec\.|\.test\.|\.spec\.)"
DOC_FILENAMES = ("readme", "license", "contributing", "changelog", "copying")
DOC_DIRECTORIES = ("/docs/", "/documentation/", "/doc/", "/wiki/", "/examples/", "/guides/")
DOC_TERMS = ("guide", "tutorial", "manual", "howto")
GENERIC_DOC_PATTERN = r"(?i)(README|RUNBOOK|CONTRIBUTING|CHANGELOG|LICENSE|SETUP|INSTALL)(\.md|$)"
GENERIC_DOC_TITLES = (
    "readme", "runbook", "changelog", "contributing", "license", "setup", "installation", "getting started",
)

# --- fixed values: automated accounts ---
BOT_NAMES = (
    "dependabot[bot]", "renovate[bot]", "github-actions[bot]", "codecov[bot]", "sonarqubecloud[bot]",
    "sonarcloud[bot]", "snyk[bot]", "greenkeeper[bot]", "semantic-release-bot", "allcontributors[bot]",
    "stale[bot]", "mergify[bot]", "auto-merge-bot", "ci-bot", "deploy-bot", "vercel[bot]", "netlify[bot]",
    "heroku[bot]", "circleci[bot]", "travis[bot]", "jenkins[bot]", "azure-pipelines[bot]", "gitpod[bot]",
    "codesandbox[bot]", "deepsource[bot]", "codeclimate[bot]", "codebeat[bot]", "codacy[bot]", "houndci-bot",
    "danger[bot]", "prettier[bot]", "eslint[bot]", "typescript[bot]",
)
BOT_PATTERNS = (
    r"\[bot\]$", "^bot-", "-bot$", "^dependabot", "^renovate", "^github-actions", "^codecov", "^sonarcloud",
    "^sonarqube", "^snyk", "^greenkeeper", "^semantic-release", "^allcontributors", "^stale", "^mergify",
    "^auto-merge", "^ci-bot", "^deploy-bot",
)
DEPENDENCY_BOTS = ("dependabot[bot]", "dependabot-preview[bot]")

# --- fixed values: comment classification, in rule order ---
CATEGORY_PATTERNS = {
    "security": (
        "sql injection", "xss", "cross.?site", "sanitize", "vulnerability", "security", "authentication",
        "authorization", "password", "token", "secret", "encryption", "sensitive", "exploit", "attack",
    ),
    "performance": (
        "inefficient", "performance", "slow", "memory leak", "optimization", "algorithm", "complexity",
        "bottleneck", "cache", "database.*query", r"n\+1", "timeout",
    ),
    "style": (
        "naming", "convention", "documentation", "comment", "indentation", "formatting", "camelcase",
        "snake_case", "consistency", "readability", "typo",
    ),
    "logic": (
        "condition", "always false", "always true", "error handling", "edge case", "logic", "simplified",
        "missing", "handle", "check", "validation",
    ),
}
SEVERITY_PATTERNS = {
    "critical": ("critical", "crash", "security flaw", "data loss", "system down", "fatal"),
    "major": ("major", "serious", "important", "significant", "will cause", "breaks", "failure"),
    "style": ("typo", "formatting", "whitespace", "spacing", "minor style"),
}
PATTERN_KEYWORDS = {
    "error_handling": ("error handling", "error", "exception", "try catch", "handle"),
    "input_validation": ("validation", "validate", "sanitize", "check input"),
    "null_check": ("null check", "null", "undefined", "falsy"),
    "async_await": ("async", "await", "promise", "callback"),
    "performance": ("performance", "optimize", "efficient", "slow"),
    "security": ("security", "sanitize", "escape", "auth"),
    "documentation": ("documentation", "comment", "doc", "readme"),
    "testing": ("test", "unit test", "coverage", "spec"),
}
ISSUE_WORDS = ("bug", "error", "issue", "problem", "broken", "fail")
REVIEW_WORDS = ("suggest", "recommend", "consider", "improve", "better")
TECHNICAL_WORDS = ("performance", "security", "memory", "optimization", "scalability")
DISMISSAL_PHRASES = ("false positive", "not relevant", "ignore")
DISMISSAL_RESOLVED = "resolved"
VERIFY_TAIL_WORDS = ("fix", "bug", "issue", "error", "problem", "solution", "should", "recommend")

# --- fixed values: code and document context ---
FRONTEND_MARKS = ("react", "usestate", "useeffect", "angular", "vue", "document.getelementbyid", "jsx", ".tsx")
BACKEND_MARKS = ("require('express')", "http.createserver", "fs.readfilesync", "process.env")
COMMON_TECH_WORDS = (
    "api", "component", "module", "function", "class", "hook", "service", "database", "query", "state", "props",
)
TEST_QUERY_WORDS = (
    "test", "spec", "mock", "stub", "assertion", "coverage", "fixture", "beforeEach", "afterEach", "describe",
    "it", "expect",
)
AREAS = (
    "Frontend", "Backend", "FullStack", "Database", "DevOps", "Testing", "Security", "Architecture",
    "ToolingInternal", "GeneralProjectDoc", "Unknown",
)
AREA_DOMAIN_MARKS = {
    "Frontend": ("frontend", "ui/ux"),
    "Backend": ("backend", "api"),
    "Database": ("database", "data"),
    "DevOps": ("devops", "infrastructure"),
    "Testing": ("testing", "qa"),
    "Security": ("security",),
    "Architecture": ("architecture",),
    "ToolingInternal": ("tooling", "developer tools"),
    "GeneralProjectDoc": ("general",),
}
AREA_DOMAIN_WEIGHTS = {"GeneralProjectDoc": 0.5}
AREA_TECH_MARKS = {
    "Frontend": ("react", "vue", "angular"),
    "Backend": ("node", "express", "django"),
    "Database": ("postgres", "mysql", "mongodb"),
    "DevOps": ("docker", "kubernetes", "terraform"),
    "Testing": ("jest", "pytest", "testing"),
}
AREA_PATH_MARKS = {
    "ToolingInternal": (("/tools/", "/scripts/", "/cli/"), (" cli", " tool")),
    "Backend": (("/api/", "/server/", "/db/", "/backend/"), (" api", " server", " backend")),
    "Frontend": (("/frontend/", "/ui/", "/components/", "/views/", "/pages/"), (" frontend", " user interface")),
}
GENERAL_DOC_SUFFIXES = ("readme.md", "runbook.md", "contributing.md", "changelog.md")
README_POINTS = {
    "getting started": 2, "installation": 2, "setup": 2, "how to run": 2, "usage": 1, "configuration": 1,
    "deployment": 1, "troubleshooting": 1, "prerequisites": 1, "table of contents": 1, "contributing": 0.5,
    "license": 0.5, "overview": 1, "introduction": 1, "purpose": 1, "project structure": 0.5,
}
TITLE_STOPWORDS = ("the", "for", "and", "with", "into", "about", "using", "docs", "this", "that")
KEYWORD_STOPWORDS = ("the", "and", "for", "with", "this", "that", "from", "into")
DOMAIN_LABELS = (
    "frontend/UI", "backend/server", "database", "DevOps/infrastructure", "mobile app", "data science/ML", "API",
    "security", "testing", "architecture", "getting started/setup", "configuration", "deployment",
    "troubleshooting", "reference", "tutorial", "best practices", "changelog/release notes",
)

# --- fixed values: key-file rules (lower-cased names) ---
FILE_TYPE_RULES = {
    "config": {
        "name_patterns": (
            r"\.config\.(js|ts|json|yaml|yml|toml|ini|conf)$", "^dockerfile$", r"^docker-compose\.(yml|yaml)$",
            "^makefile$", r"^cmake.*\.txt$", r"^(webpack|vite|babel|rollup|prettier|eslint)\.config",
            r"^(tsconfig|jsconfig)\.json$", r"\.(eslintrc|prettierrc|babelrc)", r"^(jest|vitest|playwright)\.config",
            r"^(setup|pyproject|tox|pytest)\.(py|toml|ini|cfg)$", r"^\.pylintrc$", r"^requirements.*\.txt$",
            r"^pipfile(\.lock)?$", r"^pom\.xml$", r"^build\.gradle(\.kts)?$", r"^gradle\.properties$",
            r"^go\.(mod|sum)$", r"^cargo\.(toml|lock)$", r"^gemfile(\.lock)?$", r"^composer\.(json|lock)$",
            r"^cmakelists\.txt$", r"^conanfile\.(txt|py)$", r"^vcpkg\.json$",
        ),
        "path_marks": (".github/workflows/", ".vscode/", ".devcontainer/"),
        "keywords": ("config",),
    },
    "entry": {
        "name_patterns": (
            r"^(index|main|app|server)\.(js|ts|jsx|tsx|mjs|cjs)$", r"^_app\.(js|ts|jsx|tsx)$",
            r"(router|routes|routing)\.(js|ts)$", r"^(__main__|main|app|run|manage)\.py$",
            r"^(main|application|app)\.java$", r"^main\.go$", r"^(main|lib)\.rs$", r"^(main|app)\.rb$",
            r"^(index|app|main)\.php$", r"^main\.(c|cpp|cc|cxx)$", r"^(run|start|bootstrap)\.(sh|bash|zsh)$",
        ),
        "path_marks": ("/bin/", "/scripts/"),
        "keywords": ("index", "main"),
    },
    "dependency": {
        "name_patterns": (
            r"^package(-lock)?\.json$", r"^yarn\.lock$", r"^pnpm-lock\.yaml$", r"^requirements.*\.txt$",
            r"^pipfile(\.lock)?$", r"^pyproject\.toml$", r"^poetry\.lock$", r"^pom\.xml$",
            r"^build\.gradle(\.kts)?$", r"^gradle\.lockfile$", r"^go\.(mod|sum)$", r"^cargo\.(toml|lock)$",
            r"^gemfile(\.lock)?$", r"^composer\.(json|lock)$", r"^conanfile\.(txt|py)$", r"^vcpkg\.json$",
            r"-lock\.(json|yaml|yml|toml)$", r"\.lock$",
        ),
        "path_marks": (),
        "keywords": (),
    },
    "utility": {
        "name_patterns": (
            "(util|utility|helper|service|api|hook|wrapper|component|store|state|common|shared|lib)",
            "(core|base|foundation|framework)",
            "(middleware|plugin|extension|adapter)",
            "(lazy|async|await|promise|retry|preload|loader|chunk|suspend)",
            "(context|provider|factory|builder|creator|generator|maker)",
            "(error|boundary|fallback|recovery)",
        ),
        "path_marks": (
            "/src/", "/lib/", "/utils/", "/helpers/", "/services/", "/common/", "/shared/", "/core/", "/pkg/",
            "/internal/",
        ),
        "keywords": (),
        "not_test_or_doc": True,
    },
    "types": {
        "name_patterns": (
            "(types?|interface|model|schema|definition|contract)",
            r"\.(d\.ts|types\.ts|interfaces\.ts|models\.ts)$",
            "(graphql|gql|schema)",
        ),
        "path_marks": ("/src/", "/types/", "/models/", "/schemas/", "/lib/"),
        "keywords": (),
        "not_test_or_doc": True,
    },
}
KEY_FILE_SEARCHES = (
    # category, matcher, terms searched in content, path and name; or name/path LIKE rules
    ("package", "dependency", ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt",
                               "pipfile", "pyproject.toml", "gemfile", "cargo.toml", "pom.xml", "build.gradle",
                               "composer.json"), None, None),
    ("config", "config", ("config", "dockerfile", "makefile", "eslint", "prettier", "jest"), None, None),
    ("setup", "entry", None, (("name", "%index%"), ("name", "%main%"), ("name", "%app%"), ("name", "%server%")), 20),
    ("utility", "utility", ("utils", "helpers", "common", "lib", "hooks", "wrapper", "lazy", "async", "context",
                            "provider"), None, None),
    ("frontend", "utility", ("components", "lazy", "preload", "chunk", "route", "app", "wrapper", "async", "suspense",
                             "react", "retry", "error", "boundary", "fallback", "maker"), None, None),
    ("backend", "utility", ("services", "api", "graphql", "resolver", "schema", "server", "database", "context",
                            "auth", "middleware", "validation"), None, None),
    ("types", "types", ("types", "interfaces", "models", "schema", "definitions"), None, None),
    ("docs", "docs", None, (("name", "%README%"), ("name", "%CHANGELOG%"), ("name", "%.md")), 10),
    ("tests", "tests", None, (("name", "%test%"), ("name", "%spec%"), ("path", "%test%"), ("path", "%spec%")), 15),
)
TERM_SEARCH_CANDIDATES = 500
CATEGORY_QUOTAS = {"package": 3, "config": 6, "setup": 4, "utility": 4, "types": 3, "test-config": 2}
DEFAULT_QUOTA = 2
KEY_FILE_LIMIT = 15

# --- fixed values: report wording ---
SEVERITY_EMOJI = {
    "critical": "\U0001F6A8", "high": "\U0001F525", "medium": "⚠️", "low": "\U0001F4A1",
    "info": "ℹ️",
}
OTHER_EMOJI = "•"
SUMMARY_GUIDELINES = (
    "Follow established patterns in the codebase",
    "Maintain consistency with existing code style",
    "Ensure proper error handling",
    "Add appropriate tests for new functionality",
)

# --- fixed values: English stop words (the list Spark ships as StopWordsRemover's default) ---
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't",
    "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't",
    "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
)
