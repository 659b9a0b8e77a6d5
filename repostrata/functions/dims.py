"""Fixed values that decide results: names, lookups, thresholds and patterns."""

from __future__ import annotations

import unicodedata

# Directories that are never analysed.
SKIP_DIRS = [
    ".git", "node_modules", ".venv", "venv", "__pycache__",
    "dist", "build", ".next", ".nuxt", "target", "vendor",
    ".gradle", ".idea", ".vscode", "coverage", ".pytest_cache",
    ".mypy_cache", ".tox", "eggs", ".eggs", "htmlcov", ".cache",
]

# The shorter list used by the complexity job.
COMPLEXITY_SKIP_DIRS = [
    ".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build",
]

# File extension to language.
EXTENSION_LANGUAGES = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "JavaScript",
    ".tsx": "TypeScript",
    ".java": "Java",
    ".kt": "Kotlin",
    ".go": "Go",
    ".rs": "Rust",
    ".rb": "Ruby",
    ".php": "PHP",
    ".cs": "C#",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".c": "C",
    ".h": "C",
    ".scala": "Scala",
    ".swift": "Swift",
    ".sh": "Shell",
    ".bash": "Shell",
    ".zsh": "Shell",
    ".sql": "SQL",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "SCSS",
    ".vue": "Vue",
    ".svelte": "Svelte",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".erl": "Erlang",
    ".lua": "Lua",
    ".r": "R",
    ".dart": "Dart",
    ".tf": "Terraform",
    ".hcl": "HCL",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".json": "JSON",
    ".toml": "TOML",
    ".xml": "XML",
    ".proto": "Protobuf",
    ".graphql": "GraphQL",
    ".gql": "GraphQL",
    ".md": "Markdown",
    ".rst": "reStructuredText",
    ".dockerfile": "Dockerfile",
}

# Whole file names to language.
FILENAME_LANGUAGES = {
    "Dockerfile": "Dockerfile",
    "Makefile": "Makefile",
    "Jenkinsfile": "Groovy",
    "Gemfile": "Ruby",
    "Rakefile": "Ruby",
}

# Extensions that are not text sources.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".pdf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".wasm",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".ttf", ".woff", ".woff2",
    ".lock",
]

# Path segments of tests, configuration extensions, lockfiles, documents.
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "__tests__", "_test"]
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".env"]
LOCKFILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "poetry.lock", "Pipfile.lock", "Gemfile.lock",
    "go.sum", "Cargo.lock", "composer.lock",
]
DOC_STEMS = [
    "readme", "changelog", "history", "architecture", "adr",
    "install", "setup", "runbook", "contributing",
]
PLAIN_DOC_EXTENSIONS = [".txt", ".adoc", ".wiki"]

# Thresholds.
LARGE_FILE_LINES = 500
LARGE_FUNCTION_LINES = 50
TOP_FILES = 10

# Languages the complexity job looks at, by extension.
COMPLEXITY_EXTENSIONS = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript",
    ".jsx": "JavaScript", ".tsx": "TypeScript",
    ".java": "Java", ".kt": "Kotlin", ".go": "Go",
    ".rs": "Rust", ".rb": "Ruby", ".cs": "C#",
}

# A line that starts a function, per language. One modifier or blank before
# the type is enough for a search, and a repeated group would overflow Java's stack.
FUNCTION_PATTERNS = {
    "Python": r"^\s{0,4}(async\s+)?def\s+\w+",
    "JavaScript": r"(function\s+\w+|\w+\s*[:=]\s*(async\s*)?(function|\([^)]*\)\s*=>))",
    "TypeScript": r"(function\s+\w+|\w+\s*[:=]\s*(async\s*)?(function|\([^)]*\)\s*=>))",
    "Java": r"(public|private|protected|static|final|\s)[\w<>\[\]]+\s+\w+\s*\(",
    "Go": r"^func\s+",
    "Kotlin": r"^\s*(override\s+)?fun\s+\w+",
    "Rust": r"^\s*(pub\s+)?(async\s+)?fn\s+\w+",
    "Ruby": r"^\s*def\s+\w+",
    "C#": r"(public|private|protected|internal|static|virtual|override|async|\s)[\w<>\[\]?]+\s+\w+\s*\(",
}

# A line that imports, per language.
IMPORT_PATTERNS = {
    "Python": r"^\s*(import|from)\s+\w+",
    "JavaScript": r"(import .+ from|require\s*\()",
    "TypeScript": r"(import .+ from|require\s*\()",
    "Go": r'^\s*"[\w./-]+"',
    "Java": r"^import\s+[\w.]+",
}

# Words of which every line that the patterns above find has one.
FUNCTION_WORDS = {
    "Python": ["def"], "JavaScript": ["function", "=>"], "TypeScript": ["function", "=>"], "Java": ["("], "Go": ["func"],
    "Kotlin": ["fun"], "Rust": ["fn"], "Ruby": ["def"], "C#": ["("],
}
IMPORT_WORDS = {
    "Python": ["import", "from"], "JavaScript": ["import ", "require"], "TypeScript": ["import ", "require"], "Go": ['"'],
    "Java": ["import"],
}

# Comment style by extension.
HASH_EXTENSIONS = [".py", ".rb", ".sh", ".bash", ".zsh", ".yml", ".yaml", ".toml", ".r", ".coffee"]
C_STYLE_EXTENSIONS = [
    ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".c", ".cpp", ".cc",
    ".cxx", ".h", ".hpp", ".cs", ".rs", ".swift", ".kt", ".scala",
    ".php", ".dart", ".m",
]
SQL_EXTENSIONS = [".sql"]

# Languages that decide the project type.
FRONTEND_LANGUAGES = ["JavaScript", "TypeScript", "Vue", "Svelte", "HTML"]
BACKEND_LANGUAGES = ["Python", "Java", "Go", "Kotlin", "Scala", "Ruby", "PHP", "C#", "Rust"]
INFRA_LANGUAGES = ["Terraform", "HCL", "YAML"]
MONOREPO_DIRS = ["packages", "apps", "services", "libs"]

# Marker files in report order.
PACKAGE_MANAGER_FILES = [
    ("package-lock.json", "npm"),
    ("yarn.lock", "yarn"),
    ("pnpm-lock.yaml", "pnpm"),
    ("requirements.txt", "pip"),
    ("Pipfile", "pipenv"),
    ("pyproject.toml", "pip/poetry"),
    ("poetry.lock", "poetry"),
    ("go.mod", "go modules"),
    ("Cargo.toml", "cargo"),
    ("pom.xml", "maven"),
    ("build.gradle", "gradle"),
    ("build.gradle.kts", "gradle"),
    ("Gemfile", "bundler"),
    ("composer.json", "composer"),
]
NPM_FRAMEWORKS = [
    ("react", "React"),
    ("next", "Next.js"),
    ("vue", "Vue"),
    ("nuxt", "Nuxt.js"),
    ("angular", "Angular"),
    ("@angular/core", "Angular"),
    ("svelte", "Svelte"),
    ("express", "Express"),
    ("fastify", "Fastify"),
    ("nestjs", "NestJS"),
    ("@nestjs/core", "NestJS"),
    ("koa", "Koa"),
]
PYTHON_FRAMEWORKS = [
    ("fastapi", "FastAPI"),
    ("django", "Django"),
    ("flask", "Flask"),
    ("tornado", "Tornado"),
    ("aiohttp", "aiohttp"),
    ("starlette", "Starlette"),
    ("sqlalchemy", "SQLAlchemy"),
    ("celery", "Celery"),
]
GO_FRAMEWORKS = [
    ("gin-gonic/gin", "Gin"),
    ("labstack/echo", "Echo"),
    ("gofiber/fiber", "Fiber"),
    ("gorilla/mux", "Gorilla Mux"),
]
JVM_FRAMEWORKS = [
    ("spring-boot", "Spring Boot"),
    ("spring-web", "Spring MVC"),
    ("micronaut", "Micronaut"),
    ("quarkus", "Quarkus"),
    ("ktor", "Ktor"),
]
DOCKER_FILES = [
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "Dockerfile.dev", "Dockerfile.prod",
]
LINTER_FILES = [
    (["eslint.config.js", "eslint.config.mjs", ".eslintrc", ".eslintrc.js",
      ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml"], "ESLint"),
    ([".flake8"], "Flake8"),
    ([".pylintrc"], "Pylint"),
    (["mypy.ini"], "MyPy"),
    ([".rubocop.yml", ".rubocop.yaml"], "RuboCop"),
    (["golangci.yml", ".golangci.yml", "golangci.yaml", ".golangci.yaml"], "golangci-lint"),
]
FORMATTER_FILES = [
    ([".prettierrc", ".prettierrc.js", ".prettierrc.json",
      ".prettierrc.yml", ".prettierrc.yaml", "prettier.config.js"], "Prettier"),
    (["gofmt"], "gofmt"),
]

# Cyrillic letters and their Latin spelling.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d",
    "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i",
    "й": "j", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya",
}


def diacritic_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, multi): characters whose compatibility decomposition leaves ASCII.

    Built from the Unicode rule rather than listed, over all planes: one-character results
    go into a `translate` pair, longer ones into a map.
    """
    src, dst, multi = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or unicodedata.decomposition(chr(cp)) == "":
            continue
        ch = chr(cp)
        kept = "".join(
            c for c in unicodedata.normalize("NFKD", ch)
            if c.isascii() and unicodedata.category(c) != "Mn"
        )
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        elif len(kept) > 1:
            multi[ch] = kept
    return "".join(src), "".join(dst), multi


# Licence spellings to SPDX identifiers.
SPDX_ALIASES = {
    "mit": "MIT",
    "mit license": "MIT",
    "mit/x11": "MIT",
    "the mit license": "MIT",
    "apache 2.0": "Apache-2.0",
    "apache-2.0": "Apache-2.0",
    "apache 2": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache license, version 2.0": "Apache-2.0",
    "apache software license": "Apache-2.0",
    "apache software license 2.0": "Apache-2.0",
    "bsd": "BSD-2-Clause",
    "bsd-2-clause": "BSD-2-Clause",
    "bsd 2-clause": "BSD-2-Clause",
    "simplified bsd": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "new bsd": "BSD-3-Clause",
    "revised bsd": "BSD-3-Clause",
    "bsd-4-clause": "BSD-4-Clause",
    "isc": "ISC",
    "isc license": "ISC",
    "isc license (iscl)": "ISC",
    "mpl-2.0": "MPL-2.0",
    "mpl 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "mozilla public license 2.0 (mpl 2.0)": "MPL-2.0",
    "cc0-1.0": "CC0-1.0",
    "cc0": "CC0-1.0",
    "creative commons zero v1.0 universal": "CC0-1.0",
    "unlicense": "Unlicense",
    "the unlicense": "Unlicense",
    "the unlicense (unlicense)": "Unlicense",
    "wtfpl": "WTFPL",
    "do what the f*ck you want to public license": "WTFPL",
    "0bsd": "0BSD",
    "python software foundation license": "PSF-2.0",
    "psf-2.0": "PSF-2.0",
    "python-2.0": "Python-2.0",
    "zlib": "Zlib",
    "zlib/libpng": "Zlib",
    "zlib license": "Zlib",
    "artistic-2.0": "Artistic-2.0",
    "artistic license 2.0": "Artistic-2.0",
    "gpl-2.0": "GPL-2.0-only",
    "gpl-2.0-only": "GPL-2.0-only",
    "gpl-2.0-or-later": "GPL-2.0-or-later",
    "gpl 2.0": "GPL-2.0-only",
    "gnu general public license v2 (gplv2)": "GPL-2.0-only",
    "gnu general public license v2 or later (gplv2+)": "GPL-2.0-or-later",
    "gpl-3.0": "GPL-3.0-only",
    "gpl-3.0-only": "GPL-3.0-only",
    "gpl-3.0-or-later": "GPL-3.0-or-later",
    "gpl 3.0": "GPL-3.0-only",
    "gnu general public license v3 (gplv3)": "GPL-3.0-only",
    "gnu general public license v3 or later (gplv3+)": "GPL-3.0-or-later",
    "agpl-3.0": "AGPL-3.0-only",
    "agpl-3.0-only": "AGPL-3.0-only",
    "agpl-3.0-or-later": "AGPL-3.0-or-later",
    "agpl 3.0": "AGPL-3.0-only",
    "gnu affero general public license v3": "AGPL-3.0-only",
    "lgpl-2.0": "LGPL-2.0-only",
    "lgpl-2.1": "LGPL-2.1-only",
    "lgpl-2.1-only": "LGPL-2.1-only",
    "lgpl-2.1-or-later": "LGPL-2.1-or-later",
    "gnu lesser general public license v2 (lgplv2)": "LGPL-2.0-only",
    "gnu lesser general public license v2 or later (lgplv2+)": "LGPL-2.1-or-later",
    "lgpl-3.0": "LGPL-3.0-only",
    "lgpl-3.0-only": "LGPL-3.0-only",
    "lgpl-3.0-or-later": "LGPL-3.0-or-later",
    "gnu lesser general public license v3 (lgplv3)": "LGPL-3.0-only",
    "eupl-1.1": "EUPL-1.1",
    "eupl-1.2": "EUPL-1.2",
    "european union public licence 1.2": "EUPL-1.2",
    "cddl-1.0": "CDDL-1.0",
    "eclipse public license 1.0": "EPL-1.0",
    "epl-1.0": "EPL-1.0",
    "eclipse public license 2.0": "EPL-2.0",
    "epl-2.0": "EPL-2.0",
    "osl-3.0": "OSL-3.0",
    "open software license 3.0": "OSL-3.0",
}

# Risk and class of a licence.
RISKY_PREFIXES = ["GPL-", "AGPL-", "LGPL-", "EUPL-", "OSL-", "CPAL-", "RPSL-"]
SAFE_LICENSES = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC",
    "CC0-1.0", "Unlicense", "WTFPL", "MPL-2.0", "PSF-2.0",
    "0BSD", "Zlib", "Python-2.0", "Artistic-2.0", "EPL-1.0", "EPL-2.0",
]
PERMISSIVE = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
    "ISC", "CC0-1.0", "Unlicense", "WTFPL", "0BSD", "Zlib", "Python-2.0",
    "PSF-2.0", "Artistic-2.0", "EPL-1.0", "EPL-2.0",
]
WEAK_COPYLEFT = [
    "MPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later",
    "EUPL-1.1", "EUPL-1.2",
    "CDDL-1.0",
]
STRONG_COPYLEFT = [
    "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later",
    "OSL-3.0", "CPAL-1.0", "RPSL-1.0",
]
STRONG_PREFIXES = ["GPL-", "AGPL-"]
WEAK_PREFIXES = ["LGPL-", "MPL-", "EUPL-"]
LICENSE_CLASSES = ["permissive", "weak_copyleft", "strong_copyleft", "unknown"]

# Package classifiers to SPDX identifiers.
TROVE_LICENSES = {
    "license :: osi approved :: mit license": "MIT",
    "license :: osi approved :: apache software license": "Apache-2.0",
    "license :: osi approved :: bsd license": "BSD-3-Clause",
    "license :: osi approved :: isc license (iscl)": "ISC",
    "license :: osi approved :: mozilla public license 2.0 (mpl 2.0)": "MPL-2.0",
    "license :: osi approved :: python software foundation license": "PSF-2.0",
    "license :: osi approved :: the unlicense (unlicense)": "Unlicense",
    "license :: osi approved :: gnu general public license v2 (gplv2)": "GPL-2.0-only",
    "license :: osi approved :: gnu general public license v2 or later (gplv2+)": "GPL-2.0-or-later",
    "license :: osi approved :: gnu general public license v3 (gplv3)": "GPL-3.0-only",
    "license :: osi approved :: gnu general public license v3 or later (gplv3+)": "GPL-3.0-or-later",
    "license :: osi approved :: gnu lesser general public license v2 (lgplv2)": "LGPL-2.0-only",
    "license :: osi approved :: gnu lesser general public license v2 or later (lgplv2+)": "LGPL-2.1-or-later",
    "license :: osi approved :: gnu lesser general public license v3 (lgplv3)": "LGPL-3.0-only",
    "license :: osi approved :: artistic license": "Artistic-2.0",
    "license :: osi approved :: eclipse public license 1.0 (epl-1.0)": "EPL-1.0",
    "license :: osi approved :: eclipse public license 2.0 (epl-2.0)": "EPL-2.0",
}

# Phrases that identify a licence text, first match wins.
LICENSE_TEXT_PATTERNS = [
    (r"permission is hereby granted.*?without restriction", "MIT"),
    (r"apache license.*?version 2\.0", "Apache-2.0"),
    (r"gnu general public license.*?version 3", "GPL-3.0-only"),
    (r"gnu general public license.*?version 2", "GPL-2.0-only"),
    (r"gnu lesser general public license.*?version 3", "LGPL-3.0-only"),
    (r"gnu lesser general public license.*?version 2\.1", "LGPL-2.1-only"),
    (r"bsd 3-clause|redistribution and use.*?three", "BSD-3-Clause"),
    (r"bsd 2-clause|redistribution and use.*?two", "BSD-2-Clause"),
    (r"isc license|permission to use.*?isc", "ISC"),
    (r"mozilla public license.*?2\.0", "MPL-2.0"),
    (r"creative commons.*?zero", "CC0-1.0"),
]
LICENSE_FILE_NAMES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "LICENCE", "COPYING"]

# Quality of a dependency source, higher wins.
DISCOVERY_RANK = {"installed": 4, "resolved": 3, "locked": 2, "declared_only": 1, "unknown": 0}

# Manifest names read for pip, in order.
REQUIREMENT_FILES = [
    "requirements.txt", "requirements-dev.txt", "requirements-test.txt",
    "requirements-prod.txt", "requirements/base.txt",
    "requirements/dev.txt", "requirements/prod.txt",
]
REQUIREMENT_PATTERN = r"^([A-Za-z0-9_\-\.]+)\s*([>=<!~^].+)?"

# Ecosystems with a registry.
REGISTRY_ECOSYSTEMS = ["pip", "cargo", "bundler", "maven", "npm"]

# Weights and domains of the scorecard.
SCORE_WEIGHTS = {
    "code_quality": 0.25,
    "test_quality": 0.20,
    "doc_quality": 0.15,
    "delivery_quality": 0.20,
    "maintainability": 0.20,
}

# Risk thresholds.
TOP1_SHARE = 0.70
TOP2_SHARE = 0.90
MONO_OWNER_SHARE = 0.80
LOCKFILE_MANAGERS = ["npm", "yarn", "pnpm", "poetry", "pipenv", "cargo", "bundler"]
ORPHAN_DAYS = 180
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Inactivity report.
INACTIVE_TAG = "inactive"
INACTIVITY_WINDOW_DAYS = 90
INACTIVITY_THRESHOLD = 4.0
BORDERLINE_SCORE = 2.0
PERIOD_DAYS = {"1m": 30, "3m": 90, "6m": 180, "1y": 365}
