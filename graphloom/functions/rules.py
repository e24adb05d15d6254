"""Pattern rules, and columns that apply them: the first rule that matches, in order, decides.

Rules are chained conditions in one expression, so a row stops at its first match and no
join with a table of rules is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of code that brings in untrusted data, and the category of each.
SOURCES = [
    (r"req(?:uest)?\.body", "sql_injection"), (r"req(?:uest)?\.query", "sql_injection"), (r"req(?:uest)?\.params", "sql_injection"),
    (r"req(?:uest)?\.headers", "ssrf"), (r"req(?:uest)?\.cookies", "xss"), (r"request\.form", "sql_injection"), (r"request\.args", "sql_injection"),
    (r"request\.GET|request\.POST", "sql_injection"), (r"process\.env", "ssrf"), (r"os\.environ", "ssrf"), (r"System\.getenv", "ssrf"), (r"os\.Getenv", "ssrf"),
    (r"\.find(?:One|Many|All|By)?\(", "xss"), (r"\.query\(", "xss"), (r"\.select\(", "xss"), (r"fs\.readFile", "path_traversal"), (r"open\(", "path_traversal"),
    (r"\.read\(\)", "path_traversal"), (r"readline", "command_injection"), (r"input\(", "command_injection"), (r"Scanner", "command_injection"),
    (r"window\.location", "open_redirect"), (r"document\.location", "open_redirect"), (r"document\.cookie", "xss"), (r"localStorage\.getItem", "xss"),
    (r"JSON\.parse\(", "insecure_deserialization"), (r"pickle\.loads?\(", "insecure_deserialization"), (r"yaml\.load\(", "insecure_deserialization"),
]

# Patterns of code that untrusted data must not reach, with category and severity.
SINKS = [
    (r"\.query\(.*\$\{", "sql_injection", "critical"), (r"\.raw\(", "sql_injection", "critical"), (r"cursor\.execute\(", "sql_injection", "critical"),
    (r"\.exec(?:ute)?Sql\(", "sql_injection", "critical"), (r"db\.run\(", "sql_injection", "critical"), (r"exec\(", "command_injection", "critical"),
    (r"spawn\(", "command_injection", "critical"), (r"child_process", "command_injection", "critical"), (r"subprocess", "command_injection", "critical"),
    (r"os\.system\(", "command_injection", "critical"), (r"Runtime\.exec\(", "command_injection", "critical"), (r"innerHTML", "xss", "critical"),
    (r"dangerouslySetInnerHTML", "xss", "critical"), (r"document\.write\(", "xss", "critical"), (r"\.html\(", "xss", "warning"), (r"render\(.*\$\{", "xss", "warning"),
    (r"fs\.writeFile", "path_traversal", "critical"), (r"fs\.readFile", "path_traversal", "warning"), (r"fs\.unlink", "path_traversal", "critical"),
    (r"\.createWriteStream\(", "path_traversal", "critical"), (r"\beval\(", "command_injection", "critical"), (r"new\s+Function\(", "command_injection", "critical"),
    (r"vm\.runInContext", "command_injection", "critical"), (r"fetch\(", "ssrf", "warning"), (r"axios\.\w+\(", "ssrf", "warning"), (r"http\.get\(", "ssrf", "warning"),
    (r"requests\.\w+\(", "ssrf", "warning"), (r"res\.redirect\(", "open_redirect", "warning"), (r"window\.location\s*=", "open_redirect", "warning"),
    (r"location\.href\s*=", "open_redirect", "warning"), (r"console\.log\(.*(?:email|password|ssn|phone|token|secret|key)", "pii_leak", "warning"), (r"logger\.\w+\(.*(?:email|password|ssn|phone|token|secret|key)", "pii_leak", "warning"),
]

# Patterns of code that makes data safe.
SANITIZERS = [
    r"\.parse\(|\.safeParse\(", r"\.validate\(", r"express-validator|validationResult", r"escapeHtml|escape_html|htmlspecialchars", r"encodeURIComponent|encodeURI",
    r"DOMPurify|sanitize-html|bleach\.clean", r"\?\s*[,)]|\$\d+|\%s", r"\.prepare\(", r"parseInt\(|Number\(|parseFloat\(", r"String\(|\.toString\(\)", r"Boolean\(",
    r"path\.resolve|path\.normalize|path\.basename", r"""\.replace\(\s*['"]\.{2}['"]|\.includes\(\s*['"]\.{2}['"]""", r"new\s+URL\(", r"bcrypt|argon2|scrypt|pbkdf2",
    r"(?i)\.includes\(|\.indexOf\(|allowlist|whitelist",
]

# What a line scanner reports, first match first: pattern, category, severity.
LINES = [
    (r"""\.query\s*\(\s*[`"'].*\$\{""", "sql_injection", "critical"), (r"""\.query\s*\(\s*['"].*\+\s*""", "sql_injection", "critical"), (r"\.raw\s*\(", "sql_injection", "high"),
    (r"\.exec(?:ute)?Sql\s*\(", "sql_injection", "high"), (r"""db\.run\s*\(\s*[`"'].*\$\{""", "sql_injection", "critical"),
    (r"""\bexec\s*\(\s*[`"'].*\$\{""", "command_injection", "critical"), (r"""\bexec\s*\(\s*['"].*\+\s*""", "command_injection", "critical"),
    (r"child_process.*\bexec\b", "command_injection", "high"), (r"""\bspawn\s*\(\s*[`"'].*\$\{""", "command_injection", "critical"), (r"\beval\s*\(", "command_injection", "critical"),
    (r"new\s+Function\s*\(", "command_injection", "critical"), (r"\.innerHTML\s*=", "xss", "critical"), (r"dangerouslySetInnerHTML", "xss", "critical"),
    (r"document\.write\s*\(", "xss", "critical"), (r"\.html\s*\(\s*[^)]", "xss", "medium"),
    (r"""fs\.(readFile|writeFile|unlink|rmdir|mkdir)\w*\s*\(\s*[`"'].*\$\{""", "path_traversal", "critical"),
    (r"fs\.(readFile|writeFile|unlink|rmdir|mkdir)\w*\s*\(\s*\w+[\s,]", "path_traversal", "medium"), (r"createWriteStream\s*\(", "path_traversal", "high"),
    (r"""fetch\s*\(\s*[`"'].*\$\{""", "ssrf", "high"), (r"""axios\.\w+\s*\(\s*[`"'].*\$\{""", "ssrf", "high"), (r"""http\.get\s*\(\s*[`"'].*\$\{""", "ssrf", "high"),
    (r"res\.redirect\s*\(\s*(?:req\.|params|query|body)", "open_redirect", "high"), (r"""window\.location\s*=\s*(?!['"]https?:\/\/)""", "open_redirect", "medium"),
    (r"""(?:password|passwd|pwd)\s*[:=]\s*["'][^"']{8,}["']""", "hardcoded_secret", "high"),
    (r"""(?:api[_-]?key|apiKey)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']""", "hardcoded_secret", "high"),
    (r"""(?:secret|token|auth[_-]?token)\s*[:=]\s*["'][A-Za-z0-9_\-/.+=]{16,}["']""", "hardcoded_secret", "high"),
    (r"""(?:AWS|AZURE|GCP|GITHUB)[_A-Z]*(?:KEY|SECRET|TOKEN)\s*[:=]\s*["'][^"']+["']""", "hardcoded_secret", "critical"),
    (r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "hardcoded_secret", "critical"), (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "hardcoded_secret", "high"),
    (r"console\.log\s*\(.*(?:password|secret|token|ssn|email|phone)", "pii_leak", "medium"), (r"logger\.\w+\s*\(.*(?:password|secret|token|ssn|email|phone)", "pii_leak", "medium"),
    (r"JSON\.parse\s*\(\s*(?:req\.|params|query|body|Buffer)", "insecure_deserialization", "medium"), (r"yaml\.load\s*\(", "insecure_deserialization", "high"),
    (r"pickle\.loads?\s*\(", "insecure_deserialization", "critical"), (r"Object\.assign\s*\(\s*\{\}\s*,\s*(?:req\.|params|query|body)", "prototype_pollution", "medium"),
    (r"\[(?:req|params|query|body)\.\w+\]", "prototype_pollution", "medium"), (r"new RegExp\s*\(\s*(?:req\.|params|query|body|user)", "unsafe_regex", "medium"),
    (r"cors\s*\(\s*\)", "missing_auth", "medium"), (r"helmet\s*\(\s*\{[^}]*contentSecurityPolicy\s*:\s*false", "missing_auth", "medium"),
]

# Entry points by name, signature and decorator.
ENTRIES = [
    ("http_handler", [r"(?i)handler$", r"(?i)controller$", r"(?i)route$"],
     [r"\(req\w*[:,]?\s*\w*,?\s*res\w*[:,]?\s*\w*", r"\(request[:,]?\s*\w*,?\s*response[:,]?\s*\w*", r"\(ctx[:,]?\s*\w*", r"app\.(get|post|put|delete|patch)\s*\(", r"router\.(get|post|put|delete|patch)\s*\("],
     [r"(?i)@(Get|Post|Put|Patch|Delete|Head|Options)\(", r"(?i)@app\.(get|post|put|patch|delete)\(", r"(?i)@router\.(get|post|put|patch|delete)\(", r"(?i)@RequestMapping"]),
    ("event_listener", [r"^on[A-Z]", r"^handle[A-Z]", r"Listener$"], [r"\.on\(", r"\.addEventListener\(", r"\.subscribe\("], [r"@EventHandler", r"@OnEvent", r"@Subscribe"]),
    ("cron_job", [r"(?i)cron", r"(?i)scheduler", r"(?i)job$", r"(?i)task$"], [], [r"@Cron\(", r"@Scheduled\(", r"@celery_app\.task"]),
    ("cli_command", [r"^command_", r"Command$", r"^cmd_"], [r"\.command\(", r"program\.command\("], [r"@click\.command", r"@app\.command"]),
    ("main_function", [r"^main$", r"^Main$", r"^__main__$"], [r"func\s+main\s*\("], []),
    ("test_function", [r"^test_", r"^Test", r"\.test\.", r"\.spec\."], [r"\b(describe|it|test)\s*\("], [r"@Test", r"@pytest\.mark"]),
    ("graphql_resolver", [r"Resolver$", r"^resolve[A-Z]"], [], [r"@Query\(", r"@Mutation\(", r"@Resolver"]),
    ("websocket_handler", [r"^ws_", r"WebSocket", r"Socket"], [r"""(?i)\.on\(\s*['"]message""", r"ws\.on\("], [r"@WebSocketGateway", r"@SubscribeMessage"]),
    ("queue_consumer", [r"(?i)consumer", r"(?i)worker", r"(?i)processor"], [r"\.process\(", r"\.consume\("], [r"@Process\(", r"@Consume"]),
]

# Test frameworks by path and name.
FRAMEWORKS = [
    ("jest", [r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$", r"__tests__\/"], [r"^(describe|it|test)\b"]), ("vitest", [r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$"], [r"^(describe|it|test)\b"]), ("mocha", [r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$"], [r"^(describe|it)\b"]),
    ("pytest", [r"test_\w+\.py$", r"\w+_test\.py$", r"tests?\/"], [r"^test_"]), ("unittest", [r"test_\w+\.py$", r"\w+_test\.py$"], [r"^test_", r"^Test"]),
    ("junit", [r"Test\.java$", r"Tests\.java$", r"\w+Test\.java$"], [r"^test", r"^should"]), ("go_test", [r"_test\.go$"], [r"^Test", r"^Benchmark"]),
    ("rspec", [r"_spec\.rb$", r"spec\/"], [r"^(describe|it|context)\b"]), ("phpunit", [r"Test\.php$", r"Tests\.php$"], [r"^test"]),
]

# Languages by extension and by file name.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".php": "php", ".rb": "ruby",
    ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
}
FILENAMES = {"Gemfile": "ruby", "Rakefile": "ruby", "Podfile": "ruby", "Makefile": "c", "CMakeLists.txt": "cpp"}


def any_of(column: Column, patterns: Sequence[str]) -> Column:
    """True where one of patterns is found in column."""
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike(p)
    return F.coalesce(out, F.lit(False))


def first_of(column: Column, rules: Sequence[tuple], value: int = 1) -> Column:
    """The value of the first rule whose pattern is found, null if none is."""
    out = F.when(F.lit(False), F.lit(rules[0][value]))
    for rule in rules:
        out = out.when(column.rlike(rule[0]), F.lit(rule[value]))
    return out


def added(rules: Sequence[tuple], *more: tuple) -> list[tuple]:
    """rules with a user's own behind them: (pattern, category) as in SOURCES, with a severity as in SINKS and LINES; patterns alone for SANITIZERS."""
    import re

    width = {len(r) if isinstance(r, tuple) else 0 for r in rules} | {len(r) if isinstance(r, tuple) else 0 for r in more}
    if len(width) > 1:
        raise ValueError("a rule needs as many parts as those it joins")
    for r in more:
        re.compile(r[0] if isinstance(r, tuple) else r)
    return [*rules, *more]


def language_or_text(path: Column) -> Column:
    """language(), "text" where that is unknown."""
    return F.coalesce(language(path), F.lit("text"))


def repository(url: Column) -> Column:
    """owner and name of the address of a repository, by https or ssh; null if it is none."""
    part = r"([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?$"
    hit = F.coalesce(*[F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).alias("owner"), F.regexp_extract(url, p, 2).alias("name"))) for p in (rf"^https://github\.com/{part}", rf"^git@github\.com:{part}")])
    return hit


def entry_type(name: Column, signature: Column, decorators: Column | None = None) -> Column:
    """The first entry-point type, in order of types and then of name, signature and decorators, that fits."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, names, signatures, marks in ENTRIES:
        hit = any_of(name, names) | any_of(signature, signatures)
        if decorators is not None:
            hit = hit | F.coalesce(F.exists(decorators, lambda d, marks=marks: any_of(d, marks)), F.lit(False))
        out = out.when(hit, F.lit(kind))
    return out


def test_framework(path: Column, name: Column, is_test: Column) -> Column:
    """The first framework whose path and name patterns both fit; for marked tests, else, one by the extension."""
    out = F.when(F.lit(False), F.lit(""))
    for framework, paths, names in FRAMEWORKS:
        out = out.when(any_of(path, paths) & any_of(name, names), F.lit(framework))
    for end, framework in ((r"\.py$", "pytest"), (r"\.java$", "junit"), (r"\.go$", "go_test"), (r"\.rb$", "rspec"), (r"\.php$", "phpunit"), (r"\.[tj]sx?$", "vitest")):
        out = out.when(is_test & path.rlike(end), F.lit(framework))
    return out


def language(path: Column) -> Column:
    """By extension in any case, then by file name; null if unknown."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    by_extension = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    by_name = F.create_map(*[F.lit(x) for kv in FILENAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(by_extension, extension), F.try_element_at(by_name, F.substring_index(path, "/", -1)))


# Fixed values, here and in orm(): words in names and contents, and what they tell.
def reference_kind(name: Column) -> Column:
    """How code that bears name uses a field."""
    n = F.lower(name)
    return (
        F.when(n.rlike("test|spec|fixture"), "fixture").when(n.contains("migrat"), "migration").when(n.rlike("create|update|insert|save|write|set"), "write")
        .when(n.rlike("find|query|where|select|search"), "query").otherwise("read")
    )


def orm(path: Column, content: Column) -> Column:
    return (
        F.when(path.endswith(".prisma"), "prisma").when(content.contains("@Entity") | content.contains("@Column"), "typeorm")
        .when(content.contains("Model.init") | content.contains("sequelize.define"), "sequelize").when(content.rlike("pgTable|sqliteTable|mysqlTable"), "drizzle")
        .when(content.contains("Column(") & content.contains("Base"), "sqlalchemy").when(content.contains("models.Model") | content.contains("models.CharField"), "django")
    )
