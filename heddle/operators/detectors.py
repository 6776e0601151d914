"""The detector catalogue as data: rules of a few relational shapes over the line relation.

lines: change_set, path, status, op (add, delete, normal), pos (order in the file), line, content (without its sign).
Each shape is one operator for all of its rules: line rules are tried in a single pass, frames share one window sort,
file rules one aggregation. Results have change_set, path, line, kind, severity; `findings` unites the shapes, keeps
the first of each (kind, path, line) and leaves out deleted files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import shingles

TESTS = r"(?i)(\.|/|_)(test|spec)s?(\.|/|_)|__tests__"
KEYS = ("change_set", "path")


@dataclass(frozen=True)
class Line:
    """A line that matches and does not match `unless`; of rules with one `group` the first that fits counts.

    alike: whether the pattern's first two groups must be equal (True) or different (False) but for case; None: either.
    Patterns use neither look-around nor back-references, so that any regular-expression engine can run them.
    """

    kind: str
    pattern: str
    severity: str = "warning"
    unless: str = ""
    op: str = "add"
    path: str = ""
    path_unless: str = ""
    group: str = ""
    alike: bool | None = None


@dataclass(frozen=True)
class Frame:
    """An added line that matches `start` where, in the next (before: previous) n added lines, `want` occurs (absent: does not)."""

    kind: str
    start: str
    want: str
    n: int
    severity: str = "warning"
    absent: bool = False
    before: bool = False
    unless: str = ""
    path_unless: str = ""
    want_unless: str = ""


@dataclass(frozen=True)
class Without:
    """First lines of a file that match `acquire` where no line of the file (wide: of the change set) matches `release`."""

    kind: str
    acquire: str
    release: str
    severity: str = "warning"
    rows: int = 100
    wide: bool = False
    path: str = ""


@dataclass(frozen=True)
class Both:
    """Files in which both patterns occur; `rows` first lines of the first."""

    kind: str
    first: str
    second: str
    severity: str = "info"
    rows: int = 2


@dataclass(frozen=True)
class Across:
    """A key (first group of the pattern) that occurs in so many files."""

    kind: str
    pattern: str
    files: int = 2
    severity: str = "info"


LINES = (
    Line("weak-assertion", r"\.(toBeTruthy|toBeDefined|toBeFalsy|toBeUndefined)\(\)|assert\(\w+\);?$", unless=r"\.not\."),
    Line("tautological-assertion", r"expect\((true|false|1|null)\)\.(?:toBe|toEqual)\((true|false|1|null)\)", "critical", group="tautology", alike=True),
    Line("tautological-assertion", r"assert(?:Equals|_eq!?)?\((\w+), ?(\w+)\)", "critical", group="tautology", alike=True),
    Line("type-assertion", r"[\w)\]] as (unknown\b|any\b|[A-Z][A-Za-z0-9_<>\[\]]*)", unless=r"^\s*(import|export)\b|\bas const\b"),
    Line("any-type", r":\s*any\b|<any>|\bany\[\]", unless=r"^\s*(//|\*|/\*)"),
    Line("ts-directive", r"@ts-nocheck", "critical", group="ts"),
    Line("ts-directive", r"@ts-ignore", group="ts"),
    Line("ts-directive", r"@ts-expect-error", "info", group="ts"),
    Line("lint-suppression", r"eslint-disable(-next-line)?(\s|$)", "info"),
    Line("todo", r"\bTODO\b", "info"),
    Line("fixme", r"\bFIXME\b"),
    Line("hack", r"\bHACK\b"),
    Line("xxx", r"\bXXX\b", "info"),
    Line("workaround", r"(?i)\bworkaround\b", "info"),
    Line("numeric-literal", r"(^|[^\w.#\"'])\d{2,}([^\w.]|$)", "info", unless=r"\b(19|20)\d\d\b|\d+\.\d+\.\d+|^\s*(//|\*|const\s+[A-Z_]+\s*=)|(^|[^\w.])(10|24|60|100|1000)([^\w.]|$)", path_unless=TESTS),
    Line("string-literal", r"[=!]==?\s*['\"][A-Za-z_]{3,}['\"]", "info", path_unless=TESTS),
    Line("timeout-duration", r"(?i)set(timeout|interval)\([^,]+,\s*\d{2,}|timeout\s*[:=]\s*\d{2,}", "info"),
    Line("missing-await", r"^\s*(fetch|axios\.\w+|\w+\.save|\w+\.findOne|\w+Async)\(", unless=r"\bawait\b|\breturn\b|\.then\(|\.catch\("),
    Line("unnecessary-await", r"\bawait\s+(\d+|['\"]|true\b|false\b|null\b|\[)", "info"),
    Line("sync-in-async", r"\b(readFile|writeFile|exists|exec|readdir|stat|mkdir)Sync\("),
    Line("missing-error-metadata", r"(?i)log(ger)?\.(error|warn)\(\s*('[^'\"`]*'|\"[^'\"`]*\"|`[^'\"`]*`)\s*\)", "info"),
    Line("unbounded-promise-all", r"Promise\.all\(\s*\w+\.map\(|Promise\.all\(\[(?:[^,\]]*,){4,}"),
    Line("unit-mismatch", r"(?i)\b\w+(ms|millis)\b\s*[-+<>]=?\s*\w+(sec|seconds|minutes)\b|\b\w+cents\b\s*[-+<>]=?\s*\w+(dollars|usd)\b|\b\w+bytes\b\s*[-+<>]=?\s*\w+(kb|mb|gb)\b", "critical"),
    Line("id-confusion", r"\b(\w+)Id\s*===?\s*(\w+)Id\b", group="ids", alike=False),
    Line("id-confusion", r"\bget([A-Z]\w*)\((\w+)Id\)", group="ids", alike=False),
    Line("timestamp-duration-swap", r"(?i)settimeout\([^,]+,\s*\w*(timestamp|date\.now\(\))|new Date\(\w*(duration|timeout|ttl)\w*\)"),
    Line("string-subtype-confusion", r"(?i)\b(email|phone|url|path)\w*\s*=\s*(email|phone|url|path)\w*\b", alike=False),
    Line("unprotected-pii-in-response", r"(?i)res(ponse)?\.(json|send)\(.*(ssn|credit_?card|account_?number|iban)", "critical", unless=r"(?i)mask|redact|sanitize|omit", group="pii"),
    Line("unprotected-pii-in-response", r"(?i)res(ponse)?\.(json|send)\(.*(email|phone|birth|address)", unless=r"(?i)mask|redact|sanitize|omit", group="pii"),
    Line("sensitive-data-in-log", r"(?i)(log(ger)?|console)\.\w+\(.*(password|secret|token|ssn|credit_?card|api_?key)", "critical", unless=r"(?i)mask|redact|sanitize"),
    Line("trust-boundary-skip", r"(?i)(fetch|axios|http)\w*[.(].*\b(db|repo|model|prisma)\.\w+|(fetch|axios)\w*\(.*\.\.\.\w+"),
    Line("client-side-leak", r"(?i)(local|session)storage\.setitem\(.*(token|secret|password|key)", "critical"),
    Line("deep-access-without-guard", r"\b(user|data|result|response|config|props|params|query)\.\w+\.\w+", "info", unless=r"\?\.|&&|\bif\b"),
    Line("array-index-without-check", r"\b(items|results|rows|list|data|users)\[\w+\]\.\w+", "info", unless=r"\.length|\?\."),
    Line("optional-chain-coverage-gap", r"\w\?\.\w+\.\w+", "info"),
    Line("assertive-access-on-optional", r"\w!\.\w+", unless=r"[!=]==? ?(null|undefined)"),
    Line("hallucinated-import", r"from ['\"](react/hooks|fs/async|express/middleware|lodash/async|node:utils)['\"]"),
    Line("sycophantic-stub", r"\{\s*return\s+(true|false|null|\[\]|\{\}|''|0);?\s*\}", group="stub"),
    Line("sycophantic-stub", r"function\s+\w+\((\w+)[^)]*\)\s*\{\s*return\s+(\w+);?\s*\}", group="stub", alike=True),
    Line("confident-wrong-api", r"(?i)\bset\w*\.includes\(|\barr\w*\.has\(|\barr\w*\.size\b|\bmap\w*\.length\b"),
    Line("hardcoded-url", r"['\"`]https?://", "info", unless=r"^\s*(export )?const [A-Z_]+|^\s*(//|\*)|://(localhost|127\.|example\.)", path_unless=TESTS),
    Line("hardcoded-port", r"(?i)(listen\(|port\s*[:=]\s*)\d{2,5}\b", "info", unless=r"(?i)(listen\(|port\s*[:=]\s*)(80|443|22)\b"),
    Line("hardcoded-limit", r"(?i)(limit|max\w*|threshold)\s*[:=]\s*\d{2,}", "info"),
    Line("hardcoded-toggle", r"(?i)(enable|disable|is|use|feature)\w*\s*[:=]\s*(true|false)\b", "info"),
    Line("debugger-statement", r"^\s*debugger;?\s*$", "critical"),
    Line("console-debug", r"console\.(log|debug|info)\(", "info", path_unless=TESTS),
    Line("test-isolation-break", r"\b(it|test|describe)\.only\(|\bf(it|describe)\(", "critical", group="isolation"),
    Line("test-isolation-break", r"\b(it|test|describe)\.skip\(|\bx(it|describe)\(", group="isolation"),
    Line("debug-flag-true", r"(?i)\b(debug|verbose|trace)\w*\s*[:=]\s*true\b"),
    Line("callback-promise-mix", r"\.then\(.*,\s*(callback|cb|done)\)|await\s+\w+\(.*,\s*(callback|cb)\)"),
    Line("deprecated-callback-api", r"\bfs\.(exists|readFile|writeFile|readdir)\([^)]*(function|=>)", "info"),
    Line("slopsquatting-signal", r"(?i)from ['\"](\w+-(helper|utils?)-(pro|plus|ai)|\w+(js|py){2,}|easy-\w+-\w+|super-\w+-\w+)['\"]"),
    Line("version-mismatch", r"\.v\d+\.\w+\(", "info"),
    Line("self-assertion", r"expect\((\w+(?:\.\w+)*)\)\.to(?:Be|Equal)\((\w+(?:\.\w+)*)\)", "critical", alike=True),
    Line("private-helper-in-test", r"import .*\b_\w+.* from|\.(_\w+)\(", "info", path=TESTS),
    Line("non-existent-method", r"\.(push_back|append_to|len\(\)|strip\(\)|isEmpty\(\)|contains_key|toLower\(\))"),
    Line("fantasy-optional-chain", r"(\d|['\"]|true|false)\?\.\w+", "info"),
    Line("unimplemented-spec", r"(?i)not implemented|throw new Error\(['\"]TODO|pass\s*# ?todo"),
    Line("contract-erosion", r":\s*any\b.*[,)]|\w+!\(|catch\s*(\(\w*\))?\s*\{\s*\}", "info"),
    Line("docker-insecurity", r"^\s*(FROM \S+:latest|USER root|ADD https?://|RUN .*chmod 777|RUN curl .*\| ?(ba)?sh)", "critical", path=r"(?i)dockerfile"),
    Line("tf-insecurity", r"0\.0\.0\.0/0|acl\s*=\s*\"public|encrypted\s*=\s*false|publicly_accessible\s*=\s*true", "critical", path=r"\.tf$"),
    Line("cicd-insecurity", r"pull_request_target|permissions:\s*write-all|uses:\s*\S+@(master|main)\b|\$\{\{\s*github\.event\.\w+\.(title|body)", "critical", path=r"\.github/workflows/"),
    Line("cloudformation-insecurity", r"(?i)CidrIp:\s*0\.0\.0\.0/0|PublicAccess\w*:\s*false|Encrypted:\s*false", "critical", path=r"(?i)(cloudformation|template)\S*\.(ya?ml|json)$"),
    Line("dead-validation", r"if\s*\((true|false)\)|\|\|\s*true\b|&&\s*false\b"),
    Line("sanitizer-sink-mismatch", r"(?i)escapehtml\(.*(query|sql)|encodeuri\w*\(.*innerhtml|escapesql\(.*(html|render)"),
    Line("crypto-voided-parameters", r"(?i)createcipheriv\(['\"][^'\"]+-ecb|iterations\s*[:=]\s*\d{1,3}\b|iv\s*[:=]\s*(buffer\.alloc\(16\)|['\"]0+['\"])", "critical"),
    Line("auth-decorator-stripped", r"@(UseGuards|Auth\w*|Roles|PreAuthorize|login_required)", "critical", op="delete"),
    Line("validation-guard-stripped", r"(?i)\b(validate\w*|assert\w*|sanitize\w*)\(|if\s*\(!", op="delete"),
    Line("removed-export", r"^\s*export\s+(default\s+)?(async\s+)?(function|class|const|interface|type|enum)\s+\w+", "critical", op="delete"),
    Line("deleted-public-method", r"^\s*public\s+[\w<>\[\]]+\s*\w*\(", "critical", op="delete"),
    Line("custom-crypto", r"(?i)function\s+\w*(encrypt|decrypt|hash|cipher)\w*\(|\bxor\w*\(.*key", unless=r"(?i)crypto\.|bcrypt|argon2|libsodium"),
    Line("overengineered-encryption", r"(?i)encrypt\(.*encrypt\(|base64\(.*base64\(", "info"),
    Line("training-era-drift", r"componentWillMount|new Buffer\(|request\(['\"]http|moment\(\)|\.substr\(", "info"),
    Line("over-permissive-iam", r"\"(Action|Resource|Principal)\"\s*:\s*\[?\s*\"\*\"", "critical", group="iam"),
    Line("over-permissive-iam", r"\"\w+:\*\"", group="iam"),
    Line("missing-auth-middleware", r"\b(app|router)\.(post|put|patch|delete)\(['\"]", "critical", unless=r"(?i)auth|guard|protect|login|verify", group="route"),
    Line("missing-auth-middleware", r"\b(app|router)\.get\(['\"]", unless=r"(?i)auth|guard|protect|login|verify|public|health", group="route"),
    Line("absent-audit-logging", r"(?i)\b(deleteuser|changepassword|resetpassword|grantrole|revoke\w+)\(", unless=r"(?i)log|audit"),
    Line("hidden-unicode-control", "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]", "critical"),
    Line("malicious-mcp-redirect", r"(?i)https?://\S*(ngrok|webhook\.site|requestbin|pastebin|\d+\.\d+\.\d+\.\d+)", "critical"),
    Line("safety-hook-disabling", r"(?i)--no-verify|skip_?hooks\s*[:=]\s*true|husky.*(skip|disable)", "critical"),
    Line("agent-permission-expansion", r"(?i)allow(ed)?_?tools\s*[:=]\s*\[?['\"]?\*|dangerously\w+|bypass_?permissions", "critical"),
    Line("excessive-autonomy", r"(?i)auto_?(approve|merge|deploy|execute)\s*[:=]\s*true|max_?iterations\s*[:=]\s*(\d{3,}|infinity)"),
    Line("unrestricted-tool-parameter", r"(?i)(command|path|url|query)\s*:\s*(z\.string\(\)|\{\s*type:\s*['\"]string['\"]\s*\})", unless=r"\.(regex|enum|refine|max)\("),
    Line("dangerous-sink-from-llm-output", r"(?i)(eval|exec\w*|innerhtml\s*=|query)\(?.*\b(completion|llm\w*|response\.text|generated\w*)", "critical", unless=r"(?i)sanitize|validate|escape"),
    Line("pr-content-to-exec", r"(?i)(exec\w*|spawn|system)\(.*\b(pr|pull_?request|issue|comment)\.(title|body)", "critical"),
    Line("unvalidated-redirect", r"(?i)redirect\(\s*(req\.|params|query|\w*url\b)", unless=r"(?i)allow|valid|safe|startswith"),
    Line("rule-softening", r"['\"][\w/-]+['\"]\s*:\s*(['\"]off['\"]|0\b)", path=r"(?i)(eslint|tslint|biome|stylelint)", group="config"),
    Line("threshold-manipulation", r"(?i)(branches|functions|lines|statements|threshold)['\"]?\s*:\s*\d{1,2}\b", path=r"(?i)(jest|vitest|nyc|coverage|sonar)", group="config"),
    Line("exclude-expansion", r"(?i)(exclude|ignore\w*)['\"]?\s*[:=]", "info", path=r"(?i)(config|rc|ignore)", group="config"),
    Line("require-await", r"\.then\(", "info", unless=r"\.catch\(|await|return"),
    Line("ungated-write", r"^\s*(validate|authorize|checkAuth|verify)\w*\([^)]*\);?\s*$"),
)

FRAMES = (
    Frame("unreachable-code", r"^\s*(return\b.*;|throw\b.*;|break;|continue;)\s*$", r"^\s*\S", 1, unless=r"^\s*(if|for|while)\b", want_unless=r"^\s*(\}|//|case\b|default:|else\b)"),
    Frame("empty-catch", r"catch\s*(\(\w*\))?\s*\{\s*$", r"^\s*\}", 1, "critical"),
    Frame("unhandled-promise", r"\.then\(", r"\.catch\(|\btry\b", 2, absent=True, unless=r"\.catch\(|\bawait\b|\breturn\b"),
    Frame("n-plus-1-query", r"\b(for|while)\s*\(|\.forEach\(|\.map\(", r"(?i)\b(find(One|Many|By\w+)?|query|execute|fetch|select)\(", 10, "critical"),
    Frame("waterfall-await", r"^\s*(const|let)\s+\w+\s*=\s*await\b", r"^\s*(const|let)\s+\w+\s*=\s*await\b", 1, "info"),
    Frame("swallowed-error", r"catch\s*\(\w+\)\s*\{", r"\b(throw|return|log|report|reject|next)\b", 5, absent=True),
    Frame("missing-finally-cleanup", r"^\s*try\s*\{", r"\bfinally\b", 19, "info", absent=True),
    Frame("react-missing-cleanup", r"useEffect\(", r"return\s*\(?\)?\s*(=>|function|\()", 14, absent=True),
    Frame("silent-catch", r"catch\s*(\(\w*\))?\s*\{", r"(?i)\b(logger|log\.error|metrics|trace|throw|reject)\b", 14, absent=True),
    Frame("throw-without-log", r"throw new \w+", r"(?i)\b(log|logger|metric)\w*\.", 5, "info", absent=True, before=True),
    Frame("unlogged-route", r"\b(app|router)\.(get|post|put|patch|delete)\(", r"(?i)\b(log|logger|metric|trace)\w*[.(]", 19, "info", absent=True),
    Frame("toctou", r"\b(existsSync|exists|access|stat)\w*\(", r"\b(readFile|writeFile|unlink|open|mkdir|rm)\w*\(", 7),
    Frame("race-on-flag", r"if\s*\(!?\s*(this\.)?is[A-Z]\w*\)", r"\bawait\b", 9),
    Frame("missing-initial-state", r"createMachine\(", r"\binitial\s*:", 19, absent=True),
    Frame("missing-error-state", r"createMachine\(", r"(?i)\b(error|failed|failure)\b", 29, "info", absent=True),
    Frame("promise-callback-wrap", r"new Promise\(", r"\b(readFile|writeFile|exec|request)\(.*(=>|function)", 20, "info"),
    Frame("unhandled-callback-error", r"\((err|error),\s*\w+\)\s*(=>|\{)", r"if\s*\((err|error)\)|throw (err|error)|(err|error) (&&|\?)", 9, absent=True),
    Frame("loop-var-closure", r"for\s*\(\s*var\b", r"(=>|function\s*\()", 19),
    Frame("stale-event-handler", r"addEventListener\(|\.on\(", r"\b(let|var)\s+\w+", 5, "info", before=True),
    Frame("settimeout-stale-capture", r"set(Timeout|Interval)\(", r"\b(let|var)\s+\w+", 7, "info", before=True),
    Frame("async-closure-race", r"\blet\s+\w+\s*=\s*await\b", r"^\s*\w+\s*=[^=]", 14),
    Frame("secret-context", r"(?i)\b(password|secret|api_?key)\s*[:=]\s*['\"][^'\"]{6,}['\"]", r"(?i)\b(env|vault|example|dummy)\b", 3, "critical", absent=True, before=True, path_unless=TESTS),
)

RELEASES = (
    Without("unclosed-resource", r"\b(fs\.open|createReadStream|createWriteStream|openSync|open)\(", r"\.(close|end|destroy)\(|\busing\b|\bwith\b"),
    Without("unreleased-connection", r"(?i)\.(connect|getConnection|acquire)\(", r"(?i)\.(disconnect|release|end|close)\("),
    Without("unsubscribed-listener", r"addEventListener\(|\.subscribe\(|\.on\(['\"]", r"removeEventListener\(|\.unsubscribe\(|\.off\(|removeListener\("),
    Without("auth-without-authz", r"(?i)\b(authenticate|verifyToken|login)\w*\(", r"(?i)\b(authorize|hasRole|hasPermission|canAccess|checkPermission)\w*", rows=2, wide=True),
    Without("encrypt-without-kdf", r"(?i)createCipher\w*\(|\.encrypt\(", r"(?i)pbkdf2|scrypt|argon2|hkdf|bcrypt", rows=2, wide=True),
    Without("validate-without-sanitize", r"(?i)\bvalidate\w*\(", r"(?i)sanitize|escape|dompurify", rows=1),
    Without("rate-count-without-enforce", r"(?i)\b(requestCount|rateCount|attempts)\b.*\+\+|\+= 1", r"(?i)\b(429|tooManyRequests|rateLimit\w*|throttle)\b", rows=1),
    Without("decorative-security-import", r"(?i)import .*\b(helmet|cors|csurf|rateLimit)\b", r"(?i)\.use\(|helmet\(|cors\(|csurf\(|rateLimit\(", rows=1),
    Without("zero-assertion-file", r"\b(it|test|describe)\(", r"\bexpect\b|\bassert\w*\b", "critical", rows=1, path=TESTS),
    Without("happy-path-only", r"\b(it|test)\(", r"(?i)\b(throw|reject|error|fail|invalid)\w*", "info", rows=1, path=TESTS),
    Without("unprotected-route", r"\b(app|router)\.(get|post|put|patch|delete)\(['\"]", r"(?i)\b(auth|guard|protect|requireUser|passport|jwt)\w*"),
    Without("docker-no-user", r"^\s*FROM\s", r"^\s*USER\s", rows=1, path=r"(?i)dockerfile"),
    Without("docker-no-healthcheck", r"^\s*FROM\s", r"^\s*HEALTHCHECK\s", "info", rows=1, path=r"(?i)dockerfile"),
    Without("workflow-no-permissions", r"^\s*on:", r"^\s*permissions:", rows=1, path=r"\.github/workflows/"),
)

MIXES = (
    Both("react-class-and-hooks", r"\buse(State|Effect|Memo|Ref)\(", r"extends (React\.)?(Pure)?Component"),
    Both("callback-and-async-await", r"\b(callback|cb)\(", r"\basync\b|\bawait\b"),
    Both("oop-and-functional-mix", r"^\s*(export )?class \w+", r"\b(pipe|compose|curry)\("),
    Both("framework-clash", r"from ['\"](react|react-dom)['\"]", r"from ['\"](vue|@angular/core|svelte)['\"]", "warning"),
    Both("orm-clash", r"from ['\"](typeorm|sequelize)['\"]", r"from ['\"](@prisma/client|drizzle-orm|mongoose)['\"]", "warning"),
)

ACROSS = (
    Across("divergent-utility", r"(?:function|const)\s+((?:format|parse|validate|convert|to)[A-Z]\w*)"),
    Across("import-divergence", r"import\s+\{\s*(\w+)\s*\}\s+from"),
    Across("boilerplate-proliferation", r"(try\s*\{\s*const\s+\w+\s*=\s*await\s+fetch\(|process\.on\(['\"]\w+['\"])", 3),
)


def _fits(c: Column, pattern: str, unless: str = "") -> Column:
    return c.rlike(pattern) & ~c.rlike(unless) if unless else c.rlike(pattern)


def _mark(kind: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))


def _out(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "line", F.explode(F.array_compact("hits")).alias("x")).select(*KEYS, "line", "x.*")


def line_rules(lines: DataFrame, rules: tuple[Line, ...] = LINES) -> DataFrame:
    """All line rules in one pass over added and deleted lines."""
    content, path = F.col("content"), F.col("path")

    def test(r: Line) -> Column:
        c = (F.col("op") == r.op) & _fits(content, r.pattern, r.unless)
        if r.alike is not None:
            same = F.lower(F.regexp_extract(content, r.pattern, 1)) == F.lower(F.regexp_extract(content, r.pattern, 2))
            c = c & (same if r.alike else ~same)
        c = c & path.rlike(r.path) if r.path else c
        return c & ~path.rlike(r.path_unless) if r.path_unless else c

    hits: list[Column] = []
    groups: dict[str, Column] = {}
    for r in rules:
        if not r.group:
            hits.append(F.when(test(r), _mark(r.kind, r.severity)))
        else:
            groups[r.group] = groups[r.group].when(test(r), _mark(r.kind, r.severity)) if r.group in groups else F.when(test(r), _mark(r.kind, r.severity))
    return _out(lines.where("op != 'normal'").withColumn("hits", F.array(*hits, *groups.values())))


def frame_rules(lines: DataFrame, rules: tuple[Frame, ...] = FRAMES) -> DataFrame:
    """All look-ahead and look-behind rules over added lines with one sort."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    c = F.col("content")
    cols = {f"__hd_{i}": F.max(_fits(c, r.want, r.want_unless).cast("int")).over(w.rowsBetween(-r.n, -1) if r.before else w.rowsBetween(1, r.n)) for i, r in enumerate(rules)}
    seen = lines.where("op = 'add'").withColumns(cols)

    def test(i: int, r: Frame) -> Column:
        there = F.coalesce(F.col(f"__hd_{i}"), F.lit(0)) == 1
        ok = _fits(c, r.start, r.unless) & (~there if r.absent else there)
        return ok & ~F.col("path").rlike(r.path_unless) if r.path_unless else ok

    return _out(seen.withColumn("hits", F.array(*[F.when(test(i, r), _mark(r.kind, r.severity)) for i, r in enumerate(rules)])))


def _first_rows(hits: DataFrame, limits: dict[str, int]) -> DataFrame:
    w = Window.partitionBy(*KEYS, "kind").orderBy("pos")
    n = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind"))
    return hits.withColumn("__hd_n", F.row_number().over(w)).where(F.col("__hd_n") <= n).select(*KEYS, "line", "kind", "severity")


def release_rules(lines: DataFrame, rules: tuple[Without, ...] = RELEASES) -> DataFrame:
    """Acquiring lines joined with per-file (and per-change-set) flags of releasing ones; flags are one aggregation."""
    c, added = F.col("content"), lines.where("op = 'add'")
    flags = [F.coalesce(F.bool_or(c.rlike(r.release)), F.lit(False)).alias(f"f{i}") for i, r in enumerate(rules)]
    per_file = lines.where("op != 'delete'").groupBy(*KEYS).agg(*flags)
    per_set = per_file.groupBy("change_set").agg(*[F.bool_or(f"f{i}").alias(f"s{i}") for i in range(len(rules))])
    hit = [F.when(_fits(c, r.acquire) & (F.col("path").rlike(r.path) if r.path else F.lit(True)), F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"))) for i, r in enumerate(rules)]
    got = added.select(*KEYS, "pos", "line", F.explode(F.array_compact(F.array(*hit))).alias("x"))
    released = F.get(F.array(*[F.col(f"s{i}" if r.wide else f"f{i}") for i, r in enumerate(rules)]), F.col("x.i"))
    open_ = got.join(per_file, list(KEYS)).join(per_set, "change_set").where(~released).select(*KEYS, "pos", "line", "x.kind", "x.severity")
    return _first_rows(open_, {r.kind: r.rows for r in rules})


def mix_rules(lines: DataFrame, rules: tuple[Both, ...] = MIXES) -> DataFrame:
    c, added = F.col("content"), lines.where("op = 'add'")
    flags = added.groupBy(*KEYS).agg(*[F.bool_or(c.rlike(r.second)).alias(f"f{i}") for i, r in enumerate(rules)])
    hit = F.array(*[F.when(c.rlike(r.first) & F.col(f"f{i}"), _mark(r.kind, r.severity)) for i, r in enumerate(rules)])
    got = added.join(flags, list(KEYS)).select(*KEYS, "pos", "line", F.explode(F.array_compact(hit)).alias("x")).select(*KEYS, "pos", "line", "x.*")
    return _first_rows(got, {r.kind: r.rows for r in rules})


def across_rules(lines: DataFrame, rules: tuple[Across, ...] = ACROSS, copies: bool = True) -> DataFrame:
    """Keys in several files of a change set, at their first place; copied shingles among them if `copies` is set."""
    c, added = F.col("content"), lines.where("op = 'add'")
    keys = [F.when(c.rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.files).alias("least"), F.lower(F.regexp_extract(c, r.pattern, 1)).alias("key"))) for r in rules]
    named = added.select("change_set", "path", "pos", "line", F.explode(F.array_compact(F.array(*keys))).alias("x")).select("change_set", "path", "pos", "line", "x.*")
    copied = added.select("change_set", "path", "pos", "line", F.explode(shingles(c)).alias("key")).select("change_set", "path", "pos", "line", F.lit("copy-paste-pattern").alias("kind"), F.lit("info").alias("severity"), F.lit(3).alias("least"), "key")
    every = named.unionByName(copied) if copies else named
    per = every.groupBy("change_set", "kind", "severity", "least", "key", "path").agg(F.min(F.struct("pos", "line")).alias("at"))
    wide = per.groupBy("change_set", "kind", "severity", "least", "key").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("path", "at")).alias("x")).where("files >= least")
    return wide.select("change_set", F.col("x.path").alias("path"), F.col("x.at.line").alias("line"), "kind", "severity").distinct()


REPLACED = {
    "parameterization-loss": (r"\?\s*['\"]?\s*,\s*\[|\$\d|:\w+\b.*\bexecute", r"(?i)(select|insert|update|delete)\b.*(\+\s*\w|\$\{)"),
    "error-handling-weakened": (r"catch\s*\(\w+\s*(instanceof|:)\s*\w+", r"catch\s*(\(\w*\))?\s*\{"),
    "return-type-narrowing": (r"\)\s*:\s*\w+\s*\|\s*(null|undefined)", r"\)\s*:\s*\w+\s*\{"),
}


def replaced_rules(lines: DataFrame, pairs: dict[str, tuple[str, str]] = REPLACED) -> DataFrame:
    """Removed safe code with an unsafe addition in the same file: first added line of each."""
    c = F.col("content")
    gone = lines.groupBy(*KEYS).agg(*[F.bool_or((F.col("op") == "delete") & c.rlike(a)).alias(f"f{i}") for i, (a, _) in enumerate(pairs.values())])
    hit = F.array(*[F.when(c.rlike(b) & F.col(f"f{i}"), _mark(k, "critical")) for i, (k, (_, b)) in enumerate(pairs.items())])
    got = lines.where("op = 'add'").join(gone, list(KEYS)).select(*KEYS, "pos", "line", F.explode(F.array_compact(hit)).alias("x")).select(*KEYS, "pos", "line", "x.*")
    return _first_rows(got, dict.fromkeys(pairs, 1))


def file_rules(lines: DataFrame) -> DataFrame:
    """Path predicates and whole-file counts."""
    c, add = F.col("content"), F.col("op") == "add"
    typed = F.count_if(add & c.rlike(r":\s*\w+|expect\(|assert"))
    per = lines.groupBy(*KEYS).agg(F.min("status").alias("status"), F.count_if(add).alias("plus"), F.count_if(F.col("op") == "delete").alias("minus"), typed.alias("typed"), F.min("line").alias("line"))
    p = F.col("path")
    fresh = F.col("status") == "added"
    rules = {
        "sensitive-file-added": ("critical", F.col("status").isin("added", "modified") & p.rlike(r"(^|/)(\.env(\.\w+)?|id_rsa|.*\.(pem|p12|key|keystore))$")),
        "build-artifact-added": ("warning", fresh & p.rlike(r"(^|/)(dist|build|out|target|node_modules)/|\.(class|pyc|o|exe|dll)$")),
        "os-ide-artifact-added": ("info", fresh & p.rlike(r"(^|/)(\.DS_Store|Thumbs\.db|\.idea/|\.vscode/)")),
        "sweep-no-safety": ("warning", (F.col("plus") > 20) & (F.col("minus") / (F.col("plus") + F.col("minus")) > 0.6) & (F.col("typed") / F.col("plus") < 0.1)),
        "large-new-file": ("info", fresh & (F.col("plus") > 100) & (F.col("typed") == 0) & ~p.rlike(TESTS)),
    }
    hits = F.array(*[F.when(test, _mark(k, s)) for k, (s, test) in rules.items()])
    return _out(per.withColumn("hits", hits))


def change_set_rules(lines: DataFrame) -> DataFrame:
    """Manifests without lockfiles, lockfiles without manifests, governance files changed along with sources."""
    manifest, lock = r"(^|/)(package\.json|pyproject\.toml|Cargo\.toml|go\.mod)$", r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum)$"
    governance, source = r"(^|/)(\.github/workflows/|CODEOWNERS$|\.mcp\.json$)", r"\.(ts|js|py|go|rs|java)$"
    p = F.col("path")
    first = lambda rx: F.min(F.when(p.rlike(rx), p))
    a = lines.groupBy("change_set").agg(first(manifest).alias("m"), first(lock).alias("l"), first(governance).alias("g"), first(source).alias("s"))
    hit = lambda test, path, kind, sev: F.when(test, F.struct(F.col(path).alias("path"), F.lit(kind).alias("kind"), F.lit(sev).alias("severity")))
    hits = F.array(
        hit(F.col("m").isNotNull() & F.col("l").isNull(), "m", "missing-lockfile-update", "warning"),
        hit(F.col("l").isNotNull() & F.col("m").isNull(), "l", "orphan-lockfile-change", "warning"),
        hit(F.col("g").isNotNull() & F.col("s").isNotNull(), "g", "governance-config-modification", "critical"),
    )
    return a.select("change_set", F.explode(F.array_compact(hits)).alias("x")).select("change_set", "x.path", F.lit(1).cast("bigint").alias("line"), "x.kind", "x.severity")


def unused_variables(lines: DataFrame) -> DataFrame:
    """Declared names of added lines that no other added line of the file mentions: an anti-join on words."""
    a = lines.where("op = 'add'")
    name = F.regexp_extract("content", r"^\s*(?:const|let|var)\s+([A-Za-z]\w+)\s*=", 1)
    d = a.where(~F.col("content").rlike(r"\bexport\b|\{.*\}")).select(*KEYS, "pos", "line", name.alias("name")).where("name != ''")
    used = a.select(*KEYS, F.col("pos").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return d.join(used, (F.col("pos") != F.col("at")) & (d["name"] == used["name"]) & (d["path"] == used["path"]) & (d["change_set"] == used["change_set"]), "left_anti").select(*KEYS, "line", F.lit("unused-variable").alias("kind"), F.lit("warning").alias("severity"))


SOURCES = r"\b(?:const|let|var)?\s*(\w+)\s*=\s*.*\b(?:req\.(?:body|query|params)|process\.argv|location\.(?:hash|search)|prompt\()"
SINK = r"\b(eval|exec|execSync|innerHTML|query|spawn|system|writeFile)\b"


ASSIGNED = r"^\s*(?:const|let|var)?\s*(\w+)\s*=[^=](.*)$"


def taint(lines: DataFrame, aliases: int = 3) -> DataFrame:
    """Variables assigned from a source, and in line order from such variables, that a sink line mentions: of the same
    file later (critical) or of another file of the change set (warning). Chains of up to `aliases` assignments are followed."""
    a = lines.where("op = 'add'")
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))))
    src = a.select("change_set", F.col("path").alias("sp"), F.col("pos").alias("spos"), F.regexp_extract("content", SOURCES, 1).alias("v")).where("v != ''").distinct()
    given = a.where(F.col("content").rlike(ASSIGNED)).select("change_set", F.col("path").alias("sp"), "pos", F.regexp_extract("content", ASSIGNED, 1).alias("to"), words(F.regexp_extract("content", ASSIGNED, 2)).alias("v"))
    last = src
    for _ in range(aliases):
        last = given.join(last, ["change_set", "sp", "v"]).where("pos > spos").select("change_set", "sp", F.col("pos").alias("spos"), F.col("to").alias("v")).distinct()
        src = src.unionByName(last)
    snk = a.where(F.col("content").rlike(SINK)).select("change_set", "path", "pos", "line", words(F.col("content")).alias("v"))
    j = src.join(snk, ["change_set", "v"]).where((F.col("sp") != F.col("path")) | (F.col("pos") >= F.col("spos")))
    return j.groupBy(*KEYS, "line").agg(F.max(F.col("sp") == F.col("path")).alias("own")).select(*KEYS, "line", F.lit("taint-trace").alias("kind"), F.when(F.col("own"), "critical").otherwise("warning").alias("severity"))


def findings(lines: DataFrame) -> DataFrame:
    """All shapes together, distinct by (kind, path, line), gravest first when ordered by `rank`."""
    live = lines.where("status != 'deleted'")
    parts = [line_rules(live), frame_rules(live), release_rules(live), mix_rules(live), across_rules(live), replaced_rules(live), file_rules(live), change_set_rules(lines), unused_variables(live), taint(live)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.array_position(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.col("severity"))
    return every.groupBy(*KEYS, "line", "kind").agg(F.min_by("severity", rank).alias("severity")).withColumn("rank", F.array_position(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.col("severity")))
