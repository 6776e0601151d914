"""Queries of the detector catalogue over a line relation made from every order, with their DuckDB statements.

An order is a file, four neighbouring orders are a change set, and a file's lines run through SNIPPETS from a place that
its key gives. The statements are written from the same rule tables, whose patterns both engines can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import contracts as ct
from heddle.operators import detectors as dt
from heddle.operators import graph
from heddle.plans import views as v

LINES_A_FILE = 8
PATHS = (
    "src/mod{n}.ts", "lib/part{n}.js", "src/mod{t}.test.ts", "svc{n}/Dockerfile", "infra/net{n}.tf", ".github/workflows/job{n}.yml", "cloudformation/stack{n}.yaml", "eslint.config{n}.json", "jest.config{n}.js",
    "conf{n}/.env", "dist/app{n}.js", ".vscode/s{n}.json", "pkg{n}/package.json", "pkg{n}/package-lock.json", "src/auth{n}.ts", "py/tool{n}.py", "docs/read{n}.md",
)
SNIPPETS = tuple(
    r"""import { helper{k} } from './m{k}'
import _ from 'easy-json-kit'
import { useState } from 'react/hooks'
import react from 'react'
import vue from 'vue'
import typeorm from 'typeorm'
import prisma from '@prisma/client'
import helmet from 'helmet'
export function load{k}(id: any) {
const user = await db.findOne({k})
const orders = await db.find(user.profile.name)
for (const row of rows) {
  const item = await repo.findBy(row)
}
try {
  const body = await fetch('https://api{k}.shop.net/v1')
} catch (e) {
}
// TODO tidy part {k}
// FIXME off by one
// HACK around the cache
// XXX unsure; a workaround
expect(true).toBe(true)
expect(a.b).toBe(a.b)
expect(result).toBeTruthy()
assertEquals(total, total)
assertEquals(total, other)
it('adds {k}', () => { add({k}) })
describe.only('slow', () => {})
it.skip('flaky', () => {})
import { x } from './_private'; helper._hidden{k}()
const typed = value as Order{k}
let loose: any = {}
// @ts-ignore
// @ts-expect-error
// eslint-disable-next-line
const rate = 37 * base
const limit = {k}5
if (status === 'pending') {
setTimeout(run, 5000)
const timeoutMs = 3{k}
fetchAsync(url{k})
const one = await 1
const data{k} = readFileSync(name)
logger.error('failed')
logger.error('failed', { id })
Promise.all(ids.map(load))
if (delayMs > maxSeconds) {
if (userId === orderId) {
if (userId === UserId) {
getUser(orderId)
getUser(userId)
setTimeout(run, startTimestamp)
const email = phoneNumber
const email2 = emailAddress
res.json({ email: u.email })
res.json({ ssn: u.ssn })
res.json(mask({ email: u.email }))
console.log(password)
console.log('step {k}')
fetch(target, { body: db.users })
localStorage.setItem('token', t)
const city = user.address.city
const first = items[i].name
const deep = a?.b.c
const sure = maybe!.value
function same(x) { return x }
function stub() { return null; }
setOfIds.includes(3)
app.listen(80{k})
const port = 443
const enableCache = true
const DEBUG = true
debugger
load().then(ok, callback)
fs.exists(name, function () {
  use(data)
})
load().then(use)
api.v2.users()
list.push_back(1)
5?.toString()
throw new Error('TODO later')
  // not implemented
FROM node:latest
USER root
RUN chmod 777 /srv
HEALTHCHECK CMD true
cidr_blocks = ["0.0.0.0/0"]
publicly_accessible = true
on: pull_request_target
permissions: write-all
uses: some/action@main
CidrIp: 0.0.0.0/0
Encrypted: false
if (true) {
ok = valid || true
escapeHtml(sqlQuery)
createCipheriv('aes-128-ecb', key)
iterations: 100
@UseGuards(AuthGuard)
@login_required
validateInput(body)
assertOwner(user)
if (!allowed) {
export class Shop{k} {
public total(): number {
function encryptData(x) {
encrypt(encrypt(x))
componentWillMount() {
new Buffer(3)
"Action": "*"
"s3:*"
app.post('/orders', handler)
app.get('/orders', handler)
router.get('/public/health', handler)
deleteUser(id)
hidden​ text
https://abc.ngrok.io/x
git commit --no-verify
allowed_tools: ['*']
auto_approve: true
command: z.string()
eval(completion)
exec(pr.title)
redirect(req.query.next)
redirect(safeUrl)
'no-eval': 'off'
branches: 40
exclude: ['src/x']
load().then(x => x)
checkAuth(user)
return total;
total += 1
}
case 3:
useEffect(() => {
  socket.subscribe(f)
})
socket.unsubscribe(f)
if (existsSync(name)) {
  unlink(name)
if (!this.isReady) {
  await start()
createMachine({
  states: { idle: {}, failed: {} }
new Promise((resolve) => {
  readFile(name, (err, d) => resolve(d))
run((err, value) => {
  save(value)
for (var i = 0; i < n; i++) {
  later(() => i)
let count{k} = 0
button.addEventListener('click', f)
setInterval(tick, 10)
let latest = await get()
latest = other
const apiKey = 'abcdef12345'
const stream = fs.createReadStream(name)
stream.close()
pool.getConnection()
conn.release()
verifyToken(t)
hasRole(u)
createCipher('aes')
scrypt(k)
requestCount++
rateLimit(x)
class List extends React.Component {
useState(0)
callback(null)
async function go() {
class Plain {
compose(f, g)
function formatDate{k}(d) {
const parsePrice = (x) => x
db.execute("select ?", [id])
db.query("select * from t where id=" + id)
catch (e instanceof RangeError) {
): Order | null
): Order {
const name = req.body.name
let alias = name
exec(name)
element.innerHTML = alias
throw new HttpError(4)
metrics.count(1)
const secret = process.env.KEY
function spare(a, b) {
const unused{k} = 1
let used = 2
use(used)
expect(used).toBe(2)
export function price{c}(a) {
export function price{c}(a, b = 1) {
export function price{c}(a, b) {
price{c}(1, 2)
throw new TypeError(x)
export const oldName{k} = 1
export const oldNames{k} = 1
it('does nothing', () => {
  run()
})
it('checks', () => {
  expect(run()).toBe(3)
})
let count = 0
async function work() {
  count = 3
  return api.load(x)
}
class Facade{k} {
  open(a) {
    return this.inner.open(a)
  }
}
class Narrow { open(a) { } close(b) { } }
class Wide{k} {
  open(a) {
return this.inner.open(a)
  }
  close(a) {
class Single { private constructor() {} static getInstance() {} }
on: { target: 'open' }
state open {
state lost {
setState('closed')
setState('error')



try { } catch (e) { }
import lodash from 'lodash'
import thing from '@acme/thing'
"left-pad": "^1.3.0"
"lodash": "^4.0.0"
"lockfileVersion": 1
"lockfileVersion": 3
const TITLE = 'Monthly report'
const HEAD = 'Monthly report'
function getInvoice(a) {
function fetchInvoice(a) {
const loadInvoice = 2
const loadOrder = 1
interface Store{c} {
class Disk{k} implements Store{c} {
class A{k} extends B{k} {
class B{k} extends C{k} {
class C{k} extends D{k} {
@Injectable()
@Logged
@Cached
parseInt(a, 10, 3)
parseInt(a, 10)
Math.max()
import { useFetch } from 'react'
export function lonely{k}() {
lonely{k}()
use moment here
use luxon here
function risky{c}(x) {
throw new RangeError(x)
}
risky{c}(1)
try { risky{c}(2) } catch (e) { log(e) }""".split("\n")
)
#: A name that a file 17 orders before exports, if its lines reach that far, and one that it does not.
SNIPPETS = SNIPPETS[:90] + ("import { load{j}, gone{j} } from './mod{p}'",) + SNIPPETS[90:]


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """change_set, path, status, op, pos, line, content: LINES_A_FILE lines for each order."""
    key, pos = F.col("o_orderkey"), F.col("pos")
    pick = lambda items, at: F.get(F.array(*map(F.lit, items)), (at % len(items)).cast("int"))

    def filled(c):
        for mark, value in (("{k}", key % 10), ("{c}", F.floor(key / 4) % 10), ("{j}", (key + 3) % 10), ("{p}", key - 17)):
            c = F.replace(c, F.lit(mark), value.cast("string"))
        return c

    # A join and not an explode, for which Spark takes a file's lines to be as large as its key and broadcasts them all.
    at = spark.range(1, LINES_A_FILE + 1).select(F.col("id").cast("int").alias("pos"))
    o = v.table(spark, d, "orders").select("o_orderkey").crossJoin(F.broadcast(at))
    return o.select(
        F.floor(key / 4).alias("change_set"),
        F.replace(F.replace(pick(PATHS, key), F.lit("{n}"), key.cast("string")), F.lit("{t}"), (key - 2).cast("string")).alias("path"),
        pick(("added", "modified", "modified", "deleted", "modified"), key).alias("status"),
        F.when((key + pos) % 7 == 6, "delete").when((key + pos) % 11 == 10, "normal").otherwise("add").alias("op"),
        pos.cast("bigint").alias("pos"),
        (pos * 3).cast("bigint").alias("line"),
        filled(pick(SNIPPETS, key * 5 + pos)).alias("content"),
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


CODE = f"""cl AS (
  SELECT o_orderkey // 4 AS change_set, replace(replace({_list(PATHS)}[1 + o_orderkey % {len(PATHS)}], '{{n}}', CAST(o_orderkey AS VARCHAR)), '{{t}}', CAST(o_orderkey - 2 AS VARCHAR)) AS path,
    ['added', 'modified', 'modified', 'deleted', 'modified'][1 + o_orderkey % 5] AS status,
    CASE WHEN (o_orderkey + pos) % 7 = 6 THEN 'delete' WHEN (o_orderkey + pos) % 11 = 10 THEN 'normal' ELSE 'add' END AS op,
    pos, pos * 3 AS line, replace(replace(replace(replace({_list(SNIPPETS)}[1 + (o_orderkey * 5 + pos) % {len(SNIPPETS)}], '{{k}}', CAST(o_orderkey % 10 AS VARCHAR)), '{{c}}', CAST((o_orderkey // 4) % 10 AS VARCHAR)), '{{j}}', CAST((o_orderkey + 3) % 10 AS VARCHAR)), '{{p}}', CAST(o_orderkey - 17 AS VARCHAR)) AS content
  FROM (SELECT o_orderkey, unnest(range(1, {LINES_A_FILE + 1})) AS pos FROM orders))"""


def _fits(pattern: str, unless: str = "", c: str = "content") -> str:
    return f"regexp_matches({c}, {_q(pattern)})" + (f" AND NOT regexp_matches({c}, {_q(unless)})" if unless else "")


def _line_test(r: dt.Line) -> str:
    t = f"op = '{r.op}' AND {_fits(r.pattern, r.unless)}"
    if r.alike is not None:
        t += f" AND lower(regexp_extract(content, {_q(r.pattern)}, 1)) {'=' if r.alike else '!='} lower(regexp_extract(content, {_q(r.pattern)}, 2))"
    t += f" AND {_fits(r.path, c='path')}" if r.path else ""
    return t + (f" AND NOT {_fits(r.path_unless, c='path')}" if r.path_unless else "")


def _mark(kind: str, severity: str) -> str:
    return f"{{'kind': '{kind}', 'severity': '{severity}'}}"


def _hits(cases: list[str], frm: str, more: str = "") -> str:
    """Rows of the marks that the cases give."""
    return f"SELECT change_set, path, line, x.kind AS kind, x.severity AS severity{more} FROM (SELECT change_set, path, line{more}, unnest([{', '.join(cases)}]) AS x FROM {frm}) WHERE x IS NOT NULL"


def _line_sql() -> str:
    cases, groups = [], {}
    for r in dt.LINES:
        when = f"WHEN {_line_test(r)} THEN {_mark(r.kind, r.severity)}"
        if r.group:
            groups.setdefault(r.group, []).append(when)
        else:
            cases.append(f"CASE {when} END")
    cases += [f"CASE {' '.join(g)} END" for g in groups.values()]
    return f"WITH {CODE} " + _hits(cases, "cl WHERE op != 'normal'")


def _frame_sql() -> str:
    cols, cases = [], []
    for i, r in enumerate(dt.FRAMES):
        over = f"ROWS BETWEEN {r.n} PRECEDING AND 1 PRECEDING" if r.before else f"ROWS BETWEEN 1 FOLLOWING AND {r.n} FOLLOWING"
        cols.append(f"coalesce(max(CAST({_fits(r.want, r.want_unless)} AS INT)) OVER (PARTITION BY change_set, path ORDER BY pos {over}), 0) AS w{i}")
        t = f"{_fits(r.start, r.unless)} AND w{i} = {0 if r.absent else 1}" + (f" AND NOT {_fits(r.path_unless, c='path')}" if r.path_unless else "")
        cases.append(f"CASE WHEN {t} THEN {_mark(r.kind, r.severity)} END")
    return f"WITH {CODE}, w AS (SELECT change_set, path, line, content, {', '.join(cols)} FROM cl WHERE op = 'add') " + _hits(cases, "w")


def _first(rows: dict[str, int], hits: str) -> str:
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in rows.items()) + " END"
    return f"SELECT change_set, path, line, kind, severity FROM (SELECT *, row_number() OVER (PARTITION BY change_set, path, kind ORDER BY pos) AS nth FROM ({hits})) WHERE nth <= {limit}"


def _release_sql() -> str:
    flags = ", ".join(f"bool_or({_fits(r.release)}) AS f{i}" for i, r in enumerate(dt.RELEASES))
    wide = ", ".join(f"bool_or(f{i}) AS s{i}" for i in range(len(dt.RELEASES)))
    cases = []
    for i, r in enumerate(dt.RELEASES):
        t = _fits(r.acquire) + (f" AND {_fits(r.path, c='path')}" if r.path else "")
        cases.append(f"CASE WHEN {t} AND NOT {'s' if r.wide else 'f'}{i} THEN {_mark(r.kind, r.severity)} END")
    hits = _hits(cases, "j", ", pos")
    return f"""WITH {CODE}, pf AS (SELECT change_set, path, {flags} FROM cl WHERE op != 'delete' GROUP BY 1, 2), ps AS (SELECT change_set, {wide} FROM pf GROUP BY 1),
j AS (SELECT cl.*, pf.* EXCLUDE (change_set, path), ps.* EXCLUDE (change_set) FROM cl JOIN pf ON cl.change_set = pf.change_set AND cl.path = pf.path JOIN ps ON cl.change_set = ps.change_set WHERE op = 'add')
""" + _first({r.kind: r.rows for r in dt.RELEASES}, hits)


def _mix_sql() -> str:
    flags = ", ".join(f"bool_or({_fits(r.second)}) AS f{i}" for i, r in enumerate(dt.MIXES))
    cases = [f"CASE WHEN {_fits(r.first)} AND f{i} THEN {_mark(r.kind, r.severity)} END" for i, r in enumerate(dt.MIXES)]
    return f"""WITH {CODE}, pf AS (SELECT change_set, path, {flags} FROM cl WHERE op = 'add' GROUP BY 1, 2), j AS (SELECT cl.*, pf.* EXCLUDE (change_set, path) FROM cl JOIN pf ON cl.change_set = pf.change_set AND cl.path = pf.path WHERE op = 'add')
""" + _first({r.kind: r.rows for r in dt.MIXES}, _hits(cases, "j", ", pos"))


def _across_sql() -> str:
    keys = [f"CASE WHEN {_fits(r.pattern)} THEN {{'kind': '{r.kind}', 'severity': '{r.severity}', 'least': {r.files}, 'key': lower(regexp_extract(content, {_q(r.pattern)}, 1))}} END" for r in dt.ACROSS]
    return f"""WITH {CODE}, n AS (SELECT change_set, path, pos, line, x.* FROM (SELECT change_set, path, pos, line, unnest([{', '.join(keys)}]) AS x FROM cl WHERE op = 'add') WHERE x IS NOT NULL),
p AS (SELECT change_set, kind, severity, least, key, path, arg_min(line, pos) AS line FROM n GROUP BY ALL),
g AS (SELECT change_set, kind, severity, least, key, count(*) AS files, min(path) AS first_path, arg_min(line, path) AS first_line FROM p GROUP BY ALL)
SELECT DISTINCT change_set, first_path AS path, first_line AS line, kind, severity FROM g WHERE files >= least"""


def _replaced_sql() -> str:
    flags = ", ".join(f"bool_or(op = 'delete' AND {_fits(a)}) AS f{i}" for i, (a, _) in enumerate(dt.REPLACED.values()))
    cases = [f"CASE WHEN {_fits(b)} AND f{i} THEN {_mark(k, 'critical')} END" for i, (k, (_, b)) in enumerate(dt.REPLACED.items())]
    return f"""WITH {CODE}, pf AS (SELECT change_set, path, {flags} FROM cl GROUP BY 1, 2), j AS (SELECT cl.*, pf.* EXCLUDE (change_set, path) FROM cl JOIN pf ON cl.change_set = pf.change_set AND cl.path = pf.path WHERE op = 'add')
""" + _first(dict.fromkeys(dt.REPLACED, 1), _hits(cases, "j", ", pos"))


_TAINT = f"""WITH RECURSIVE {CODE}, gv AS (SELECT change_set, path, pos, regexp_extract(content, {_q(dt.ASSIGNED)}, 1) AS given, unnest(list_distinct(regexp_extract_all(regexp_extract(content, {_q(dt.ASSIGNED)}, 2), '\\w+'))) AS w FROM cl WHERE op = 'add' AND {_fits(dt.ASSIGNED)}),
src AS (SELECT change_set, path AS sp, pos AS spos, regexp_extract(content, {_q(dt.SOURCES)}, 1) AS v FROM cl WHERE op = 'add' AND regexp_extract(content, {_q(dt.SOURCES)}, 1) != '' UNION SELECT gv.change_set, gv.path, gv.pos, gv.given FROM gv JOIN src ON gv.change_set = src.change_set AND gv.path = src.sp AND gv.w = src.v AND gv.pos > src.spos),
snk AS (SELECT change_set, path, pos, line, unnest(list_distinct(regexp_extract_all(content, '\\w+'))) AS v FROM cl WHERE op = 'add' AND {_fits(dt.SINK)})
SELECT snk.change_set, path, line, 'taint-trace' AS kind, CASE WHEN bool_or(sp = path) THEN 'critical' ELSE 'warning' END AS severity FROM src JOIN snk ON src.change_set = snk.change_set AND src.v = snk.v WHERE sp != path OR pos >= spos GROUP BY 1, 2, 3"""

_UNUSED = f"""WITH {CODE}, a AS (SELECT * FROM cl WHERE op = 'add'), d AS (SELECT change_set, path, pos, line, regexp_extract(content, '^\\s*(?:const|let|var)\\s+([A-Za-z]\\w+)\\s*=', 1) AS name FROM a WHERE NOT regexp_matches(content, '\\bexport\\b|\\{{.*\\}}')),
u AS (SELECT change_set, path, pos, unnest(list_distinct(regexp_extract_all(content, '\\w+'))) AS name FROM a)
SELECT change_set, path, line, 'unused-variable' AS kind, 'warning' AS severity FROM d WHERE name != '' AND NOT EXISTS (SELECT 1 FROM u WHERE u.change_set = d.change_set AND u.path = d.path AND u.name = d.name AND u.pos != d.pos)"""

_FILES = f"""WITH {CODE}, p AS (SELECT change_set, path, min(status) AS status, count(*) FILTER (op = 'add') AS plus, count(*) FILTER (op = 'delete') AS minus, count(*) FILTER (op = 'add' AND regexp_matches(content, ':\\s*\\w+|expect\\(|assert')) AS typed, min(line) AS line FROM cl GROUP BY 1, 2)
""" + _hits([f"CASE WHEN {t} THEN {_mark(k, s)} END" for k, s, t in (
    ("sensitive-file-added", "critical", "status IN ('added', 'modified') AND regexp_matches(path, '(^|/)(\\.env(\\.\\w+)?|id_rsa|.*\\.(pem|p12|key|keystore))$')"),
    ("build-artifact-added", "warning", "status = 'added' AND regexp_matches(path, '(^|/)(dist|build|out|target|node_modules)/|\\.(class|pyc|o|exe|dll)$')"),
    ("os-ide-artifact-added", "info", "status = 'added' AND regexp_matches(path, '(^|/)(\\.DS_Store|Thumbs\\.db|\\.idea/|\\.vscode/)')"),
    ("sweep-no-safety", "warning", "plus > 20 AND minus / (plus + minus) > 0.6 AND typed / plus < 0.1"),
    ("large-new-file", "info", f"status = 'added' AND plus > 100 AND typed = 0 AND NOT {_fits(dt.TESTS, c='path')}"),
)], "p")

_SETS = f"""WITH {CODE}, a AS (SELECT change_set, min(path) FILTER (regexp_matches(path, '(^|/)(package\\.json|pyproject\\.toml|Cargo\\.toml|go\\.mod)$')) AS m, min(path) FILTER (regexp_matches(path, '(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|poetry\\.lock|Cargo\\.lock|go\\.sum)$')) AS l,
  min(path) FILTER (regexp_matches(path, '(^|/)(\\.github/workflows/|CODEOWNERS$|\\.mcp\\.json$)')) AS g, min(path) FILTER (regexp_matches(path, '\\.(ts|js|py|go|rs|java)$')) AS s FROM cl GROUP BY 1)
SELECT change_set, m AS path, 1 AS line, 'missing-lockfile-update' AS kind, 'warning' AS severity FROM a WHERE m IS NOT NULL AND l IS NULL
UNION ALL SELECT change_set, l, 1, 'orphan-lockfile-change', 'warning' FROM a WHERE l IS NOT NULL AND m IS NULL
UNION ALL SELECT change_set, g, 1, 'governance-config-modification', 'critical' FROM a WHERE g IS NOT NULL AND s IS NOT NULL"""

def _sym(pattern: str, where: str = "op = 'add'", more: str = "") -> str:
    return f"SELECT change_set, path, pos, line, regexp_extract(content, {_q(pattern)}, 1) AS symbol{more} FROM cl WHERE {where} AND {_fits(pattern)}"


_STEM = "regexp_replace(path, '\\.[A-Za-z0-9]+$', '')"
_TEST = _fits(dt.TESTS, c="path")
_IMPORTED = f"""im AS (SELECT DISTINCT change_set, path, line, target, regexp_replace(trim(n), '\\s+as\\s+\\w+$', '') AS symbol FROM (SELECT change_set, path, line, regexp_replace(regexp_replace(path, '/?[^/]*$', '') || '/' || regexp_replace(regexp_extract(content, {_q(ct.IMPORT)}, 2), '^\\./', ''), '\\.[A-Za-z0-9]+$', '') AS target,
  unnest(string_split(regexp_extract(content, {_q(ct.IMPORT)}, 1), ',')) AS n FROM cl WHERE op = 'add' AND {_fits(ct.IMPORT)}) WHERE trim(n) != '')"""

_MISSING = f"""WITH {CODE}, {_IMPORTED}, ex AS (SELECT DISTINCT {_STEM} AS target, symbol FROM ({_sym(ct.EXPORT, "op != 'delete' AND status != 'deleted'")})), here AS (SELECT DISTINCT {_STEM} AS target FROM cl WHERE status != 'deleted')
SELECT change_set, path, line, symbol, 'missing-export' AS kind FROM im WHERE target IN (SELECT target FROM here) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.target = im.target AND ex.symbol = im.symbol)"""

_SIDES = f"""sg AS (SELECT change_set, path, line, op, regexp_extract(content, {_q(ct.FUNCTION)}, 1) AS symbol, list_filter(list_transform(string_split(regexp_extract(content, {_q(ct.FUNCTION)}, 2), ','), lambda x: trim(x)), lambda x: x != '') AS ps FROM cl WHERE op IN ('add', 'delete') AND {_fits(ct.FUNCTION)}),
sd AS (SELECT change_set, path, symbol, min(line) FILTER (op = 'add') AS line, max(len(ps)) FILTER (op = 'delete') AS old_n, max(len(ps)) FILTER (op = 'add') AS new_n, max(len(list_filter(ps, lambda x: contains(x, '=') OR contains(x, '?')))) FILTER (op = 'delete') AS old_o, max(len(list_filter(ps, lambda x: contains(x, '=') OR contains(x, '?')))) FILTER (op = 'add') AS new_o FROM sg GROUP BY 1, 2, 3)"""

_BLOCK = """a AS (SELECT *, length(content) - length(replace(content, '{', '')) - (length(content) - length(replace(content, '}', ''))) AS step FROM cl WHERE op = 'add'),
d AS (SELECT *, sum(step) OVER (PARTITION BY change_set, path ORDER BY pos) AS depth FROM a),"""


def _inner(start: str) -> str:
    """b: each block's line with every line inside it."""
    return f"""{_BLOCK} st AS (SELECT change_set, path, line, pos, step, depth - step AS base FROM d WHERE {_fits(start)}),
en AS (SELECT s.change_set, s.path, s.line, s.pos, CASE WHEN s.step <= 0 THEN s.pos ELSE coalesce(min(d.pos) FILTER (d.pos >= s.pos AND d.depth <= s.base), max(d.pos)) END AS fin FROM st s JOIN d ON s.change_set = d.change_set AND s.path = d.path GROUP BY s.change_set, s.path, s.line, s.pos, s.step),
b AS (SELECT e.change_set, e.path, e.line, d.line AS inner_line, d.content FROM en e JOIN d ON e.change_set = d.change_set AND e.path = d.path AND d.pos BETWEEN e.pos AND e.fin)"""


_EXEMPT = ", ".join(map(_q, ct.EXEMPT_STATES))
_MEANS = "CASE " + " ".join(f"WHEN verb IN ({', '.join(map(_q, g))}) THEN {_q(g[0])}" for g in ct.SYNONYMS) + " ELSE verb END"
_ARITY = [
    f"CASE WHEN regexp_matches(content, {_q(p)}) AND len(list_filter(string_split(regexp_extract(content, {_q(p)}, 1), ','), lambda x: trim(x) != '')) NOT BETWEEN {lo} AND {hi} THEN {{'kind': 'wrong-arity', 'symbol': '{n}'}} END"
    for n, (lo, hi) in ct.ARITY.items()
    for p in [r"(?:^|[^\w.])" + n.replace(".", r"\.") + r"\(([^()]*)\)"]
] + [
    f"CASE WHEN regexp_matches(content, {_q(chr(92) + f's*import\\s+\\{{[^}}]*\\b{n}\\b[^}}]*\\}}\\s+from\\s+.{m}.')}) THEN {{'kind': 'confabulated-import', 'symbol': '{n}'}} END"
    for m, names in ct.WRONG_EXPORTS.items()
    for n in names
]
KNOWN = ("react", "vue", "typeorm", "helmet", "@prisma/client")
DECISIONS = ((7, "moment", r"\.(ts|js)$"), (9, "luxon", "^docs/"))
_POINTS = {
    "security": "3 * safe + 2 * CAST(regexp_matches(path, '(?i)auth|secret|\\.env$') AS INT)",
    "bugfix": "3 * fix + CAST(status = 'modified' AS INT)",
    "feature": "3 * CAST(status = 'added' AS INT) + 2 * exported",
    "refactor": "3 * CAST(minus > 0 AND plus <= 3 * minus AS INT)",
    "test": f"5 * CAST({_TEST} AS INT)",
    "docs": "5 * CAST(regexp_matches(path, '(?i)\\.md$') AS INT)",
    "config": "5 * CAST(regexp_matches(path, '(?i)\\.(ya?ml|json|tf)$|config|Dockerfile$') AS INT)",
}
_INTENT = f"""WITH {CODE}, f AS (SELECT change_set, path, min(status) AS status, count(*) FILTER (op = 'add') AS plus, count(*) FILTER (op = 'delete') AS minus,
  max(CAST(op = 'add' AND regexp_matches(content, '(?i)\\b(password|token|encrypt|auth\\w*|secret)\\b') AS INT)) AS safe, max(CAST(op = 'add' AND regexp_matches(content, '(?i)\\b(fix|bug|null check|edge case|FIXME)\\b') AS INT)) AS fix, max(CAST(op = 'add' AND regexp_matches(content, '\\bexport\\b') AS INT)) AS exported FROM cl GROUP BY 1, 2),
g AS (SELECT change_set, path, {', '.join(f'{x} AS p{i}' for i, x in enumerate(_POINTS.values()))} FROM f),
it AS (SELECT change_set, path, CASE {' '.join(f"WHEN p{i} = greatest({', '.join(f'p{j}' for j in range(len(_POINTS)))}) THEN '{k}'" for i, k in enumerate(_POINTS))} END AS intent FROM g)"""
_PLACE = "list_position([" + ", ".join(map(_q, ct.INTENTS)) + "], intent)"
_CHANGES = "ch AS (SELECT o_orderkey % 500 AS change_set, o_custkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'modified' END AS status FROM orders)"


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KNOWN], "symbol string")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 500).alias("change_set"), F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status"))


#: name -> (operator over session and folder, statement)
OTHERS = {
    "missing_exports": (lambda s, d: ct.missing_exports(code_lines(s, d)), _MISSING),
    "new_required_parameters": (lambda s, d: ct.new_required_parameters(code_lines(s, d)), f"WITH {CODE}, {_SIDES} SELECT change_set, path, line, symbol, CASE WHEN new_o - old_o >= new_n - old_n THEN 'info' ELSE 'critical' END AS severity, 'new-required-param' AS kind FROM sd WHERE new_n > old_n"),
    "narrowed_signature_calls": (lambda s, d: ct.narrowed_signature_calls(code_lines(s, d)), f"""WITH {CODE}, {_SIDES}, ca AS (SELECT change_set, path, line, unnest(list_distinct(regexp_extract_all(content, {_q(ct.CALL)}, 1))) AS symbol FROM cl WHERE op = 'add' AND NOT {_fits(ct.FUNCTION)})
SELECT DISTINCT ca.change_set, ca.path, ca.line, ca.symbol, 'signature-change' AS kind FROM ca JOIN sd ON ca.change_set = sd.change_set AND ca.symbol = sd.symbol AND ca.path != sd.path WHERE new_n < old_n"""),
    "unhandled_throws": (lambda s, d: ct.unhandled_throws(code_lines(s, d)), f"""WITH {CODE}, {_inner(ct.FUNCTION)}, tl AS (SELECT DISTINCT change_set, path, line FROM b WHERE {_fits(ct.THROWN)}), th AS (SELECT DISTINCT cl.change_set, regexp_extract(content, {_q(ct.FUNCTION)}, 1) AS symbol FROM tl JOIN cl ON cl.change_set = tl.change_set AND cl.path = tl.path AND cl.line = tl.line AND op = 'add'),
ca AS (SELECT change_set, path, line, safe, unnest(list_distinct(regexp_extract_all(content, {_q(ct.CALL)}, 1))) AS symbol FROM (SELECT *, bool_or(regexp_matches(content, '\\btry\\b')) OVER (PARTITION BY change_set, path ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AND bool_or(regexp_matches(content, '\\bcatch\\b')) OVER (PARTITION BY change_set, path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) AS safe FROM cl WHERE op = 'add') WHERE NOT {_fits(ct.FUNCTION)})
SELECT ca.change_set, path, line, ca.symbol, 'unhandled-throw' AS kind FROM ca JOIN th ON ca.change_set = th.change_set AND ca.symbol = th.symbol WHERE NOT safe"""),
    "new_thrown_types": (lambda s, d: ct.new_thrown_types(code_lines(s, d)), f"""WITH {CODE}, n AS ({_sym(ct.THROWN)}), o AS ({_sym(ct.THROWN, "op = 'delete'")})
SELECT change_set, path, min(line) AS line, symbol, 'changed-thrown-exceptions' AS kind FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.change_set = n.change_set AND o.path = n.path AND o.symbol = n.symbol) GROUP BY change_set, path, symbol"""),
    "renamed_exports": (lambda s, d: ct.renamed_exports(code_lines(s, d)), f"""WITH {CODE}, o AS (SELECT DISTINCT change_set, path, symbol FROM ({_sym(ct.EXPORT, "op = 'delete'")})), n AS (SELECT change_set, path, symbol, min(line) AS line FROM ({_sym(ct.EXPORT)}) GROUP BY 1, 2, 3)
SELECT n.change_set, n.path, n.line, o.symbol || ' -> ' || n.symbol AS symbol, 'renamed-export' AS kind FROM o JOIN n ON o.change_set = n.change_set AND o.path = n.path WHERE o.symbol != n.symbol AND (left(o.symbol, 3) = left(n.symbol, 3) AND least(length(o.symbol), length(n.symbol)) >= 3 AND abs(length(o.symbol) - length(n.symbol)) <= 2 OR greatest(length(o.symbol), length(n.symbol)) <= 6 AND levenshtein(o.symbol, n.symbol) <= 2)"""),
    "assertion_free_tests": (lambda s, d: ct.assertion_free_tests(code_lines(s, d)), f"WITH {CODE}, {_inner(ct.TEST_START)} SELECT change_set, path, line, 'assertion-free-test' AS kind FROM b GROUP BY 1, 2, 3 HAVING NOT bool_or({_fits(ct.ASSERTION)})"),
    "returns_without_await": (lambda s, d: ct.returns_without_await(code_lines(s, d)), f"WITH {CODE}, {_inner(ct.ASYNC_START)} SELECT DISTINCT change_set, path, inner_line AS line, 'spec-implementation-mismatch' AS kind FROM b WHERE regexp_matches(content, '^\\s*return\\s+\\w[\\w.]*\\(') AND NOT regexp_matches(content, '\\bawait\\b')"),
    "shared_mutable_state": (lambda s, d: ct.shared_mutable_state(code_lines(s, d)), f"""WITH {CODE}, {_inner(ct.ASYNC_START)}, m AS ({_sym(ct.MODULE_VARIABLE)}), w AS (SELECT change_set, path, inner_line AS line, regexp_extract(content, '^\\s*(\\w+)\\s*(?:=[^=]|\\+=|-=|\\+\\+)', 1) AS symbol FROM b)
SELECT DISTINCT w.change_set, w.path, w.line, w.symbol, 'shared-mutable-state' AS kind FROM w JOIN m ON w.change_set = m.change_set AND w.path = m.path AND w.symbol = m.symbol WHERE w.symbol != '' AND w.line != m.line"""),
    "facades": (lambda s, d: ct.facades(code_lines(s, d)), f"""WITH {CODE}, {_inner(ct.CLASS_START)}, c AS (SELECT change_set, path, line, count(*) FILTER (regexp_matches(content, '^\\s*(?:async\\s+)?\\w+\\([^)]*\\)\\s*\\{{')) AS methods, count(*) FILTER (regexp_matches(content, 'return\\s+this\\.\\w+\\.\\w+\\(')) AS handed, bool_or(regexp_matches(content, 'private\\s+constructor')) AS hidden, bool_or(regexp_matches(content, 'getInstance\\(')) AS one FROM b GROUP BY 1, 2, 3)
SELECT change_set, path, line, 'enterprise-facade' AS kind FROM c WHERE methods BETWEEN 2 AND 3 AND handed >= methods - 1 UNION ALL SELECT change_set, path, line, 'singleton-misuse' FROM c WHERE hidden AND one"""),
    "state_machines": (lambda s, d: ct.state_machines(code_lines(s, d)), f"""WITH {CODE}, t AS (SELECT DISTINCT change_set, path, symbol FROM ({_sym(ct.TRANSITION)})), u AS (SELECT *, 'invalid-transition' AS kind FROM ({_sym(ct.SET_STATE)}) UNION ALL SELECT *, 'unreachable-state' FROM ({_sym(ct.STATE)}))
SELECT change_set, path, line, symbol, kind FROM u WHERE symbol NOT IN ({_EXEMPT}) AND EXISTS (SELECT 1 FROM t WHERE t.change_set = u.change_set AND t.path = u.path) AND NOT EXISTS (SELECT 1 FROM t WHERE t.change_set = u.change_set AND t.path = u.path AND t.symbol = u.symbol)"""),
    "boilerplate_expansion": (lambda s, d: ct.boilerplate(code_lines(s, d)), f"""WITH {CODE}, a AS (SELECT *, trim(content) = '' AS b0, lag(trim(content) = '', 1, false) OVER w AS b1, lag(trim(content) = '', 2, false) OVER w AS b2 FROM cl WHERE op = 'add' WINDOW w AS (PARTITION BY change_set, path ORDER BY pos))
SELECT DISTINCT change_set, path, line, 'boilerplate-expansion' AS kind FROM (SELECT change_set, path, min(line) AS line FROM a WHERE b0 AND b1 AND b2 GROUP BY 1, 2 UNION ALL SELECT change_set, path, line FROM a WHERE regexp_matches(content, '\\b(try|catch)\\s*(\\(\\w*\\))?\\s*\\{{\\s*\\}}'))"""),
    "unknown_imports": (lambda s, d: ct.unknown_imports(code_lines(s, d), _known(s)), f"WITH {CODE}, p AS (SELECT * REPLACE (CASE WHEN symbol LIKE '@%' THEN symbol ELSE split_part(symbol, '/', 1) END AS symbol) FROM ({_sym(ct.PACKAGE)})) SELECT change_set, path, line, symbol, CASE WHEN symbol LIKE '@%' THEN 'phantom-scoped-import' ELSE 'unknown-import' END AS kind FROM p WHERE symbol NOT IN ({', '.join(map(_q, KNOWN))})"),
    "dependency_files": (lambda s, d: ct.dependencies(code_lines(s, d)), f"""WITH {CODE}, n AS ({_sym(ct.DEPENDENCY, "op = 'add' AND path LIKE '%package.json'")}), u AS ({_sym(ct.PACKAGE, f"op = 'add' AND NOT {_TEST}")}), k AS (SELECT change_set, path, arg_max(line, pos) AS line, arg_max(symbol, pos) AS symbol FROM ({_sym(ct.LOCK_VERSION)}) GROUP BY 1, 2)
SELECT change_set, path, line, symbol, 'unused-new-dependency' AS kind FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.change_set = n.change_set AND u.symbol = n.symbol) UNION ALL SELECT change_set, path, line, symbol, 'lockfile-version-drift' FROM k WHERE symbol NOT IN ('2', '3')"""),
    "mirrored_constants": (lambda s, d: ct.mirrored_constants(code_lines(s, d)), f"WITH {CODE}, c AS ({_sym(ct.CONSTANT)}) SELECT change_set, path, line, symbol, 'fixture-mirror-constant' AS kind FROM c WHERE {_TEST} AND EXISTS (SELECT 1 FROM c x WHERE x.change_set = c.change_set AND x.symbol = c.symbol AND NOT {_fits(dt.TESTS, c='x.path')})"),
    "synonymous_names": (lambda s, d: ct.synonymous_names(code_lines(s, d)), f"""WITH {CODE}, x AS (SELECT *, {_MEANS} AS means FROM (SELECT change_set, path, line, regexp_extract(content, {_q(ct.DECLARED)}, 1) AS verb, regexp_extract(content, {_q(ct.DECLARED)}, 2) AS noun FROM cl WHERE op = 'add' AND {_fits(ct.DECLARED)})),
n AS (SELECT change_set, means, noun FROM x GROUP BY 1, 2, 3 HAVING count(DISTINCT verb) > 1 AND count(DISTINCT path) > 1),
y AS (SELECT change_set, min((path, line)) AS place, means FROM x WHERE means IN ({', '.join(_q(g[0]) for g in ct.SYNONYMS)}) GROUP BY change_set, means HAVING count(DISTINCT verb) > 1 AND count(DISTINCT path) > 1)
SELECT x.change_set, path, line, verb || x.noun AS symbol, 'duplicate-implementation' AS kind FROM x JOIN n ON x.change_set = n.change_set AND x.means = n.means AND x.noun = n.noun UNION ALL SELECT change_set, place[1], place[2], means, 'naming-inconsistency' FROM y"""),
    "single_implementations": (lambda s, d: ct.single_implementations(code_lines(s, d)), f"WITH {CODE}, o AS (SELECT change_set, symbol FROM ({_sym(ct.IMPLEMENTS)}) GROUP BY 1, 2 HAVING count(*) = 1) SELECT i.change_set, path, line, i.symbol, 'interface-for-single-impl' AS kind FROM ({_sym(ct.INTERFACE)}) i JOIN o ON i.change_set = o.change_set AND i.symbol = o.symbol"),
    "deep_inheritance": (lambda s, d: graph.chain_depth(ct.inheritance(code_lines(s, d))).where("depth >= 3"), f"""WITH RECURSIVE {CODE}, e AS (SELECT regexp_extract(content, {_q(ct.EXTENDS)}, 1) AS node, min(regexp_extract(content, {_q(ct.EXTENDS)}, 2)) AS parent FROM cl WHERE op = 'add' AND {_fits(ct.EXTENDS)} GROUP BY 1),
w AS (SELECT node, parent AS top, 1 AS depth FROM e WHERE node != parent UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON e.node = w.top WHERE w.depth < 6) SELECT node, max(depth) AS depth FROM w GROUP BY 1 HAVING max(depth) >= 3"""),
    "decorator_stacks": (lambda s, d: ct.decorator_stacks(code_lines(s, d)), f"""WITH {CODE}, a AS (SELECT *, row_number() OVER (PARTITION BY change_set, path ORDER BY pos) AS n FROM cl WHERE op = 'add'), r AS (SELECT *, n - row_number() OVER (PARTITION BY change_set, path ORDER BY pos) AS run FROM a WHERE {_fits(ct.DECORATOR)})
SELECT change_set, path, min(line) AS line, count(*) AS size, 'decorator-stack' AS kind FROM r GROUP BY change_set, path, run HAVING count(*) >= 3"""),
    "wrong_calls": (lambda s, d: ct.wrong_calls(code_lines(s, d)), f"WITH {CODE} SELECT change_set, path, line, x.symbol AS symbol, x.kind AS kind FROM (SELECT change_set, path, line, unnest([{', '.join(_ARITY)}]) AS x FROM cl WHERE op = 'add') WHERE x IS NOT NULL"),
    "orphaned_declarations": (lambda s, d: ct.orphaned_declarations(code_lines(s, d)), f"""WITH {CODE}, d AS ({_sym(ct.EXPORT, "op = 'add' AND NOT regexp_matches(content, '\\bexport\\s+(?:default|type|interface)\\b')")}), u AS (SELECT change_set, path, pos, unnest(list_distinct(regexp_extract_all(content, '\\w+'))) AS symbol FROM cl WHERE op = 'add')
SELECT change_set, path, line, symbol, 'orphaned-spec' AS kind FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.change_set = d.change_set AND u.symbol = d.symbol AND (u.path != d.path OR u.pos != d.pos))"""),
    "symbol_impact": (lambda s, d: ct.symbol_impact(code_lines(s, d)), f"""WITH {CODE}, {_IMPORTED}, g AS (SELECT DISTINCT {_STEM} AS target, symbol FROM ({_sym(ct.EXPORT, "op != 'normal'")})), w AS (SELECT DISTINCT im.target, im.symbol, im.path, CASE WHEN regexp_matches(path, '(?i)(^|/)(api|routes?|handlers?|lib)/') THEN 4 WHEN {_TEST} THEN 1 ELSE 2 END AS w FROM im JOIN g ON im.target = g.target AND im.symbol = g.symbol)
SELECT target AS path, symbol, count(*) AS users, CAST(sum(w) AS BIGINT) AS score, CASE WHEN sum(w) >= 7 THEN 'critical' ELSE 'warning' END AS severity FROM w GROUP BY 1, 2"""),
    "test_gaps": (lambda s, d: ct.test_gaps(code_lines(s, d)), f"""WITH {CODE}, n AS (SELECT change_set, path, count(DISTINCT symbol) AS symbols, regexp_extract(path, '(\\d+)\\D*$', 1) AS k FROM ({_sym(ct.EXPORT, f"op = 'add' AND NOT {_TEST}")}) GROUP BY 1, 2), t AS (SELECT DISTINCT change_set, regexp_extract(path, '(\\d+)\\D*$', 1) AS k FROM cl WHERE {_TEST})
SELECT change_set, path, symbols, CASE WHEN k IN (SELECT k FROM t) THEN 'test-file-not-changed' ELSE 'no-test-file' END AS kind FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.change_set = n.change_set AND t.k = n.k)"""),
    "forbidden_terms": (lambda s, d: ct.forbidden_terms(code_lines(s, d), s.createDataFrame(list(DECISIONS), "number int, term string, path_pattern string")), f"""WITH {CODE}, u AS (SELECT change_set, path, line, unnest(list_distinct(regexp_extract_all(lower(content), '\\w+'))) AS term FROM cl WHERE op = 'add')
SELECT change_set, path, line, term AS symbol, CASE term WHEN 'moment' THEN 'ADR-7' ELSE 'ADR-9' END AS kind FROM u WHERE term = 'moment' AND regexp_matches(path, '\\.(ts|js)$') OR term = 'luxon' AND regexp_matches(path, '^docs/')"""),
    "intents": (lambda s, d: ct.intents(code_lines(s, d)), _INTENT + " SELECT change_set, path, intent FROM it"),
    "dominant_intent": (lambda s, d: ct.dominant_intent(ct.intents(code_lines(s, d))), _INTENT + f", n AS (SELECT change_set, intent, count(*) AS files FROM it GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY change_set ORDER BY files DESC, {_PLACE}) AS nth FROM n) SELECT change_set, intent, files FROM r WHERE nth = 1"),
    "file_collisions": (lambda s, d: ct.collisions(_changes(s, d).where("change_set % 100 = 0"), _changes(s, d)), f"WITH {_CHANGES} SELECT DISTINCT a.change_set AS mine, b.change_set AS theirs, a.path FROM ch a JOIN ch b ON a.path = b.path WHERE a.change_set % 100 = 0 AND a.change_set != b.change_set"),
    "delete_uses": (lambda s, d: ct.delete_uses(v.edges(s, d), _changes(s, d).where("change_set % 100 = 0"), _changes(s, d)), f"""WITH {v.EDGES}, {_CHANGES} SELECT DISTINCT a.change_set AS mine, b.change_set AS theirs, source, target FROM ed JOIN ch a ON a.path = source AND a.status != 'deleted' JOIN ch b ON b.path = target AND b.status = 'deleted' WHERE a.change_set % 100 = 0 AND a.change_set != b.change_set"""),
    "boundary_violations": (lambda s, d: ct.boundary_violations(v.edges(s, d), lambda c: F.when(c % 5 < 4, F.concat(F.lit("context"), (c % 5).cast("string")))), f"WITH {v.EDGES} SELECT source, target, 'context' || source % 5 AS from_context, 'context' || target % 5 AS to_context FROM ed WHERE source % 5 < 4 AND target % 5 < 4 AND source % 5 != target % 5"),
    "lock_orders": (lambda s, d: ct.lock_orders(v.table(s, d, "events").select(F.col("user_id").alias("owner"), (F.col("event_id") % 40).alias("lock"), F.col("event_id").alias("pos")).where("lock < 3")), """WITH q AS (SELECT user_id AS owner, event_id % 40 AS lock, min(event_id) AS pos FROM events WHERE event_id % 40 < 3 GROUP BY 1, 2), p AS (SELECT x.owner, x.lock AS a, y.lock AS b FROM q x JOIN q y ON x.owner = y.owner AND x.pos < y.pos)
SELECT t.owner AS first, b.owner AS second, t.a AS lock_a, t.b AS lock_b FROM p t JOIN p b ON t.a = b.b AND t.b = b.a WHERE t.a < t.b"""),
}


def _other(name: str, f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(spark, d)

    run.__name__ = name
    return run


#: name -> (operator over the line relation, statement)
SHAPES = {
    "detector_lines": (dt.line_rules, _line_sql()),
    "detector_frames": (dt.frame_rules, _frame_sql()),
    "detector_releases": (dt.release_rules, _release_sql()),
    "detector_mixes": (dt.mix_rules, _mix_sql()),
    "detector_across": (lambda lines: dt.across_rules(lines, copies=False), _across_sql()),
    "detector_replaced": (dt.replaced_rules, _replaced_sql()),
    "detector_files": (dt.file_rules, _FILES),
    "detector_change_sets": (dt.change_set_rules, _SETS),
    "detector_unused": (dt.unused_variables, _UNUSED),
    "detector_taint": (lambda lines: dt.taint(lines, LINES_A_FILE - 1), _TAINT),
}


def _query(name: str, f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(code_lines(spark, d))

    run.__name__, run.__doc__ = name, f.__doc__
    return run


def queries() -> dict:
    return {name: _query(name, f) for name, (f, _) in SHAPES.items()} | {name: _other(name, f) for name, (f, _) in OTHERS.items()}


def statements() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (SHAPES | OTHERS).items()}
