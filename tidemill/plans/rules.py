"""Queries over events and orders as command logs, calls and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import retention, screening
from tidemill.sources.tables import table

# One template a kind of command; {e} is the event's number, {u} the user's.
VCS = ["git checkout -- f{e}", "git -C /tmp/{u} restore f", "git restore --staged f{e}", "git reset --hard HEAD~{u}", "git reset --hardly", "git clean -fd", "git clean -nfd", "git status; echo {e}", "digit checkout x;y -- f", "git --git-dir=/x -c a=b clean --force", "ls {u}", "git restored {e}"]
TSC = ["npx tsc a{e}.ts", "tsc -p tsconfig.ts", "tsc --project x.ts b.tsx", "yarn tsc --noEmit", "pnpm dlx tsrs src/{u}.ts", "tsc; ls a.ts", "echo tsc", "npx tsrs-lint a.ts"]
SLS = ["sls deploy --stage {u}", "serverless  deploy", "jsls deployment {e}", "SLS deploy", "sls info", "serverless-deploy"]
ROUTES, ENTRY = ["click", "view"], ["1", "2", "3"]
POLICY = [("view", 20, True), ("click", 20, False), ("signup", 3, True), ("purchase", 3, False), ("never", 1, True)]
AS_OF = "2024-01-31 00:00:00"


def _commands(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("event_id") % len(templates) + 1).cast("int"))
    text = F.replace(F.replace(pick, F.lit("{e}"), F.col("event_id").cast("string")), F.lit("{u}"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), text.alias("command"))


def screen_vcs_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_vcs_commands(_commands(spark, sf_dir, VCS), "command").select("event_id", "command", "rule")


def screen_compiler_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_compiler_commands(_commands(spark, sf_dir, TSC), "command").select("event_id", "command", "denied", "tool")


def screen_deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_deploys(_commands(spark, sf_dir, SLS), "command").select("event_id", "command", "denied")


def screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = screening.screen_deploys(_commands(spark, sf_dir, SLS), "command")
    return screening.screen_report(screened, ["day", "user_id"], F.col("denied"))


def calls_of(events: DataFrame) -> DataFrame:
    tool = F.when(F.col("event_id") % 3 == 0, "Agent").when(F.col("event_id") % 3 == 1, "Bash")
    effort, model = F.when(F.col("event_id") % 4 == 0, "high").when(F.col("event_id") % 4 == 1, ""), F.when(F.col("event_id") % 5 == 0, "m")
    return events.select("event_id", tool.alias("tool_name"), (F.col("user_id") % 5).cast("string").alias("entrypoint"), F.struct(F.col("event_type").alias("subagent_type"), effort.alias("effort"), model.alias("model")).alias("tool_input"))


def audit_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.audit_calls(calls_of(table(spark, sf_dir, "events")), ROUTES, ENTRY).select("event_id", F.array_join("problems", "; ").alias("problems"), "decision")


def allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names before the first colon against names of even and odd parts' brands and customers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", ""), F.lit(":"), F.col("o_orderstatus")).alias("name"))
    pri = o.select(F.substring_index("name", ":", 1).alias("name")).where("name < '3'")
    sec = o.select(F.substring_index("name", ":", 1).alias("name")).where("name < '5'")
    return screening.allowlisted(o, pri, sec, ["3MEDIUM"], "name")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("mtime"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("is_archived"))
    return c.where("session_id % 2 = 0")


def _policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "category string, days int, protects boolean")


def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_plan(_inventory(spark, sf_dir), _sessions(spark, sf_dir), _policy(spark), F.lit(AS_OF).cast("timestamp")).select("event_id", "category", "session_id", "action")


def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = retention.retention_plan(_inventory(spark, sf_dir), _sessions(spark, sf_dir), _policy(spark), F.lit(AS_OF).cast("timestamp"))
    return retention.retention_summary(plan, _policy(spark))


def stale_empty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(uuid, F.lit("x"))).otherwise(uuid).alias("name"), F.when(F.col("event_type") == "error", "file").otherwise("dir").alias("kind"), (F.col("value") < 50).alias("is_empty"), F.col("ts").alias("mtime"))
    return retention.stale_empty_keys(e, e.where("event_id % 4 = 0").select(F.upper("name").alias("name")), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "name")


def empty_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("r"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    files = table(spark, sf_dir, "customer").select(path.alias("path"), "c_acctbal")
    dirs = files.select("path").unionByName(files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))).distinct()
    return retention.empty_prefixes(dirs, files.where("c_acctbal > 5000").select(F.concat("path", F.lit("/f")).alias("path")))


QUERIES = {f.__name__: f for f in (screen_vcs_commands, screen_compiler_commands, screen_deploys, screen_report, audit_calls, allowlisted, retention_plan, retention_summary, stale_empty_keys, empty_prefixes)}


def _commands_sql(templates: list[str]) -> str:
    return "WITH c AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, replace(replace([" + ", ".join(f"'{t}'" for t in templates) + f"][event_id % {len(templates)} + 1], '{{e}}', event_id::VARCHAR), '{{u}}', user_id::VARCHAR) AS command FROM events) "


_GIT = r"git(?:\s+(?:-C\s+\S+|-c\s+\S+|--git-dir=\S+))*\s+"
ORACLE_SQL = {
    "screen_vcs_commands": _commands_sql(VCS) + rf"""SELECT event_id, command, CASE
 WHEN regexp_matches(command, '{_GIT}checkout\s[^|&;]*?--(\s|$)') THEN 'checkout'
 WHEN regexp_matches(command, '{_GIT}restore\b') AND NOT (regexp_matches(command, '--staged\b') AND NOT regexp_matches(command, '--worktree\b|-W\b')) THEN 'restore'
 WHEN regexp_matches(command, '{_GIT}reset\b') AND regexp_matches(command, '--hard(\s|$)') THEN 'reset'
 WHEN regexp_matches(command, '{_GIT}clean\b') AND NOT regexp_matches(command, '\s(--dry-run|-[a-zA-Z]*n[a-zA-Z]*)(\s|$)') AND regexp_matches(command, '\s(--force|-[a-zA-Z]*f[a-zA-Z]*)(\s|$)') THEN 'clean' END AS rule FROM c""",
    "screen_compiler_commands": _commands_sql(TSC) + r"""SELECT event_id, command, denied, CASE WHEN denied THEN CASE WHEN contains(command, 'tsrs') THEN 'tsrs' ELSE 'tsc' END END AS tool
FROM (SELECT event_id, command, regexp_matches(command, '(^|[\s|;&])(npx|pnpm|yarn)?(tsc|tsrs)(\s|$)')
 AND regexp_matches(regexp_replace(' ' || regexp_replace(command, '^.*(tsc|tsrs)(\s|$)', ''), '\s(-p|--project)\s+\S+', ''), '\s[^-\s]\S*\.tsx?(\s|$)') AS denied FROM c)""",
    "screen_deploys": _commands_sql(SLS) + r"SELECT event_id, command, regexp_matches(command, '(serverless|sls)\s+deploy') AS denied FROM c",
    "screen_report": _commands_sql(SLS) + r""", d AS (SELECT *, regexp_matches(command, '(serverless|sls)\s+deploy') AS denied FROM c)
SELECT day, user_id, count(*) AS n, count(*) FILTER (denied) AS violations, grouping(day, user_id) AS level, count(*) FILTER (denied) / count(*)::DOUBLE AS rate FROM d GROUP BY CUBE (day, user_id)""",
    "audit_calls": """
WITH c AS (SELECT event_id, event_type IN ('click', 'view') AND event_id % 3 <> 1 AS routed, user_id % 5 AS entry FROM events),
p AS (SELECT event_id, CASE WHEN routed AND entry IN (1, 2, 3) AND event_id % 4 <> 0 THEN 'effort is missing' END AS a, CASE WHEN routed AND event_id % 5 = 0 THEN 'model is given' END AS b FROM c)
SELECT event_id, concat_ws('; ', a, b) AS problems, CASE WHEN a IS NULL AND b IS NULL THEN 'allow' ELSE 'deny' END AS decision FROM p""",
    "allowlisted": """
WITH o AS (SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') AS part, part || ':' || o_orderstatus AS name FROM orders),
pri AS (SELECT DISTINCT part FROM o WHERE part < '3')
SELECT o_orderkey, name, part IN (SELECT part FROM pri) OR (part < '5' AND part <> '3MEDIUM') AS allowed FROM o""",
    "retention_plan": f"""
WITH p(category, days, protects) AS (VALUES ('view', 20, true), ('click', 20, false), ('signup', 3, true), ('purchase', 3, false)),
live AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0)
SELECT event_id, event_type AS category, user_id::VARCHAR AS session_id,
 CASE WHEN days IS NULL OR date_diff('second', date_trunc('second', ts), TIMESTAMP '{AS_OF}') <= days * 86400 THEN 'KEEP' WHEN protects AND user_id IN (SELECT * FROM live) THEN 'PROTECTED' ELSE 'DELETE' END AS action
FROM events LEFT JOIN p ON category = event_type""",
    "retention_summary": f"""
WITH p(category, days, protects) AS (VALUES ('view', 20, true), ('click', 20, false), ('signup', 3, true), ('purchase', 3, false), ('never', 1, true)),
live AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0),
e AS (SELECT category, protects AND user_id IN (SELECT * FROM live) AS safe, event_id FROM p LEFT JOIN events ON category = event_type AND date_diff('second', date_trunc('second', ts), TIMESTAMP '{AS_OF}') > days * 86400)
SELECT category, count(event_id) FILTER (NOT safe) AS planned, count(event_id) FILTER (safe) AS protected FROM e GROUP BY 1""",
    "stale_empty_keys": """
WITH e AS (SELECT event_id, md5(event_id::VARCHAR) AS h, ts, event_type, value FROM events)
SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS name FROM e
WHERE event_id % 11 <> 0 AND event_type <> 'error' AND value < 50 AND event_id % 4 <> 0 AND date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-20 00:00:00') > 3600""",
    "empty_prefixes": """
WITH k AS (SELECT 'r/n' || c_nationkey AS n, 'r/n' || c_nationkey || '/k' || c_custkey AS path, c_acctbal > 5000 AS live FROM customer)
SELECT path FROM k WHERE NOT live UNION SELECT n FROM k GROUP BY n HAVING NOT bool_or(live)""",
}
