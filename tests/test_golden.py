"""Decisions that the three rule sets must give. Commands and the decision on each."""

import re

from tidemill.operators import screening

VCS_DENIED = [
    "git checkout -- src/a.ts", "git checkout HEAD -- f", "git checkout --ours -- f", "git -C /tmp/r checkout -- .", "git -c core.x=1 checkout -- f", "git checkout\t--\tf", "digit checkout -- f",
    "git checkout --", "git checkout x -- f; ls", "git checkout" + " " * 30 + "\u2003" + " " * 30 + "; git restore f",
    "git restore f", "git restore --staged --worktree f", "git restore --staged -W f", "git restore -S f", "git restore-x", "git -C git restore f", "git restore\xb2 f", "git restore\u2163 f",
    "git restore\u3007 f", "git restore f; echo --staged --worktree\xb2", "git restore --staged -W\u2460 f", "git restore\ufeff f", "git restore\xa0f", "git\u3000restore\u2003f", "git restore\u000bf",
    "git restore\u000cf", "git restore\u2028f", "git restore\u0085f", "git restore\u088f f", "git restore\xbc f",
    "git reset --hard", "git reset HEAD~1; echo --hard", "git reset\n--hard", "git reset\xb2 --hard", "git reset\u2003--hard", "git reset\xa0--hard", "git -C a -C b -c x=y --no-pager reset --hard",
    "ls && git -C /d reset --hard HEAD",
    "git clean -fd", "git clean -n1 -f", "git clean\xbc -f", "echo git; git clean -f", "git clean -d; rm -f x", "git rest\0ore f", "git restore f\n\n",
]
VCS_ALLOWED = [
    "git checkout x;y -- f", "git -C checkout -- f", "git checkout main", "git checkout -b feature", "git checkout --track origin/x", "git checkout main && echo -- x", "git checkout main | tee -- out",
    "git restore --staged f", "git restore --staged f -Wall", "git restore . && git diff --staged", "git restored", "git restore\xe9 f", "git restore\u0663 f", "git\ufeffrestore f", "git restore_ f", "git restore\u0e01 f",
    "git reset --soft HEAD~1", "git reset --hard-not-really", "git reset\u0663 --hard", 'git commit -m "reset --hard"', "git --unknown reset --hard", "git -C reset --hard", "git --git-dir= reset --hard", "git -pX reset --hard",
    "git clean -n", "git clean -fdn", "git clean --dry-run --force", "git clean -fz9", "git clean --force=1", "find . -name x; git clean -fd", "git clean -d", "git clean -Fd", "git -c clean.requireForce=false clean -d", "git cleanup -f",
    "git status", "git push --force", "", "\n", "git status\0",
]
VCS_MIXED = ["git restore --staged\xb2 f"]
COMPILED = [
    ("tsc", None), ("tsc --noEmit", None), ("tsc src/a.ts", "tsc"), ("npx tsc a.tsx", "tsc"), ("pnpm dlx tsc a.ts", "tsc"), ("pnpm dlx  tsc a.ts", "tsc"), ("yarn tsc a.ts", "tsc"), ("bunx tsc a.ts", "tsc"),
    ("tsc -p tsconfig.json", None), ("tsc -p a.ts", None), ("tsc --outFile out.ts --noEmit", None), ("tsc -b a.ts", "tsc"), ("tsc a.mts", None), ("tsc a.d.ts", "tsc"), ('tsc "a.ts"', None), ("tsc a.ts;", None),
    ("tsc --noEmit && git add foo.ts", "tsc"), ("tsc --noEmit | head -50", None), ("cp a.ts b.ts\ntsc --noEmit", "tsc"), ("foo;tsc a.ts", "tsc"), ("./node_modules/.bin/tsc a.ts", None), ("npxtsc a.ts", "tsc"),
    ("mytsc a.ts", None), ("tsc --noEmit a.ts", "tsc"), ("echo tsc a.ts", "tsc"), ("tsc src/*", None), ("tsc nomatch*.ts", "tsc"), ("tsc nomatch*", None), ('tsc "src/*"', None), (" " * 40 + "echo ok\ntsc a.ts", "tsc"),
    ("tsrs a.ts", "tsrs"), ("tsrs --noEmit src/a.tsx", "tsrs"), ("bunx tsrs a.ts", "tsrs"), ("npx tsrs a.ts", "tsrs"), ("false && tsrs a.ts", "tsrs"), ("tsrs --noEmit", None), ("tsrs -p tsconfig.json", None),
    ("tsrs -p tsconfig.types.json", None), ("tsrs --fast --noEmit", None), ("tsrs --lsp --stdio", None), ("tsrs-lint a.ts", None), ("node node_modules/tsrs/bin/tsrs a.ts", None), ("tsrs nomatch*.ts", "tsrs"),
    ("tsc --noEmit && tsrs a.ts", "tsrs"), ("tsrs --noEmit && tsc a.ts", "tsc"), ("", None),
]
DEPLOYS = [
    ("serverless deploy", True), ("sls deploy", True), ("npx serverless deploy --stage prod", True), ("sls deploy function -f x", True), ("serverless\ndeploy", True), ("sls\tdeploy", True), ("sls\xa0deploy", True),
    ("sls\ufeffdeploy", False), ("serverless deployment", True), ('echo "sls deploy"', True), ("jsls deploy", True), ("sls package", False), ("slsdeploy", False), ("SLS deploy", False), ("cdk deploy", False),
    ("sls  --verbose deploy", False), ("", False), ("sls\0 deploy", True), ("sls\u0085deploy", False), ("sls\u3000deploy", True), ("sls\u200bdeploy", False), ("\U0001f600sls deploy", True), ("serverless deploy \U0001f600", True),
]


def decided(spark, screen, commands, column):
    rows = spark.createDataFrame(list(enumerate(commands)), "i int, c string")
    return [r[column] for r in screen(rows, "c").orderBy("i").collect()]


def test_destructive_commands(spark):
    got = decided(spark, screening.screen_vcs_commands, VCS_DENIED, "rule")
    assert [c for c, r in zip(VCS_DENIED, got, strict=True) if r is None] == []
    got = decided(spark, screening.screen_vcs_commands, VCS_ALLOWED + VCS_MIXED, "rule")
    assert [c for c, r in zip(VCS_ALLOWED + VCS_MIXED, got, strict=True) if r is not None] == []


def test_compiler_calls(spark):
    got = decided(spark, screening.screen_compiler_commands, [c for c, _ in COMPILED], "tool")
    assert [(c, g) for (c, t), g in zip(COMPILED, got, strict=True) if g != t] == []


def test_deploys(spark):
    got = decided(spark, screening.screen_deploys, [c for c, _ in DEPLOYS], "denied")
    assert [(c, g) for (c, t), g in zip(DEPLOYS, got, strict=True) if g != t] == []


def test_options_are_passed_over(spark):
    """Every option alone, with its value as a word, and with it in the word, reaches the subcommand; cut short it doesn't."""
    reach = [*screening.ALONE, *[f"{o} v" for o in (*screening.VALUED, "-C", "-c")], *[f"{o}=v" for o in screening.VALUED], *[f"{o}v" for o in screening.GLUED], "-Cv", "-cv=1"]
    miss = [*screening.VALUED, *[f"{o}=" for o in screening.VALUED], "-C", "--pag", "-x"]
    assert all(screening.subcommands(f"git {o} restore") == {"restore"} for o in reach)
    assert [o for o in miss if screening.subcommands(f"git {o} restore")] == []


def test_long_compiler_commands_are_linear(spark):
    import time

    command = "tsc " + "-p a.ts " * 100_000
    begun = time.perf_counter()
    assert decided(spark, screening.screen_compiler_commands, [command], "tool") == [None]
    assert time.perf_counter() - begun < 30
    assert re.fullmatch("tsrs", decided(spark, screening.screen_compiler_commands, [command + "; tsrs b.ts"], "tool")[0])
