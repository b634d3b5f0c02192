"""Rule screening of command and call logs."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import SPACE, norm_command

# The version-control tool's options, as a chain of them may stand before a subcommand.
ALONE = {"-p", "--paginate", "-P", "--no-pager", "--no-optional-locks", "--no-replace-objects", "--literal-pathspecs", "--glob-pathspecs", "--noglob-pathspecs", "--icase-pathspecs", "--bare", "--exec-path"}
VALUED = ("--git-dir", "--work-tree", "--namespace")
GLUED = ("--super-prefix=", "--config-env=", "--exec-path=")
# Compiler options whose value is the next word.
TAKES_NEXT = ("-p", "--project", "--outDir", "--outFile", "--rootDir", "--baseUrl", "--declarationDir", "--tsBuildInfoFile")
COMPILERS, RUNNERS = ("tsc", "tsrs"), ("", "npx", "pnpm", "yarn")
BOUNDARY = r"(?![\p{L}\p{Nd}_])"
REASONS = {"checkout": "discards changes in the working tree", "restore": "overwrites files in the working tree", "reset": "a hard reset loses uncommitted work", "clean": "a forced clean deletes untracked files"}

_TOKEN = re.compile(f"[^{SPACE[1:-1]}]+")


def _ends_word(line: str, i: int) -> bool:
    c = line[i : i + 1]
    return not (c == "_" or c.isalpha() or c.isdecimal())


#: How many words an option takes, itself included, by its whole text.
WIDTH = dict.fromkeys(ALONE, 1) | dict.fromkeys(("-C", "-c", *VALUED), 2)
#: Options whose value is part of the word: how the word begins.
WITHIN = ("-C", "-c", *GLUED, *(f"{name}=" for name in VALUED))


def _option_width(token: str) -> int:
    """The width of a token as an option, 0 for any other word."""
    return WIDTH.get(token) or int(any(len(token) > len(x) and token.startswith(x) for x in WITHIN))


def subcommands(line: str) -> set[str]:
    """Destructive subcommands that a line reaches from a token ending in ``git`` over global options only; what ``scanned`` is tested by.

    One pass from the left: a token is reached if the one before ends in ``git``, or if an option that was reached
    itself takes just the tokens between.
    """
    spans = [m.span() for m in _TOKEN.finditer(line)]
    text = [line[a:b] for a, b in spans]
    dashes = [a for (a, _), t in zip(spans, text, strict=True) if t == "--"]
    stops = [m.start() for m in re.finditer("[|&;]", line)]
    reached, found = {}, set()
    for t, token in enumerate(text):
        if t and text[t - 1].endswith("git"):
            reached[t] = True
        if not reached.pop(t, False):
            continue
        a, b = spans[t]
        if token == "checkout":
            d, s = bisect_left(dashes, b), bisect_left(stops, b)
            if d < len(dashes) and (s == len(stops) or stops[s] > dashes[d]):
                found.add(token)
        found |= {s for s in ("restore", "reset", "clean") if token.startswith(s) and _ends_word(line, a + len(s))}
        if width := _option_width(token):
            reached[t + width] = True
    return found


def _one_of(token: Column, words: list[str]) -> Column:
    return token.isin(*sorted(words))


def scanned(cmd: Column) -> Column:
    """The same as ``subcommands`` over all lines of a command, as one native expression: a struct of a flag a subcommand.

    A fold over the tokens. Its state holds which of the next two tokens are reached, whether the last ended in ``git``,
    and whether a reached ``checkout`` still waits for its ``--``; the end of a line takes all of that back.
    """
    tokens = F.flatten(F.transform(F.split(cmd, "\n", -1), lambda line: F.concat(F.filter(F.split(line, f"{SPACE}+", -1), lambda t: t != ""), F.array(F.lit("\n")))))
    names = ("next", "second", "tool", "open", "checkout", "restore", "reset", "clean")
    state = lambda *flags: F.struct(*[x.alias(n) for x, n in zip(flags, names, strict=True)])
    no = F.lit(False)

    def step(s: Column, t: Column) -> Column:
        reached = s["next"] | s["tool"]
        one = _one_of(t, [w for w, n in WIDTH.items() if n == 1])
        two = _one_of(t, [w for w, n in WIDTH.items() if n == 2])
        for x in WITHIN:
            one = one | (t.startswith(x) & (F.length(t) > len(x)) & ~two)
        begins = lambda name: s[name] | (reached & t.startswith(name) & t.rlike(f"^{name}{BOUNDARY}"))
        found = s["checkout"] | (s["open"] & (t == "--"))
        still = (s["open"] & ~t.rlike("[|&;]")) | (reached & (t == "checkout"))
        on = state(s["second"] | (reached & one), reached & two, t.endswith("git"), still, found, *[begins(n) for n in names[5:]])
        return F.when(t == "\n", state(no, no, no, no, *[s[n] for n in names[4:]])).otherwise(on)

    return F.aggregate(tokens, state(*[no] * len(names)), step)


def screen_vcs_commands(df: DataFrame, cmd_col: str) -> DataFrame:
    """Adds rule and reason for destructive version-control commands; null where there is no objection. Native expressions only."""
    cmd = F.coalesce(norm_command(cmd_col), F.lit(""))
    out = df.withColumn("hits@", F.when(cmd.contains("git") & cmd.rlike("checkout|restore|reset|clean"), scanned(cmd)))
    has = lambda s: F.coalesce(F.col("hits@")[s], F.lit(False))
    words = F.split(cmd, SPACE)
    flag = lambda letter: F.exists(words, lambda w: w.rlike(f"^-[a-zA-Z]*{letter}[a-zA-Z]*\\z"))
    staged = cmd.rlike(rf"--staged{BOUNDARY}") & ~cmd.rlike(rf"--worktree{BOUNDARY}|-W{BOUNDARY}")
    hard = cmd.rlike(rf"--hard(?:{SPACE}|\n|\z)")
    dry, force = F.array_contains(words, "--dry-run") | flag("n"), F.array_contains(words, "--force") | flag("f")
    rule = F.when(has("checkout"), "checkout").when(has("restore") & ~staged, "restore").when(has("reset") & hard, "reset").when(has("clean") & ~dry & force, "clean")
    reason = F.lit(None).cast("string")
    for k, v in REASONS.items():
        reason = F.when(F.col("rule") == k, v).otherwise(reason)
    return out.withColumn("rule", rule).withColumn("reason", reason).drop("hits@")


def screen_compiler_commands(df: DataFrame, cmd_col: str) -> DataFrame:
    """Adds denied and tool (the compiler named last) for compiler calls that name .ts or .tsx files.

    A command calls a compiler if the last part of some word (after a pipe, a semicolon or an ampersand) is one's name,
    a runner's name before it or not. Of each line the words after its last compiler count, or all if it has none; a word that
    is an option's value does not.
    """
    cmd = F.coalesce(norm_command(cmd_col), F.lit(""))
    ends = F.transform(F.split(cmd, SPACE), lambda w: F.element_at(F.split(w, "[|;&]", -1), -1))
    called = F.filter(ends, lambda w: w.isin(*[r + t for r in RUNNERS for t in COMPILERS]))
    after = F.transform(F.split(cmd, "\n", -1), lambda line: F.element_at(F.split(line, rf"(?<![^{SPACE[1:-1]}])(?:{'|'.join(COMPILERS)})(?:{SPACE}|\z)", -1), -1))
    words = F.filter(F.split(F.array_join(after, "\n"), r"[ \t\n]+"), lambda w: w != "")
    state = lambda skip, hit: F.struct(skip.alias("skip"), hit.alias("hit"))
    source = lambda w: ~w.startswith("-") & (w.endswith(".ts") | w.endswith(".tsx"))
    step = lambda a, w: F.when(a["skip"], state(F.lit(False), a["hit"])).otherwise(state(w.isin(*TAKES_NEXT), a["hit"] | (~w.isin(*TAKES_NEXT) & source(w))))
    named = F.aggregate(words, state(F.lit(False), F.lit(False)), step)["hit"]
    tool = F.when(F.element_at(called, -1).endswith(COMPILERS[1]), COMPILERS[1]).otherwise(COMPILERS[0])
    return df.withColumn("denied", (F.size(called) > 0) & named).withColumn("tool", F.when(F.col("denied"), tool))


def screen_deploys(df: DataFrame, cmd_col: str) -> DataFrame:
    """Adds denied for deploy commands: case-sensitive, whole string, no word boundaries."""
    return df.withColumn("denied", F.coalesce(norm_command(cmd_col, strip=False).rlike(f"(?:serverless|sls){SPACE}+deploy"), F.lit(False)))


def audit_calls(df: DataFrame, routes: list[str], entrypoints: list[str]) -> DataFrame:
    """Adds problems and decision to calls (tool_name, entrypoint, tool_input struct of subagent_type, effort, model)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    routed = F.coalesce(F.col("tool_name"), F.lit("Agent")).isin("Agent", "Task") & F.coalesce(F.col("tool_input.subagent_type").isin(*routes), F.lit(False))
    none = F.when(routed & blank("tool_input.effort") & F.coalesce(F.col("entrypoint").isin(*entrypoints), F.lit(False)), "effort is missing")
    model = F.when(routed & ~blank("tool_input.model"), "model is given")
    out = df.withColumn("problems", F.array_compact(F.array(none, model)))
    return out.withColumn("decision", F.when(F.size("problems") > 0, "deny").otherwise("allow"))


def screen_report(screened: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """Rows, violations and rate for every level of ``by``, subtotals included; ``level`` tells which columns are summed over."""
    out = screened.cube(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("violations"), F.grouping_id().alias("level"))
    return out.withColumn("rate", F.col("violations") / F.col("n"))


def allowlisted(df: DataFrame, primary: DataFrame, secondary: DataFrame, infra: list[str], name: str) -> DataFrame:
    """Adds allowed: the part before the first colon is a plain name in primary, or in secondary and not in ``infra``."""
    part = F.substring_index(F.col(name), ":", 1)
    out = df.withColumn("part@", F.when(part.rlike(r"^[A-Za-z0-9_-]+\z"), part))
    one = primary.select(F.col("name").alias("part@")).distinct().withColumn("p@", F.lit(True))
    two = secondary.select(F.col("name").alias("part@")).distinct().withColumn("s@", F.lit(True))
    out = out.join(one, "part@", "left").join(two, "part@", "left")
    ok = F.coalesce("p@", F.lit(False)) | (F.coalesce("s@", F.lit(False)) & ~F.coalesce(F.col("part@").isin(*infra), F.lit(False)))
    return out.withColumn("allowed", ok).drop("part@", "p@", "s@")
