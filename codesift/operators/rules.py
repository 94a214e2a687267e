"""Rules over source lines and calls: a table of patterns, applied inside the JVM.

A rule with ``call`` looks at calls, whose arguments may go over several lines
(with one more level of brackets inside); the others look at single lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "rs": "rust"}
# Names of secrets, and values that are none.
_NAMES = "password|secret|api_key|apikey|private_key|token|database_url"
_JS_NAMES = "password|secret|apikey|api_key|private_key|token"
_NONE = r"=\s*[\"'`](?:changeme|xxx|your-key-here)[\"'`]"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    severity: str
    category: str
    pattern: str
    unless: str = ""
    call: str = ""


# Rule ids, severities and categories of the scanner; patterns stay within what RE2 also reads.
RULES = (
    Rule("python-sqli-fstring", "python", "CRITICAL", "A03", r"(?i)(?:\bf[\"'].*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP) .*\{|\b(?:SELECT|INSERT|UPDATE|DELETE) .*f[\"']|f[\"'].*\b(?:SELECT|INSERT|UPDATE|DELETE) )"),
    Rule("python-sqli-concat", "python", "CRITICAL", "A03", r"(?i)(?:[\"'][^\"']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP) [^\"']*[\"']\s*\+|\+\s*[\"'][^\"']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP) )", r"\bf[\"']"),
    Rule("python-hardcoded-secret", "python", "HIGH", "A07", rf"(?i)^\s*[\w.]*(?:{_NAMES})\w*\s*(?::\s*\w+\s*)?=\s*[rRbBuU]?[\"'][^\"']+[\"']", _NONE),
    Rule("python-unsafe-pickle", "python", "CRITICAL", "A08", r"\bpickle\.loads?\("),
    Rule("python-unsafe-yaml", "python", "HIGH", "A08", "", r"SafeLoader|safe_load", r"\byaml\.(?:load|unsafe_load)\("),
    Rule("python-eval-exec", "python", "CRITICAL", "A03", r"(?:^|[^.\w])(?:eval|exec)\("),
    Rule("python-cmd-injection", "python", "CRITICAL", "A03", r"\bos\.(?:system|popen)\("),
    Rule("python-subprocess-shell", "python", "HIGH", "A03", r"shell\s*=\s*True", "", r"\bsubprocess\.(?:call|run|Popen)\("),
    Rule("js-xss-innerhtml", "javascript", "HIGH", "A03", r"\.innerHTML\s*=[^=]"),
    Rule("js-xss-dangerous-html", "javascript", "HIGH", "A03", r"\bdangerouslySetInnerHTML\b"),
    Rule("js-xss-document-write", "javascript", "HIGH", "A03", r"\bdocument\.write\("),
    Rule("js-eval", "javascript", "CRITICAL", "A03", r"(?:^|[^.\w])eval\("),
    Rule("js-hardcoded-secret", "javascript", "HIGH", "A07", rf"(?i)\b(?:const|let|var)\s+\w*(?:{_JS_NAMES})\w*\s*(?::\s*\w+\s*)?=\s*[\"'`][^\"'`]+[\"'`]", r"=\s*[\"'`](?:changeme|xxx)[\"'`]"),
    Rule("go-sqli-sprintf", "go", "CRITICAL", "A03", r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE) ", "", r"\bfmt\.Sprintf\("),
    Rule("go-cmd-injection", "go", "HIGH", "A03", r"\bexec\.Command(?:Context)?\("),
)
# What is read of a call: its name and, to one level of brackets within, its arguments.
ARGUMENTS = r"^[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*"
MARK = "\u0001"
COMMENT = r"^\s*(?:#|//|\*|/\*)"


def language_of(path: Column) -> Column:
    """Language by extension, or null."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def code_lines(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, repo_name, language, line_no, line) of every line that is no comment, in the languages with rules."""
    rows = chunks.select(key, "repo_name", language_of(F.col("file_path")).alias("language"), "content").where("language IS NOT NULL AND content IS NOT NULL")
    lines = rows.select(key, "repo_name", "language", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1).where(~F.col("line").rlike(COMMENT))


def _hit(rule: Rule) -> Column:
    return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"))


def _broken(rule: Rule, text: Column) -> Column:
    met = text.rlike(rule.pattern) if rule.pattern else F.lit(True)
    return met & ~text.rlike(rule.unless) if rule.unless else met


def scan(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The lines with (rule_id, severity, category) of each rule of lines they break.

    The rules are constants of the plan, so a line is read once and matched
    against the rules of its language without a join.
    """
    hits = F.array(*[F.when((F.col("language") == r.language) & _broken(r, F.col("line")), _hit(r)) for r in rules if not r.call])
    found = F.filter(hits, lambda h: h.isNotNull())
    return lines.select("*", F.explode(found).alias("hit")).select(*lines.columns, "hit.*")


def scan_calls(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "chunk_id") -> DataFrame:
    """(key, line_no, rule_id, severity, category): the calls that break a rule of calls, by the line on which they begin.

    The text is cut before each call's name; a call is then the head of its part.
    """
    rows = chunks.select(key, language_of(F.col("file_path")).alias("language"), F.replace("content", F.lit(MARK), F.lit(" ")).alias("content")).where("language IS NOT NULL AND content IS NOT NULL")
    found = None
    for rule in (r for r in rules if r.call):
        own = rows.where((F.col("language") == rule.language) & F.col("content").rlike(rule.call))
        parts = own.select(key, F.split(F.regexp_replace("content", f"({rule.call})", f"{MARK}$1"), MARK, -1).alias("parts"))
        each = parts.select(key, "parts", F.posexplode("parts").alias("nth", "text")).where("nth > 0")
        before = F.array_join(F.slice("parts", F.lit(1), F.col("nth")), "")
        each = each.select(key, "text", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line_no"), F.substring_index(before, "\n", -1).alias("left"))
        call = F.regexp_extract("text", ARGUMENTS, 0)
        hits = each.where(~F.col("left").rlike(COMMENT) & _broken(rule, call)).select(key, "line_no", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"))
        hits = hits.distinct()
        found = hits if found is None else found.unionByName(hits)
    return found


def scan_chunks(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "chunk_id") -> DataFrame:
    """(key, line_no, rule_id, severity, category): the lines and the calls of (key, repo_name, file_path, content) that break a rule."""
    lines = scan(code_lines(chunks, key), rules).select(key, "line_no", "rule_id", "severity", "category")
    calls = scan_calls(chunks, rules, key)
    return lines if calls is None else lines.unionByName(calls)
