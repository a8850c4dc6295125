"""Column expressions that judge SQL text. All run inside the JVM, row by row.

Patterns are written once; `U` makes word and space classes Unicode-aware and
`d` makes a line end at a newline only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values ------------------------------------------------------------------------------

WHITELIST = (
    r"^\s*select\s+\*\s+from\s+\w+\s*;?\s*$",
    r"^\s*select\s+[\w\s,]+from\s+\w+\s*;?\s*$",
    r"^\s*select\s+[\w\s,]+from\s+\w+\s+where\s+[\w\s=<>'\"()]+;?\s*$",
    r"^\s*select\s+.*?\s+from\s+\w+\s+limit\s+\d+\s*;?\s*$",
    r"^\s*select\s+.*?\s+from\s+\w+\s+order\s+by\s+\w+\s*;?\s*$",
    r"^\s*with\s+\w+\s+as\s*\(.*?\)\s*select\s+.*?\s*;?\s*$",
    r"^\s*explain\s+(analyze\s+)?\s*select\s+.*?\s*;?\s*$",
)
COMMENT_DANGER = (
    r"\b(drop|delete|truncate|alter|create|insert|update|exec|execute|union|or\s+1\s*=\s*1)\b"
)
DANGEROUS = (
    r";\s*--",
    r"/\*.*?\*/",
    r"\bunion\b\s+all\s+\bselect\b",
    r"\bunion\b\s+\bselect\b.*?\bfrom\b.*?\bwhere\b.*?\b1\s*=\s*1\b",
    r"\bor\b\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+['\"]?\s*--",
    r"\bor\b\s+['\"]?1['\"]?\s*=\s*['\"]?1['\"]?\s*--",
    r"\band\b\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+['\"]?\s*--",
    r"\bpg_sleep\b\s*\(",
    r"\bsleep\b\s*\(",
    r"\bwaitfor\b\s+delay\b",
    r"\bxp_cmdshell\b",
    r"\bexec\b\s*\(.*?xp_cmdshell",
    r"\bexecute\b\s*\(.*?xp_cmdshell",
    r";\s*\b(insert|update|delete|drop|create|alter|truncate)\b",
    r"\binformation_schema\b.*?\bunion\b",
    r"0x[0-9a-f]+.*?\bunion\b",
)
SUSPICIOUS = (
    r"union.*select",
    r"or\s+1\s*=\s*1",
    r"and\s+1\s*=\s*1",
    r"exec\s*\(",
    r"execute\s*\(",
    r"pg_sleep",
    r"sleep\s*\(",
    r"information_schema",
    r"0x[0-9a-f]+",
    r"--",
    r"/\*",
)
# A plain text without which the pattern at the same place cannot match.
DANGEROUS_NEEDS = (
    "--", "/*", "union", "union", "--", "--", "--", "pg_sleep", "sleep", "waitfor",
    "xp_cmdshell", "xp_cmdshell", "xp_cmdshell", ";", "information_schema", "0x",
)
SUSPICIOUS_NEEDS = (
    "union", "or", "and", "exec", "execute", "pg_sleep", "sleep", "information_schema", "0x", "--", "/*",
)
FORBIDDEN = ("drop", "truncate", "alter", "grant", "revoke", "copy", "create", "delete", "update", "insert")
CATALOG_NAMES = ("information_schema", "pg_catalog")
SAFE_STARTS = ("select", "with", "explain")
FEATURE_WORDS = (
    "select", "union", "insert", "update", "delete", "drop", "sleep", "pg_sleep", "benchmark",
    "--", "/*", "*/", ";", "or", "and", "information_schema",
)
BANNED_IN_NAME = ("'", '"', ";", "--", "/*", "*/", "\\", "\x00")
BANNED_CALLS = ("pg_sleep", "sleep", "exec", "execute", "xp_cmdshell", "load_file")
LONGEST_QUERY = 10000
MOST_QUOTES = 20
MOST_SPECIALS = 20
LONGEST_NAME = 100
MOST_FILTER_QUOTES = 10
THRESHOLD = 0.7367346938775511
STRICT_THRESHOLD = 0.65

EMPTY = "Empty query after normalization"
STACKED = "Multiple statements detected (stacked queries)"
NOT_SELECT = "Non-SELECT statement is forbidden"
KEYWORD = "Forbidden keyword used as command: "
PATTERN = "Matched dangerous pattern: "
TOO_LONG = "Query too long (possible injection attempt)"
BAD_CHARACTER = "Suspicious character detected: "
TOO_MANY_QUOTES = "Too many quotes (possible injection attempt)"

# Building blocks ---------------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f]"


def _raw(pattern: str) -> str:
    """A pattern for raw text, where the separators 1c to 1f are whitespace too."""
    return pattern.replace(r"\s", _SPACE)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _java(pattern: str, flags: str) -> str:
    return f"(?{flags}){pattern}"


def matches(column: Column, pattern: str, flags: str = "iU", needs: str | None = None) -> Column:
    """Whether the pattern is found.

    `needs` is a lower-case text the pattern cannot match without; looking for it
    first spares most texts the pattern. Beyond ASCII a letter may match in
    another form, so such texts always get the pattern.
    """
    found = column.rlike(_java(pattern, flags))
    if needs is None:
        return found
    beyond = F.octet_length(column) != F.length(column)
    return (F.contains(column, F.lit(needs)) | beyond) & found


def occurrences(column: Column, text: str) -> Column:
    """Times a plain text occurs, not counting overlaps."""
    gone = F.length(F.replace(column, F.lit(text), F.lit("")))
    return ((F.length(column) - gone) / len(text)).cast("int")


def normalized(sql: Column) -> Column:
    """Comments dropped, whitespace runs made one blank, ends trimmed."""
    out = F.regexp_replace(sql, r"(?md)--.*?$", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, rf"(?U){_SPACE}+", " ")
    return F.trim(out)


def dangerous_comment(sql: Column) -> Column:
    """True where a comment of the raw text names a command or `or 1=1`."""
    lines = F.regexp_extract_all(sql, F.lit(r"(?md)--.*?$"), F.lit(0))
    blocks = F.regexp_extract_all(sql, F.lit(r"(?s)/\*.*?\*/"), F.lit(0))
    bad = F.exists(F.concat(lines, blocks), lambda c: matches(c, _raw(COMMENT_DANGER)))
    return (F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))) & bad


def whitelisted(sql: Column, clean: Column) -> Column:
    """`clean` is the normalised lower-case text."""
    needs = ("select",) * 5 + ("with", "explain")
    hit = _any([matches(clean, p, "iUs", n) for p, n in zip(WHITELIST, needs)])
    return hit & ~dangerous_comment(sql)


def structure_reason(sql: Column, clean: Column) -> Column:
    """Reason to refuse for size or odd characters, NULL when there is none."""
    return (
        F.when(F.length(clean) > LONGEST_QUERY, TOO_LONG)
        .when(F.instr(sql, "\x00") > 0, BAD_CHARACTER + "'\\x00'")
        .when(F.instr(sql, "\x1a") > 0, BAD_CHARACTER + "'\\x1a'")
        .when((occurrences(sql, "'") > MOST_QUOTES) | (occurrences(sql, '"') > MOST_QUOTES), TOO_MANY_QUOTES)
    )


def stacked(clean: Column) -> Column:
    """More than one statement: several semicolons or one before the end, and several parts."""
    ends = occurrences(clean, ";")
    parts = F.filter(F.split(clean, ";"), lambda p: F.trim(p) != "")
    many = (ends > 1) | ((ends == 1) & ~clean.endswith(";"))
    return many & (F.size(parts) > 1)


def safe_start(clean: Column) -> Column:
    return _any([clean.startswith(s) for s in SAFE_STARTS])


def forbidden_hits(clean: Column) -> Column:
    """Sorted forbidden keywords used as commands.

    A keyword whose first occurrence is inside an open quote does not count, and
    none counts in a text that names the system catalog.
    """
    def hit(word: str) -> Column:
        before = F.substring(clean, F.lit(1), F.instr(clean, word) - 1)
        odd = (occurrences(before, "'") % 2 == 1) | (occurrences(before, '"') % 2 == 1)
        used = matches(clean, rf"(^|\s|;)\b{word}\b(\s|\(|;|$)", needs=word)
        return F.when(used & ~odd, F.lit(word))

    hits = F.filter(F.array(*[hit(w) for w in sorted(FORBIDDEN)]), lambda w: w.isNotNull())
    names_catalog = _any([F.contains(clean, F.lit(n)) for n in CATALOG_NAMES])
    return F.when(names_catalog, F.array().cast("array<string>")).otherwise(hits)


def first_pattern(clean: Column) -> Column:
    """The first dangerous pattern found, NULL when there is none."""
    return F.coalesce(
        *[F.when(matches(clean, p, needs=n), F.lit(p)) for p, n in zip(DANGEROUS, DANGEROUS_NEEDS)]
    )


def rule_reason(clean: Column, hits: Column, pattern: Column) -> Column:
    """Reason to refuse by the rules in their order, NULL when they pass."""
    return (
        F.when(clean == "", EMPTY)
        .when(stacked(clean), STACKED)
        .when(~safe_start(clean), NOT_SELECT)
        .when(F.size(hits) > 0, F.concat(F.lit(KEYWORD), F.array_join(hits, ", ")))
        .when(pattern.isNotNull(), F.concat(F.lit(PATTERN), pattern))
    )


def suspicious(sql: Column) -> Column:
    low = F.lower(sql)
    specials = F.regexp_count(sql, F.lit(r"[()\[\]{}\"'`;]"))
    found = [matches(low, _raw(p), "iUd", n) for p, n in zip(SUSPICIOUS, SUSPICIOUS_NEEDS)]
    return _any(found) | (specials > MOST_SPECIALS)


def features(sql: Column) -> dict[str, Column]:
    """The ten lexical features of a text."""
    q = F.lower(sql)
    specials = F.regexp_count(q, F.lit("['\";-]"))
    words = reduce(lambda a, b: a + b, [F.contains(q, F.lit(w)).cast("int") for w in FEATURE_WORDS])
    return {
        "length": F.length(q),
        "num_quotes": occurrences(q, "'") + occurrences(q, '"'),
        "num_comments": F.regexp_count(q, F.lit(r"--|/\*|\*/")),
        "num_semicolons": occurrences(q, ";"),
        "has_union": F.contains(q, F.lit("union select")).cast("int"),
        "has_or_true": matches(q, _raw(r"or\s+1\s*=\s*1"), "U", "or").cast("int"),
        "num_keywords": words,
        "special_char_ratio": specials / F.greatest(F.length(q), F.lit(1)),
        "num_sleep": matches(q, "sleep|pg_sleep|benchmark").cast("int"),
        "num_subqueries": occurrences(q, "(") - occurrences(q, ")"),
    }
