"""Text expressions: tokens, n-grams, normalisation and token budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII words, or runs of CJK ideographs; everything else, accented letters included, separates.
TOKEN = r"[0-9A-Za-z]+|[\x{4e00}-\x{9fff}]+"
IDEOGRAPH = r"[\x{4e00}-\x{9fff}]"


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters; empty for texts of fewer than two."""
    n = F.length(text)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Search tokens in order: ASCII words in lower case, CJK runs as bigrams (a single ideograph as itself)."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    one = lambda r: F.when(r.rlike(r"^[0-9A-Za-z]"), F.array(F.lower(r))).when(F.length(r) == 1, F.array(r)).otherwise(bigrams(r))
    # Texts without ideographs, most of them, need no look at each run.
    return F.when(text.rlike(IDEOGRAPH), F.flatten(F.transform(runs, one))).otherwise(F.transform(runs, F.lower))


def coverage_grams(text: Column) -> Column:
    """The set behind lexical coverage: ASCII words in lower case and CJK bigrams, no single ideographs."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    one = lambda r: F.when(r.rlike(r"^[0-9A-Za-z]"), F.array(F.lower(r))).otherwise(bigrams(r))
    return F.array_distinct(F.flatten(F.transform(runs, one)))


def lexical_coverage(query: Column, text: Column) -> Column:
    """Share of the query's grams that the text has; 0 for a query without any."""
    wanted = coverage_grams(query)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, coverage_grams(text))) / F.size(wanted).cast("double"))


def dice(a: Column, b: Column) -> Column:
    """Twice the common grams over the grams of both; 0 if either has none."""
    x, y = coverage_grams(a), coverage_grams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def normalize_document(text: Column) -> Column:
    """Without byte order mark, with LF line ends, no trailing white space in lines, none around the text."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\x{feff}", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalize_question(text: Column) -> Column:
    """One line without leading '#'; empty unless 4 to 120 characters long."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    out = F.trim(F.regexp_replace(out, "^#+", ""))
    return F.when(F.length(out).between(4, 120), out).otherwise("")


def normalize_answer(text: Column) -> Column:
    """Trimmed lines without headings of level 2 and 3; empty unless 20 to 1200 characters long."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~(x.startswith("## ") | x.startswith("### ")))
    out = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    return F.when(F.length(out).between(20, 1200), out).otherwise("")


def estimate_tokens(text: Column) -> Column:
    """A quarter of each ASCII run's length, rounded down, and one for each other character; at least 1 unless blank."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7f]+"), F.lit(0))
    quarters = F.aggregate(F.transform(runs, lambda r: F.floor(F.length(r) / 4).cast("int")), F.lit(0), lambda a, x: a + x)
    ascii_chars = F.aggregate(F.transform(runs, F.length), F.lit(0), lambda a, x: a + x)
    total = quarters + F.length(text) - ascii_chars
    return F.greatest(total, F.when(text.rlike(r"\S"), 1).otherwise(0))


#: Shares of a context window and the most that each may take; fixed values.
SHARES = {"system": (0.20, 8192), "memory": (0.10, 8192), "dialog": (0.50, 65536), "output_reserve": (0.20, None)}


def budget_shares(window: Column) -> dict[str, Column]:
    at_least = F.greatest(window, F.lit(1024))
    out = {}
    for name, (share, cap) in SHARES.items():
        part = F.floor(at_least * F.lit(share)).cast("long")
        out[name] = part if cap is None else F.least(part, F.lit(cap).cast("long"))
    return out


def clean_context(text: Column, most: int = 200) -> Column:
    """One line without quotes around it; if too long, cut after the last sentence end that fits, else at the limit."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r'^["\'“”]+|["\'“”]+$', "")
    head = F.substring(out, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*[。！？；.!?;])", 1)
    return F.when(F.length(out) <= most, out).when(cut != "", cut).otherwise(head)


def truncate_summary(text: Column, most: int = 200, marker: str = "…") -> Column:
    """Whole if it fits; else its last whole sentence that leaves room for the marker, or a plain cut, and the marker."""
    room = most - len(marker)
    head = F.substring(text, 1, room)
    cut = F.regexp_extract(head, r"(?s)^(.*[。！？.!?\n])", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut != "", F.rtrim(cut)).otherwise(head), F.lit(marker)))


def markdown_table(rows: Column) -> Column:
    """A pipe table of an array of rows of cells: white space collapsed, pipes escaped, empty rows dropped, short rows padded."""
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    full = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(full, F.size))
    padded = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    body = F.transform(padded, line)
    return F.when(F.size(full) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))), "\n")).otherwise("")
