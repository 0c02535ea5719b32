"""Stack traces and test failures as Spark columns: detection, frames, exceptions.

Two dialects are kept apart: the loose one ranks (any mention of a .py file counts), the strict one cites. Patterns are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOOSE_FRAME = r'File "([^"]+)", line (\d+), in ([^\s\n\(\)]+)'
DOTTED_FRAME = r"at\s+([a-zA-Z0-9_\-\.]+)\(([^:]+):(\d+)\)"
FILE_AFTER_IN = r"(?i)\bin\s+([a-zA-Z0-9_\-\./]+\.py)\b"
ANY_FILE = r"(?i)\b([a-zA-Z0-9_\-\./]+\.py)\b"
LINE_WORD = r"(?i)\bline\s+(\d+)\b"
PLACE_WORD = r"(?i)\b(?:in|inside|at)\s+([a-zA-Z0-9_]+)\b"
AT_WORD = r"(?i)\bat\s+([a-zA-Z0-9_]+)\b"
PLACE_STOP_WORDS = ("line", "graph", "relation", "handling", "error", "exception", "validation", "failure")
ERROR_LINE = r"(?m)^([a-zA-Z0-9_\.]+Error|[a-zA-Z0-9_\.]+Exception):[^\S\n]*(.*)$"
STRICT_FRAME = r'(?m)^\s*File "([^"]+)", line (\d+), in ([^\n]+)(?:\n[ \t]+(?!File ")([^\n]+))?$'
STRICT_EXCEPTION = r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|Exit)):\s*(.*)$"
PYTEST_PLACE = r"(?m)^(.+?\.py):(\d+):\s*([^\n]+?)(?:\n[ \t]+(?!E\s+)([^\n]+))?$"
PYTEST_DETAIL = r"(?m)^\s*E\s+(.*)$"


def is_stack_trace(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low.contains("traceback") | low.contains("exception:") | low.contains("error:")
            | low.rlike(r"\b\w+\.py\b") | low.rlike(r"\bat\s+[\w.$]+\([\w./\-]+:\d+\)") | low.rlike(r"line\s+\d+"))


def _frames(text: Column, pattern: str, path: int, line: int, name: int, last_part: bool = False) -> Column:
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((path, "p"), (line, "n"), (name, "f"))])
    fn = (lambda x: F.substring_index(x["f"], ".", -1)) if last_part else (lambda x: F.trim(x["f"]))
    return F.transform(found, lambda x: F.struct(x["p"].alias("file_path"), x["n"].try_cast("int").alias("line_number"), fn(x).alias("function_name")))


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _last_place(text: Column, pattern: str, stop: tuple[str, ...]) -> Column:
    """The last word after in / inside / at that is no stop word and no part of a file name."""
    words = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: ~F.lower(w).isin(*stop) & ~F.contains(F.lower(text), F.concat(F.lower(w), F.lit(".py"))))
    return F.try_element_at(words, F.lit(-1))


def loose_frames(text: Column) -> Column:
    """array<struct<file_path, line_number, function_name>>: interpreter frames, then dotted frames, else one guessed frame."""
    t = F.coalesce(text, F.lit(""))
    exact = F.concat(_frames(t, LOOSE_FRAME, 1, 2, 3), _frames(t, DOTTED_FRAME, 2, 3, 1, last_part=True))
    path = F.coalesce(_first_group(t, FILE_AFTER_IN), _first_group(t, ANY_FILE))
    line = _first_group(t, LINE_WORD).try_cast("int")
    name = F.coalesce(_last_place(t, PLACE_WORD, PLACE_STOP_WORDS), _last_place(t, AT_WORD, ("line",)))
    guess = F.struct(path.alias("file_path"), line.alias("line_number"), name.alias("function_name"))
    some = path.isNotNull() | line.isNotNull() | name.isNotNull()
    return F.when(F.size(exact) > 0, exact).when(some, F.array(guess)).otherwise(F.slice(exact, 1, 0))


def loose_error(text: Column) -> Column:
    """struct<error_type, error_message> of the first error line, else of a short 'Type: message in file' remark."""
    t = F.coalesce(text, F.lit(""))
    kind, said = F.trim(_first_group(t, ERROR_LINE)), F.regexp_extract(t, ERROR_LINE, 2)
    head = F.split(t, r"\s+in\s+", 2)[0]
    front = F.trim(F.substring_index(head, ":", 1))
    short = head.contains(":") & (F.size(F.filter(F.split(front, r"\s+"), lambda w: w != "")) <= 2)
    cut = lambda m: F.trim(F.split(m, r"(?i)\s+in\s+[a-zA-Z0-9_\-\./]+\.py")[0])
    rest = F.substr(head, F.instr(head, ":") + 1)
    return F.struct(
        F.when(kind.isNotNull(), kind).when(short, front).alias("error_type"),
        F.when(kind.isNotNull(), cut(F.trim(said))).when(short, cut(F.trim(rest))).alias("error_message"),
    )


def can_parse_python(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("Traceback (most recent call last):")) & text.rlike(STRICT_FRAME), F.lit(False))


def can_parse_pytest(text: Column) -> Column:
    return F.coalesce(text.rlike(PYTEST_PLACE) & (F.contains(text, F.lit("AssertionError")) | text.rlike(PYTEST_DETAIL)), F.lit(False))


def _strict(text: Column, pattern: str, named: bool) -> Column:
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "p"), (2, "n"), (3, "f"), (4, "c"))])
    return F.transform(groups, lambda x: F.struct(x["p"].alias("file_path"), x["n"].try_cast("int").alias("line_number"), (F.trim(x["f"]) if named else F.lit("<pytest>")).alias("function_name"), F.nullif(F.trim(x["c"]), F.lit("")).alias("code_line")))


def python_failure(text: Column) -> Column:
    """struct<frames, exceptions, chain_markers, warnings> of an interpreter traceback."""
    frames = _strict(text, STRICT_FRAME, True)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(STRICT_EXCEPTION), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(STRICT_EXCEPTION), F.lit(2)).alias("m"))
    errors = F.transform(found, lambda x: F.struct(x["t"].alias("type"), F.trim(x["m"]).alias("message")))
    markers = F.filter(F.array(F.when(F.contains(text, F.lit("The above exception was the direct cause")), "direct_cause"), F.when(F.contains(text, F.lit("During handling of the above exception")), "during_handling")), lambda m: m.isNotNull())
    warnings = F.filter(F.array(F.when(F.size(frames) == 0, "No Python traceback frames were found."), F.when(F.size(errors) == 0, "No terminal Python exception was found.")), lambda m: m.isNotNull())
    return F.struct(frames.alias("frames"), errors.alias("exceptions"), markers.alias("chain_markers"), warnings.alias("warnings"))


def pytest_failure(text: Column) -> Column:
    """Same struct for a pytest report: places as frames, the last E line as message; a '>' line stands in for missing code."""
    arrow = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*>+[ \t]*(.*)$", 1))
    frames = F.transform(_strict(text, PYTEST_PLACE, False), lambda x: F.struct(x["file_path"].alias("file_path"), x["line_number"].alias("line_number"), x["function_name"].alias("function_name"), F.coalesce(x["code_line"], F.nullif(arrow, F.lit(""))).alias("code_line")))
    kind = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(PYTEST_PLACE), F.lit(3)), F.lit(-1)), F.lit("AssertionError"))
    detail = F.coalesce(F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(PYTEST_DETAIL), F.lit(1)), F.lit(-1))), F.lit(""))
    warnings = F.filter(F.array(F.when(F.size(frames) == 0, "No pytest failure location was found.")), lambda m: m.isNotNull())
    return F.struct(frames.alias("frames"), F.array(F.struct(kind.alias("type"), detail.alias("message"))).alias("exceptions"), F.array().cast("array<string>").alias("chain_markers"), warnings.alias("warnings"))


def parse_failure(text: Column) -> Column:
    """Strict parse: the first dialect that fits, Python before pytest; null if none does."""
    return F.when(can_parse_python(text), python_failure(text)).when(can_parse_pytest(text), pytest_failure(text))
