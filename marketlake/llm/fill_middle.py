"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix by one match of a counted pattern per row, all in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import spread_rows

#: A unit of the cut: a line with its end, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _checked(marks: tuple[str, str, str]) -> None:
    """In an output, marks can be told from what lies between them only if none ends as one begins."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("marks must be three different strings")
    for x in marks:
        for y in marks:
            if (x != y and y in x) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"marks {x} and {y} overlap")


def _plain(s: str) -> str:
    """A mark as a replacement: $ and backslash stand for themselves."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n 8-digit groups of the hex sha256 of ``seed:id`` as numbers; a null id counts as empty."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, unit: str = LINES
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row of ``docs``.

    ``regexp_count`` gives the number of units n, the id's hash two cuts a <= b of them, and one match of
    ``(unit{a})(unit{b-a})(rest)`` the three parts, which its replacement puts in the order of the form. The counted groups are
    possessive, so the match runs forward once, without a stack that grows with the lines. ``rate`` per cent of the rows are
    cut, of them ``spm`` per cent with the suffix first. A null text is empty; empty texts and those that hold a mark stay as they are
    (form plain, null lengths). Equal rows give equal results, rows without an id those of an empty id, an empty table none; other
    columns of ``docs``, whatever their names, are not carried. A text is one row's work and never cut short.
    """
    _checked(marks)
    p, s, m = marks
    rows = spread_rows(docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    h = draws(F.col("id"), seed)
    rows = rows.select("id", "text", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    held = F.lit(False)
    for x in marks:
        held = held | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    counted = lambda k: F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.col("a")), counted(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    order = F.when(F.col("form") == "spm", _plain(s) + "$3" + _plain(p) + "$1" + _plain(m) + "$2").otherwise(_plain(p) + "$1" + _plain(s) + "$3" + _plain(m) + "$2")
    rows = rows.select("id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))
    at = {x: F.instr("output", x) for x in marks}
    prefix = F.when(F.col("form") == "psm", at[s] - 1 - len(p)).when(F.col("form") == "spm", at[m] - at[p] - len(p))
    middle = F.when(F.col("form") != "plain", F.length("output") - at[m] - len(m) + 1)
    return rows.select(F.col("id").alias(id_col), "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    _checked(marks)
    p, s, m = (rf"\Q{x}\E" for x in marks)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
