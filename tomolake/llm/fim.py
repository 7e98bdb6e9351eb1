"""Fill-in-middle transformation by escaped marker injection. DataFrame functions only, no shuffle.

A delimiter that the escaped text cannot hold is put behind every unit by one regexp_replace. The number of units is
the number of delimiters, and the parts before, between and behind two cuts are substring_index of the marked text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: The delimiter, the escape character, and what stands behind the escape character for either.
DELIMITER, ESCAPE, AS_DELIMITER, AS_ESCAPE = "\x01", "\x02", "d", "e"


@dataclass(frozen=True)
class Form:
    """Markers before prefix, suffix and middle; percentages of documents transformed and, of those, suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm: int = 50

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        # A marker cannot be found across an edge if its first character stands nowhere else in any marker.
        if any(len(m) < 2 or m[0] != self.prefix[0] or m[0] in m[1:] for m in self.markers) or len(set(self.markers)) < 3:
            raise ValueError("markers are three different strings that begin with one character and hold it nowhere else")
        if any(a != b and a.startswith(b) for a in self.markers for b in self.markers):
            raise ValueError("no marker may begin with another")


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + AS_ESCAPE))
    return F.replace(text, F.lit(DELIMITER), F.lit(ESCAPE + AS_DELIMITER))


def _unescaped(marked: Column) -> Column:
    """The text of marked units: delimiters go, escapes are undone, in the reverse order."""
    text = F.replace(marked, F.lit(DELIMITER))
    text = F.replace(text, F.lit(ESCAPE + AS_DELIMITER), F.lit(DELIMITER))
    return F.replace(text, F.lit(ESCAPE + AS_ESCAPE), F.lit(ESCAPE))


def _index(text: Column, count: Column) -> Column:
    """substring_index with the delimiter and a count that differs by row."""
    return F.call_function("substring_index", text, F.lit(DELIMITER), count.cast("int"))


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits, from one, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, form: Form = Form(), units: str = LINES) -> DataFrame:
    """doc_id, text, n (units), kind (plain, psm or spm), prefix, middle, suffix and output for each row of docs(doc_id, text).

    units is a pattern whose matches, left to right, make up the text. Two cuts come from the sha256 of `seed:doc_id`.
    A text that is empty or holds a marker is plain, as is one that the rate leaves out: output is the text, the three
    parts are null. Nulls count as empty texts; a null id hashes as no digits; rows that repeat an id are cut alike;
    other columns are ignored; an empty table gives no rows. Any text may hold delimiter and escape character.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = F.concat(F.lit(f"{form.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = F.regexp_replace(_escaped(F.col("text")), F.lit(units), F.lit("$0" + DELIMITER))
    rows = rows.select("*", F.sha2(named.cast("binary"), 256).alias("h"), marked.alias("marked"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER)))).cast("long"))
    one, two = (_number(F.col("h"), k) % (F.col("n") + 1) for k in (1, 2))
    rows = rows.withColumns({"one": one, "two": two, "h3": _number(F.col("h"), 3), "h4": _number(F.col("h"), 4)})
    rows = rows.withColumns({"first": F.least("one", "two"), "last": F.greatest("one", "two")})
    held = F.lit(False)
    for m in form.markers:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= form.rate)
    kind = F.when(plain, "plain").when(F.col("h4") % 100 < form.spm, "spm").otherwise("psm")
    rows = rows.withColumn("kind", kind)

    # Every unit ends with a delimiter, so what stands behind the last one is an empty piece of its own.
    before = _index(F.col("marked"), F.col("first"))
    between = _index(_index(F.col("marked"), F.col("last")), F.col("first") - F.col("last"))
    behind = _index(F.col("marked"), F.col("last") - F.col("n") - 1)
    parts = {"prefix": before, "middle": between, "suffix": behind}
    whole = F.col("kind") == "plain"
    rows = rows.withColumns({k: F.when(~whole, _unescaped(part)) for k, part in parts.items()}).drop("marked")

    p, s, m = map(F.lit, form.markers)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(whole, F.col("text")).when(F.col("kind") == "spm", spm).otherwise(psm)
    return rows.select("doc_id", "text", "n", "kind", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The text that an output was made of, from output and kind alone."""

    def behind(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, -1)

    def upto(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, 1)

    p, s, m = form.markers
    psm = F.concat(behind(upto(output, s), p), behind(output, m), behind(upto(output, m), s))
    spm = F.concat(behind(upto(output, m), p), behind(output, m), behind(upto(output, p), s))
    return F.when(kind == "plain", output).when(kind == "spm", spm).otherwise(psm)


def digests(docs: DataFrame, form: Form = Form(), units: str = LINES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of transform's rows: code points of
    the parts (null if plain), and lowercase hex digests of the output and of the text rebuilt from it."""
    rows = transform(docs, form, units).select("doc_id", "n", "kind", *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")], "output")
    back = rows.withColumn("back", restored(F.col("output"), F.col("kind"), form))
    return back.select(
        "doc_id", "n", F.col("kind").alias("form"), "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("back").cast("binary"), 256).alias("restored_sha256"),
    )
