"""Lines repeated across one source's documents, by PrefixSpan over line forms.

Each document is the sequence of its non-empty lines' forms. PrefixSpan grows
the frequent sequences of every source level by level. Its first level counts
single forms; lines whose form isn't frequent leave the sequences. From then on a
projection (a document with the place where an occurrence of a frequent prefix
ends) has one postfix, and is extended by the postfix's first line if no more
than ``gap`` of the lines that left stand between; extensions of enough distinct
documents make the next level. It ends with an empty level: no length is too great.

What is deleted are the occurrences of the frequent sequences: of every line
where one starts the longest is kept, and as each further line of it starts one
of its own (a postfix of a frequent sequence is frequent), these starts are the
lines of all occurrences, once each.

Scale: texts are read once; forms go on as 128-bit hashes. They are counted after removing repeats within the
document, with partial counts before the shuffle; a source's third of all rows
is spread over its forms. The frequent forms of a source number at most
(mean distinct lines of a document) * 100 / min_percent, and the planner decides at run time
whether their join is a broadcast. Projections are rows, so no document's or source's are gathered.

Defined results: rows with a null source or a null or empty text have no
lines; a form counts once per document (row; rows of one id are documents of their own); lines whose form is empty are
never found; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.plans.materialize import drop_materialized, materialize

#: Characters cut from both ends of a line (fixed by the definition of a form), with the blank.
EDGE = "-–—*•|·>»:.,; "
_EDGE = "[" + EDGE.replace("-", "\\-").replace("|", "\\|") + "]"


def line_forms(text: Column) -> Column:
    """The forms of a text's lines in order, empty ones included; one pass over the whole text."""
    t = F.lower(text)
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "[0-9]+", "0")
    # (?d): only \n ends a line; the look-behind keeps long runs linear
    t = F.regexp_replace(t, f"(?md)^{_EDGE}++|(?<!{_EDGE}){_EDGE}++$", "")
    return F.split(t, "\n")


def _hashes(form: Column) -> list[Column]:
    return [F.xxhash64(form).alias("h1"), F.xxhash64(form, F.lit(1)).alias("h2")]


def _enough(docs: Column, total: Column, min_docs: int, min_percent: int) -> Column:
    return (docs >= min_docs) & (docs * 100 >= F.lit(min_percent) * total)


class PrefixSpan:
    """The search over one table; its tables are written as they come.

    ``levels``: ``src, h1, h2, docs`` first, then ``src, p1, p2, l1, l2, q1, q2, docs`` each (the pattern q is
    the pattern p with the line l). ``places``: ``doc, line_no, n_lines``, the longest occurrence that starts at each line.
    """

    def __init__(self, df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int, min_percent: int, gap: int, max_lines: int | None = None):
        named = df.filter(F.col(source_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(source_col).alias("src"), F.col(text_col).alias("text"))
        totals = named.groupBy("src").agg(F.count("*").alias("total"))
        numbered = F.transform(line_forms(F.col("text")), lambda x, i: F.struct(i.alias("line_no"), x.alias("form")))
        hashed = F.transform(F.filter(numbered, lambda x: x["form"] != ""), lambda x: F.struct(x["line_no"].alias("line_no"), *_hashes(x["form"])))
        # the number of a row is written with it, so it is the same for all that read on
        lines = materialize(named.filter("text <> ''").select(F.monotonically_increasing_id().alias("row"), "doc", "src", hashed.alias("lines")), "lines")
        once = lines.select("src", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("h")).select("src", "h.*")
        counted = once.groupBy("src", "h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
        enough = _enough(F.col("docs"), F.col("total"), min_docs, min_percent)
        single = materialize(counted.join(totals, "src").filter(enough).select("src", "h1", "h2", "docs"), "sequences-1")
        self.levels = [single]
        kept = lines.select("row", "doc", "src", F.posexplode("lines").alias("seq", "l")).select("row", "doc", "src", "seq", "l.*").join(single, ["src", "h1", "h2"], "left_semi")
        by_row = Window.partitionBy("row").orderBy("seq")
        near = F.lead("seq").over(by_row) - F.col("seq") <= gap + 1
        items = kept.select("*", *[F.when(near, F.lead(c).over(by_row)).alias(n) for c, n in (("seq", "next"), ("h1", "l1"), ("h2", "l2"))])
        items = materialize(items, "items")
        drop_materialized(lines)
        following = items.select("row", F.col("seq").alias("end"), "next", "l1", "l2").filter("next is not null")
        at = items.select("row", "doc", "src", "line_no", F.col("seq").alias("end"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
        self.places = at.select("row", "doc", "line_no", F.lit(1).alias("n_lines"))
        for n in count(2) if max_lines is None else range(2, max_lines + 1):
            grown = at.join(following, ["row", "end"]).select(
                "row", "doc", "src", "line_no", F.col("next").alias("end"), "p1", "p2", "l1", "l2", F.xxhash64("p1", "l1").alias("q1"), F.xxhash64("p2", "l2").alias("q2")
            )
            of = ["src", "p1", "p2", "l1", "l2", "q1", "q2"]
            supported = grown.select(*of, "row").distinct().groupBy(*of).agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
            level = materialize(supported.join(totals, "src").filter(enough).select(*of, "docs"), f"sequences-{n}")
            if level.isEmpty():
                break
            self.levels.append(level)
            at = materialize(grown.join(level, ["src", "q1", "q2"], "left_semi").select("row", "doc", "src", "line_no", "end", F.col("q1").alias("p1"), F.col("q2").alias("p2")), f"projections-{n}")
            self.places = self.places.unionByName(at.select("row", "doc", "line_no", F.lit(n).alias("n_lines")))
        self.places = self.places.groupBy("row", "doc", "line_no").agg(F.max("n_lines").alias("n_lines")).drop("row")


def find_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "normalized_text", min_docs: int = 5, min_percent: int = 5, gap: int = 1
) -> DataFrame:
    """``id_col, line_no`` of every line of an occurrence of a frequent sequence."""
    return PrefixSpan(df, id_col, source_col, text_col, min_docs, min_percent, gap).places.select(F.col("doc").alias(id_col), "line_no")


def frequent_sequences(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "normalized_text", min_docs: int = 5, min_percent: int = 5, gap: int = 1, max_lines: int | None = None
) -> DataFrame:
    """``source, n_lines, lines, docs``: the frequent sequences, of every length (or up to ``max_lines``)."""
    found = PrefixSpan(df, id_col, source_col, text_col, min_docs, min_percent, gap, max_lines)
    forms = df.filter(F.col(source_col).isNotNull()).select(F.col(source_col).alias("src"), F.explode(line_forms(F.col(text_col))).alias("form")).select("*", *_hashes(F.col("form")))
    names = materialize(forms.join(found.levels[0], ["src", "h1", "h2"], "left_semi").distinct(), "forms")
    patterns = found.levels[0].join(names, ["src", "h1", "h2"]).select("src", F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.array("form").alias("lines"), "docs")
    out = patterns
    for level in found.levels[1:]:
        last = names.select("src", F.col("h1").alias("l1"), F.col("h2").alias("l2"), "form")
        longer = level.join(patterns.drop("docs"), ["src", "p1", "p2"]).join(last, ["src", "l1", "l2"])
        patterns = materialize(longer.select("src", F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.concat("lines", F.array("form")).alias("lines"), "docs"), "patterns")
        out = out.unionByName(patterns)
    return out.select(F.col("src").alias("source"), F.size("lines").alias("n_lines"), "lines", "docs")


def remove_repeated_lines(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "normalized_text", min_docs: int = 5, min_percent: int = 5) -> DataFrame:
    """``id_col, text, removed``: every row with its repeated lines deleted; rows without any keep their text."""
    found = find_repeated_lines(df, id_col, source_col, text_col, min_docs, min_percent)
    gone = found.groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("gone", i))
    return (
        df.select(F.col(id_col), F.col(text_col))
        .join(gone, id_col, "left")
        .select(id_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
    )
