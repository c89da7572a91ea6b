"""Exports: CSV, Markdown, BibTeX, and everything of a paper by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scholarly import bibtex_key, resolve_citations
from paperloom.functions.text import slugify
from paperloom.schemas import READ_STATES


def csv_cell(c: Column) -> Column:
    """A cell, quoted if it must be."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def grid_csv(grid: Column) -> Column:
    """A grid as CSV, a line feed behind each row."""
    return F.array_join(F.transform(grid, lambda r: F.concat(F.array_join(F.transform(r, csv_cell), ","), F.lit("\n"))), "")


def table_filename(label: Column, page: Column) -> Column:
    return F.concat(slugify(F.when(label != "", label).otherwise(F.concat(F.lit("table p"), page.cast("string")))), F.lit(".csv"))


def figure_filename(label: Column, page: Column, media_type: Column) -> Column:
    return F.concat(slugify(F.when(label != "", label).otherwise(F.concat(F.lit("figure p"), page.cast("string")))), F.when(media_type == "image/jpeg", ".jpg").when(media_type == "image/webp", ".webp").otherwise(".png"))


def bibtex(papers: DataFrame) -> DataFrame:
    """(paper_id, bib): an entry for each paper (paper_id, title, authors, year, venue, doi, arxiv_id, source_url); fields without a value are left out, braces go."""
    bare = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[{}]", "")
    field = lambda name, c: F.when(bare(c) != "", F.concat(F.lit(f"  {name} = {{"), bare(c), F.lit("}")))
    c = F.col
    fields = F.array_compact(F.array(field("title", c("title")), field("author", F.array_join("authors", " and ")), field("year", c("year")), field("journal", c("venue")), field("doi", c("doi")), field("eprint", c("arxiv_id")), field("url", c("source_url"))))
    kind = F.when(F.coalesce("venue", F.lit("")) != "", "article").otherwise("misc")
    return papers.select("paper_id", F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(c("authors"), c("year"), c("title")), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n")).alias("bib"))


def analyses_markdown(papers: DataFrame, analyses: DataFrame) -> DataFrame:
    """(paper_id, markdown): a paper's title and authors, then its analyses (paper_id, lens, content, citations as a map) in the order of their names, their citations resolved."""
    part = F.struct("lens", F.concat(F.lit("## "), F.initcap(F.replace("lens", F.lit("_"), F.lit(" "))), F.lit("\n\n"), resolve_citations(F.col("content"), F.col("citations"))).alias("text"))
    parts = analyses.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("_parts"))
    head = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.when(F.size("authors") > 0, F.array_join("authors", ", ")))
    return papers.join(parts, "paper_id").select("paper_id", F.concat(head, F.lit("\n\n"), "_parts", F.lit("\n")).alias("markdown"))


def library_markdown(papers: DataFrame) -> DataFrame:
    """(state_no, read_state, markdown): a reading list, a part for each read state in its order; to be joined in the order of ``state_no``."""
    line = F.concat(F.lit("- "), "title", F.when(F.size("authors") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("authors", 1, 3), ", "), F.lit(")"))).otherwise(F.lit("")), F.when(F.coalesce("verdict", F.lit("")) != "", F.concat(F.lit(": "), "verdict")).otherwise(F.lit("")))
    no = F.array_position(F.array(*map(F.lit, READ_STATES)), F.col("read_state"))
    lists = papers.groupBy(no.alias("state_no"), "read_state").agg(F.array_sort(F.collect_list(F.struct("title", line.alias("line")))).alias("_l"))
    return lists.select("state_no", "read_state", F.concat(F.lit("## "), F.initcap("read_state"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def bundle(papers: DataFrame, elements: DataFrame, analyses: DataFrame) -> DataFrame:
    """(paper_id, filename, content): everything of a paper that can be exported as text. Tables of one name are numbered."""
    tables = elements.where("kind = 'table' and `table` is not null").select("paper_id", table_filename(F.coalesce("label", F.lit("")), F.col("page")).alias("_f"), "ord", grid_csv(F.col("table.grid")).alias("content"))
    n = F.row_number().over(Window.partitionBy("paper_id", "_f").orderBy("ord"))
    named = tables.withColumn("_n", n).select("paper_id", F.when(F.col("_n") > 1, F.regexp_replace("_f", r"\.csv$", F.concat(F.lit("-"), F.col("_n").cast("string"), F.lit(".csv")))).otherwise(F.col("_f")).alias("filename"), "content")
    return named.union(bibtex(papers).select("paper_id", F.lit("reference.bib"), "bib")).union(analyses_markdown(papers, analyses).select("paper_id", F.lit("analyses.md"), "markdown"))
