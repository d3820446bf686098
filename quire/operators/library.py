"""Progress, contributor and participation analytics over snippets, suggestions and users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import lstrip, n_words, rstrip, strip
from quire.operators._order import with_neighbours
from quire.operators._skew import with_group

NOT_RANKED = ("guest", "superadmin")


def completion(done: Column, total: Column) -> Column:
    """Percentage of done in total, one decimal, halves to even; 0 where there is nothing."""
    return F.when(total > 0, F.bround(100.0 * done / total, 1)).otherwise(F.lit(0.0))


def progress(books: DataFrame, snippets: DataFrame, hidden: bool = False) -> DataFrame:
    """Six counts per book; snippets (with suggestion_count and attention) are summed before the join, so that a book
    without any has zeros."""
    final, some = F.col("final_text").isNotNull(), F.col("suggestion_count") > 0
    counts = snippets.groupBy("book_id").agg(
        F.count("*").alias("total"), F.count_if(final).alias("finalized"), F.count_if(~final & some).alias("awaiting_approval"),
        F.count_if(~final & ~some).alias("untouched"), F.count_if(~final & F.col("attention")).alias("needs_attention"), F.count_if(final & F.col("attention")).alias("finalized_challenged"),
    )
    shown = books if hidden else books.where(~F.col("hidden"))
    rows = shown.join(counts, "book_id", "left").fillna(0, [c for c in counts.columns if c != "book_id"])
    return rows.withColumns({"pending": F.col("total") - F.col("finalized"), "completion_pct": completion(F.col("finalized"), F.col("total"))})


def page_progress(snippets: DataFrame) -> DataFrame:
    final = F.col("final_text").isNotNull()
    return snippets.groupBy("book_id", "page_index", "side").agg(F.min("page_number").alias("page_number"), F.count("*").alias("total"), F.count_if(final).alias("finalized"), F.count_if(~final & F.col("attention")).alias("needs_attention"))


def votes(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def contributors(users: DataFrame, suggestions: DataFrame, snippets: DataFrame, book_id: str | None = None) -> DataFrame:
    """Edits, confirmations and approvals of all users but guests, those without any included. Suggestions are scoped and
    counted before the outer join."""
    if book_id is not None:
        snippets = snippets.where(F.col("book_id") == book_id)
        suggestions = suggestions.join(snippets.select("snippet_id"), "snippet_id", "left_semi")
    made = suggestions.groupBy(F.col("user_id").alias("id")).agg(votes("edit").alias("edits"), votes("confirm").alias("confirms"))
    approved = snippets.where("final_text IS NOT NULL").groupBy(F.col("finalized_by").alias("uid")).agg(F.count("*").alias("approvals"))
    rows = users.where("role <> 'guest'").join(made, "id", "left").join(approved, "uid", "left")
    return rows.select("id", "uid", "name", "role", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("edits", "confirms", "approvals")])


def guests(users: DataFrame, suggestions: DataFrame) -> DataFrame:
    rows = suggestions.join(users.where("role = 'guest'").select(F.col("id").alias("user_id")), "user_id")
    return rows.agg(F.count_distinct("user_id").alias("people"), votes("edit").alias("edits"), votes("confirm").alias("confirms"))


def ranked(users: DataFrame) -> DataFrame:
    return users.where(~F.col("role").isin(*NOT_RANKED)).select(F.col("id").alias("user_id"), "name", "role")


def top(rows: DataFrame, users: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The n people with most rows, then by id; counted before users are joined."""
    counts = rows.groupBy("user_id").agg(F.count("*").alias(name)).join(ranked(users), "user_id")
    return counts.select("user_id", "name", "role", name).orderBy(F.desc(name), "user_id").limit(n)


def top_suggesters(users: DataFrame, suggestions: DataFrame, n: int = 10) -> DataFrame:
    return top(suggestions, users, "suggestions", n)


def top_approved(users: DataFrame, suggestions: DataFrame, snippets: DataFrame, n: int = 10) -> DataFrame:
    """Edits whose text is the snippet's final text."""
    final = snippets.where("final_text IS NOT NULL").select("snippet_id", "final_text")
    return top(suggestions.where("kind = 'edit'").join(final, "snippet_id").where("text = final_text"), users, "approved", n)


def touched(snippets: DataFrame) -> DataFrame:
    return snippets.where((F.col("suggestion_count") > 0) | F.col("final_text").isNotNull())


def trends(snippets: DataFrame) -> DataFrame:
    rows = touched(snippets)
    return rows.agg(F.count_distinct("book_id").alias("books_reviewed"), F.count_distinct("book_id", "page_index").alias("pages_reviewed"), F.sum(n_words(F.coalesce(F.nullif("final_text", F.lit("")), "working_text"))).alias("words_reviewed"))


def participation(books: DataFrame, users: DataFrame, suggestions: DataFrame, snippets: DataFrame) -> DataFrame:
    people = suggestions.join(ranked(users).select("user_id"), "user_id").join(snippets.select("snippet_id", F.col("book_id").alias("_b")), "snippet_id")
    counts = people.groupBy(F.col("_b").alias("book_id")).agg(F.count_distinct("user_id").alias("participants"))
    return counts.join(books.select("book_id", "title"), "book_id").select("book_id", "title", "participants")


def dashboard(books: DataFrame, users: DataFrame, suggestions: DataFrame, snippets: DataFrame) -> dict[str, DataFrame]:
    shown = progress(books, snippets)
    return {
        "top_suggesters": top_suggesters(users, suggestions), "top_approved": top_approved(users, suggestions, snippets), "trends": trends(snippets),
        "participation": participation(books, users, suggestions, snippets), "books": shown, "pending_admin_review": pending_admin_review(shown),
    }


def pending_admin_review(shown: DataFrame) -> DataFrame:
    """Of books' progress those that wait for an administrator."""
    return shown.where("needs_attention > 0")


def page_counts(snippets: DataFrame) -> DataFrame:
    """Distinct (page, side) and the last page index of each book."""
    return snippets.groupBy("book_id").agg(F.count_distinct("page_number", "side").alias("page_count"), F.max("page_index").alias("total_pages"))


def neighbours_of_pages(snippets: DataFrame) -> DataFrame:
    """Every page with the one before and after it, null at the ends."""
    pages = snippets.select("book_id", "page_index").distinct().join(page_counts(snippets).select("book_id", "total_pages"), "book_id")
    i = F.col("page_index")
    return pages.select("book_id", "page_index", "total_pages", F.when(i > 1, i - 1).alias("prev"), F.when(i < F.col("total_pages"), i + 1).alias("next"))


def page_range(snippets: DataFrame, start: int, count: int) -> DataFrame:
    """Current texts of pages start to start+count-1; count is held to 1..20."""
    count = max(1, min(count, 20))
    rows = snippets.where(F.col("page_index").between(start, start + count - 1))
    return rows.select("snippet_id", "book_id", "page_index", "seq", F.coalesce("final_text", "working_text").alias("text"), F.col("final_text").isNotNull().alias("finalized"))


#: Pages of a file of a book's text.
FILE_PAGES = 256


def book_lines(snippets: DataFrame, final: bool = False, file_pages: int = FILE_PAGES) -> DataFrame:
    """The lines of all books' texts in reading order: book_id, block (so many pages each), page_index, seq, snippet_id and value,
    the line with an empty one before it where a page begins. The values of a book, each with a line feed behind it, are its text:
    blank lines at its ends are left out and blanks at its ends cut off.

    Rows are sorted in ranges of whole pages, so the only window is that over a page's lines; a book's first and last line come
    from an aggregation. Nothing holds a book."""
    rows = snippets.where("final_text IS NOT NULL") if final else snippets
    lines = rows.select("book_id", F.floor(F.col("page_index") / file_pages).cast("int").alias("block"), "page_index", "seq", "snippet_id", F.coalesce("final_text", "working_text").alias("line"))
    at = F.struct("page_index", "seq", "snippet_id")
    shown = F.when(strip(F.col("line")) != "", at)
    ends = lines.groupBy("book_id").agg(F.min(shown).alias("_first"), F.max(shown).alias("_last"), F.count("*").alias("_n"))
    held = with_group(lines, ends, "book_id", "_n").where((at >= F.col("_first")) & (at <= F.col("_last")))
    line = F.when(at == F.col("_first"), lstrip(F.col("line"))).otherwise(F.col("line"))
    line = F.when(at == F.col("_last"), rstrip(line)).otherwise(line)
    held = held.select("book_id", "block", "page_index", "seq", "snippet_id", line.alias("line"), (F.col("page_index") == F.col("_first.page_index")).alias("_opens"))
    by_page = held.repartitionByRange("book_id", "block", "page_index")
    begins = F.row_number().over(W.partitionBy("book_id", "block", "page_index").orderBy("seq", "snippet_id")) == 1
    value = F.concat(F.when(begins & ~F.col("_opens"), "\n").otherwise(""), "line")
    return by_page.select("book_id", "block", "page_index", "seq", "snippet_id", value.alias("value"))


def text_blocks(lines: DataFrame) -> DataFrame:
    """(book_id, block, first_page, last_page, n_lines, n_bytes, offset): where each block of a book's text stands in it."""
    size = F.octet_length("value") + 1
    blocks = lines.groupBy("book_id", "block").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.count("*").alias("n_lines"), F.sum(size).alias("n_bytes"))
    return with_neighbours(blocks, "book_id", ["block"], sums=("n_bytes",)).select(*blocks.columns, F.col("before_n_bytes").alias("offset"))


def book_texts(snippets: DataFrame, final: bool = False) -> DataFrame:
    """Each book as one text: lines in reading order, an empty line between pages, one line feed at the end. A row is a book;
    sinks.text_files writes the same texts without one.

    Lines are joined by blocks of pages first, all over the cluster; a book's row is put together from its few blocks, of which
    only the texts are held. A book without lines has a row without a block."""
    joined = lambda *key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "value"))), lambda x: x["value"]), "")
    lines = book_lines(snippets, final).withColumn("value", F.concat("value", F.lit("\n")))
    blocks = lines.groupBy("book_id", "block").agg(joined("page_index", "seq", "snippet_id").alias("value"))
    empty = snippets.select("book_id").distinct().select("book_id", F.lit(None).cast("int").alias("block"), F.lit("").alias("value"))
    return blocks.unionByName(empty).groupBy("book_id").agg(F.when(F.count("block") > 0, joined("block")).otherwise("\n").alias("text"))


def all_of(*predicates: Column | None) -> Column:
    """The predicates that are given, and-ed; none at all keeps every row."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def paged(rows: DataFrame, order: list, page: int, per_page: int, most: int = 100) -> DataFrame:
    per_page = max(1, min(per_page, most))
    return rows.orderBy(*order).offset((max(1, page) - 1) * per_page).limit(per_page)


def positions(snippets: DataFrame, order: list[str]) -> DataFrame:
    """Place of each snippet in its book, out of how many, and the snippets before and after it."""
    rows = with_neighbours(snippets.select("book_id", "snippet_id", *order), "book_id", order, ("snippet_id",))
    sizes = snippets.groupBy("book_id").agg(F.count("*").alias("total"))
    return with_group(rows, sizes, "book_id", "total").select("book_id", "snippet_id", "position", "total", F.col("prev_snippet_id").alias("prev"), F.col("next_snippet_id").alias("next"))


def table_key(rows: DataFrame, key: str) -> Column:
    """What a table is sorted by: texts as people sort them (accents and case come after letters), others by value."""
    return F.collate(key, "UNICODE") if rows.schema[key].dataType.typeName() == "string" else F.col(key)


def sorted_table(rows: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """rows by a column that a user picked, ties by book_id."""
    by = table_key(rows, key)
    return rows.orderBy(by.desc() if descending else by.asc(), "book_id")
