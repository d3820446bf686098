"""Per-snippet tallies of suggested word changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.diff import CHANGES, apply_changes, diff_changes

#: Signed-in reviewers who must agree on one change.
ATTENTION = 2
EDITORS = ("editor", "admin", "superadmin")


def changes_of(base: str, asked: Column | None = None) -> Column:
    """The changes that a suggestion (kind, text) makes to the text in base; none for a confirmation, whose texts aren't sent to Python, nor
    are those of rows that aren't asked for."""
    edit = (F.col("kind") == "edit") if asked is None else (F.col("kind") == "edit") & asked
    return F.when(edit, diff_changes(F.when(edit, F.col(base)), F.when(edit, F.col("text")))).otherwise(F.array().cast(CHANGES))


def each_change(snippets: DataFrame, suggestions: DataFrame, users: DataFrame) -> DataFrame:
    """One row per suggestion with its changes to the snippet's current text (none for a confirmation).

    Users are joined with their present role. An edit that changes no word is a confirmation."""
    base = snippets.select("snippet_id", F.coalesce("final_text", "working_text").alias("current_text"))
    rows = suggestions.select("snippet_id", F.col("id").alias("suggestion_id"), "user_id", "kind", "text", "ts").join(base, "snippet_id")
    # one pass over all kinds; the changes are found before users are joined, so that no text goes through that join
    rows = rows.where("kind IS NOT NULL").withColumn("changes", changes_of("current_text")).drop("current_text", "text")
    return rows.join(users.select(F.col("id").alias("user_id"), "name", "role"), "user_id").withColumn("guest", F.col("role") == "guest")


def changed(reviewed: DataFrame) -> DataFrame:
    """each_change() of suggestions that come with their snippets' current_text and their people's name and role.

    Nothing is joined here, so rows that come dealt by snippet are summed where they are."""
    return of_changes(reviewed.withColumn("changes", changes_of("current_text")))


def of_changes(rows: DataFrame) -> DataFrame:
    """each_change() of suggestions with their changes and their people's name and role; no text is read."""
    rows = rows.where("kind IS NOT NULL")
    return rows.select("snippet_id", F.col("id").alias("suggestion_id"), "ts", "user_id", "name", "role", (F.col("role") == "guest").alias("guest"), "kind", "changes")


def groups(each: DataFrame) -> DataFrame:
    """One row per (snippet, change) with who agrees on it; first is the earliest suggestion's (ts, id)."""
    rows = each.select("snippet_id", "suggestion_id", "ts", "user_id", "name", "role", "guest", F.explode("changes").alias("c"))
    person = F.when(~F.col("guest"), F.struct("user_id", "name", "role"))
    return rows.groupBy("snippet_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.replacement").alias("replacement")).agg(
        F.min_by("c.original", F.struct("ts", "suggestion_id")).alias("original"),
        F.array_sort(F.collect_list(person)).alias("reviewers"),
        F.count_if(~F.col("guest")).alias("count"),
        F.count_if(F.col("role").isin(*EDITORS)).alias("editors"),
        F.count_if("guest").alias("guests"),
        F.min(F.struct("ts", "suggestion_id")).alias("first"),
    )


def tallied(snippets: DataFrame, suggestions: DataFrame, users: DataFrame) -> DataFrame:
    """One row per snippet: confirmations, edits and word changes, most agreed first."""
    each = each_change(snippets, suggestions, users)
    return folded(snippets, each)


#: What a word change says.
CHANGE = ("start", "end", "original", "replacement", "reviewers", "editors", "guests", "count")


def folded(snippets: DataFrame, each: DataFrame, change: tuple[str, ...] = CHANGE) -> DataFrame:
    """tallied() of changes that are there (see each_change); change names what is asked of a word change.

    One aggregation by snippet and change gives the groups and, in a row without a change, the votes; one by snippet puts
    both together. A suggestion's row of votes and its changes come from one explode, so the changes are found once."""
    none = F.lit(None).cast(each.schema["changes"].dataType.elementType)
    rows = each.select("snippet_id", "suggestion_id", "ts", "user_id", "name", "role", "guest", (F.size("changes") == 0).alias("same"), F.explode(F.concat(F.array(none), F.col("changes"))).alias("c"))
    person = F.when(~F.col("guest") & F.col("c").isNotNull(), F.struct("user_id", "name", "role"))
    per = rows.groupBy("snippet_id", F.col("c").isNull().alias("vote"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.replacement").alias("replacement")).agg(
        F.min_by("c.original", F.struct("ts", "suggestion_id")).alias("original"), F.array_sort(F.collect_list(person)).alias("reviewers"),
        F.count_if(~F.col("guest")).alias("count"), F.count_if(F.col("role").isin(*EDITORS)).alias("editors"), F.count_if("guest").alias("guests"), F.min(F.struct("ts", "suggestion_id")).alias("first"),
        F.count_if(F.col("same") & ~F.col("guest")).alias("confirms_reviewers"), F.count_if(F.col("same") & F.col("guest")).alias("confirms_guests"), F.count_if(~F.col("same")).alias("edit_suggestions"), F.count("*").alias("suggestion_count"),
    )
    order = F.struct((-F.col("count")).alias("k1"), (-F.col("guests")).alias("k2"), F.col("start").alias("k3"), F.col("first").alias("k4"))
    vote = F.col("vote")
    numbers = ("confirms_reviewers", "confirms_guests", "edit_suggestions", "suggestion_count")
    lists = per.groupBy("snippet_id").agg(
        F.array_sort(F.collect_list(F.when(~vote, F.struct(order.alias("o"), F.struct(*change).alias("g"))))).alias("l"), F.max(F.when(~vote, F.col("count"))).alias("most"), *[F.max(F.when(vote, F.col(c))).alias(c) for c in numbers],
    )
    lists = lists.withColumn("word_changes", F.when(F.size("l") > 0, F.transform("l", lambda x: x["g"]))).drop("l")
    rows = snippets.join(lists, "snippet_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        *snippets.columns, *map(zero, numbers), "word_changes", F.coalesce(F.col("most") >= ATTENTION, F.lit(False)).alias("attention"), F.col("suggestion_count").isNotNull().alias("has_activity"),
    )


def auto_approvable(word_changes: Column, confirms: Column) -> Column:
    """Changes that enough reviewers, and more than confirm the text, agree on."""
    return F.filter(word_changes, lambda g: (g["count"] >= ATTENTION) & (g["count"] > confirms))


def approval_plan(tallies: DataFrame) -> DataFrame:
    """For every snippet that isn't final: its text before and after the approvable changes, and how many they are."""
    todo = tallies.where("final_text IS NULL").withColumn("plan", F.coalesce(auto_approvable(F.col("word_changes"), F.col("confirms_reviewers")), F.array().cast(tallies.schema["word_changes"].dataType)))
    slim = F.transform("plan", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["original"].alias("original"), g["replacement"].alias("replacement")))
    some = F.size("plan") > 0  # other texts stay as they are and aren't sent to Python
    after = F.when(some, apply_changes(F.when(some, F.col("working_text")), slim)).otherwise(F.col("working_text"))
    return todo.select("snippet_id", "book_id", "page_index", F.col("working_text").alias("before"), after.alias("after"), F.size("plan").cast("long").alias("changes_applied"))


def change_order(each: DataFrame) -> DataFrame:
    """(snippet_id, ordered) of each_change(): a snippet's word changes, most agreed first."""
    order = F.struct(-F.col("count"), -F.col("guests"), "start", "first")
    told = F.struct(order.alias("o"), F.concat_ws("/", "count", "guests", "start", "replacement").alias("text"))
    return groups(each).groupBy("snippet_id").agg(F.array_sort(F.collect_list(told))["text"].alias("ordered"))


def word_marks(changes: DataFrame) -> DataFrame:
    """(snippet_id, place, insertion, count, hot, marks) of groups(): on each base word the change that most agree on, of
    equal ones the first in tally order; before a word (or behind the last one) all insertions there, in tally order."""
    order = F.struct(-F.col("count"), -F.col("guests"), "start", "first")
    mark = F.struct(order.alias("o"), F.col("count").alias("count"), F.concat_ws(" > ", "original", "replacement").alias("text"))
    # one pass over the changes: a filter for each kind would find them once more
    new = F.col("end") == F.col("start")
    places = F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1)).when(new, F.array("start"))
    rows = changes.select("snippet_id", new.alias("insertion"), mark.alias("m"), F.explode(places).alias("place"))
    per = rows.groupBy("snippet_id", "place", "insertion").agg(F.min(F.when(~F.col("insertion"), F.col("m"))).alias("best"), F.array_sort(F.collect_list(F.when(F.col("insertion"), F.col("m")))).alias("l"))
    count, marks = F.when(F.col("insertion"), F.array_max("l.count")).otherwise(F.col("best.count")), F.when(F.col("insertion"), F.col("l.text")).otherwise(F.array("best.text"))
    return per.select("snippet_id", "place", "insertion", count.alias("count"), marks.alias("marks")).withColumn("hot", F.col("count") >= ATTENTION)
