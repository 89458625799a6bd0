"""Duplicates of a catalogue as classes: links between records that may stand for one book, and their connected components.

Links are never made for all pairs of a group. Records of one ISBN, and of one first author with titles whose lengths differ by three
characters at most, form chains: each is linked with the next one only, which joins the same records. Titles that hold another one are found
by the rarest trigram of the shorter: a title that holds it has all its trigrams. Equal titles of one author are one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: How much titles may differ in length to be alike, and the letters of a gram.
NEAR, GRAM = 3, 3


def components(links: DataFrame) -> DataFrame:
    """id, class: for each id that has a link (a, b), the least id that it is connected with.

    Each id takes the least class among itself and its neighbours, and each class that of its own least member (a jump along
    classes), until nothing changes: rounds grow with the logarithm of the longest path. Each round is written, and aggregates before
    it joins, so an id with very many links meets one row per class only.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    state = written(both.select(F.col("a").alias("id")).distinct().withColumn("class", F.col("id")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near"))
        hooked = written(state.join(near, F.col("id") == F.col("a"), "left").select("id", "class", F.least("class", F.coalesce("near", "class")).alias("new")))
        # a class follows the least one that any of its members met
        moved = hooked.groupBy(F.col("class").alias("old")).agg(F.min("new").alias("to"))
        once = hooked.join(moved, F.col("class") == F.col("old")).select("id", "class", F.least("new", "to").alias("new"))
        jump = moved.select(F.col("old").alias("new"), F.col("to").alias("further"))
        following = written(once.join(jump, "new", "left").select("id", F.col("class").alias("was"), F.least("new", F.coalesce("further", "new")).alias("class")))
        if following.filter("class <> was").isEmpty():
            return following.select("id", "class")
        state = following.select("id", "class")


def grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text; a shorter text is its own."""
    n = F.greatest(F.length(text) - GRAM + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM))))


def holding(rows: DataFrame, more: int = NEAR) -> DataFrame:
    """a, b: ids of rows of one group where a's text holds b's and is longer by more than `more` letters. rows: id, g, t, each text once in a group."""
    rows = rows.select("id", "g", "t").filter("g is not null and t <> ''")
    each = written(rows.filter(F.length("t") >= GRAM).select("g", "id", "t", F.explode(grams(F.col("t"))).alias("gram")))
    df = each.groupBy("g", "gram").agg(F.count("*").alias("df"))
    rarest = each.join(df, ["g", "gram"]).groupBy("g", "id").agg(F.min_by(F.struct("gram", "t"), F.struct("df", "gram")).alias("r")).select("g", F.col("id").alias("b"), F.col("r.gram").alias("gram"), F.col("r.t").alias("held"))
    longer = (F.length("t") - F.length("held") > more) & F.contains(F.col("t"), F.col("held"))
    found = each.join(rarest, ["g", "gram"]).filter(longer).select(F.col("id").alias("a"), "b")
    few = rows.filter(F.length("t") < GRAM).select("g", F.col("id").alias("b"), F.col("t").alias("held"))  # no gram of that length: looked up within the group
    return found.unionByName(rows.join(few, "g").filter(longer).select(F.col("id").alias("a"), "b")).distinct()


def titles_of(books: DataFrame) -> DataFrame:
    """id (the least), author, t and n: the titles of each first author, and how many records have each."""
    rows = books.select("id", F.lower("title").alias("t"), F.lower(F.get("authors", F.lit(0))).alias("author")).filter("t <> '' and author <> ''")
    return rows.groupBy("author", "t").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def links(books: DataFrame) -> DataFrame:
    """a, b: links whose components are the classes of duplicates of a catalogue (id, isbn_13, title, authors)."""
    numbered = books.select("id", "isbn_13").filter("isbn_13 is not null")
    by_isbn = numbered.groupBy("isbn_13").agg(F.min("id").alias("b")).join(numbered, "isbn_13").select(F.col("id").alias("a"), "b")
    titles = written(titles_of(books))
    named = books.select(F.col("id").alias("a"), F.lower("title").alias("t"), F.lower(F.get("authors", F.lit(0))).alias("author"))
    same = named.join(titles, ["author", "t"]).select("a", F.col("id").alias("b"))
    # an author's titles are a group, and so are those of two authors of whom one's name holds the other's
    authors = titles.groupBy("author").agg(F.min("id").alias("id"))
    pairs = holding(authors.select("id", F.lit(0).alias("g"), F.col("author").alias("t")), 0)
    pairs = pairs.select(F.concat_ws("-", F.lit("both"), "a", "b").alias("g"), F.explode(F.array("a", "b")).alias("id")).join(authors, "id").select("g", "author")
    groups = authors.select(F.concat_ws("-", F.lit("one"), "id").alias("g"), "author").unionByName(pairs)
    rows = written(titles.join(groups, "author").select("id", "g", "t"))
    sizes = rows.groupBy("g", F.length("t").alias("n")).agg(F.min("id").alias("b"))
    level = rows.withColumn("n", F.length("t")).join(sizes, ["g", "n"]).select(F.col("id").alias("a"), "b")
    order = Window.partitionBy("g").orderBy("n")
    before = sizes.select(F.col("b").alias("a"), F.lag("b").over(order).alias("b"), (F.col("n") - F.lag("n").over(order)).alias("gap"))
    chain = before.filter(F.col("gap") <= NEAR).select("a", "b")
    return by_isbn.unionByName(same).unionByName(level).unionByName(chain).unionByName(holding(rows)).filter("a <> b")


def classes(books: DataFrame) -> DataFrame:
    """id, class (the least id of its class) and size: every record of the catalogue."""
    books = written(books.select("id", "isbn_13", "title", "authors"))  # read several times, and often dear to derive
    found = components(links(books))
    out = written(books.select("id").join(found, "id", "left").select("id", F.coalesce("class", "id").alias("class")))
    return out.join(out.groupBy("class").agg(F.count("*").alias("size")), "class").select("id", "class", "size")
