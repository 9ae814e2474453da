"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A window is a line and the lines that start within the next `words` words. Its minimal line hash is its fingerprint:
whatever stands around it, a repeated run of `words` words or more holds a whole window, so both copies select the
same fingerprints. Only windows whose fingerprint occurs again go on; equal windows meet by fingerprint and content,
each with its first position alone, so a passage of a million copies makes a million matches, not their square.
Matches of a document are merged to runs and extended both ways to where any earlier copy reaches: every line of a run
from which a window fits has a match of its own, and past the last of these windows *ending* at a line are matched. So a
line goes exactly if it lies in a run of `words` words or more that occurs earlier, in any copy.

Lines are compared by two hashes (64 and 32 bits) of the line without white space at its ends; lines without a word
are no part of runs and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import documents, free_name, full_text, numbered, stored

#: Words that a window covers: every repeated run of as many words is found.
WORDS = 30
KEY = ["_doc", "_hash"]  # a document: its id, and a hash of its text


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows equal in doc_id and text are one document; a null id sorts before all others."""
    return docs.withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64(full_text(text)))


def lines(docs: DataFrame) -> DataFrame:
    """_doc, _hash, line (index in the text), n (index among lines with words), h, check, words."""
    bare = F.btrim(F.col("_line"), F.lit(" \t\r\x0b\x0c"))
    rows = keyed(docs.select("doc_id", "text")).select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "_line"))
    rows = rows.withColumn("_line", bare).filter("_line <> ''").select(
        *KEY, "line", F.xxhash64("_line").alias("h"), F.hash("_line").alias("check"),
        F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return rows.repartition(*KEY).distinct()  # the same document given twice has its lines once


def windows(rows: DataFrame, words: int) -> DataFrame:
    """Each line's window, from it and up to it: size in lines and words, content hash; and the fingerprint of the former."""
    document = Window.partitionBy(*KEY).orderBy("line")
    rows = rows.withColumn("n", F.row_number().over(document).cast("long")).withColumn("end", F.sum("words").over(document))
    rows = rows.withColumn("start", F.col("end") - F.col("words"))
    ahead = Window.partitionBy(*KEY).orderBy("start").rangeBetween(Window.currentRow, words - 1)
    behind = Window.partitionBy(*KEY).orderBy("end").rangeBetween(1 - words, Window.currentRow)
    content = lambda w: F.collect_list(F.struct("h", "check")).over(w)
    rows = rows.select(
        *KEY, "line", "n",
        F.min("h").over(ahead).alias("fingerprint"),
        F.count("h").over(ahead).alias("size"),
        F.sum("words").over(ahead).alias("covers"),
        content(ahead).alias("content"),
        F.count("h").over(behind).alias("back_size"),
        F.sum("words").over(behind).alias("back_covers"),
        content(behind).alias("back"),
    )
    return rows.withColumns({c: F.struct(F.xxhash64(c).alias("a"), F.hash(c).alias("b")) for c in ("content", "back")})


def place() -> Column:
    return F.struct(*KEY, "n")


def matches(found: DataFrame, words: int) -> DataFrame:
    """Windows that occur earlier: where they start (n) and their size."""
    whole = found.filter(F.col("covers") >= words)
    repeated = whole.groupBy("fingerprint").agg(F.count("*").alias("_times")).filter("_times > 1").select("fingerprint")
    candidates = whole.select(*KEY, "n", "fingerprint", "content", "size").join(repeated, "fingerprint", "left_semi")
    first = (
        candidates.groupBy("fingerprint", "content")
        .agg(F.min(place()).alias("first"), F.count("*").alias("_times"))
        .filter("_times > 1").drop("_times")
    )
    return candidates.join(first, ["fingerprint", "content"]).filter(place() > F.col("first")).select(*KEY, "n", "size")


def runs(matched: DataFrame) -> DataFrame:
    """Overlapping or adjacent matches of a document as runs, whatever copies they have: lines low to high."""
    matched = matched.withColumn("end", F.col("n") + F.col("size"))
    order = Window.partitionBy(*KEY).orderBy("n")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    matched = matched.withColumn("_new", F.when(F.col("n") <= reached, 0).otherwise(1))
    matched = matched.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return matched.groupBy(*KEY, "_run").agg(F.min("n").alias("low"), (F.max("end") - 1).alias("high")).drop("_run")


def extended(found: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Runs with `high` moved to where any earlier copy reaches.

    To the left a run is whole: each of its lines from which a window still fits has matched. On the right fewer than
    `words` words are missing, so the lines that follow are asked whether the window that *ends* there, and begins in the
    run, occurs earlier anywhere.

    Merge joins, as elsewhere where rows are made from a few (`explode`) or stored rows repeat much: Spark takes their
    size from the files they come from, and would send through the driver, to be broadcast, many times of that.
    """
    found = stored(found, "runs")
    after = found.select(*KEY, "low", "high", F.explode(F.sequence(F.col("high") + 1, F.col("high") + words - 1)).alias("n")) if words > 1 else found.withColumn("n", F.lit(0))
    tails = after.hint("merge").join(rows.select(*KEY, "n", "back", "back_size", "back_covers"), [*KEY, "n"])
    tails = stored(tails.filter((F.col("back_covers") >= words) & (F.col("n") - F.col("back_size") < F.col("high"))).select(*KEY, "low", "n", "back"), "run-tails")
    first = rows.filter(F.col("back_covers") >= words).select(*KEY, "n", "back").join(tails.select("back").distinct(), "back", "left_semi")
    first = first.groupBy("back").agg(F.min(place()).alias("first"))
    reached = tails.hint("merge").join(first, "back").filter(place() > F.col("first")).groupBy(*KEY, "low").agg(F.max("n").alias("_to"))
    return found.join(reached, [*KEY, "low"], "left").select(*KEY, "low", F.greatest("high", "_to").alias("high"))


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_doc, _hash, and `gone`: the sorted indexes (from 0) of the lines that repeat a run which occurs earlier."""
    rows = stored(windows(lines(docs), words), "line-windows")
    later = extended(runs(matches(rows, words)), rows, words)
    gone = later.select(*KEY, F.explode(F.sequence("low", "high")).alias("n"))
    return gone.hint("merge").join(rows.select(*KEY, "n", "line"), [*KEY, "n"]).groupBy(*KEY).agg(F.array_sort(F.collect_set("line")).alias("gone"))


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` with repeated runs of `words` words or more cut from `text`, and two columns more: n_lines, n_removed.

    Runs are looked for in all documents and within one; the first copy, by doc_id and then by line, stays. Null
    texts stay null, empty ones and documents without a repeated run stay as they are, a document all of whose lines
    repeat gets the empty text. Rows equal in doc_id and text are one document and get the same text; a null doc_id
    counts as the first. If n_lines or n_removed exist, the new columns get underscores in front.
    """
    gone = stored(repeated_lines(docs, words), "repeated-lines")
    rows, names = numbered(docs)
    text = F.col(names["text"])
    split = F.split(text, "\n")
    rows = keyed(rows, names["doc_id"], names["text"]).join(gone.hint("merge"), KEY, "left")  # one plan at every size
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    # the outer transform splits once; inside the inner one the split would run again for every line
    kept = F.array_join(F.transform(F.array(split), lambda whole: F.transform(stay, lambda i: F.get(whole, i)))[0], "\n")
    return rows.select(
        *(F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()),
        F.coalesce(F.size(split), F.lit(0)).alias(free_name(docs, "n_lines")),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias(free_name(docs, "n_removed")),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op8_line_dedup": (op8_line_dedup, None)}
