"""Line deduplication by a log-template tree: templates that recur across documents are dropped."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import bit_table, fresh, group_apart, materialise, maybe_member
from meritlens.llm.minhash import near_duplicates

#: Leading tokens on the path of a leaf, after the number of tokens.
DEPTH = 3
#: A template recurs if it stands in so many different documents, copies of a whole text counting once.
RECURS = 5
#: Lines of so many tokens are long, and lines that are a leaf of their own from so many characters (texts without
#: spaces); few documents share them by chance, so fewer make them recur.
LONG_TOKENS, LONG_CHARS, RECURS_LONG = 16, 100, 3
#: Tokens after the leading ones that must be constant for a line to be of a template.
CONSTANT = 0.75
ANY = "<*>"
#: Texts of which this share of the characters would go are looked at as possible near copies of each other.
SUSPECT = 0.5


def _lines(docs: DataFrame) -> DataFrame:
    """All lines: id, hash of the whole text, place, and the line as it is."""
    pieces = docs.where(F.col("t").isNotNull()).select("id", F.xxhash64("t").alias("text_hash"), F.split("t", "\n").alias("ls"))
    return pieces.select("id", "text_hash", F.posexplode("ls").alias("place", "raw"))


def _parsed(placed: DataFrame, depth: int) -> DataFrame:
    """Lines that are not blank: hashes of line and path, whether they are long, and the tokens as one string, fields masked.

    All lines of a path are long or none is.
    """
    # Tests of plain strings read the bytes as they are; a regular expression would decode each line first.
    uneven = reduce(or_, [F.col("raw").contains(x) for x in ("  ", *"\t\n\x0b\x0c\r")])
    even = F.when(uneven, F.regexp_replace("raw", "[\\x20\\x09-\\x0D]+", " ")).otherwise(F.col("raw"))
    placed = placed.withColumn("line", F.trim(even))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ 0-9]*+[0-9][^ ]*", ANY)).otherwise(F.col("line"))
    placed = placed.where("line != ''").withColumn("line", masked)
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    long = (count >= LONG_TOKENS) | ((count <= depth) & (F.length("line") >= LONG_CHARS))
    leaf = F.xxhash64(count, F.substring_index("line", " ", depth))
    return placed.select(*placed.columns, leaf.alias("leaf"), F.xxhash64("line").alias("h"), long.alias("long"))


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, recurs: int = RECURS, constant: float = CONSTANT,
    recurs_long: int = RECURS_LONG,
) -> DataFrame:
    """Lines to drop: (id, text_hash, place), place counting the lines of the text from 0.

    Lines are parsed into a tree of fixed depth: by their number of tokens, then by their leading
    tokens, tokens with digits being variable fields. In a leaf, a token that occurs at its position in ``recurs`` documents,
    counted for every distinct line apart, is constant, others are variable fields; a line whose later tokens are constant
    to the share ``constant`` is of the template that this leaves. A template that stands in at least ``recurs`` different
    documents recurs, wherever it stands in them; for long lines ``recurs_long`` are enough. What one document repeats does
    not recur. Of a recurring template the first line, by id and place, stays and all others go.

    Documents are different if their texts are no copies of each other: equal texts count once, and so do near copies
    (components of texts that share 0.8 of their five-word shingles). Near copies are looked for among the texts of which
    at least the share SUSPECT would go if only equal texts counted once; other texts lose less than that anyway. Which
    tokens are constant is decided by different texts.

    Blank lines never go; null and empty texts have no lines to drop. A document is known by its id and
    the hash of its text, so rows that repeat an id, or have none, lose only lines of their own; rows equal in both are
    treated alike. A line of variable fields only has no template. Extra columns are ignored.
    """
    lines = _lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    light = materialise(_parsed(lines, depth).select("id", "text_hash", "place", "leaf", "h", "long", F.xxhash64("raw").alias("r"), F.length("raw").alias("chars")))
    need = F.when(F.col("long"), recurs_long).otherwise(recurs)
    # Leaves without enough documents have no recurring template; most lines end here.
    leaves = light.groupBy("leaf", "long", "text_hash").agg(F.lit(1).alias("one")).groupBy("leaf", "long").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    busy = bit_table(leaves, F.xxhash64("leaf"))
    open_lines = materialise(maybe_member(light, F.xxhash64("leaf"), busy, "busy").where("busy").drop("busy"))
    # Tokens of the distinct lines in such leaves, read again from the texts, and how often each stands where.
    known = bit_table(open_lines, F.col("r"))
    again = maybe_member(lines.select("raw"), F.xxhash64("raw"), known, "busy").where("busy").select("raw").distinct()
    again = _parsed(again, depth).select("leaf", "h", "line").distinct()
    weights = open_lines.groupBy("leaf", "h", "long", "text_hash").agg(F.lit(1).alias("one")).groupBy("leaf", "h", "long").agg(F.count("*").alias("n"))
    tokens = again.join(weights, ["leaf", "h"]).select("leaf", "h", "long", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    tokens = materialise(tokens)
    fixed = group_apart(tokens, ["leaf", "at", "token"], F.sum("n").alias("all"), F.first("long").alias("long")).where(F.col("all") >= need).drop("all", "long")
    marked = tokens.join(fixed.withColumn("fixed", F.lit(True)), ["leaf", "at", "token"], "left")
    shape = F.struct("at", F.when(F.col("fixed"), F.col("token")).otherwise(ANY).alias("w"))
    # Templates as order-free hashes: positions with what stands there.
    later = (F.col("at") >= depth).cast("int")
    shapes = marked.select("leaf", "h", "at", F.xxhash64(shape).alias("x"), (later * F.coalesce("fixed", F.lit(False)).cast("int")).alias("c"), later.alias("l"),
                           (F.coalesce("fixed", F.lit(False)) & (F.col("token") != ANY)).cast("int").alias("word"))
    shapes = shapes.groupBy("leaf", "h").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("word").alias("words"), F.count("*").alias("n")
    )
    shapes = shapes.where((F.col("words") > 0) & (F.col("c") >= constant * F.col("l")))
    shapes = shapes.select("leaf", "h", F.xxhash64("leaf", "n", "x").alias("template"))
    named = materialise(open_lines.join(group_apart(shapes, ["leaf", "h"], F.first("template").alias("template")), ["leaf", "h"]).select("id", "text_hash", "place", "long", "template", "chars"))
    often = group_apart(named.select("template", "long", "text_hash").distinct(), ["template", "long"], F.count("*").alias("n")).where(F.col("n") >= need)
    named = _with_copies(docs.select(F.col(text_col).alias("t")), light, named, materialise(often.select("template")))
    at = F.struct("id", "text_hash", "place")
    spread = named.groupBy("template", "long", "copy_of").agg(F.min(at).alias("first"))
    recurring = group_apart(spread, ["template", "long"], F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= need).drop("long")
    gone = named.join(recurring, "template").where(~at.eqNullSafe(F.col("first")))
    return gone.select("id", "text_hash", "place")


def _with_copies(texts: DataFrame, light: DataFrame, named: DataFrame, often: DataFrame) -> DataFrame:
    """``named`` with ``copy_of``: the near-copy class of texts that would lose most of their lines, the text's own hash for others."""
    lost = named.join(often, "template").groupBy("text_hash").agg(F.sum("chars").alias("lost"))
    whole = light.groupBy("text_hash").agg(F.sum("chars").alias("whole"))
    suspects = materialise(lost.join(whole, "text_hash").where(F.col("lost") >= SUSPECT * F.col("whole")).select("text_hash"))
    if suspects.isEmpty():
        return named.withColumn("copy_of", F.col("text_hash"))
    hashed = texts.select(F.xxhash64("t").alias("text_hash"), "t")
    near = maybe_member(hashed, F.xxhash64("text_hash"), bit_table(suspects, F.xxhash64("text_hash")), "suspect").where("suspect")
    found = near_duplicates(near.select("text_hash", "t"), "text_hash", "t").where("id != component_id")
    classes = group_apart(found.withColumnRenamed("id", "text_hash"), ["text_hash"], F.min("component_id").alias("class"))
    return materialise(named.join(materialise(classes), "text_hash", "left").withColumn("copy_of", F.coalesce("class", "text_hash")).drop("class"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_dropped", **options) -> DataFrame:
    """``docs`` with the recurring lines cut out of its texts, and their number; other columns and rows stay.

    Texts of documents that lose no line stay as they are, where they are: a bit table tells them. The
    list of lines to cut grows with the input, so it is never broadcast.
    """
    lost, key, hashed, flag = fresh(docs, "_gone", "_id", "_hash", "_touched")
    gone = materialise(recurring_lines(docs, id_col, text_col, **options))
    per_doc = group_apart(gone, ["id", "text_hash"], F.collect_set("place").alias(lost)).withColumnsRenamed({"id": key, "text_hash": hashed})
    touched = maybe_member(docs, F.xxhash64(id_col, F.xxhash64(text_col)), bit_table(gone, F.xxhash64("id", "text_hash")), flag)
    same = touched.where(~F.col(flag)).drop(flag).withColumn(count_col, F.lit(0))
    own = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(hashed))
    cut = touched.where(F.col(flag)).drop(flag).join(per_doc.hint("merge"), own, "left").drop(key, hashed)
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(F.coalesce(lost, F.array().cast("array<int>")), i)), "\n")
    cut = cut.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(rest))
    cut = cut.withColumn(count_col, F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost))).drop(lost)
    return same.unionByName(cut)


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    cut = drop_lines(docs.select("doc_id", "text"))
    blank = F.coalesce(F.length(F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " "))) > 0, F.lit(False))
    return cut.select(
        "doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("text_bytes"), blank.alias("has_text"),
    )
