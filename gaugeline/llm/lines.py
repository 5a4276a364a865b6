"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are the \\n-split parts of a text that hold a word. A line goes if it equals an earlier line of the
corpus, or if it has ``min_chars`` characters or more and an earlier line lies within one edit of it
(insertion, deletion or substitution of a character). *Earlier* is by (doc_id, place in the text), judged on
the input, whatever happens to the earlier line.

1. Equal lines: two 64-bit hashes, a partial aggregate, the earliest occurrence of each.
2. Blocking that loses nothing: of two lines within one edit, the first or the second half is the same, so
   lines of which no half is met twice (at their length or one less) have no near line.
3. Deletion neighbourhood of the rest: the line and every string with one character deleted, as hashed keys.
   A key is the XOR of hashes of 32-character blocks, so each deletion costs one block, not one line.
4. Equal keys join: same key and place is a substitution, a line equal to another's variant is an insertion.
   A key's lines point to its earliest line only, so evidence grows with lines, not with pairs.
5. Each piece of evidence is verified by edit distance on the texts.

Null text has no lines; blank lines stay; rows with a null doc_id are left as they are; rows that repeat doc_id and
text are one document given twice; rows of one doc_id with different texts are documents of their own, the earlier
that of the smaller CRC-32 of its text; empty tables give empty results; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 32
_WORD = "[^\\x20\\x09-\\x0D]"


#: Where a line stands in its document: (CRC-32 of the document's text, line), so that rows of one doc_id with different
#: texts are documents of their own, in order of their CRC.
_SPOT = 2**63


def _at() -> Column:
    """(doc_id, spot) as one number that sorts alike."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(str(_SPOT)).cast("decimal(19,0)") + F.col("spot")).cast("decimal(38,0)")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, text) of the documents that have an id."""
    text = F.col("text").cast("string")
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("crc"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    lines = _rows(docs).select("doc_id", "crc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(_WORD))
    return lines.withColumn("spot", F.col("crc") * (1 << 31) + F.col("pos")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _half_keys() -> list[Column]:
    """Keys of the halves of a line, as the shorter (its length) and as the longer (one less) of a pair."""
    out = []
    for c in (F.col("size"), F.col("size") - 1):
        half = F.floor(c / 2).cast("int")
        out.append(F.xxhash64(c, F.lit(0), F.substring(F.col("line"), F.lit(1), half)))
        out.append(F.xxhash64(c, F.lit(1), F.substring(F.col("line"), half - c, c - half)))
    return out


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(at, own, size, variants: array of (place, key)) of (at, line, size)."""
    hashed = lambda b, x: F.when(F.length(x) > 0, F.xxhash64(b, x)).otherwise(F.lit(0).cast("long"))
    cut = lines.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int")), lambda b: F.substring(F.col("line"), b * BLOCK + 1, F.lit(BLOCK + 1))))
    both = cut.select("at", "size", "blocks", F.transform("blocks", lambda x, b: hashed(b, F.substring(x, 1, BLOCK))).alias("plain"), F.transform("blocks", lambda x, b: hashed(b, F.substring(x, 2, BLOCK))).alias("moved"))
    zero = F.array(F.lit(0).cast("long"))
    running = lambda hashes: F.aggregate(hashes, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))
    sums = both.select("at", "size", "blocks", running(F.col("plain")).alias("before"), F.reverse(running(F.reverse("moved"))).alias("after"))

    def of_block(x: Column, k: Column) -> Column:
        rest = F.element_at("before", k + 1).bitwiseXOR(F.element_at("after", k + 2))
        return F.transform(F.sequence(F.lit(0), F.least(F.length(x), F.lit(BLOCK)) - 1), lambda j: F.struct((k * BLOCK + j).alias("place"), rest.bitwiseXOR(hashed(k, F.concat(F.substring(x, F.lit(1), j), F.substring(x, j + 2, F.lit(BLOCK))))).alias("key")))

    return sums.select("at", "size", F.element_at("before", -1).alias("own"), F.flatten(F.transform("blocks", of_block)).alias("variants"))


def _near(docs: DataFrame, distinct: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    """``at`` of the distinct lines that have an earlier line within one edit."""
    long = distinct.filter(F.col("size") >= min_chars)
    halves = long.select("at", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    asked = halves.join(met, "half").select("at").distinct()
    spot = F.pmod("at", F.lit(str(_SPOT)).cast("decimal(38,0)"))
    places = asked.select(((F.col("at") - spot) / F.lit(str(_SPOT)).cast("decimal(38,0)")).cast("long").alias("doc"), spot.cast("long").alias("spot"))
    places = places.groupBy("doc", F.shiftright("spot", 31).alias("of")).agg(F.collect_set(F.col("spot").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("want"))
    places = materialize(places, "line-places")
    found = _rows(docs).join(_side(places, "want", broadcast_rows), (F.col("doc_id") == F.col("doc")) & (F.col("crc") == F.col("of"))).select("doc_id", "crc", F.split("text", "\n").alias("lines"), F.explode("want").alias("pos"))
    found = found.select("doc_id", (F.col("crc") * (1 << 31) + F.col("pos")).alias("spot"), F.get("lines", F.col("pos")).alias("line")).filter("line is not null")
    lines = materialize(found.select(_at().alias("at"), "line", F.length("line").alias("size")).dropDuplicates(["at"]), "line-candidates")

    variants = _neighbourhood(lines).select("at", "size", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.col("own").alias("key"))), "variants")).alias("v"))
    keys = variants.select("at", F.when(F.col("v.place") < 0, F.col("size")).otherwise(F.col("size") - 1).alias("length"), "v.place", "v.key")
    keys = materialize(keys, "line-variants")  # read twice
    shared = keys.groupBy("length", "key").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high").select("length", "key")
    keys = materialize(keys.join(shared, ["length", "key"]), "line-keys")
    alike = keys.filter("place >= 0").groupBy("length", "key", "place").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")
    changed = keys.join(alike, ["length", "key", "place"]).filter(F.col("at") > F.col("first")).select("at", "first")
    own = keys.filter("place < 0").select("length", "key", F.col("at").alias("short"))
    grown = keys.filter("place >= 0").join(own, ["length", "key"]).select(F.greatest("at", "short").alias("at"), F.least("at", "short").alias("first"))
    # of a line's shorter and longer neighbours, each longer one points at the shorter or is pointed at by it: the least is enough
    evidence = changed.union(grown).filter("first < at").groupBy("at").agg(F.collect_set("first").alias("firsts")).select("at", F.explode("firsts").alias("first"))
    pairs = evidence.join(lines.select("at", F.col("line").alias("a")), "at").join(lines.select(F.col("at").alias("first"), F.col("line").alias("b")), "first")
    return pairs.filter(F.levenshtein("a", "b", 1) >= 0).select("at").distinct()


def _side(df: DataFrame, lists: str, rows: int) -> DataFrame:
    """Broadcast hint if counted to be at most ``rows`` rows and 16 list entries a row on the average."""
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(lists)), F.lit(0)).alias("m")).head()
    return F.broadcast(df) if seen["n"] <= rows and seen["m"] <= 16 * rows else df


def repeated_lines(docs: DataFrame, min_chars: int = 20, broadcast_rows: int = 300_000) -> DataFrame:
    """(__doc, __crc, equal: places of lines equal to an earlier one, near: places of other lines that go) of the
    documents that lose lines."""
    lines = _lines(docs).withColumn("size", F.length("line"))
    keyed = lines.select("h1", "h2", _at().alias("at"), "size", F.when(F.col("size") >= min_chars, F.array(*_half_keys())).alias("halves"))
    keyed = keyed.select("h1", "h2", "at", "size", *(F.col("halves")[i].alias(f"k{i}") for i in range(4)))
    distinct = keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("size").alias("size"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4)))
    distinct = materialize(distinct.withColumn("halves", F.array("k0", "k1", "k2", "k3")).drop("k0", "k1", "k2", "k3"), "line-distinct")
    near = materialize(_near(docs, distinct, min_chars, broadcast_rows), "line-near").select("at", F.lit(True).alias("near"))
    fate = distinct.select("h1", "h2", "n", F.col("at").alias("first")).join(near.withColumnRenamed("at", "first"), "first", "left").filter("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = _lines(docs).select("doc_id", "crc", "spot", "pos", "h1", "h2").join(fate, ["h1", "h2"])
    equal = _at() > F.col("first")
    gone = gone.select("doc_id", "crc", "pos", equal.alias("equal"), "near").filter("equal or near")
    return materialize(gone.groupBy(F.col("doc_id").alias("__doc"), F.col("crc").alias("__crc")).agg(F.collect_set(F.when(F.col("equal"), F.col("pos"))).alias("equal"), F.collect_set(F.when(~F.col("equal"), F.col("pos"))).alias("near")), "line-gone")


def _joined(docs: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    gone = repeated_lines(docs, min_chars, broadcast_rows)
    gone = _side(gone.withColumn("__gone", F.concat("equal", "near")), "__gone", broadcast_rows)
    same = (docs["doc_id"].cast("long") == F.col("__doc")) & (F.crc32(docs["text"].cast("string")) == F.col("__crc"))
    return docs.join(gone.select("__doc", "__crc", F.size("equal").alias("__equal"), F.size("near").alias("__near"), "__gone"), same, "left")


def _kept_text() -> Column:
    """The text without the lines in ``__gone``; a map of them makes each look-up cheap however long the text."""
    lines = F.split(F.col("text"), "\n")
    flags = F.map_from_arrays(F.col("__gone"), F.col("__gone"))
    kept = F.filter(lines, lambda x, i: F.element_at(flags, i).isNull())
    return F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def report(docs: DataFrame, min_chars: int = 20, broadcast_rows: int = 300_000) -> DataFrame:
    """Per document: doc_id, n_equal and n_near (lines removed as equal, as near), kept_sha256 of the text left
    (null text: of the empty text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.lit(0)
    return _joined(rows, min_chars, broadcast_rows).select("doc_id", F.coalesce("__equal", none).cast("long").alias("n_equal"), F.coalesce("__near", none).cast("long").alias("n_near"), F.sha2(F.coalesce(_kept_text(), F.lit("")), 256).alias("kept_sha256"))


def dedup(docs: DataFrame, min_chars: int = 20, broadcast_rows: int = 300_000) -> DataFrame:
    """``docs`` with repeated lines taken from ``text``; a document that loses lines and has no word left goes.
    All other columns stay as they are (``n_chars``, where there is one, follows the new text)."""
    out = _joined(docs, min_chars, broadcast_rows).withColumn("__kept", _kept_text())
    out = out.filter(F.col("__gone").isNull() | F.col("__kept").rlike(_WORD))
    new = {"text": F.col("__kept")} | ({"n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__kept")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
